"""Registered queries over the bibliographic operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.api import recommend_articles
from folioscope.config import DIMENSIONS
from folioscope.functions import text as X
from folioscope.functions.vectors import pack_vector, unpack_vector
from folioscope.operators import ingest, lexical, semantic, stored_index, validation, versioning
from folioscope.operators.keep import keep
from folioscope.operators.queries import normalize_weights, prepare_query
from folioscope.operators import ranking
from folioscope.operators.ranking import EXPLAIN_ORDER, Filters, explanation
from folioscope.plans import corpus as C
from folioscope.plans import oracle as O
from folioscope.release import build_database_release
from folioscope.sources.files import import_article_data
from folioscope.sources.releases import read_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
ASKED = ["theme", "purpose", "context"]
WEIGHTS = normalize_weights(None, ASKED)
CUSTOM = normalize_weights({"theme": 3.0, "context": 1.0}, ASKED)
TOP = 20


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = O.sql(sql)
        return f

    return register


# Text functions, over whole documents.


@query(f"SELECT doc_id, {O.norm('text')} AS normalized, {O.match('text')} AS matching FROM documents")
def text_normalize(spark, folder):
    docs = C.table(spark, folder, "documents")
    return docs.select("doc_id", X.normalize_text(F.col("text")).alias("normalized"), X.normalize_for_matching(F.col("text")).alias("matching"))


@query(f"SELECT doc_id, {O.doi('doi_raw')} AS doi FROM raw")
def doi_normalize(spark, folder):
    return C.raw(spark, folder).select("doc_id", X.normalize_doi(F.col("DOI")).alias("doi"))


@query(f"SELECT doc_id, {O.authors('authors_raw')} AS authors, replace({O.match('authors_raw')}, ' ', '_') AS authors_id FROM raw")
def authors_clean(spark, folder):
    rows = C.raw(spark, folder)
    return rows.select("doc_id", X.clean_authors(F.col("Authors")).alias("authors"), X.normalize_authors_for_id(F.col("Authors")).alias("authors_id"))


@query(f"SELECT doc_id, {O.keywords('author_keywords_raw', 'index_keywords_raw')} AS keywords FROM raw")
def keywords_clean(spark, folder):
    return C.raw(spark, folder).select("doc_id", X.clean_keywords(F.col("Keywords A"), F.col("Keywords I")).alias("keywords"))


@query("SELECT doc_id, year FROM raw")
def year_parse(spark, folder):
    return C.raw(spark, folder).select("doc_id", X.parse_year(F.col("Year")).alias("year"))


@query(f"SELECT doc_id, len({O.sentences('abstract_raw')})::INTEGER AS n, array_to_string({O.sentences('abstract_raw')}, ' | ') AS sentences FROM raw")
def sentence_split(spark, folder):
    found = X.split_sentences(F.col("Abstract"))
    return C.raw(spark, folder).select("doc_id", F.size(found).alias("n"), F.array_join(found, " | ").alias("sentences"))


@query(f"SELECT doc_id, array_to_string({O.tokens(O.match('text'))}, ' ') AS tokens FROM documents")
def tokenize(spark, folder):
    return C.table(spark, folder, "documents").select("doc_id", F.array_join(X.tokenize(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({O.exact_terms('abstract_raw', O.match('abstract_raw'))}, '; ') AS terms FROM raw")
def exact_terms(spark, folder):
    return C.raw(spark, folder).select("doc_id", F.array_join(X.exact_terms(F.col("Abstract")), "; ").alias("terms"))


@query(f"SELECT doc_id, array_to_string({O.doi_terms('abstract_raw')}, '; ') AS dois FROM raw")
def doi_terms(spark, folder):
    return C.raw(spark, folder).select("doc_id", F.array_join(X.doi_terms(F.col("Abstract")), "; ").alias("dois"))


# Ingest.

RECORD = "title, authors, abstract, keywords, doi, year, source_title, doi_normalized, title_normalized, authors_normalized"


@query(f"SELECT doc_id, {RECORD} FROM rec")
def canonical_records(spark, folder):
    return C.records(spark, folder).select(F.col("pos").cast("long").alias("doc_id"), *RECORD.split(", "))


@query(f"SELECT doc_id, {O.ARTICLE_ID} AS article_id FROM rec")
def article_ids(spark, folder):
    return C.records(spark, folder).select(F.col("pos").cast("long").alias("doc_id"), ingest.article_id().alias("article_id"))


@query(f"SELECT doc_id, {O.hashed(*O.CONTENT, *[O.quoted('')] * 5)} AS content_hash FROM rec")
def content_hash(spark, folder):
    return C.records(spark, folder).select(F.col("pos").cast("long").alias("doc_id"), ingest.content_hash().alias("content_hash"))


MERGED = "pos, title, authors, keywords, doi_normalized, source_title, year, original_rows"


def _stages(spark, folder, n):
    records, out = C.records(spark, folder), []
    for rule, key in [*ingest.RULES.items(), ("article_id", ingest.article_id)][:n]:
        records = ingest.collapse(records, key())
        out.append((rule, records))
    return out


@query(f"SELECT {MERGED} FROM s1")
def dedup_doi(spark, folder):
    return _stages(spark, folder, 1)[-1][1].select(*MERGED.split(", "))


@query(f"SELECT {MERGED} FROM s2")
def dedup_title_year(spark, folder):
    return _stages(spark, folder, 2)[-1][1].select(*MERGED.split(", "))


@query(f"SELECT {MERGED} FROM s3")
def dedup_title_authors(spark, folder):
    return _stages(spark, folder, 3)[-1][1].select(*MERGED.split(", "))


FULL = "title, title_normalized, authors, abstract, keywords, doi, doi_normalized, year, source_title"


@query(f"SELECT {O.ARTICLE_ID} AS article_id, {FULL}, {O.hashed(*O.CONTENT, *[O.quoted('')] * 5)} AS content_hash FROM s4")
def dedup_full(spark, folder):
    done = ingest.process_records(C.raw(spark, folder), C.COLUMN_MAP, position=F.col("doc_id"))
    return done.articles.select("article_id", *FULL.split(", "), "content_hash")


@query(" UNION ALL ".join(f"SELECT rule, pos AS key, original_rows, original_rows - 1 AS removed_rows FROM {s} WHERE original_rows > 1" for s in ("s1", "s2", "s3", "s4")))
def duplicate_report(spark, folder):
    return ingest.duplicate_report(_stages(spark, folder, 4))


@query(
    """SELECT least(a.article_id, b.article_id) AS article_a, greatest(a.article_id, b.article_id) AS article_b, a.year AS year,
    CASE WHEN a.article_id < b.article_id THEN a.title ELSE b.title END AS title_a, CASE WHEN a.article_id < b.article_id THEN b.title ELSE a.title END AS title_b,
    round(levenshtein(a.title_normalized, b.title_normalized)::DOUBLE / greatest(length(a.title_normalized), length(b.title_normalized)), 6) AS normalized_distance
    FROM art a JOIN art b ON a.year IS NOT DISTINCT FROM b.year AND a.article_id < b.article_id AND a.title_normalized <> b.title_normalized
    AND abs(length(a.title_normalized) - length(b.title_normalized)) <= 0.08 * greatest(length(a.title_normalized), length(b.title_normalized))
    WHERE levenshtein(a.title_normalized, b.title_normalized) <= 0.08 * greatest(length(a.title_normalized), length(b.title_normalized)) + 1e-9"""
)
def near_duplicates(spark, folder):
    return ingest.near_duplicates(C.articles(spark, folder))


# Dimensions and lexical documents.

DIMS = ", ".join(f"{d}_{p}" for d in DIMENSIONS for p in ("text", "source", "confidence"))


@query(f"SELECT article_id, {DIMS}, content_hash FROM hashes")
def dimension_texts(spark, folder):
    return C.dimension_articles(spark, folder).select("article_id", *DIMS.split(", "), "content_hash")


@query(
    """SELECT article_id, dimension, normalized_text, CASE WHEN len(tokens) = 0 THEN '[]' ELSE '["' || array_to_string(tokens, '","') || '"]' END AS tokens_json,
    document_length, array_to_string(exact_terms, '; ') AS exact_terms, content_hash FROM docs"""
)
def lexical_documents(spark, folder):
    return lexical.export_lexical_documents(lexical.build_lexical_documents(C.dimension_articles(spark, folder)))


def _documents(spark, folder):
    return lexical.build_lexical_documents(C.dimension_articles(spark, folder))


@query("SELECT dimension, article_id, term, tf FROM tf")
def tf_counts(spark, folder):
    return lexical.term_counts(_documents(spark, folder))


@query("SELECT dimension, term, df FROM dfs")
def doc_frequency(spark, folder):
    return lexical.term_counts(_documents(spark, folder)).groupBy("dimension", "term").agg(F.count(F.lit(1)).alias("df"))


@query("SELECT dimension, term, df, round(idf, 6) AS idf, round(bm25_idf, 6) AS bm25_idf FROM terms")
def idf_tables(spark, folder):
    docs = _documents(spark, folder)
    terms = lexical.term_table(lexical.term_counts(docs), lexical.corpus_stats(docs))
    return terms.select("dimension", "term", "df", F.round("idf", 6).alias("idf"), F.round("bm25_idf", 6).alias("bm25_idf"))


@query("SELECT dimension, article_id, round(norm, 6) AS norm FROM norms")
def doc_norms(spark, folder):
    docs = lexical.build_index(_documents(spark, folder)).documents.where("norm > 0")
    return docs.select("dimension", "article_id", F.round("norm", 6).alias("norm"))


@query("SELECT dimension, n, round(avgdl, 6) AS avgdl FROM stats")
def avg_doc_length(spark, folder):
    return lexical.corpus_stats(_documents(spark, folder)).withColumn("avgdl", F.round("avgdl", 6))


# Scores and ranking.  The index is kept while a query runs, as a user would keep it.


def _index(spark, folder):
    return lexical.build_index(_documents(spark, folder))


def _asked(spark, folder, weights=WEIGHTS):
    return C.benchmark_queries(spark, folder, weights)


@query("SELECT query_id, dimension, article_id, round(tfidf, 6) AS tfidf FROM tscore")
def tfidf_scores(spark, folder):
    found = lexical.term_scores(_asked(spark, folder), _index(spark, folder))
    return found.select("query_id", "dimension", "article_id", F.round("tfidf", 6).alias("tfidf"))


@query("SELECT query_id, dimension, article_id, round(bm25_raw, 5) AS bm25_raw FROM tscore")
def bm25_scores(spark, folder):
    found = lexical.term_scores(_asked(spark, folder), _index(spark, folder))
    return found.select("query_id", "dimension", "article_id", F.round("bm25_raw", 5).alias("bm25_raw"))


@query("SELECT query_id, dimension, article_id, round(phrase_coverage, 6) AS phrase_coverage FROM pscore")
def exact_scores(spark, folder):
    found = lexical.phrase_scores(_asked(spark, folder), _index(spark, folder))
    return found.withColumn("phrase_coverage", F.round("phrase_coverage", 6))


@query("SELECT query_id, dimension, article_id, round(tfidf, 5) AS tfidf, round(bm25, 5) AS bm25, round(exact, 5) AS exact, round(score, 5) AS score FROM dscore")
def dimension_scores(spark, folder):
    found = lexical.dimension_scores(_asked(spark, folder), _index(spark, folder))
    return found.select("query_id", "dimension", "article_id", *(F.round(c, 5).alias(c) for c in ("tfidf", "bm25", "exact", "score")))


def _ranking(weights: dict[str, float], where: str = "TRUE", n: int = TOP, source: str = "dscore", ids: str = "qry") -> str:
    combined = (
        f"SELECT query_id, article_id, sum(score * CASE dimension {' '.join(f'WHEN {O.quoted(d)} THEN {w!r}::DOUBLE' for d, w in weights.items())} END) AS idx, "
        + ", ".join(f"max(CASE WHEN dimension = '{d}' THEN score END) AS s_{d}" for d in DIMENSIONS)
        + f" FROM {source} GROUP BY ALL"
    )
    shown = ", ".join(
        f"round(100 * coalesce(s_{d}, 0), 6) AS similarity_{d}" if weights[d] or d in ASKED else f"NULL::DOUBLE AS similarity_{d}" for d in EXPLAIN_ORDER
    )
    scored = (
        f"SELECT q.query_id, a.*, round(100 * least(1, greatest(0, coalesce(idx, 0))), 6) AS index, {shown} "
        f"FROM (SELECT DISTINCT query_id FROM {ids}) q CROSS JOIN (SELECT * FROM art WHERE {where}) a "
        f"LEFT JOIN ({combined}) c ON c.query_id = q.query_id AND c.article_id = a.article_id"
    )
    order = "index DESC, similarity_theme DESC NULLS LAST, year DESC NULLS LAST, title, article_id"
    return (
        f"SELECT query_id, rank, index, {', '.join(f'similarity_{d}' for d in EXPLAIN_ORDER)}, title, authors, year, "
        f"CASE WHEN length(doi_normalized) > 0 THEN doi_normalized ELSE doi END AS doi, keywords, source_title, abstract, article_id, "
        f"{O.explained({d: f'similarity_{d}' for d in EXPLAIN_ORDER})} AS explanation, 'lexical' AS engine "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order})::INTEGER AS rank FROM ({scored})) WHERE rank <= {n}"
    )


def _stored(spark, folder):
    """The articles and their stored index, which later queries of the session open."""
    articles = keep(C.dimension_articles(spark, folder))
    where = f"{spark.sparkContext.getCheckpointDir()}/index-{folder.strip('/').replace('/', '-').replace(':', '')}"
    return articles, stored_index.index_of(spark, where, articles, lexical.build_lexical_documents(articles))


def _searched(spark, folder, weights=WEIGHTS, filters=Filters(), n=TOP):
    articles, index = _stored(spark, folder)
    return stored_index.search(articles, index, _asked(spark, folder, weights), filters, n)


@query(_ranking(WEIGHTS))
def rank_lexical(spark, folder):
    return _searched(spark, folder)


@query(_ranking(WEIGHTS))
def rank_lexical_batch(spark, folder):
    """The same result from an index that is built and read in one go, with the scores of all pairs."""
    articles, documents = lexical.kept_articles(C.dimension_articles(spark, folder))
    index = lexical.build_index(documents)
    return ranking.rank_lexical(articles, index, _asked(spark, folder), n=TOP)


@query(_ranking(CUSTOM))
def weights_custom(spark, folder):
    return _searched(spark, folder, CUSTOM)


@query("SELECT * EXCLUDE (query_id) FROM (" + _ranking(WEIGHTS, n=1) + ")")
def rank_lexical_best(spark, folder):
    return _searched(spark, folder, n=1).drop("query_id")


@query(_ranking(WEIGHTS, n=5))
def rank_updated_index(spark, folder):
    """An index of a previous version, in which articles lacked, read otherwise or stood that are gone, brought up to date."""
    articles = keep(C.dimension_articles(spark, folder))
    documents = keep(lexical.build_lexical_documents(articles))
    h = F.pmod(F.xxhash64("article_id"), F.lit(12))
    earlier = F.when(h < 3, F.concat(F.lit("gone"), "article_id")).otherwise(F.col("article_id"))
    told = F.when(h.isin(5, 6), F.lit("otherwise")).otherwise(F.col("content_hash"))
    tokens = F.when(h.isin(5, 6), F.concat(F.slice("tokens", 1, 9), F.array(F.lit("former")))).otherwise(F.col("tokens"))
    previous = articles.where(h < 10).select(earlier.alias("article_id"), told.alias("content_hash"))
    before = documents.where(h < 10).select(earlier.alias("article_id"), "dimension", "normalized_text", tokens.alias("tokens"), "exact_terms", told.alias("content_hash"))
    path = f"{spark.sparkContext.getCheckpointDir()}/updated-{uuid.uuid4().hex}"
    index = stored_index.create_index(before.withColumn("document_length", F.size("tokens")), path, "previous")
    index = stored_index.update_index(index, documents, versioning.compare_versions(articles, previous), "current")
    return stored_index.search(articles, index, _asked(spark, folder), n=5)


@query(_ranking(WEIGHTS, f"year >= 2005 AND year <= 2015 AND contains({O.match('source_title')}, 'src1')"))
def rank_lexical_filtered(spark, folder):
    return _searched(spark, folder, filters=Filters(year_min=2005, year_max=2015, source_title="SRC1"))


@query(
    f"SELECT article_id, {O.explained({'theme': 's1', 'method': 's2', 'data': 's3', 'context': 's4', 'purpose': 's5'})} AS explanation FROM "
    "(SELECT article_id, CASE WHEN year % 2 = 0 THEN (year % 7)::DOUBLE END AS s1, CASE WHEN year % 3 = 0 THEN (year % 5)::DOUBLE END AS s2, "
    "CASE WHEN year % 4 = 0 THEN 1.0::DOUBLE END AS s3, CASE WHEN year % 5 = 0 THEN 2.0::DOUBLE END AS s4, CASE WHEN year % 6 = 0 THEN 0.0::DOUBLE END AS s5 FROM art)"
)
def explain(spark, folder):
    year = F.col("year")
    scores = {
        "theme": F.when(year % 2 == 0, (year % 7).cast("double")),
        "method": F.when(year % 3 == 0, (year % 5).cast("double")),
        "data": F.when(year % 4 == 0, F.lit(1.0)),
        "context": F.when(year % 5 == 0, F.lit(2.0)),
        "purpose": F.when(year % 6 == 0, F.lit(0.0)),
    }
    return C.articles(spark, folder).select("article_id", explanation(scores).alias("explanation"))


def _filter(name: str, filters: Filters, where: str) -> None:
    def run(spark, folder):
        return filters.apply(C.articles(spark, folder)).select("article_id", "year", "source_title", "authors", "doi_normalized")

    run.__name__ = name
    query(f"SELECT article_id, year, source_title, authors, doi_normalized FROM art WHERE {where}")(run)


_filter("filter_year", Filters(year_min=2003, year_max=2012), "year BETWEEN 2003 AND 2012")
_filter("filter_years", Filters(years=(2001, 2007, 2024)), "year IN (2001, 2007, 2024)")
_filter("filter_source", Filters(source_title="Src1"), f"contains({O.match('source_title')}, 'src1')")
_filter("filter_authors", Filters(authors="MULLER 3"), f"contains({O.match('authors')}, 'muller 3')")
_filter("filter_doi", Filters(doi="https://doi.org/10.1000/DOC.7"), "doi_normalized = '10.1000/doc.7'")
_filter("filter_doi_invalid", Filters(doi="nothing"), "doi_normalized = ''")


@query("SELECT article_id FROM art WHERE article_id IN (SELECT article_id FROM art WHERE title_normalized < 'm')")
def filter_ids(spark, folder):
    articles = C.articles(spark, folder)
    return Filters(article_ids=articles.where("title_normalized < 'm'").select("article_id")).apply(articles).select("article_id")


# Versions.


@query("SELECT * FROM cmp")
def compare_versions(spark, folder):
    return versioning.compare_versions(*C.versions(spark, folder))


@query("SELECT s.status, count(c.status) AS n_articles FROM (VALUES ('new'), ('modified'), ('unchanged'), ('removed')) s(status) LEFT JOIN cmp c USING (status) GROUP BY 1")
def compare_summary(spark, folder):
    return versioning.comparison_summary(versioning.compare_versions(*C.versions(spark, folder))).drop("position")


@query(
    f"""SELECT article_id, content_hash, CASE WHEN status = 'new' THEN '{O.NOW}' ELSE '2025-01-01T00:00:00Z' END AS created_at,
    CASE WHEN status = 'unchanged' THEN '2025-01-01T00:00:00Z' ELSE '{O.NOW}' END AS updated_at FROM cur JOIN cmp USING (article_id)"""
)
def timestamps_merge(spark, folder):
    current, previous = C.versions(spark, folder)
    return versioning.merge_timestamps(current, previous, versioning.compare_versions(current, previous), C.NOW)


# Embeddings.


@query("SELECT count(*) AS actual, min(len(embedding))::INTEGER AS dimensions, CASE WHEN count(*) = 5 * count(DISTINCT article_id) THEN 'complete' ELSE 'partial' END AS status, TRUE AS normalized FROM emb")
def embedding_status(spark, folder):
    every = C.embeddings(spark, folder)
    status = semantic.embedding_status(every, every.select("article_id").distinct().count())
    return spark.createDataFrame([(status["actual"], status["dimensions"], status["status"], status["normalized"])], "actual long, dimensions int, status string, normalized boolean")


@query(
    """SELECT article_id, dimension, 'supplied' AS origin FROM emb WHERE vec_id % 3 = 0 AND article_id IN (SELECT article_id FROM eart)
    UNION ALL SELECT article_id, dimension, 'previous' FROM emb WHERE vec_id % 3 <> 0 AND article_id IN (SELECT e.article_id FROM eart e WHERE e.content_hash <> 'other')"""
)
def embedding_reuse(spark, folder):
    every, articles = C.embeddings(spark, folder), C.embedded_articles(spark, folder)
    supplied = every.where("vec_id % 3 = 0").withColumn("model_name", F.lit("supplied")).drop("vec_id")
    previous = every.withColumn("model_name", F.lit("previous")).drop("vec_id")
    unchanged = articles.where("content_hash <> 'other'")
    return semantic.merge_embeddings(supplied, previous, unchanged, articles).select("article_id", "dimension", F.col("model_name").alias("origin"))


@query("SELECT query_id, article_id, dimension, round(cosine, 6) AS cosine, round((greatest(-1, least(1, cosine)) + 1) / 2, 6) AS score FROM cos")
def cosine_scores(spark, folder):
    found = semantic.semantic_scores(C.embeddings(spark, folder), C.query_vectors(spark, folder))
    return found.select("query_id", "article_id", "dimension", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


@query("SELECT vec_id, 684::INTEGER AS n_chars, len(embedding)::INTEGER AS n, embedding[1]::DOUBLE AS first, embedding[33]::DOUBLE AS middle, embedding[64]::DOUBLE AS last FROM embeddings")
def vector_export(spark, folder):
    """Vectors as text and back."""
    packed = C.table(spark, folder, "embeddings").select("vec_id", pack_vector(F.col("embedding")).alias("t"))
    back = packed.withColumn("v", unpack_vector(F.col("t")))
    return back.select("vec_id", F.length("t").alias("n_chars"), F.size("v").alias("n"), *(F.get("v", F.lit(i)).alias(c) for c, i in (("first", 0), ("middle", 32), ("last", 63))))


ALL_WEIGHTS = normalize_weights(None, list(DIMENSIONS))


@query(
    f"""SELECT query_id, rank, article_id, index, {', '.join(f'similarity_{d}' for d in EXPLAIN_ORDER)}, title, year, doi FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY index DESC, similarity_theme DESC NULLS LAST, year DESC NULLS LAST, title, article_id)::INTEGER AS rank FROM (
    SELECT query_id, article_id, title, year, doi, round(100 * sum(score * w), 6) AS index,
    {', '.join(f"round(100 * max(CASE WHEN dimension = '{d}' THEN score END), 6) AS similarity_{d}" for d in EXPLAIN_ORDER)}
    FROM (SELECT *, (greatest(-1, least(1, cosine)) + 1) / 2 AS score,
    CASE dimension {' '.join(f"WHEN '{d}' THEN {w!r}::DOUBLE" for d, w in ALL_WEIGHTS.items())} END AS w FROM cos) JOIN eart USING (article_id)
    WHERE year >= 2004 GROUP BY ALL)) WHERE rank <= 20"""
)
def rank_semantic(spark, folder):
    vectors = C.query_vectors(spark, folder)
    weight = F.create_map(*(F.lit(x) for d, w in ALL_WEIGHTS.items() for x in (d, w)))
    asked = vectors.select("query_id", "dimension", F.lit("-").alias("text"), weight[F.col("dimension")].alias("weight"))
    found = semantic.rank_semantic(C.embedded_articles(spark, folder), C.embeddings(spark, folder), asked, vectors, Filters(year_min=2004))
    return found.select("query_id", "rank", "article_id", "index", *(f"similarity_{d}" for d in EXPLAIN_ORDER), "title", "year", "doi")


# Files and releases.  What is written goes to the session's folder.


def _folder(spark, folder: str, name: str) -> str:
    keep(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{folder.strip('/').replace('/', '-').replace(':', '')}-{uuid.uuid4().hex}"


@query("SELECT doc_id, NULLIF(text, '') AS text, source FROM documents")
def import_csv(spark, folder):
    """Whole documents with their line feeds and quotes, from quoted files that are read in ranges."""
    path = _folder(spark, folder, "table") + ".csv"
    docs = C.table(spark, folder, "documents").select("doc_id", "text", "source")
    docs.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return import_article_data(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")


@query("SELECT conv_id, turn, role, text FROM conversations")
def import_json(spark, folder):
    """Conversations written as nested objects, read in ranges and flattened."""
    path = _folder(spark, folder, "nested") + ".json"
    rows = C.table(spark, folder, "conversations").select("conv_id", F.struct("turn", F.struct("role", "text").alias("said")).alias("at"))
    rows.write.option("ignoreNullFields", False).json(path)
    found = import_article_data(spark, path)
    return found.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("`at.turn`").cast("long").alias("turn"), F.col("`at.said.role`").alias("role"), F.col("`at.said.text`").alias("text"))


def _released(spark, folder):
    """A release of the articles with vectors by the stand-in encoder, written, hashed and validated."""
    root = _folder(spark, folder, "release")
    return build_database_release(keep(C.articles(spark, folder)), "2026.01", root, C.NOW, model_name="m", encoder=semantic.hashing_encoder(8))


@query(f"SELECT article_id, title, authors, abstract, keywords, doi_normalized, year, source_title, {', '.join(f'{d}_text' for d in DIMENSIONS)}, content_hash FROM hashes")
def release_articles(spark, folder):
    """What readers of a release find in its current version."""
    found = read_tables(spark, _released(spark, folder).database)["articles"]
    return found.select("article_id", "title", "authors", "abstract", "keywords", "doi_normalized", "year", "source_title", *(f"{d}_text" for d in DIMENSIONS), "content_hash")


@query(
    """SELECT 'manifest' AS check_id, count(*) AS violations FROM art UNION ALL SELECT 'embeddings', 5 * count(*) FROM art UNION ALL
    SELECT * FROM (VALUES ('V1_tables', 0::BIGINT), ('V2_articles_columns', 0), ('V2_lexical_documents_columns', 0), ('V2_embeddings_columns', 0), ('V3_metadata', 0), ('V12_model_agrees', 1),
    ('V13_length_agrees', 0), ('V16_status', 1), ('V17_manifest', 2), ('V18_schema', 1))"""
)
def release_checks(spark, folder):
    """Counts of a release's manifest, and the checks of its metadata after its status, model, schema and number of articles were changed."""
    release = _released(spark, folder)
    tables = read_tables(spark, release.database)
    wrong = {"embedding_status": "partial", "embedding_model": "other", "database_schema_version": "9"}
    value = F.coalesce(F.create_map(*(F.lit(x) for kv in wrong.items() for x in kv))[F.col("key")], F.col("value"))
    tables["database_metadata"] = tables["database_metadata"].withColumn("value", value)
    manifest = {**release.manifest, "number_of_articles": 1, "embedding_status": "partial"}
    checks = validation.validate_tables(tables, manifest).where("check_id IN ('V1_tables', 'V3_metadata', 'V16_status', 'V17_manifest', 'V18_schema', 'V12_model_agrees', 'V13_length_agrees') OR check_id LIKE 'V2%'")
    counts = [("manifest", int(release.manifest["number_of_articles"])), ("embeddings", read_tables(spark, release.database)["embeddings"].count())]
    return spark.createDataFrame(counts, "check_id string, violations long").union(checks)


@query(_ranking(WEIGHTS, n=5))
def recommend(spark, folder):
    """The entry point: prepared queries over a release and the index that is stored beside it."""
    release = _released(spark, folder)
    asked = [
        prepare_query(title=r.text, purpose=f"This study aims to {r.text}", context=f"{r.text} women in Honduras, DOI 10.5555/abc.77", query_id=f"b{r.item_id}")
        for r in C.table(spark, folder, "benchmark").select("item_id", "text").collect()
    ]
    return recommend_articles(spark, release.database, asked, n=5, engine="lexical").table


# Integrity checks.


@query(
    """SELECT * FROM (WITH a AS (SELECT article_id FROM art UNION ALL SELECT article_id FROM art WHERE year % 4 = 0),
    d AS (SELECT article_id, dimension FROM docs WHERE dimension <> 'data' UNION ALL SELECT 'gone' || article_id, dimension FROM docs WHERE dimension = 'purpose' AND document_length % 3 = 0)
    SELECT 'V4_article_ids_unique' AS check_id, count(*) - count(DISTINCT article_id) AS violations FROM a UNION ALL SELECT 'V5_lexical_unique', count(*) FROM (SELECT 1 FROM d GROUP BY article_id, dimension HAVING count(*) > 1)
    UNION ALL SELECT 'V6_lexical_complete', abs((SELECT count(*) FROM d) - 5 * (SELECT count(*) FROM a))
    UNION ALL SELECT 'V6b_lexical_orphans', count(*) FROM d WHERE article_id NOT IN (SELECT article_id FROM a) UNION ALL SELECT 'V7_lexical_dimensions', count(*) FILTER (WHERE dimension = 'theme') FROM d)"""
)
def checks_lexical(spark, folder):
    """Articles stand twice, documents are left out, renamed or without an article, so that every check fails."""
    articles = keep(C.dimension_articles(spark, folder))
    documents = keep(lexical.build_lexical_documents(articles))
    lost = documents.where("dimension = 'purpose' AND document_length % 3 = 0").withColumn("article_id", F.concat(F.lit("gone"), "article_id"))
    documents = documents.where("dimension <> 'data'").unionByName(lost)
    articles = articles.unionByName(articles.where("year % 4 = 0"))
    broken = documents.withColumn("dimension", F.when(F.col("dimension") == "theme", "topic").otherwise(F.col("dimension")))
    return validation.lexical_checks(articles, broken)


@query(
    """SELECT * FROM (WITH b AS (SELECT article_id, CASE WHEN vec_id % 31 = 3 THEN 'topic' ELSE dimension END AS dimension, CASE WHEN vec_id % 10 = 1 THEN 'other' ELSE 'm' END AS model,
        vec_id % 6 <> 0 AS flag, vec_id % 8 = 5 AS odd, vec_id % 9 = 2 AS long, embedding, content_hash FROM emb UNION ALL
        SELECT article_id, CASE WHEN vec_id % 31 = 3 THEN 'topic' ELSE dimension END, CASE WHEN vec_id % 10 = 1 THEN 'other' ELSE 'm' END, vec_id % 6 <> 0, vec_id % 8 = 5, vec_id % 9 = 2, embedding, content_hash FROM emb WHERE vec_id % 50 = 7)
    SELECT 'V8_embedding_orphans' AS check_id, count(*) AS violations FROM b WHERE article_id NOT IN (SELECT article_id FROM eart)
    UNION ALL SELECT 'V9_embedding_unique', count(*) FROM (SELECT 1 FROM b GROUP BY article_id, dimension HAVING count(*) > 1)
    UNION ALL SELECT 'V10_embedding_dimensions', count(*) FROM b WHERE dimension NOT IN ('theme', 'purpose', 'method', 'data', 'context')
    UNION ALL SELECT 'V11_embedding_hashes', count(*) FROM b e JOIN eart a USING (article_id) WHERE e.content_hash <> a.content_hash
    UNION ALL SELECT 'V12_one_model', count(DISTINCT model) - 1 FROM b UNION ALL SELECT 'V13_one_length', count(DISTINCT CASE WHEN long THEN len(embedding) + 1 ELSE len(embedding) END) - 1 FROM b
    UNION ALL SELECT 'V14_normalized_flag', count(*) FROM b WHERE NOT flag
    UNION ALL SELECT 'V14b_unit_norm', count(*) FROM b WHERE odd OR long OR abs(sqrt(list_dot_product(embedding, embedding)) - 1) > 1e-6
    UNION ALL SELECT 'V15_finite', count(*) FROM b WHERE odd
    UNION ALL SELECT 'V16_articles_even', count(*) FROM (SELECT article_id FROM b GROUP BY 1 HAVING count(*) > 5 OR count(*) <> count(DISTINCT dimension)))"""
)
def checks_embeddings(spark, folder):
    """Vectors stand twice, under a wrong dimension, of another model, without the flag, too long or not a number, so that every check fails."""
    every = C.embeddings(spark, folder)
    every = every.unionByName(every.where("vec_id % 50 = 7"))
    nan = F.transform("embedding", lambda x: F.lit(float("nan")))
    broken = every.withColumns(
        {
            "dimension": F.when(F.col("vec_id") % 31 == 3, "topic").otherwise(F.col("dimension")),
            "model_name": F.when(F.col("vec_id") % 10 == 1, "other").otherwise("m"),
            "normalized": F.col("vec_id") % 6 != 0,
            "embedding": F.concat(F.when(F.col("vec_id") % 8 == 5, nan).otherwise(F.col("embedding")), F.when(F.col("vec_id") % 9 == 2, F.array(F.lit(2.0))).otherwise(F.array().cast("array<double>"))),
        }
    )
    return validation.embedding_checks(C.embedded_articles(spark, folder), broken)


@query("SELECT article_id, dimension FROM emb WHERE article_id NOT IN (SELECT article_id FROM eart)")
def checks_orphans(spark, folder):
    return C.embeddings(spark, folder).join(C.embedded_articles(spark, folder), "article_id", "left_anti").select("article_id", "dimension")


@query("SELECT article_id, dimension FROM emb e JOIN eart a USING (article_id) WHERE e.content_hash <> a.content_hash")
def checks_hash(spark, folder):
    articles = C.embedded_articles(spark, folder).select("article_id", F.col("content_hash").alias("h"))
    return C.embeddings(spark, folder).join(articles, "article_id").where("content_hash <> h").select("article_id", "dimension")


#: What a release of this date, model and state says, whatever its articles.
FIXED_METADATA = {
    "data_version": "2026.01",
    "published_at": "2026-01-01",
    "database_schema_version": "1.0",
    "embedding_model": "m",
    "embedding_status": "absent",
    "embedding_dimensions": "0",
    "embedding_normalized": "FALSE",
    "query_prefix": "query: ",
    "passage_prefix": "passage: ",
    "semantic_index_version": "1.0",
    "minimum_package_version": "0.1.0",
    "lexical_index_version": "1.0",
    "lexical_components": "tfidf:0.45,bm25:0.35,exact:0.20",
}


@query(
    "SELECT * FROM (SELECT unnest(['number_of_articles', 'articles_new', 'articles_modified', 'articles_unchanged', 'articles_removed']) AS key, unnest([(SELECT count(*) FROM cur), "
    + ", ".join(f"(SELECT count(*) FROM cmp WHERE status = '{s}')" for s in versioning.STATUSES)
    + "])::VARCHAR AS value) UNION ALL SELECT unnest("
    + O.listed(FIXED_METADATA)
    + "), unnest("
    + O.listed(map(str, FIXED_METADATA.values()))
    + ")"
)
def metadata_kv(spark, folder):
    current, previous = C.versions(spark, folder)
    rows = versioning.comparison_summary(versioning.compare_versions(current, previous)).collect()
    status = {"status": "absent", "dimensions": 0, "normalized": False}
    values = versioning.release_metadata("2026.01", C.NOW[:10], current.count(), "m", status, {r.status: r.n_articles for r in rows})
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")
