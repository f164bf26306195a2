"""The same data and operators as DuckDB SQL: functions give expressions, ``CTES`` the tables."""

from __future__ import annotations

from folioscope.config import BM25_B, BM25_K1, BM25_K3, DIMENSION_CUES, DIMENSIONS, EXACT_TERMS, SHORT_TERMS, STOPWORDS
from folioscope.functions import text as X
from folioscope.operators.ranking import EXPLAIN_ORDER
from folioscope.plans.corpus import NOW, SEEDS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def regex(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, 'g')"


def squish(x: str) -> str:
    return f"trim({regex(x, X.SPACES, ' ')})"


def norm(x: str) -> str:
    return squish(regex(f"coalesce({x}, '')", r"[\x00-\x1F\x7F]", " "))


def plain(x: str) -> str:
    out = f"translate({x}, {quoted(''.join(X.MARKED))}, {quoted(''.join(X.MARKED.values()))})"
    for a, b in X.EXPANDED.items():
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    return out


def match(x: str) -> str:
    return f"trim({regex(plain(f'lower({norm(x)})'), X.NOT_ALNUM, ' ')})"


def doi(x: str) -> str:
    out = f"lower({norm(x)})"
    for pattern in (r"^https?://(dx\.)?doi\.org/", r"^doi\s*:\s*", r"\s+", r"[.,;]+$"):
        out = regex(out, pattern, "")
    return f"(CASE WHEN regexp_matches({out}, {quoted(r'^10\.[0-9]{4,9}/\S+$')}) THEN {out} ELSE '' END)"


def authors(x: str) -> str:
    out = norm(x)
    for pattern, new in ((r"\s*\|\s*", "; "), (r"\s*;\s*", "; "), (r";{2,}", ";"), (r";$", "")):
        out = regex(out, pattern, new)
    return out


def distinct_terms(x: str) -> str:
    pairs = f"list_filter(list_transform({x}, lambda x: {{'t': trim(x), 'n': {match('x')}}}), lambda p: p.t <> '')"
    return (
        f"list_transform(list_filter({pairs}, lambda p, i: list_position(list_transform({pairs}, lambda y: y.n), p.n) = i), lambda p: p.t)"
    )


def keywords(a: str, b: str) -> str:
    both = " || '; ' || ".join(regex(norm(x), r"\s*[,|]\s*", "; ") for x in (a, b))
    return f"array_to_string({distinct_terms(f'string_split({both}, {quoted(chr(59))})')}, '; ')"


def hashed(*columns: str) -> str:
    return "sha256(" + f" || '{X.FIELD_MARK}' || ".join(f"coalesce(({c})::VARCHAR, '')" for c in columns) + ")"


def tokens(normed: str) -> str:
    return (
        f"list_filter(string_split({normed}, ' '), lambda w: w <> '' AND (length(w) > 1 OR list_contains({listed(SHORT_TERMS)}, w))"
        f" AND NOT list_contains({listed(STOPWORDS)}, w))"
    )


def doi_terms(x: str) -> str:
    found = f"list_transform(regexp_extract_all(lower(coalesce({x}, '')), {quoted(X.DOI)}), lambda x: {regex('x', '[.,;]+$', '')})"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


def exact_terms(x: str, normed: str) -> str:
    phrases = f"list_filter({listed(EXACT_TERMS)}, lambda t: contains(' ' || {normed} || ' ', ' ' || t || ' '))"
    return f"list_concat({phrases}, list_filter({doi_terms(x)}, lambda d: NOT list_contains({listed(EXACT_TERMS)}, d)))"


def sentences(x: str) -> str:
    marked = f"regexp_replace({norm(x)}, {quoted(X.SENTENCE_END)}, {quoted(chr(92) + '1' + X.SENTENCE_MARK + chr(92) + '2')}, 'g')"
    return f"list_filter(list_transform(string_split({marked}, '{X.SENTENCE_MARK}'), lambda x: trim(x)), lambda x: x <> '')"


def sentences_with(x: str, cues: str) -> str:
    found = f"list_filter({sentences(x)}, lambda s: regexp_matches(lower(s), {quoted(X.cue_pattern(cues))}))"
    return f"array_to_string(({found})[1:3], ' ')"


SEED_CASE = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {quoted(s)}" for i, s in enumerate(SEEDS)) + " END"
CONTENT = ["title_normalized", "authors", "abstract", "keywords", "doi_normalized", "year", "source_title"]


def _choice(extracted: str, fallback: str, name: str) -> str:
    return (
        f"CASE WHEN {extracted} <> '' THEN {extracted} ELSE {norm(fallback)} END AS {name}_text, "
        f"CASE WHEN {extracted} <> '' THEN 'rule_based' ELSE 'fallback' END AS {name}_source, "
        f"CASE WHEN {extracted} <> '' THEN 0.75::DOUBLE ELSE 0.35::DOUBLE END AS {name}_confidence"
    )


def stage(before: str, key: str, rule: str) -> str:
    """One round of merging, with the group's key as the new position."""

    def longest(c: str) -> str:
        return f"coalesce(first(trim({c}) ORDER BY length(trim({c})) DESC, pos) FILTER (WHERE trim({c}) <> ''), '') AS {c}"

    def first(c: str) -> str:
        return f"coalesce(first(trim({c}) ORDER BY pos) FILTER (WHERE trim({c}) <> ''), '') AS {c}"

    def united(c: str) -> str:
        parts = f"flatten(list(string_split({c}, ';') ORDER BY pos))"
        return f"{parts} AS {c}_all"

    keyed = f"SELECT *, coalesce(nullif({key}, ''), 'row:' || pos) AS k FROM {before}"
    merged = (
        f"SELECT k AS pos, {longest('title')}, {longest('abstract')}, {united('authors')}, {united('keywords')}, {first('doi')}, "
        f"{first('doi_normalized')}, {first('source_title')}, first(year ORDER BY pos) FILTER (WHERE year IS NOT NULL) AS year, "
        f"count(*) AS original_rows, {quoted(rule)} AS rule FROM ({keyed}) GROUP BY k"
    )
    lists = f"SELECT *, array_to_string({distinct_terms('authors_all')}, '; ') AS authors, array_to_string({distinct_terms('keywords_all')}, '; ') AS keywords FROM ({merged})"
    return f"SELECT *, {match('title')} AS title_normalized, replace({match('authors')}, ' ', '_') AS authors_normalized FROM ({lists})"


ARTICLE_ID = (
    f"CASE WHEN doi_normalized <> '' THEN {hashed(quoted('doi'), 'doi_normalized')} "
    f"ELSE {hashed(quoted('record'), 'title_normalized', 'year', 'authors_normalized')} END"
)
DOI_KEY = "CASE WHEN doi_normalized <> '' THEN 'doi:' || doi_normalized ELSE '' END"
TITLE_YEAR_KEY = "CASE WHEN year IS NOT NULL THEN 'title-year:' || title_normalized || '|' || year::VARCHAR ELSE '' END"
TITLE_AUTHORS_KEY = "CASE WHEN authors_normalized <> '' THEN 'title-authors:' || title_normalized || '|' || authors_normalized ELSE '' END"
THEME = norm("title || '. ' || keywords || '. ' || abstract")

CTES = {
    "raw": f"""SELECT doc_id, '  ' || trim(substring(split_part(text, '.', 1), 1, 120)) || CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE '' END AS title_raw,
        'Author ' || (n_chars % 40)::VARCHAR || ' | Müller ' || (n_chars % 7)::VARCHAR || ' ;' AS authors_raw,
        text || ' ' || {SEED_CASE} AS abstract_raw,
        lang || ', Topic ' || (n_chars % 5)::VARCHAR || '; tópic ' || (n_chars % 5)::VARCHAR AS author_keywords_raw,
        'Topic ' || (n_chars % 3)::VARCHAR || ' ; ' || source AS index_keywords_raw,
        CASE WHEN doc_id % 3 = 0 THEN ' HTTPS://doi.org/10.1000/Doc.' || (doc_id // 6)::VARCHAR || '.' WHEN doc_id % 3 = 1 THEN 'doi: none' END AS doi_raw,
        CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (2000 + n_chars % 25)::INTEGER END AS year, source AS source_raw FROM documents""",
    "rec": f"""SELECT * FROM (SELECT doc_id, lpad(doc_id::VARCHAR, 20, '0') AS pos, {norm('title_raw')} AS title, {authors('authors_raw')} AS authors,
        {norm('abstract_raw')} AS abstract, {keywords('author_keywords_raw', 'index_keywords_raw')} AS keywords, {norm('doi_raw')} AS doi, year,
        {norm('source_raw')} AS source_title, {doi('doi_raw')} AS doi_normalized, {match('title_raw')} AS title_normalized,
        replace({match('authors_raw')}, ' ', '_') AS authors_normalized FROM raw) WHERE title_normalized <> ''""",
    "art": f"SELECT * FROM (SELECT *, {ARTICLE_ID} AS article_id FROM rec) QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY pos) = 1",
    "dims": f"""SELECT *, {THEME} AS theme_text, 'constructed' AS theme_source, 0.85::DOUBLE AS theme_confidence,
        {', '.join(_choice(sentences_with('abstract', DIMENSION_CUES[d]), f"CASE WHEN abstract <> '' THEN abstract ELSE {THEME} END", d) for d in ('purpose', 'method', 'data'))},
        {_choice(sentences_with("title || ' ' || abstract || ' ' || keywords", DIMENSION_CUES['context']), f"CASE WHEN abstract <> '' THEN title || ' ' || keywords || ' ' || abstract ELSE {THEME} END", 'context')}
        FROM art""",
    "hashes": f"SELECT *, {hashed(*CONTENT, *(f'{d}_text' for d in DIMENSIONS))} AS content_hash FROM dims",
    "tall": " UNION ALL ".join(f"SELECT article_id, '{d}' AS dimension, {d}_text AS text, content_hash FROM hashes" for d in DIMENSIONS),
    "normed": f"SELECT *, {match('text')} AS normalized_text FROM tall",
    "lex": f"SELECT article_id, dimension, normalized_text, {tokens('normalized_text')} AS tokens, {exact_terms('text', 'normalized_text')} AS exact_terms, content_hash FROM normed",
    "docs": "SELECT *, len(tokens)::INTEGER AS document_length FROM lex",
    "tf": "SELECT dimension, article_id, term, count(*) AS tf FROM (SELECT dimension, article_id, unnest(tokens) AS term FROM docs) GROUP BY ALL",
    "stats": "SELECT dimension, count(*) AS n, CASE WHEN sum(document_length) > 0 THEN sum(document_length)::DOUBLE / count(*) ELSE 1.0 END AS avgdl FROM docs GROUP BY dimension",
    "dfs": "SELECT dimension, term, count(*) AS df FROM tf GROUP BY ALL",
    "terms": "SELECT dimension, term, df, ln((n + 1.0::DOUBLE) / (df + 1)) + 1 AS idf, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS bm25_idf FROM dfs JOIN stats USING (dimension)",
    "norms": "SELECT dimension, article_id, sqrt(sum((ln(1 + tf::DOUBLE) * idf) ** 2)) AS norm FROM tf JOIN terms USING (dimension, term) GROUP BY ALL",
    "qry": """SELECT 'b' || item_id::VARCHAR AS query_id, 'theme' AS dimension, text FROM benchmark
        UNION ALL SELECT 'b' || item_id::VARCHAR, 'purpose', 'This study aims to ' || text FROM benchmark
        UNION ALL SELECT 'b' || item_id::VARCHAR, 'context', text || ' women in Honduras, DOI 10.5555/abc.77' FROM benchmark""",
    "qnorm": f"SELECT *, {match('text')} AS nt FROM qry",
    "qlex": f"SELECT query_id, dimension, {tokens('nt')} AS tokens, {exact_terms('text', 'nt')} AS phrases FROM qnorm",
    "qtf": "SELECT query_id, dimension, term, count(*) AS qtf FROM (SELECT query_id, dimension, unnest(tokens) AS term FROM qlex) GROUP BY ALL",
    "qterms": "SELECT *, ln(1 + qtf::DOUBLE) * idf AS w, sqrt(sum((ln(1 + qtf::DOUBLE) * idf) ** 2) OVER (PARTITION BY query_id, dimension)) AS qnorm, count(*) OVER (PARTITION BY query_id, dimension) AS n_known FROM qtf JOIN terms USING (dimension, term)",
    "tscore": f"""SELECT query_id, dimension, article_id, least(1, greatest(0, sum(ln(1 + tf::DOUBLE) * idf / norm * w / qnorm))) AS tfidf,
        sum(bm25_idf * tf * {BM25_K1 + 1} / (tf + {BM25_K1} * (1 - {BM25_B} + {BM25_B}::DOUBLE * document_length / avgdl)) * qtf * {BM25_K3 + 1} / (qtf + {BM25_K3})) AS bm25_raw,
        count(*)::DOUBLE / max(n_known) AS token_coverage
        FROM qterms JOIN tf USING (dimension, term) JOIN norms USING (dimension, article_id) JOIN docs USING (dimension, article_id) JOIN stats USING (dimension)
        GROUP BY ALL""",
    "pscore": """SELECT query_id, dimension, article_id, len(list_intersect(phrases, exact_terms))::DOUBLE / len(phrases) AS phrase_coverage
        FROM qlex JOIN docs USING (dimension) WHERE len(phrases) > 0 AND len(list_intersect(phrases, exact_terms)) > 0""",
    "parts": """SELECT query_id, dimension, article_id, coalesce(tfidf, 0) AS tfidf, coalesce(bm25_raw / max(bm25_raw) OVER (PARTITION BY query_id, dimension), 0) AS bm25,
        CASE WHEN len(phrases) > 0 THEN 0.6::DOUBLE * coalesce(phrase_coverage, 0) + 0.4::DOUBLE * coalesce(token_coverage, 0) ELSE coalesce(token_coverage, 0) END AS exact
        FROM tscore FULL JOIN pscore USING (query_id, dimension, article_id) JOIN qlex USING (query_id, dimension)""",
    "dscore": "SELECT *, least(1, greatest(0, 0.45::DOUBLE * tfidf + 0.35::DOUBLE * bm25 + 0.2::DOUBLE * exact)) AS score FROM parts",
    "s1": stage("rec", DOI_KEY, "doi"),
    "s2": stage("s1", TITLE_YEAR_KEY, "title_year"),
    "s3": stage("s2", TITLE_AUTHORS_KEY, "title_authors"),
    "s4": stage(f"(SELECT *, {ARTICLE_ID} AS aid FROM s3)", "aid", "article_id"),
    "emb": f"SELECT 'a' || (vec_id // 5)::VARCHAR AS article_id, ({listed(DIMENSIONS)})[vec_id % 5 + 1] AS dimension, embedding::DOUBLE[] AS embedding, label::VARCHAR AS content_hash, vec_id FROM embeddings",
    "eart": """SELECT article_id, 'title ' || (k % 10)::VARCHAR AS title, CASE WHEN k % 8 <> 0 THEN (2000 + k % 20)::INTEGER END AS year,
        CASE WHEN k % 2 = 0 THEN '10.1000/v.' || k::VARCHAR ELSE '' END AS doi, CASE WHEN k % 7 = 0 THEN 'other' ELSE content_hash END AS content_hash
        FROM (SELECT *, vec_id // 5 AS k FROM emb WHERE dimension = 'theme') WHERE k % 9 <> 8""",
    "cos": "SELECT 'v' || q.vec_id AS query_id, e.article_id, e.dimension, list_dot_product(e.embedding, q.embedding) AS cosine FROM emb e JOIN emb q ON q.vec_id % 100 = 0",
    "cur": f"SELECT doc_id::VARCHAR AS article_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 11 <> 0",
    "prev": "SELECT doc_id::VARCHAR AS article_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 7 <> 0",
    "cmp": """SELECT article_id, c.content_hash AS current_hash, p.content_hash AS previous_hash,
        CASE WHEN p.content_hash IS NULL THEN 'new' WHEN c.content_hash IS NULL THEN 'removed' WHEN c.content_hash = p.content_hash THEN 'unchanged' ELSE 'modified' END AS status
        FROM cur c FULL JOIN prev p USING (article_id)""",
}
#: Tables that others read more than once.
KEPT = {"rec", "art", "dims", "hashes", "lex", "docs", "tf", "terms", "norms", "qlex", "qterms", "tscore", "dscore", "s1", "s2", "s3", "emb", "cmp"}


def sql(select: str) -> str:
    """``select`` with the tables that it needs before it."""
    import re

    needed: set[str] = set()

    def need(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+\(?{name}\b", text):
                needed.add(name)
                need(CTES[name])

    need(select)
    parts = [f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}({CTES[n]})" for n in CTES if n in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + select


def explained(columns: dict[str, str]) -> str:
    from folioscope.config import EXPLAIN_MANY, EXPLAIN_NONE, EXPLAIN_ONE, LABELS

    entries = ", ".join(f"CASE WHEN {columns[d]} IS NOT NULL THEN {{'s': -({columns[d]}), 'k': {k}, 'l': {quoted(LABELS[d])}}} END" for k, d in enumerate(EXPLAIN_ORDER))
    names = f"list_transform(list_sort(list_filter([{entries}], lambda e: e IS NOT NULL))[1:3], lambda e: e.l)"
    return (
        f"CASE len({names}) WHEN 0 THEN {quoted(EXPLAIN_NONE)} WHEN 1 THEN {quoted(EXPLAIN_ONE)} || ({names})[1] || '.' "
        f"WHEN 2 THEN {quoted(EXPLAIN_MANY)} || ({names})[1] || ' y ' || ({names})[2] || '.' "
        f"ELSE {quoted(EXPLAIN_MANY)} || ({names})[1] || ', ' || ({names})[2] || ' y ' || ({names})[3] || '.' END"
    )


__all__ = ["CTES", "NOW", "sql"]
