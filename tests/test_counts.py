"""Counts, norms and postings that stay with their documents, and what an index keeps."""

import math
from collections import Counter

import pytest
from folioscope.config import DIMENSIONS
from folioscope.operators import lexical as L
from pyspark.sql import functions as F

TEXTS = ["b a b", "", "one two one one two tres", "zeta", "a a a"]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(f"a{i}", d, t.split(), ["honduras"] if i % 2 else [], len(t.split())) for i, t in enumerate(TEXTS * 5) for d in DIMENSIONS[:2]]
    return spark.createDataFrame(rows, "article_id string, dimension string, tokens array<string>, exact_terms array<string>, document_length int")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_counts_are_taken_where_a_document_stands(documents):
    counts = L.term_counts(documents)
    want = {(r.dimension, r.article_id, t, n) for r in documents.collect() for t, n in Counter(r.tokens).items()}
    got = [tuple(r) for r in counts.select("dimension", "article_id", "term", "tf").collect()]
    assert len(got) == len(want) and set(got) == want
    assert exchanges(counts) == 0 and dict(counts.dtypes)["tf"] == "bigint"


@pytest.mark.parametrize("frequent", [1, 50_000])
def test_norms_are_the_same_however_many_terms_are_sent(monkeypatch, documents, frequent):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    index = L.build_index(documents)
    idf = {(r.dimension, r.term): r.idf for r in index.terms.collect()}
    said = {(r.dimension, r.article_id): r.tokens for r in documents.collect()}
    norms = {(r.dimension, r.article_id): r.norm for r in index.documents.collect()}
    assert norms.keys() == said.keys()
    for key, tokens in said.items():
        assert math.isclose(norms[key], math.sqrt(sum((math.log1p(n) * idf[key[0], t]) ** 2 for t, n in Counter(tokens).items())), abs_tol=1e-9)


def test_an_index_keeps_no_texts_and_no_table_of_postings(spark, documents):
    held = []

    def hold(df):
        held.append(df.columns)
        return L.keep(df)

    index = L.build_index(documents, hold)
    assert not any({"tf", "normalized_text", "tokens"} & set(columns) for columns in held)
    asked = spark.createDataFrame([("theme", "one"), ("theme", "none")], "dimension string, term string")
    for few in (True, False):
        got = sorted(map(tuple, index.postings_of(asked, few).select("term", "article_id", "tf").collect()))
        assert got == sorted(("one", f"a{i}", 3) for i in range(2, 25, 5))


def test_kept_articles_give_the_same_documents(spark):
    row = ("h", *("x",) * 7, 2000, "s", "Nothing of R and AI, women in Honduras", "", "Panel data, see 10.5555/abc.77.", "a b c", "ß Müller")
    columns = "article_id content_hash title authors abstract keywords doi doi_normalized year source_title".split() + [f"{d}_text" for d in DIMENSIONS]
    articles = spark.createDataFrame([row], columns)
    shown, documents = L.kept_articles(articles)
    assert shown.first().title == "x" and not any(c.endswith("_text") for c in shown.columns)
    want = L.build_lexical_documents(articles).drop("normalized_text")
    key = F.col("dimension")
    assert documents.select(want.columns).orderBy(key).collect() == want.orderBy(key).collect()
