"""The near-dedup stage against brute force: by kind of edit, by length, and in crowded groups."""

import random

import pytest
from folioscope.llm.common import spread_join
from folioscope.llm.odd_sketch import SAMPLES, band_shape, shingle_set
from folioscope.llm.similar import keep_one_similar, similar_documents

WORDS = [f"w{i}" for i in range(3000)]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def edited(rng, words, kind):
    n = len(words)
    if kind == "appended":
        return words + prose(rng, n * 15 // 100)
    if kind == "inserted":
        return words[: n // 2] + prose(rng, n * 15 // 100) + words[n // 2 :]
    if kind == "cut":
        return words[n * 12 // 100 :]
    out = list(words)
    for at in rng.sample(range(n), max(1, n // 100)):
        out[at] = rng.choice(WORDS)
    return out


def jaccard(a, b):
    x, y = set(shingle_set(a, 5)), set(shingle_set(b, 5))
    return len(x & y) / len(x | y)


def groups(spark, texts):
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    return {r.doc_id: r.component_id for r in similar_documents(df).collect()}


def brute(texts):
    sets = [set(shingle_set(" ".join(t), 5)) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return {k: r for k, r in enumerate(root) if root.count(r) > 1}


def test_recall_by_kind_of_edit_and_length(spark):
    rng, texts, kinds = random.Random(7), [], []
    for kind in ("appended", "inserted", "cut", "scattered"):
        for low, high in ((60, 150), (150, 500), (500, 1500)):
            for _ in range(25):
                words = prose(rng, rng.randint(low, high))
                texts += [words, edited(rng, words, kind)]
                kinds.append((kind, low))
    found = groups(spark, texts)
    for k, kind in enumerate(kinds):
        if jaccard(" ".join(texts[2 * k]), " ".join(texts[2 * k + 1])) >= 0.8:
            assert found.get(2 * k + 1) == 2 * k, kind


def test_pairs_around_an_unrelated_smallest_member(spark):
    """The same words in other orders: all fingerprints are equal, and only the pairs are alike."""
    rng, texts = random.Random(3), []
    words = prose(rng, 100)
    for _ in range(40):
        rng.shuffle(words)
        texts += [list(words), words[:-2] + words[:-3:-1]]
    assert groups(spark, texts) == brute(texts) != {}


@pytest.mark.parametrize("own", [45, 60])
def test_crowded_bands(spark, own):
    """All share a long passage and stay under the threshold; each has one near copy."""
    rng, texts = random.Random(own), []
    shared = prose(rng, 200)
    for _ in range(75):
        words = shared + prose(rng, own)
        texts += [words, words[:-1] + ["other"]]
    rng.shuffle(texts)
    assert groups(spark, texts) == brute(texts) != {}


def test_a_document_with_several_texts(spark):
    """Each of its texts counts, whichever comes first, and it ties their groups together."""
    rng = random.Random(5)
    a, b, c = (prose(rng, 120) for _ in range(3))
    rows = [(7, a), (7, b), (7, c), (3, a[:-1] + ["x"]), (9, b[:-1] + ["y"]), (12, c[:-2] + ["z"]), (20, prose(rng, 90)), (20, prose(rng, 90)), (21, a)]
    df = spark.createDataFrame([(d, " ".join(t), "k") for d, t in rows], "doc_id long, text string, gone string")
    assert {r.doc_id: r.component_id for r in similar_documents(df.repartition(3)).collect()} == {d: 3 for d in (3, 7, 9, 12, 21)}
    kept = keep_one_similar(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 20, 20]


def test_ids_may_be_strings(spark):
    rng = random.Random(6)
    words = prose(rng, 90)
    rows = [("d10", words), ("d9", words[:-1] + ["z"]), ("d7", prose(rng, 80)), (None, words), ("e", []), ("c", [])]
    df = spark.createDataFrame([(d, " ".join(t), "k") for d, t in rows], "doc_id string, text string, node string")
    assert sorted((r.doc_id or "-" for r in keep_one_similar(df).collect())) == ["-", "c", "d10", "d7"]


@pytest.mark.parametrize("least", [1, 64])
def test_spread_joins_keep_every_row(spark, least):
    rows = [(k % 3 if k % 2 else 7, k) for k in range(900)]
    big, small = spark.createDataFrame(rows, "key long, x long"), spark.createDataFrame([(k, -k) for k in range(6)] + [(7, 1), (7, 2)], "key long, y long")
    got = sorted(map(tuple, spread_join(big, small, ["key"], least=least).collect()))
    assert got == sorted((k, x, y) for k, x in rows for j, y in [(k, -k) for k in range(6)] + [(7, 1), (7, 2)] if j == k)


def test_bands_hold_at_the_threshold():
    for similarity in (0.5, 0.8, 0.9):
        rows, bands = band_shape(similarity)
        assert (1 - similarity**rows) ** bands <= 1e-6 and rows * bands <= SAMPLES
