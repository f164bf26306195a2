import random

import numpy as np
import pytest
from folioscope.llm.odd_sketch import BITS, LOST, MISS, SAMPLES, band_shape, estimate, minima, most_odd, near_copies, odd_sketch
from folioscope.llm.queries import op13_odd_sketch
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, shingle=2):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]
    return {" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def brute(rows, shingle=2):
    sets = [grams(t, shingle) for _, t in rows]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            shared = len(sets[a] & sets[b])
            if shared and root[a] != root[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    least = {}
    for (doc, _), r in zip(rows, root):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(((doc, len(s), least.get(r), doc == least.get(r)) for (doc, _), s, r in zip(rows, sets, root)), key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_real_documents(spark, folder, real):
    want = brute(real)
    assert shown(op13_odd_sketch(spark, folder)) == want and any(not r[3] for r in want)


def test_edge_rows(spark, docs, no_docs, rows):
    assert shown(near_copies(docs)) == brute([r[:2] for r in rows])
    assert near_copies(no_docs).count() == 0
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert shown(near_copies(named)) == brute([(None if r[0] is None else f"d{r[0]}", r[1]) for r in rows])


@pytest.mark.parametrize("changed", [1, 6, 9])
def test_groups_around_an_original(spark, changed):
    """Copies of one text with other words here and there: beyond a few of them only some pairs hold."""
    rng = random.Random(changed)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for k in range(120):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, changed)):
            words[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    want = brute(list(enumerate(texts)))
    assert shown(near_copies(frame(spark, texts))) == want and any(not r[3] for r in want)


@pytest.mark.parametrize("own", [50, 70])
def test_texts_that_share_a_passage(spark, own):
    """All meet in bands and stay under the threshold; each has one copy, and a popular settled group meets them too."""
    rng, texts = random.Random(own), []
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    shared = prose(150)
    for _ in range(60):
        words = shared + prose(own)
        texts += [words, [*words[:-1], "other"]]
    texts += [[*shared[:-1], f"end{k}"] for k in range(80)]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    assert shown(near_copies(frame(spark, texts))) == brute(list(enumerate(texts)))


def test_pairs_right_at_the_threshold(spark):
    """Eight shared of ten are linked, seven of nine are not; chains reach across."""
    texts = []
    for k in range(40):
        w = [f"k{k}x{i}" for i in range(12)]
        texts += [" ".join(w[:10]), " ".join([*w[:9], "other"]), " ".join([*w[:8], "none", w[9]]), " ".join(w[:11]), " ".join(w[1:12])]
    want = brute(list(enumerate(texts)))
    assert shown(near_copies(frame(spark, texts))) == want and len({r[2] for r in want}) > 40


def test_sketches_lose_no_more_than_they_say(spark):
    rows, bands = band_shape(0.8)
    assert (1 - 0.8**rows) ** bands <= MISS and rows * bands <= SAMPLES
    rng, cutoff, told = np.random.default_rng(4), most_odd(0.8, rows * bands), []
    for _ in range(300):
        both = rng.integers(0, 2**63, 800).astype(np.uint64)
        u, v = (odd_sketch(minima(np.concatenate([both, rng.integers(0, 2**63, 100).astype(np.uint64)]), rows * bands)) for _ in "uv")
        told.append(sum(int(x).bit_count() for x in (u ^ v).view(np.uint64)))
    assert max(told) <= cutoff < BITS // 2 and LOST < 1e-6
    guess = spark.createDataFrame([(t,) for t in told], "t long").select(F.avg(estimate(F.col("t"), rows * bands))).first()[0]
    assert abs(guess - 0.8) < 0.01
