import random

import pytest
import xxhash
from folioscope.llm.queries import op1_simhash
from folioscope.llm.similar import keep_one_similar, similar_documents
from folioscope.llm.simhash import components, covering_masks, hex_fingerprint, keep_one, links, near_duplicates
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    roots = groups(prints)
    least = {}
    for (doc, _), r in zip(rows, roots):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(((doc, f"{p:016x}", least.get(r)) for (doc, _), p, r in zip(rows, prints, roots)), key=str)


def test_real_documents(spark, folder, real):
    got = sorted((tuple(r)[:3] for r in op1_simhash(spark, folder).collect()), key=str)
    assert got == brute(real)


def test_edge_rows(docs, rows):
    got = near_duplicates(docs).select("doc_id", hex_fingerprint(F.col("fp")), "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([r[:2] for r in rows])


@pytest.mark.parametrize("radius", [1, 2])
def test_links_connect_what_lies_within_the_radius(spark, radius):
    random.seed(radius)
    seeds = [random.getrandbits(64) for _ in range(6)]
    prints = {s ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4))) for s in seeds for _ in range(40)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = links(spark.createDataFrame(signed, "fp long"), radius)
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in found.collect()]
    assert all((u ^ v).bit_count() <= 2 for u, v in edges)
    roots = {r.node % (1 << 64): r.root for r in components(found).collect()}
    for p in prints:
        for q in prints:
            if p < q and (p ^ q).bit_count() <= radius:
                assert roots[p] == roots[q]


def test_masks_cover():
    masks = covering_masks(2)
    assert all(any(not (m >> i & 1 or m >> j & 1) for m in masks) for i in range(64) for j in range(64))


def test_stage_keeps_one_of_each_group(spark, docs, no_docs, rows):
    random.seed(1)
    words = [f"v{i}" for i in range(400)]
    base = [random.choice(words) for _ in range(200)]
    near = list(base)
    near[50], near[120] = "other", "words"
    made = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(random.choice(words) for _ in range(200))), (None, " ".join(base)), (9, None), (8, "")]
    df = spark.createDataFrame([(d, t, "x") for d, t in made], "doc_id long, text string, node string")
    kept = keep_one_similar(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 8, None]
    assert {r.doc_id: r.component_id for r in similar_documents(df).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert keep_one_similar(no_docs).count() == 0 and keep_one(no_docs).count() == 0
    assert near_duplicates(no_docs).count() == 0


def test_scratch_removes_its_own_folders_only(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from folioscope.llm.common import scratch, written

    def make(name):
        return written(spark.range(3).toDF("x"), name)

    with ThreadPoolExecutor(1) as pool:
        with scratch(spark):
            own, other = make("own"), pool.submit(make, "other").result()
            assert own.count() == other.count() == 3
            gone = own.inputFiles()[0].removeprefix("file:")
        assert spark.read.parquet(other.inputFiles()[0].rsplit("/", 1)[0]).count() == 3
    assert not spark._jvm.java.io.File(gone).exists()
