"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position is given a non-zero vector of ``radius + 1`` bits; table ``v``
(a non-zero vector too) keeps the positions whose vector has an odd inner product
with ``v``.  Any ``radius`` positions span at most ``radius`` dimensions, so some
``v`` is orthogonal to all of them: every pair within the radius agrees on the
kept bits of that table, whatever its differences are.

Equal fingerprints are merged first.  A bucket of two is compared directly from
its smallest and largest member.  In larger buckets no pairs are made: each
member is sent to itself and its one-bit neighbours among the bits that the
table leaves out, and those that meet there are at most two bits apart; a meeting
point holds at most 65 different fingerprints, however large the bucket is.

Defined results
---------------
* null, empty or blank text: fingerprint zero, linked like any other.
* fewer words than a shingle: the whole word sequence is the one shingle.
* equal rows share a component; ``component_id`` ignores null ``doc_id`` and is
  null only where a whole component has none.
* columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, dealt, heavy_keys, sent, spread_join

BITS = 64
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint: a bit is one where more than half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        cuts = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        h = np.fromiter((digest(view[s:e], 42) for s, e in cuts), np.uint64, len(starts[at : at + BLOCK]))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every document as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def covering_masks(radius: int) -> list[int]:
    """The kept bits of each table; every pair within ``radius`` agrees on all of them in some table."""
    classes = 2 ** (radius + 1) - 1
    return [
        sum(1 << i for i in range(BITS) if ((1 + i % classes) & v).bit_count() % 2)
        for v in range(1, classes + 1)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _far(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``u, v``: links that connect all different fingerprints of ``fps`` (column ``fp``, no repeats) within ``radius``.

    Every link joins two fingerprints at most ``radius`` bits apart, and any two
    such fingerprints are connected by a path of links.  ``radius`` is 1 or 2.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)))
    entries = fps.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    buckets = cut(
        entries.groupBy("t", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        .where("n > 1")
    )
    direct = buckets.where((F.col("n") == 2) & (_far(F.col("u"), F.col("v")) <= radius)).select("u", "v")
    flips = F.array(
        *(
            F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)).cast("long") for i in range(BITS) if not m >> i & 1))
            for m in masks
        )
    )
    crowded = entries.join(buckets.where("n > 2").select("t", "key"), ["t", "key"])
    met = (
        crowded.select("fp", F.explode(F.get(flips, F.col("t"))).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
        .groupBy("point")
        .agg(F.collect_set("fp").alias("members"))
        .where(F.size("members") > 1)
    )
    if radius == 2:
        # Any two of them are a link; a chain of them keeps the links of a fingerprint few.
        rows = met.select(F.array_sort("members").alias("m"))
        chain = rows.select(F.explode(F.arrays_zip(F.slice("m", 1, F.size("m") - 1).alias("u"), F.slice("m", 2, F.size("m") - 1).alias("v"))).alias("x"))
        near = chain.select("x.u", "x.v")
    else:
        near = (
            met.select("members", F.explode("members").alias("u"))
            .select("u", F.explode("members").alias("v"))
            .where((F.col("u") < F.col("v")) & (_far(F.col("u"), F.col("v")) <= radius))
        )
    return direct.union(near).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable from every node of ``u, v`` links.

    Each round hangs every node and its parent under the smallest parent among
    the neighbours, then halves the paths; rounds grow with the logarithm of the
    size, and each one is cut by a checkpoint.
    """
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("near")), F.struct(F.col("v").alias("node"), F.col("u").alias("near")))
    both = cut(edges.select(F.explode(ends).alias("x")).select("x.node", "x.near"))
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")))
    # A node with most of the links is dealt to several tasks; which ones they are does not change.
    heavy = heavy_keys(both.groupBy("near").agg(F.count(F.lit(1)).alias("n")), ["near"])
    keys = ["near"] if heavy is None else ["near", "_salt"]
    asked = both if heavy is None else cut(dealt(both, ["near"], heavy))
    while True:
        told = labels.select(F.col("node").alias("near"), F.col("root").alias("offer"))
        offers = asked.join((told if heavy is None else sent(told, ["near"], heavy)).hint("merge"), keys).groupBy("node").agg(F.min("offer").alias("offer"))
        offered = labels.join(offers.hint("merge"), "node").select("node", "root", "offer")
        hung = offered.select("node", "offer").union(offered.select("root", "offer"))
        best = hung.groupBy("node").agg(F.min("offer").alias("offer"))
        moved = cut(labels.join(best.hint("merge"), "node", "left").select("node", F.least("root", "offer").alias("root"), F.col("root").alias("old")))
        up = moved.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        after = cut(spread_join(moved, up, ["root"]).select("node", F.col("higher").alias("root"), "old"))
        labels = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    prints = cut(fingerprints(docs, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    roots = components(links(nodes.select("fp"), radius))
    rooted = cut(nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "first_id", "root"))
    smallest = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    linked = spread_join(rooted, smallest, ["root"]).select("fp", "component_id")
    named = cut(
        nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    )
    return spread_join(prints, named, ["fp"], nodes).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """``docs``, same columns, with the smallest ``doc_id`` of every component; rows with a null ``doc_id`` stay.

    Rows that share a ``doc_id`` in different components go where any of them does.
    """
    gone = (
        near_duplicates(docs, radius, shingle)
        .where(F.col("doc_id") != F.col("component_id"))
        .select("doc_id")
        .distinct()
    )
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
