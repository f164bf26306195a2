"""MinHash near-duplicates: banded candidates, verified by odd sketches and then by the whole sets.

Each document's set of word shingles is sampled by minimal hashes.  Samples are cut into bands, so
many that a pair at the threshold shares no band with a probability of :data:`MISS` at most, and
all samples are folded into one odd sketch: a bitmap in which each flips the bit that its place and
value hash to.  Samples that two documents share cancel out in the XOR of their bitmaps, so its
population count tells how many differ, most exactly where few do.  :func:`most_odd` bounds that
count for pairs at the threshold; candidates beyond it are dropped before any set is moved, and
what is left is confirmed on the full sets.

A band never makes all pairs of its members.  Each is first paired with the hub, the member whose
bands are the most crowded: the original of a group of copies shares bands with all of them.
Bands whose members are then in one component are settled.  The members of the others meet anew
at their rarest shingles: of two sets at the threshold, so many of the rarest of one that the rest
is too small to reach it hold one of the other's (a prefix filter, which loses no pair).  There only
members of different components are compared, all against those outside the largest component
of the shingle, and size, place and odd sketch are tested inside the join.  No member or pair
is dropped for the size of its group.

Defined results
---------------
* null, empty or blank text: an empty set, ``n_shingles`` 0, linked with nothing.
* fewer words than a shingle: the whole word sequence is the one shingle.
* repeated rows and rows that share a ``doc_id``: each is judged by its own text.
* null ``doc_id``: the row takes part; ``component_id`` ignores it and is null only where the
  whole component has none; such a row is kept only there.
* ids may be of any type with an order; an empty table gives an empty result.
* columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import ascii_lower, cut, dealt, heavy_keys, sent, spread_join, written
from folioscope.llm.simhash import components

#: Minimal hashes of a set at most, and bits of its odd sketch.
SAMPLES, BITS = 192, 512
#: A pair at the threshold shares no band, or fails the odd sketch, with these probabilities at most.
MISS, LOST = 1e-6, 1e-7
SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles, in order; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def mixed(values: np.ndarray) -> np.ndarray:
    values = values * SPREAD[1]
    values ^= values >> np.uint64(29)
    values *= SPREAD[0]
    return values ^ values >> np.uint64(32)


def band_shape(similarity: float) -> tuple[int, int]:
    """Rows in a band and bands: the most rows with which pairs at ``similarity`` still meet."""
    fit = [(r, SAMPLES // r) for r in range(1, 17) if (1 - similarity**r) ** (SAMPLES // r) <= MISS]
    return max(fit, default=(1, SAMPLES))


def minima(grams: np.ndarray, size: int) -> np.ndarray:
    """``size`` minimal hashes of a set, each by a function of its own."""
    own = np.arange(1, 2 * size, 2, dtype=np.uint64) * SPREAD[0]
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 512):
        part = (grams[at : at + 512, None] ^ own) * SPREAD[1]
        part ^= part >> np.uint64(29)
        part *= SPREAD[0]
        np.minimum(least, part.min(0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for row in least.reshape(-1, bands):
        keys = mixed(keys ^ row)
    return keys


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The parities of the bits that the samples, by their place and value, hash to; as signed longs."""
    at = mixed(least ^ np.arange(1, len(least) + 1, dtype=np.uint64) * SPREAD[1]) % np.uint64(BITS)
    odd = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def most_odd(similarity: float, size: int) -> int:
    """The XOR population count that pairs at ``similarity`` exceed with a probability of :data:`LOST` at most.

    Each of the samples that differ flips two of the bits; their number is binomial.
    """
    odd, at = np.zeros(BITS + 1), np.arange(BITS + 1)
    odd[0], total = 1.0, np.zeros(BITS + 1)
    for d in range(size + 1):
        total += math.comb(size, d) * (1 - similarity) ** d * similarity ** (size - d) * odd
        for _ in range(2):
            up, down = odd * (BITS - at) / BITS, odd * at / BITS
            odd = np.concatenate(([0.0], up[:-1])) + np.concatenate((down[1:], [0.0]))
    beyond = np.cumsum(total[::-1])[::-1]
    return int(np.argmax(beyond <= LOST)) - 1


def estimate(odd: Column, size: int) -> Column:
    """The similarity that an XOR population count tells."""
    return 1 + F.log(1 - 2 * F.least(odd, F.lit(BITS // 2 - 1)) / BITS) * BITS / (4 * size)


def odd_bits(u: str, v: str) -> Column:
    """The population count of the XOR of two sketches."""
    return sum(F.bit_count(F.get(u, k).bitwiseXOR(F.get(v, k))) for k in range(BITS // 64))


def _likely(percent: int) -> Column:
    """Whether ``n_u, odd_u`` and ``n_v, odd_v`` may belong to a pair at the threshold."""
    sized = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
    return sized & (odd_bits("odd_u", "odd_v") <= most_odd(percent / 100, math.prod(band_shape(percent / 100))))


def _ends(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` (``u, v``) with the columns of ``facts`` (``node`` and others) for either end."""
    u, v = (facts.toDF(*(end if c == "node" else f"{c}_{end}" for c in facts.columns)) for end in "uv")
    return spread_join(pairs, u, ["u"]).join(v.hint("merge"), "v")


def confirmed(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The ``u, v`` of which the full sets are similar; ``grams`` has ``node`` and ``grams``."""
    both = _ends(pairs, grams.select("node", "grams"))
    shared = F.size(F.array_intersect("grams_u", "grams_v"))
    return both.where(100 * shared >= percent * (F.size("grams_u") + F.size("grams_v") - shared)).select("u", "v")


def text_key(text: Column | str) -> list[Column]:
    """128 bits of a text but for the case of A-Z, as columns ``a`` and ``b``."""
    same = ascii_lower(F.coalesce(text, F.lit("")))
    return [F.xxhash64(same).alias("a"), F.xxhash64(F.lit("second"), same).alias("b")]


def sketched(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``node, a, b, low, rows, n, bands, odd``: every different text, its smallest ``doc_id``, and its sketches."""
    rows, bands = band_shape(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, odd = [], [], []
            for text in batch.column("text"):
                grams = shingle_set(text.as_py(), shingle)
                least = minima(grams, rows * bands)
                sizes.append(len(grams))
                keys.append(band_keys(least, bands).view(np.int64))
                odd.append(odd_sketch(least))
            longs = pa.list_(pa.int64())
            made = [pa.array(sizes, pa.int64()), pa.array(keys, longs), pa.array(odd, longs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "a", "b")), *made], ["doc", "a", "b", "n", "bands", "odd"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = docs.select(F.col("doc_id").alias("doc"), *text_key(F.col("text")), "text").mapInArrow(run, f"doc {kind}, a long, b long, n long, bands array<long>, odd array<long>")
    texts = prints.groupBy("a", "b").agg(F.min("doc").alias("low"), F.count(F.lit(1)).alias("rows"), F.first(F.struct("n", "bands", "odd")).alias("p"))
    return cut(texts.select(F.monotonically_increasing_id().alias("node"), "a", "b", "low", "rows", "p.*"))


def shingles_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, grams`` (a written table) of the texts ``wanted`` (``node, a, b, low``); each is read from one of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array([shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), grams], ["node", "grams"])

    keys = ["d", "a", "b"]
    held = docs.select(F.xxhash64("doc_id").alias("d"), *text_key(F.col("text")), "text").groupBy(*keys).agg(F.first("text").alias("text"))
    asked = wanted.select("node", F.xxhash64("low").alias("d"), "a", "b")
    return written(held.join(asked.hint("merge"), keys).select("node", "text").mapInArrow(run, "node long, grams array<long>"), "shingles")


def banded(nodes: DataFrame) -> DataFrame:
    """``key, n, node`` of the bands with two members or more; ``nodes`` has ``node`` and ``bands``."""
    entries = nodes.select("node", F.explode("bands").alias("key"))
    bands = cut(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return cut(spread_join(entries, bands, ["key"], bands))


def hub_pairs(members: DataFrame) -> DataFrame:
    """``u, v``: every member of a band with its hub."""
    popular = members.groupBy("node").agg(F.sum("n").alias("met"))
    ranked = members.join(popular.hint("merge"), "node")
    hubs = cut(ranked.groupBy("key", "n").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("hub")))
    pairs = spread_join(members.drop("n"), hubs.drop("n"), ["key"], hubs.select("key", "n")).where("node <> hub")
    return pairs.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()


def named(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the ``root`` of their component; those without a link are their own."""
    return nodes.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, root`` of the members of bands that hold more than one component."""
    told = cut(named(members.select("key", "node"), roots))
    open_bands = told.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return cut(spread_join(told, open_bands.select("key"), ["key"]).select("node", "root").distinct())


def rare_pairs(left: DataFrame, grams: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """``u, v``: likely pairs of different components among ``left`` (``node, root``), met at their rarest shingles."""
    held = cut(left.join(grams.hint("merge"), "node"))
    heavy = heavy_keys(held.select(F.explode("grams").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), ["key"], least=16)
    often = sorted((r.key, r._parts) for r in heavy.collect()) if heavy is not None else []
    counts = held.sparkSession.sparkContext.broadcast((np.array([k for k, _ in often], np.int64), np.array([n for _, n in often], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = counts.value
        for batch in batches:
            firsts = []
            for grams in batch.column("grams"):
                keys = grams.values.to_numpy()
                at = np.searchsorted(common, keys)
                known = np.zeros(len(keys), bool)
                known[at < len(common)] = common[at[at < len(common)]] == keys[at < len(common)]
                rank = np.zeros(len(keys), np.int64)
                rank[known] = times[at[known]]
                length = len(keys) + -percent * len(keys) // 100 + 1
                firsts.append(keys[np.lexsort((keys, rank))[:length]])
            made = pa.array(firsts, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), made], ["node", "root", "firsts"])

    placed = held.mapInArrow(run, "node long, root long, firsts array<long>").join(facts.hint("merge"), "node")
    entries = cut(placed.select("node", "root", "n", "odd", F.posexplode("firsts").alias("place", "key")))
    shares = entries.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    tops = cut(shares.groupBy("key").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("k", "root")).alias("top")).where("roots > 1"))
    met = cut(spread_join(entries, tops.select("key", "top"), ["key"], tops.select("key", "n")).withColumn("outside", F.col("root") != F.col("top")))
    u, v = (met.select("key", *(F.col(c).alias(f"{c}_{end}") for c in ("node", "root", "n", "odd", "place", "outside"))) for end in "uv")
    rest = F.least(F.col("n_u") - F.col("place_u"), F.col("n_v") - F.col("place_v"))
    fit = (100 + percent) * rest >= percent * (F.col("n_u") + F.col("n_v"))
    once = ~F.col("outside_v") | (F.col("node_u") < F.col("node_v"))
    fit = (F.col("root_u") != F.col("root_v")) & once & fit & _likely(percent)
    crowded = heavy_keys(tops.select("key", "n"), ["key"])
    asking, keys = u.where("outside_u").drop("outside_u"), ["key"]
    if crowded is not None:
        asking, v, keys = dealt(asking, keys, crowded), sent(v, keys, crowded), ["key", "_salt"]
    asking, v = asking.withColumnsRenamed({k: f"{k}_x" for k in keys}), v
    on = [F.col(f"{k}_x") == F.col(k) for k in keys]
    pairs = asking.join(v.hint("merge"), [*on, fit]).select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v"))
    return pairs.distinct()


def linked_components(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, more: DataFrame | None = None) -> DataFrame:
    """``node, root`` of all nodes with a link; ``more`` has further ``u, v`` candidates."""
    facts = nodes.select("node", "n", "odd")
    members = banded(nodes.where("n > 0"))
    pairs = hub_pairs(members)
    wanted = members.select("node")
    if more is not None:
        pairs = pairs.union(more).distinct()
        wanted = wanted.union(more.select("u")).union(more.select("v"))
    grams = shingles_of(docs, nodes.select("node", "a", "b", "low").join(wanted.distinct().hint("merge"), "node"), shingle)
    likely = cut(_ends(cut(pairs), facts).where(_likely(percent)).select("u", "v"))
    roots = components(confirmed(likely, grams, percent))
    left = unsettled(members, roots)
    if left.isEmpty():
        return roots
    late = cut(rare_pairs(left, grams, facts, percent))
    links = cut(confirmed(late, grams, percent))
    if links.isEmpty():
        return roots
    # Only components have to be joined now, those of the new links' ends.
    root = left.select("node", "root")
    between = links.join(root.toDF("u", "root_u").hint("merge"), "u").join(root.toDF("v", "root_v").hint("merge"), "v")
    higher = components(between.select(F.col("root_u").alias("u"), F.col("root_v").alias("v")).distinct()).toDF("root", "higher")
    every = roots.union(left.join(roots.select("node"), "node", "left_anti").select("node", "root"))
    return cut(every.join(higher.hint("merge"), "root", "left").select("node", F.coalesce("higher", "root").alias("root")))


def component_ids(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with ``component_id``, the smallest ``low`` of their component."""
    told = cut(named(nodes, roots))
    lows = cut(told.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n")))
    return spread_join(told, lows.drop("n"), ["root"], lows.select("root", "n")).drop("root")


def near_copies(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row: the groups of texts linked at ``percent`` or more."""
    nodes = sketched(docs, shingle, percent)
    roots = linked_components(docs, nodes, shingle, percent)
    told = cut(component_ids(nodes.select("node", "a", "b", "low", "rows", F.col("n").alias("n_shingles")), roots))
    # Rows without words are one node and linked with nothing, each other included.
    rows = docs.select("doc_id", *text_key(F.col("text")))
    found = spread_join(rows, told.select("a", "b", "n_shingles", "component_id"), ["a", "b"], told.select("a", "b", F.col("rows").alias("n")))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
