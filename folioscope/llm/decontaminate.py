"""Benchmark decontamination over a distributed positional inverted index.

The training documents are indexed once, in shards that no shuffle has to move:
a shard holds some documents end to end, with a gap between them that no phrase
can bridge, and for every term of theirs the sorted positions at which it occurs.  The
index is written to the shared folder, or where the caller wants to keep it, and serves
any test items.  Corpus-wide counts tell how rare each test term is; a window is then
looked up in each shard by intersecting the offset-adjusted position lists of its terms,
from the rarest one on.  Exact phrases agree at every offset; near matches have the
first word in place and each other up to ``slop`` words from its own.

Test items are cut into windows in tasks and held against all shards in blocks of about
``block_windows``, the only thing that is broadcast; ``width`` and ``slop`` must stay under
the gap of 64 words together.

Defined results
---------------
* null or empty text has no words: it is never hit, and as an item it has no window.
* a document row is judged by itself; equal rows get equal results.
* items that share an ``item_id`` count once; windows of items with a null
  ``item_id`` mark words but name no item.
* columns other than the ids and texts are ignored; empty tables work on both sides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, scratch_path

#: Every byte to what the words are cut from: A-Z lower-cased, other ASCII but digits and letters blank.
WORD_BYTES = bytes(
    b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32
    for b in range(256)
)
SHARD_WORDS = 1 << 20
#: Windows that begin in one piece of an item.
PIECE = 1 << 14
INDEX = "shard long, doc_ids array<{doc}>, n_words array<int>, terms array<binary>, times array<int>, steps binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The positional postings of every term of every document, one row per shard, written to ``path``.

    By default the path is a new one in the shared folder.  The index can be read again
    and used for any test items.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.int64()
        ids: list = []
        counts: list[int] = []
        found: list[np.ndarray] = []
        terms: defaultdict[bytes, int] = defaultdict()
        terms.default_factory = terms.__len__
        base = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, counts, found, base
            term = np.concatenate(found)
            begins = np.repeat(np.arange(len(counts)) * GAP, counts)
            place = np.arange(len(term)) + begins
            names = list(terms)
            order = np.argsort(term, kind="stable")
            place, times = place[order], np.bincount(term, minlength=len(names))
            starts = np.cumsum(times) - times
            steps = np.diff(place, prepend=0)
            steps[starts] = place[starts]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([0], pa.int64()),
                    pa.array([ids], pa.list_(kind)),
                    pa.array([counts], pa.list_(pa.int32())),
                    pa.array([names], pa.list_(pa.binary())),
                    pa.array([times.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([steps.astype(np.int32).tobytes()], pa.binary()),
                ],
                ["shard", "doc_ids", "n_words", "terms", "times", "steps"],
            )
            ids, counts, found, base = [], [], [], 0
            terms.clear()
            return out

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = words_of(text.as_py())
                found.append(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)))
                ids.append(doc)
                counts.append(len(words))
                base += len(words) + GAP
                if base >= SHARD_WORDS:
                    yield flush()
        if ids:
            yield flush()

    path = path or scratch_path(docs.sparkSession, "positional-index")
    doc = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(shards, INDEX.format(doc=doc))
    rows.withColumn("shard", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def item_pieces(items: DataFrame, width: int) -> DataFrame:
    """``item, words``: the words of the items in pieces of bounded length that share ``width - 1`` words."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column("item"), batch.column("text")):
                words = words_of(text.as_py())
                out += [(item.as_py(), b" ".join(words[at : at + PIECE + width - 1])) for at in range(0, max(1, len(words) - width + 1) if words else 0, PIECE)]
            names, words = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.binary())], ["item", "words"])

    rows = items.select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(cut_up, "item string, words binary").distinct()


class Windows:
    """Distinct windows as rows of term numbers, and the items that have each."""

    def __init__(self, pieces: list[tuple], width: int):
        self.terms: dict[bytes, int] = {}
        number: dict[tuple[int, ...], int] = {}
        owners: list[set[str]] = []
        for item, words in pieces:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words.split()]
            for at in range(max(1, len(ids) - width + 1)):
                k = number.setdefault(tuple(ids[at : at + width]), len(owners))
                if k == len(owners):
                    owners.append(set())
                if item is not None:
                    owners[k].add(item)
        self.rows = [np.array(w, np.int32) for w in number]
        self.items = [sorted(o) for o in owners]


def window_blocks(items: DataFrame, width: int, block_windows: int) -> Iterator[Windows]:
    """The windows of the items in blocks of about ``block_windows``; only one block is on the driver at a time."""
    pieces = cut(item_pieces(items, width))
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("words") / F.lit(4)), F.lit(0))).first()[0]
    n = int(total // block_windows) + 1
    for k in range(n):
        part = pieces if n == 1 else pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k)
        yield Windows([(r.item, bytes(r.words)) for r in part.collect()], width)


#: Words left free between two documents of a shard; more than any window and slop reach over.
GAP = 64


def _within(here: np.ndarray, want: np.ndarray, slop: int) -> np.ndarray:
    """Whether each position of ``want`` has one of ``here`` within ``slop``."""
    left = np.searchsorted(here, want - slop)
    if not len(here):
        return np.zeros(len(want), bool)
    return (left < len(here)) & (here[np.minimum(left, len(here) - 1)] <= want + slop)


def find_window(positions: Callable[[int], np.ndarray], window: list[int], order: list[int], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts at which a window stands in place, and those at which it stands near.

    ``positions`` gives those of a term and ``order`` is from the rarest term of the window on.
    Near means that the first word is in place and each other within ``slop`` of its own.
    """
    k = order[0]
    starts = positions(window[k]) - k
    none = starts[:0]
    # Of two words in their places or near, one stands at most twice the slop from where the other has it.
    for other in order[1:3]:
        starts = starts[_within(positions(window[other]), starts + other, 2 * slop)] if len(starts) else starts
    if not len(starts):
        return none, none
    lists = [positions(t) for t in window]
    if k:
        starts = np.unique(np.concatenate([starts + d for d in range(-slop, slop + 1)]))
        starts = starts[_within(lists[0], starts, 0)]
    for k in order[1:]:
        if not len(starts):
            return none, none
        if k:
            starts = starts[_within(lists[k], starts + k, slop)]
    exact = starts
    for k in order if slop else ():
        exact = exact[_within(lists[k], exact + k, 0)]
    return exact, np.setdiff1d(starts, exact, assume_unique=True)


def match_shards(index: DataFrame, windows: Windows, rarity: dict[int, int], slop: int) -> DataFrame:
    """Per document row of the index: the hit runs, the items and the near matches of one block of windows."""
    seen = np.zeros(max(1, len(windows.terms)), np.int64)
    seen[list(rarity)] = list(rarity.values())
    orders = [np.lexsort((np.arange(len(w)), seen[w])).tolist() for w in windows.rows]
    # A window with a term that no document has cannot be found.
    by_first: dict[int, list[int]] = {}
    for i, (w, order) in enumerate(zip(windows.rows, orders)):
        if seen[w].all():
            by_first.setdefault(int(w[order[0]]), []).append(i)
    vocabulary = pa.array(list(windows.terms), pa.binary())
    shared = index.sparkSession.sparkContext.broadcast((vocabulary, windows.rows, windows.items, orders, by_first))
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, rows, owners, orders, by_first = shared.value
        for batch in batches:
            # One shard at a time: a batch may hold many, and their terms stay in Arrow.
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                times = row["times"].values.to_numpy().astype(np.int64)
                stops, steps = np.cumsum(times), np.frombuffer(row["steps"].as_buffer(), np.int32)
                found = pc.index_in(vocabulary, row["terms"].values)
                here = dict(zip(np.flatnonzero(found.is_valid()).tolist(), found.drop_null().to_pylist()))
                counts = row["n_words"].values.to_numpy().astype(np.int64)
                ends = np.cumsum(counts + GAP)
                lists: dict[int, np.ndarray] = {}

                def positions(term: int) -> np.ndarray:
                    if term not in lists:
                        k = here.get(term)
                        lists[term] = np.empty(0, np.int64) if k is None else np.cumsum(steps[stops[k] - times[k] : stops[k]], dtype=np.int64)
                    return lists[term]

                hits, names, near = [], [[] for _ in counts], np.zeros(len(counts), np.int64)
                for first in here:
                    for i in by_first.get(first, ()):
                        window = rows[i].tolist()
                        starts, close = find_window(positions, window, orders[i], slop)
                        np.add.at(near, np.searchsorted(ends, close, side="right"), 1)
                        if len(starts):
                            hits.append((starts, len(window)))
                            for d in np.unique(np.searchsorted(ends, starts, side="right")).tolist():
                                names[d].extend(owners[i])
                edge = np.zeros(int(ends[-1]) + 1, np.int64)
                for starts, length in hits:
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + length, -1)
                covered = np.cumsum(edge) > 0
                begins = ends - counts - GAP
                runs = []
                for d in range(len(counts)):
                    flags = covered[begins[d] : begins[d] + counts[d]] if hits else covered[:0]
                    turns = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)) if flags.any() else flags[:0]
                    runs.append(turns.astype(np.int64))
                made = [
                    pa.array([row["shard"].as_py()] * len(counts), pa.int64()),
                    pa.array(np.arange(len(counts))),
                    row["doc_ids"].values,
                    pa.array(counts),
                    pa.array(runs, kind),
                    pa.array([sorted(set(n)) for n in names], pa.list_(pa.string())),
                    pa.array(near),
                ]
                yield pa.RecordBatch.from_arrays(made, ["shard", "at", "doc_id", "n_words", "runs", "items", "n_near"])

    doc = index.schema["doc_ids"].dataType.elementType.simpleString()
    return index.mapInArrow(
        run, f"shard long, at long, doc_id {doc}, n_words long, runs array<long>, items array<string>, n_near long"
    )


def term_counts(index: DataFrame, terms: dict[bytes, int]) -> dict[int, int]:
    """How often each of ``terms`` occurs in all documents, by its number; as many entries as the block has terms."""
    if not terms:
        return {}
    wanted = index.sparkSession.createDataFrame([(bytearray(t), k) for t, k in terms.items()], "term binary, number int")
    pairs = index.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("times").alias("n"))).alias("x")).select("x.term", "x.n")
    return {r[0]: r[1] for r in pairs.join(F.broadcast(wanted), "term").groupBy("number").agg(F.sum("n")).collect()}


def contamination(
    docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 2, block_windows: int = 200_000, index: DataFrame | None = None
) -> DataFrame:
    """``doc_id, n_words, runs, items, n_near`` of every document row.

    ``runs`` lists the hit word runs as start and end in turn (end exclusive), ``items``
    the ids of the items with an occurring window, sorted as strings, and ``n_near``
    counts the places at which some window stands near and not in place.  An ``index`` of
    the documents that was built before can be given.
    """
    if not 0 <= width + slop < GAP:
        raise ValueError(f"width and slop must stay under {GAP} words together")
    index = build_index(docs) if index is None else index
    parts = [match_shards(index, w, term_counts(index, w.terms), slop) for w in window_blocks(items, width, block_windows)]
    if len(parts) == 1:
        return parts[0].drop("shard", "at")
    # The index is written, so a row of it has one place; one row per block meets here.
    flags = F.array_sort(F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.struct(F.get(r, i).alias("x"), (i % 2).alias("end"))))))
    whole = reduce(DataFrame.union, parts).groupBy("shard", "at").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.filter(F.collect_list("runs"), lambda r: F.size(r) > 0).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sum("n_near").alias("n_near"),
    )
    return whole.select("doc_id", "n_words", "items", "n_near", flags.alias("edges")).select("doc_id", "n_words", union_runs("edges").alias("runs"), "items", "n_near")


def union_runs(edges: str) -> Column:
    """Begin and end in turn of the runs that the sorted ``edges`` (place, and 1 at an end) of several lists make together."""
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).alias("open"), none.alias("out"))

    def step(state: Column, edge: Column) -> Column:
        now = state["open"] + F.when(edge["end"] == 0, 1).otherwise(-1)
        turn = (state["open"] == 0) | (now == 0)
        return F.struct(now.cast("int").alias("open"), F.when(turn, F.concat(state["out"], F.array(edge["x"]))).otherwise(state["out"]).alias("out"))

    return F.aggregate(F.col(edges), start, step, lambda state: state["out"])


def contamination_digests(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The contract's digest columns per document row."""
    found = contamination(docs, items, **options)
    ends = F.aggregate("runs", F.lit(0).cast("long"), lambda total, x: x - total)
    return found.select(
        "doc_id",
        "n_words",
        ends.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (ends > 0).alias("contaminated"),
        "n_near",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs``, same columns, without the documents that hold a window of a test item.

    Rows with a null ``doc_id`` stay; rows that share one go where any of them is hit.
    """
    gone = contamination(docs, items, slop=0, **options).where(F.size("runs") > 0).select("doc_id").distinct()
    return docs.join(cut(gone.where("doc_id is not null")), "doc_id", "left_anti").select(*docs.columns)
