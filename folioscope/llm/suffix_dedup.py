"""Exact substring dedup by externally sorted suffix arrays.

A byte goes if a string of ``width`` bytes that covers it also starts in a document
with a smaller ``doc_id``.  Passages of some hundred bytes, cut where the bytes say so,
that stand whole in a smaller document go first, by their digests: long copies are then
one span, not one for every segment.  The rest is cut into shards that need no merging:

1. every start of a ``width``-byte string is named by the smallest hash among the
   ``GRAM``-byte strings inside it, so equal strings share a name wherever they are;
2. runs of starts with one name become segments.  Of equal segments that a task holds
   together, the larger documents lose theirs there and then, and only the one of the
   smallest document goes on; tasks pack what is left, compressed, into one row for
   every shard of names;
3. a shard merges equal segments in the same way, leaves out those whose gram and the
   bytes about it are found in one document only, and sorts the suffixes of the others
   in external memory (:mod:`folioscope.llm.suffix_sort`); neighbours whose common
   prefix reaches ``width`` are equal strings, and the smallest document of each group
   is noted;
4. the starts with a smaller document go back to their documents as spans.

A shard is spooled by name into buckets, on disk if it is large, and a bucket that
does not fit is dealt anew.  A passage that a third of all documents share comes to its
shard once for every 16 MB of text, not once for every document.  Temporary files belong
to their task and vanish with it, like a spill; what outlives a task is in Spark's
shuffle.

Defined results
---------------
* null, empty or short text: nothing to remove.
* rows with a null ``doc_id`` lose nothing and take nothing from others.
* rows that share a ``doc_id`` never count as each other's smaller document.
* ``doc_id`` is taken as a long; other columns are ignored or kept as they are.
* an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import fresh_names
from folioscope.llm.suffix_sort import room, sorted_suffixes

GRAM = 12
PIECE = 1 << 20
#: A passage begins at one in so many bytes on average, and so many bytes after another at least.
PASSAGE, APART = 256, 64
#: Spans that a task holds before it hands them on.
SPANS = 1 << 21
#: Documents, row keys, begins and ends.
Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
POSITION = np.uint64(0xFFFF)
#: Starts that are named at once; their grams have places below 1 << 16.
BLOCK = 1 << 15
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _hashes(raw: np.ndarray, at: slice | np.ndarray) -> np.ndarray:
    """A 48-bit hash, above 16 empty bits, of the ``GRAM`` bytes from each position ``at``."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = words[: len(raw) - GRAM + 1][at] * MIX[0] + words[GRAM - 8 :][at] * MIX[1]
    h ^= h >> np.uint64(29)
    h *= MIX[2]
    return h & ~POSITION


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def named_runs(pieces: list[tuple[int, int, bytes]], width: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one name in ``(row, offset, bytes)`` pieces: the joined bytes, piece, start in them, length, name and where the named gram is."""
    raw = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    lengths = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(lengths)
    hashes = _hashes(raw, slice(None))
    gram = np.empty(len(raw) - width + 1, np.int64)
    for s in range(0, len(gram), BLOCK):
        # Of equal grams the leftmost names a string; its place in the block fits below the hash.
        part = hashes[s : s + BLOCK + width - GRAM]
        least = _window_min(part | np.arange(len(part), dtype=np.uint64), width - GRAM + 1)
        gram[s : s + len(least)] = (least & POSITION).view(np.int64) + s
    piece = np.repeat(np.arange(len(pieces)), lengths)[: len(gram)]
    last = ends[piece] - width
    at = np.arange(len(gram))
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(fresh & (at <= last))
    following = np.append(np.flatnonzero(fresh), len(gram))
    stop = np.minimum(following[np.searchsorted(following, first, side="right")], last[first] + 1)
    names = (hashes[gram[first]] >> np.uint64(16)).view(np.int64)
    return raw, piece[first], first, stop - first, names, (gram[first] - first).astype(np.uint8)


def _open_parts(raw: bytes, settled: list[tuple[int, int]], width: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the strings that start in none of the settled passages."""
    at = 0
    for s, e in sorted(settled):
        if at < s:
            yield at, raw[at : s + width - 1]
        at = e - width + 1
    yield at, raw[at:]


def _pieces(texts: Iterator[tuple[bytes, list[tuple[int, int]]]], width: int, limit: int = 2 * PIECE) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of pieces of about ``limit`` bytes of what is not settled; neighbours of a cut text share ``width - 1`` bytes."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row, (raw, settled) in enumerate(texts):
        for begin, part in _open_parts(raw, settled, width):
            for at in range(0, len(part) - width + 1, PIECE):
                held.append((row, begin + at, part[at : at + PIECE + width - 1]))
                size += len(held[-1][2])
                if size >= limit:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def passages(texts: list[bytes], width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end, and text, begin and end there of their passages.

    Passages begin where the bytes say so.  Each overlaps the next by ``width - 1`` bytes,
    so every string of ``width`` bytes starts in one passage and lies in it.
    """
    raw = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    words = np.ndarray((max(0, len(raw) - 7),), "<u8", raw, strides=(1,))
    hit = np.flatnonzero(words * MIX[0] < np.uint64((1 << 64) // PASSAGE))
    of = np.searchsorted(ends, hit, side="right")
    inside = hit + 8 <= ends[of]
    hit, of = hit[inside], of[inside]
    apart = np.ones(len(hit), bool)
    apart[1:] = (np.diff(hit) >= APART) | (np.diff(of) > 0)
    begin = np.union1d(hit[apart], ends - [len(t) for t in texts])
    begin = begin[begin < len(raw)]
    of = np.searchsorted(ends, begin, side="right")
    end = np.minimum(np.append(begin[1:], len(raw)) + width - 1, ends[of])
    whole = end - begin >= width
    return raw, of[whole], begin[whole], end[whole]


def settled_passages(docs: DataFrame, width: int) -> DataFrame:
    """``_doc, _row_key, _settled``: begin and end of the passages that also stand, whole, in a smaller document.

    All that starts in them goes, and what equals it finds it in the smaller document, so
    they need no suffixes.  Of the passages that a task holds together, only the smallest
    document's meet those of other tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc").to_numpy(), batch.column("row_key").to_numpy()
            texts, size, found, first = [], 0, [], 0
            for k, t in enumerate(batch.column("raw")):
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= 2 * PIECE or k == len(ids) - 1:
                    raw, of, begin, end = passages(texts, width)
                    digests = b"".join(hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(begin.tolist(), end.tolist()))
                    base = np.cumsum([0, *map(len, texts)])[of]
                    found.append((np.frombuffer(digests, np.int64).reshape(-1, 2), of + first, begin - base, end - base))
                    texts, size, first = [], 0, k + 1
            if not found:
                continue
            key, of, begin, end = (np.concatenate(x) for x in zip(*found))
            high, low, doc, row_key = key[:, 0].copy(), key[:, 1].copy(), ids[of], rows[of]
            order = np.lexsort((doc, low, high))
            heads = np.flatnonzero(np.concatenate(([len(order) > 0], (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0))))
            lost = np.empty(len(order), bool)
            lost[order] = doc[order] > np.repeat(doc[order[heads]], np.diff(np.append(heads, len(order))))
            # What is lost already meets nothing, so it gets a key of its own.
            high[lost], low[lost] = row_key[lost] ^ (doc[lost].view(np.uint64) * MIX[0]).view(np.int64), begin[lost]
            columns = [high, low, doc, row_key, begin.astype(np.int32), end.astype(np.int32), lost]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["high", "low", "_doc", "_row_key", "s", "e", "lost"])

    texts = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width)).select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row_key"), F.encode("text", "UTF-8").alias("raw")
    )
    found = texts.mapInArrow(run, "high long, low long, _doc long, _row_key long, s int, e int, lost boolean")
    least = F.min("_doc").over(Window.partitionBy("high", "low"))
    settled = found.withColumn("least", least).where("lost OR least < _doc")
    return settled.groupBy("_doc", "_row_key").agg(F.collect_list(F.struct("s", "e")).alias("_settled"))


def compressed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, _doc, _row_key, raw``: the texts of all rows, compressed before they move."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=7)
        for batch in batches:
            raw = pa.array([None if t is None else coder.compress(t) for t in batch.column("raw").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_doc"), batch.column("_row_key"), raw], ["doc_id", "_doc", "_row_key", "raw"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_row_key"), F.encode("text", "UTF-8").alias("raw"))
    return texts.mapInArrow(squeeze, f"doc_id {kind}, _doc long, _row_key long, raw binary")


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of one length, bytes of equal weight side by side, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns), 3)


def _unsqueeze(data: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions ``start`` to ``start + size`` of each row, one row after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(start - (ends - size), size) if len(size) else np.empty(0, np.int64)


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return raw[_ranges(start, size)]


def first_equals(raw: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each segment the one with equal bytes in the smallest document.

    Segments are brought together by a hash and compared with the first of theirs byte by
    byte; one that differs from it (another string with the same hash) stands for itself.
    """
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    steps = range(0, int(size.max(initial=0)), 8)
    h = size.astype(np.uint64)
    for step in steps:
        h = (h ^ words[start + np.minimum(step, size - 8)]) * MIX[0]
        h ^= h >> np.uint64(31)
    order = np.lexsort((doc, h))
    heads = np.flatnonzero(np.concatenate(([len(h) > 0], h[order][1:] != h[order][:-1])))
    rep = np.empty(len(h), np.int64)
    rep[order] = np.repeat(order[heads], np.diff(np.append(heads, len(h))))
    other = np.flatnonzero(rep != np.arange(len(h)))
    a, b, n = start[other], start[rep[other]], size[other]
    same = n == size[rep[other]]
    for step in steps:
        at = np.minimum(step, n - 8)
        same[same] = words[a[same] + at[same]] == words[b[same] + at[same]]
    rep[other[~same]] = other[~same]
    return rep


class Segments(NamedTuple):
    """Distinct segments, their texts end to end, and the owners of each: ``times`` places in its document."""

    name: np.ndarray
    doc: np.ndarray
    gram: np.ndarray
    size: np.ndarray
    times: np.ndarray
    row_key: np.ndarray
    at: np.ndarray
    text: np.ndarray

    @staticmethod
    def joined(parts: list[Segments]) -> Segments:
        return parts[0] if len(parts) == 1 else Segments(*(np.concatenate(c) for c in zip(*parts)))

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    @property
    def nbytes(self) -> int:
        return sum(c.nbytes for c in self)

    def take(self, mine: np.ndarray) -> Segments:
        own = _ranges((np.cumsum(self.times) - self.times)[mine], self.times[mine])
        text = _gather(self.text, self.start[mine], self.size[mine])
        return Segments(*(c[mine] for c in self[:5]), self.row_key[own], self.at[own], text)

    def merged(self) -> tuple[Segments, Spans | None]:
        """One segment for each text, in its smallest document, and the spans that larger documents lose by it."""
        rep = first_equals(self.text, self.start, self.size, self.doc)
        if (rep == np.arange(len(rep))).all():
            return self, None
        of = np.repeat(np.arange(len(rep)), self.times)
        lost = self.doc[rep[of]] < self.doc[of]
        gone = of[lost]
        spans = self.doc[gone], self.row_key[lost], self.at[lost], self.at[lost] + self.size[gone]
        kept = np.flatnonzero(rep == np.arange(len(rep)))
        now = np.full(len(rep), -1)
        now[kept] = np.arange(len(kept))
        own = np.flatnonzero(~lost)
        own = own[np.argsort(now[rep[of[own]]], kind="stable")]
        out = Segments(*(c[kept] for c in self[:4]), np.bincount(now[rep[of[own]]], minlength=len(kept)), self.row_key[own], self.at[own], _gather(self.text, self.start[kept], self.size[kept]))
        return out, spans


def packed_segments(texts: DataFrame, width: int, shards: int, flush_bytes: int = 16 << 20) -> DataFrame:
    """``shard, docs, places, runs, text``: the segments that a task has for a shard, compressed; or in ``done`` spans that are settled.

    ``texts`` are :func:`compressed_texts` with their :func:`settled_passages`, which make
    no segments.  Of equal segments that a task holds at once only those in their smallest document
    leave it.  The larger documents lose all of it, so their spans are known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        whole: list[Spans] = []
        size = 0

        def row(shard: int, *blobs: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], ["shard", "docs", "places", "runs", "text", "done"])

        def done(spans: list[Spans]) -> Iterator[pa.RecordBatch]:
            doc, row_key, begin, end = _joined_spans(tuple(np.concatenate(x) for x in zip(*spans)))
            if len(doc):
                yield row(int(row_key[0] % shards), None, None, None, None, _squeeze(doc, row_key, begin, end))

        def flush() -> Iterator[pa.RecordBatch]:
            raws, doc, row_key, at, start, n, key, gram = (list(x) for x in zip(*held))
            base = np.cumsum([0, *map(len, raws)])
            raw = np.concatenate(raws)
            start = np.concatenate([s + b for s, b in zip(start, base)])
            doc, row_key, at, n, key, gram = map(np.concatenate, (doc, row_key, at, n, key, gram))
            size = n + width - 1
            rep = first_equals(raw, start, size, doc)
            lost = np.flatnonzero(doc[rep] < doc)
            yield from done([*whole, (doc[lost], row_key[lost], at[lost], at[lost] + size[lost])])
            whole.clear()
            left = np.flatnonzero(doc[rep] == doc)
            order = left[np.lexsort((rep[left], key[left] % shards))]
            shard = key[order] % shards
            bounds = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
            for s, e in zip(bounds[:-1], bounds[1:]):
                mine = order[s:e]
                lead = np.flatnonzero(np.concatenate(([True], rep[mine][1:] != rep[mine][:-1])))
                segment, times = rep[mine[lead]], np.diff(np.append(lead, len(mine))).astype(np.int32)
                text = zstandard.compress(_gather(raw, start[segment], size[segment]).tobytes(), 7)
                d, r = doc[mine], row_key[mine]
                heads = np.concatenate(([True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])))
                turns = np.diff(np.append(np.flatnonzero(heads), len(d))).astype(np.int32)
                owners = _squeeze(d[heads], r[heads], turns)
                runs = _squeeze(n[segment].astype(np.uint8), gram[segment], times)
                yield row(int(shard[s]), owners, _squeeze(np.diff(at[mine], prepend=0)), runs, text, None)

        for batch in batches:
            batch = batch.filter(pc.and_(batch.column("_doc").is_valid(), batch.column("raw").is_valid()))
            ids, rows = batch.column("_doc").to_numpy(), batch.column("_row_key").to_numpy()
            settled = [[(x["s"], x["e"]) for x in spans or ()] for spans in batch.column("_settled").to_pylist()]
            of = np.repeat(np.arange(len(ids)), [len(x) for x in settled])
            if len(of):
                whole.append((ids[of], rows[of], *np.array([p for x in settled for p in x], np.int64).T))
            for pieces in _pieces(((zstandard.decompress(t.as_py()), x) for t, x in zip(batch.column("raw"), settled)), width):
                raw, of, start, n, key, gram = named_runs(pieces, width)
                line = np.array([p[0] for p in pieces])[of]
                begin = np.cumsum([0, *(len(p[2]) for p in pieces[:-1])])
                at = start - begin[of] + np.array([p[1] for p in pieces])[of]
                held.append((raw, ids[line], rows[line], at, start, n, key, gram))
                size += len(raw)
                if size >= flush_bytes:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        elif whole:
            yield from done(whole)

    return texts.mapInArrow(run, "shard int, docs binary, places binary, runs binary, text binary, done binary")


def unpacked(row: dict, width: int, shards: int) -> Segments:
    """The segments of one packed row."""
    doc, row_key, turns = _unsqueeze(row["docs"], np.int64, np.int64, np.int32)
    n, gram, times = _unsqueeze(row["runs"], np.uint8, np.uint8, np.int32)
    text = np.frombuffer(zstandard.decompress(row["text"]), np.uint8)
    size, times = n.astype(np.int64) + width - 1, times.astype(np.int64)
    start, owner = np.cumsum(size) - size, np.cumsum(times) - times
    name = (_hashes(text, start + gram) >> np.uint64(16)).view(np.int64) // shards
    at = np.cumsum(_unsqueeze(row["places"], np.int64)[0])
    return Segments(name, np.repeat(doc, turns)[owner], gram.astype(np.int64), size, times, np.repeat(row_key, turns), at, text)


class Spool:
    """Segments by name in buckets that fit in ``memory`` bytes; beyond it they move to unnamed files.

    Equal segments of a bucket are merged before they move.  A bucket that is too large
    is dealt anew by the next digit of its names; one name alone is merged part by part.
    Spans that merging settles are gathered in ``spans`` for the caller to take.
    """

    BUCKETS = 16

    def __init__(self, memory: int, level: int = 0):
        self.memory, self.level, self.held = memory, level, 0
        self.parts: list[list[Segments]] = [[] for _ in range(self.BUCKETS)]
        self.files: list = [None] * self.BUCKETS
        self.sizes = [0] * self.BUCKETS
        self.names: list[set] = [set() for _ in range(self.BUCKETS)]
        self.spans: list[Spans] = []

    def _merged(self, parts: list[Segments]) -> Segments:
        out, spans = Segments.joined(parts).merged()
        if spans is not None:
            self.spans.append(spans)
        return out

    def add(self, segments: Segments) -> None:
        bucket = segments.name // self.BUCKETS**self.level % self.BUCKETS
        for b in np.unique(bucket).tolist():
            part = segments.take(np.flatnonzero(bucket == b))
            self.parts[b].append(part)
            self.names[b].update((int(part.name.min()), int(part.name.max())))
            self.names[b] = {min(self.names[b]), max(self.names[b])}
            self.held += part.nbytes
        if self.held > self.memory:
            for b, parts in enumerate(self.parts):
                if parts:
                    whole = self._merged(parts)
                    self.files[b] = self.files[b] or tempfile.TemporaryFile()
                    pickle.dump(whole, self.files[b], protocol=5)
                    self.sizes[b] += whole.nbytes
                    parts.clear()
            self.held = 0

    def _read(self, b: int) -> Iterator[Segments]:
        if self.files[b] is not None:
            self.files[b].seek(0)
            while True:
                try:
                    yield pickle.load(self.files[b])
                except EOFError:
                    break
            self.files[b].close()
        yield from self.parts[b]
        self.parts[b] = []

    def buckets(self) -> Iterator[Segments]:
        """Every bucket, with all segments of its names."""
        for b in range(self.BUCKETS):
            size = self.sizes[b] + sum(p.nbytes for p in self.parts[b])
            if not size:
                continue
            if size <= self.memory:
                yield Segments.joined(list(self._read(b)))
            elif len(self.names[b]) == 1:
                whole, waiting = None, []
                for part in self._read(b):
                    waiting.append(part)
                    if sum(p.nbytes for p in waiting) > self.memory // 4:
                        whole, waiting = self._merged(waiting if whole is None else [whole, *waiting]), []
                yield self._merged(waiting if whole is None else [whole, *waiting])
            else:
                deeper = Spool(self.memory, self.level + 1)
                deeper.spans = self.spans
                for part in self._read(b):
                    deeper.add(part)
                yield from deeper.buckets()


def sorted_groups(raw: np.ndarray, length: np.ndarray, doc: np.ndarray, width: int, memory: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, start and length of each run of starts in distinct segments that a smaller document has.

    ``raw`` holds the segments end to end, ``doc`` the smallest document of each.
    """
    size = length + 1
    n, begin, start = int(size.sum()), np.cumsum(size) - size, np.cumsum(length) - length
    text = room(n, np.uint16, memory)
    for s in range(0, len(size), 1 << 14):
        # A separator, the smallest symbol, after each segment.
        ends = np.cumsum(length[s : s + (1 << 14)])
        data = raw[start[s] : start[s] + ends[-1]].astype(np.uint16) + 1
        text[begin[s] : begin[s] + len(data) + len(ends)] = np.insert(data, ends, 0)
    owner = room(n, np.int32, memory)
    for s in range(0, len(size), 1 << 14):
        e = min(len(size), s + (1 << 14))
        owner[begin[s] : begin[e - 1] + size[e - 1]] = np.repeat(np.arange(s, e, dtype=np.int32), size[s:e])
    group, least = room(n, np.int64, memory), room(n + 1, np.int64, memory)
    g, none = 0, np.iinfo(np.int64).max
    least[:1] = none
    for position, prefix in sorted_suffixes(text, memory, width):
        of = owner[position]
        whole = position - begin[of] + width < size[of]
        values = np.where(whole, doc[of], none)
        mine = g + np.cumsum(prefix < width)
        group[position] = mine
        bounds = np.flatnonzero(np.diff(mine, prepend=-1))
        mins = np.minimum.reduceat(values, bounds)
        if mine[0] == g:
            mins[0] = min(mins[0], least[g])
        least[mine[bounds]] = mins
        g = int(mine[-1])
    for s in range(0, len(size), 1 << 14):
        e = min(len(size), s + (1 << 14))
        lo, hi = begin[s], begin[e - 1] + size[e - 1]
        row = owner[lo:hi].astype(np.int64)
        at = np.arange(lo, hi) - begin[row]
        live = (at + width < size[row]) & (least[group[lo:hi]] < doc[row])
        row, at = row[live], at[live]
        if len(row):
            begins = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))))
            yield row[begins], at[begins], np.diff(np.append(begins, len(row)))


def shared_sides(segments: Segments, width: int) -> np.ndarray:
    """The segments whose gram and enough bytes about it are found in more than one document.

    A string that holds the gram has some number of its other bytes after it.  For each
    range of that number there is a window that every such string covers; two equal
    strings agree on one of them.
    """
    text, begin, size, gram = segments.text, segments.start, segments.size, segments.gram
    other = width - GRAM
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    cuts = [0, other // 4, other // 2, 3 * other // 4, other + 1]
    kept = np.zeros(len(size), bool)
    for after, beyond in zip(cuts, cuts[1:]):
        before = other + 1 - beyond
        known = np.flatnonzero((gram >= before) & (gram + GRAM + after <= size))
        start, span = (begin + gram - before)[known], before + GRAM + after
        h = np.zeros(len(known), np.uint64)
        for offset in [*range(0, span - 8, 8), span - 8]:
            h = (h ^ words[start + offset]) * MIX[0]
            h ^= h >> np.uint64(31)
        order = np.argsort(h, kind="stable")
        heads = np.flatnonzero(np.concatenate(([len(h) > 0], h[order][1:] != h[order][:-1])))
        if len(heads):
            of = segments.doc[known[order]]
            many = np.minimum.reduceat(of, heads) < np.maximum.reduceat(of, heads)
            kept[known[order[np.repeat(many, np.diff(np.append(heads, len(order))))]]] = True
    return np.flatnonzero(kept)


def varied_segments(bucket: Segments, width: int) -> tuple[Segments | None, Spans | None]:
    """What of a bucket has to be sorted, and the spans that need no sorting."""
    kept = shared_sides(bucket, width)
    if not len(kept):
        return None, None
    distinct, spans = bucket.take(kept).merged()
    distinct = distinct.take(shared_sides(distinct, width))
    return (distinct if len(distinct.name) else None), spans


def sorted_spans(segments: Segments, width: int, memory: int) -> Iterator[Spans]:
    """The spans that the owners of distinct segments lose to smaller documents, from the sorted suffixes."""
    found = list(sorted_groups(segments.text, segments.size, segments.doc, width, memory))
    if not found:
        return
    row, start, n = (np.concatenate(x) for x in zip(*found))
    owner = np.cumsum(segments.times) - segments.times
    for s in range(0, len(row), 1 << 18):
        r, b, m = row[s : s + (1 << 18)], start[s : s + (1 << 18)], n[s : s + (1 << 18)]
        times = segments.times[r]
        own = _ranges(owner[r], times)
        r, b, m = np.repeat(r, times), np.repeat(b, times), np.repeat(m, times)
        at = segments.at[own] + b
        yield segments.doc[r], segments.row_key[own], at, at + m - 1 + width


def _joined_spans(spans: Spans) -> Spans:
    """Spans in order, with those that touch made one; of two spans of a row the later must not end first."""
    doc, row_key, begin, end = spans
    order = np.lexsort((begin, row_key, doc))
    doc, row_key, begin, end = doc[order], row_key[order], begin[order], end[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (row_key[1:] != row_key[:-1]) | (begin[1:] > end[:-1])
    heads = np.flatnonzero(head)
    return doc[heads], row_key[heads], begin[heads], np.maximum.reduceat(end, heads) if len(heads) else end


def _span_rows(spans: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    doc, row_key, begin, end = (np.concatenate(x) for x in zip(*spans))
    order = np.lexsort((begin, row_key, doc))
    doc, row_key, begin, end = doc[order], row_key[order], begin[order], end[order]
    heads = np.flatnonzero(np.concatenate(([len(doc) > 0], (doc[1:] != doc[:-1]) | (row_key[1:] != row_key[:-1]))))
    offsets = pa.array(np.append(heads, len(doc)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (begin, end)]
    return pa.RecordBatch.from_arrays([pa.array(doc[heads]), pa.array(row_key[heads]), *lists], ["doc", "row_key", "s", "e"])


def repeated_spans(docs: DataFrame, width: int = 50, memory: int = 64 << 20, shards: int | None = None, texts: DataFrame | None = None) -> DataFrame:
    """``doc, row_key, spans``: begins and ends, by twos, of unmerged byte spans of repeats, for the documents that have any.

    Begins and ends come in lists of lists, one for each shard that found some and for
    each pack of settled ones.  ``texts`` are the
    :func:`compressed_texts` of ``docs``, if the caller needs them too.
    """
    if not GRAM + 8 <= width <= 200:
        raise ValueError(f"width must lie between {GRAM + 8} and 200 bytes")
    shards = shards or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool, waiting = Spool(memory), []

        def settled(spans: list[Spans], least: int) -> Iterator[pa.RecordBatch]:
            if spans and sum(len(p[0]) for p in spans) >= least:
                yield _span_rows(spans)
                spans.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if row["done"] is not None:
                    yield _span_rows([tuple(_unsqueeze(row["done"], np.int64, np.int64, np.int64, np.int64))])
                else:
                    spool.add(unpacked(row, width, shards))
                    yield from settled(spool.spans, SPANS)
        for bucket in spool.buckets():
            varied, spans = varied_segments(bucket, width)
            if spans is not None:
                spool.spans.append(spans)
            if varied is not None:
                waiting.append(varied)
            # Small buckets are sorted together.
            if sum(len(w.text) for w in waiting) > memory // 16:
                spool.spans.extend(sorted_spans(Segments.joined(waiting), width, memory))
                waiting = []
            yield from settled(spool.spans, SPANS)
        if waiting:
            spool.spans.extend(sorted_spans(Segments.joined(waiting), width, memory))
        yield from settled(spool.spans, 0)

    texts = compressed_texts(docs) if texts is None else texts
    open_texts = texts.join(settled_passages(docs, width), ["_doc", "_row_key"], "left")
    packed = packed_segments(open_texts, width, shards).repartitionById(shards, "shard")
    rows = packed.mapInArrow(run, "doc long, row_key long, s array<int>, e array<int>")
    return rows.groupBy("doc", "row_key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _pairs(spans: list) -> Iterator[tuple[int, int]]:
    return (p for x in spans for p in zip(x["s"], x["e"]))


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in spans:
        parts.append(raw[at:s])
        at = e
    parts.append(raw[at:])
    return b"".join(parts)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs``, same columns, without the repeated bytes; a character that loses a byte goes whole."""

    @F.pandas_udf("string")
    def shorten(texts: pd.Series, spans: pd.Series) -> pd.Series:
        made = (None if t is None else t if s is None else _kept(t.encode(), _merged(_pairs(s))).decode(errors="ignore") for t, s in zip(texts, spans))
        return pd.Series(list(made), index=texts.index, dtype=object)

    doc, key, held = fresh_names(docs.columns, "doc", "key", "spans")
    found = repeated_spans(docs, **options).toDF(doc, key, held)
    on = (docs["doc_id"].cast("long") == found[doc]) & (F.xxhash64(docs["text"]) == found[key])
    marked = docs.join(found, on, "left")
    return marked.withColumn("text", shorten("text", held)).select(*docs.columns)


def repeat_digests(docs: DataFrame, **options) -> DataFrame:
    """The contract's digest columns per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("raw"), batch.column("_spans")):
                raw = zstandard.decompress(text.as_py()) if text.is_valid else b""
                cuts = _merged(_pairs(spans.as_py() or ()))
                rest = _kept(raw, cuts)
                out.append((len(raw), len(raw) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), ",".join(f"{s}-{e}" for s, e in cuts)))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    packed = compressed_texts(docs)
    found = repeated_spans(docs, texts=packed, **options).select(F.col("doc").alias("_doc"), F.col("row_key").alias("_row_key"), F.col("spans").alias("_spans"))
    return packed.join(found, ["_doc", "_row_key"], "left").select("doc_id", "raw", "_spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
    )
