"""External induced suffix sorting with common-prefix values.

A text of symbols is sorted in four steps, none of which needs it in memory:

1. suffixes of type S whose predecessor is larger (``lms``) are found in one
   backward scan;
2. the pieces between them are sorted by induction and named;
3. if names repeat, the text of names is sorted by recursion, or in memory once
   it is small enough;
4. the order of all suffixes is induced from that of the ``lms`` ones: smaller
   suffixes put their predecessors into a priority queue by first symbol, once
   upwards for type L and once downwards for type S.

The queues hold (symbol, position, common prefix) in blocks; beyond
``memory`` bytes they move to an unnamed file that lasts as long as the sort.
The common prefix of two neighbours induced from one bucket is one more than the
least value between their successors, so it travels with the tuples.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 16
NO_LIMIT = 255
Piece = tuple[np.ndarray, np.ndarray]


def room(n: int, kind, memory: int) -> np.ndarray:
    """An array of ``n``; in an unnamed file if it is larger than ``memory`` bytes."""
    if n * np.dtype(kind).itemsize <= memory:
        return np.empty(n, kind)
    with tempfile.TemporaryFile() as file:
        file.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(file, kind, "r+", shape=(n,))


class SymbolQueue:
    """Tuples by symbol, smallest first, and in order of arrival for each symbol."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file, self.end = memory, 0, None, 0
        self.parts: dict[int, list] = {}
        self.symbols: list[int] = []

    def push(self, symbol: int, position: np.ndarray, prefix: np.ndarray) -> None:
        if symbol not in self.parts:
            self.parts[symbol] = []
            heapq.heappush(self.symbols, symbol)
        self.parts[symbol].append((position, prefix))
        self.held += position.nbytes + prefix.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        for parts in self.parts.values():
            k = len(parts)
            while k and isinstance(parts[k - 1][0], np.ndarray):
                k -= 1
            if k < len(parts):
                position = np.concatenate([p for p, _ in parts[k:]])
                prefix = np.concatenate([c for _, c in parts[k:]])
                self.file.write(position.astype(np.int64).tobytes() + prefix.astype(np.uint8).tobytes())
                parts[k:] = [(self.end, len(position))]
                self.end += 9 * len(position)
        self.held = 0

    def first(self) -> int | None:
        while self.symbols and self.symbols[0] not in self.parts:
            heapq.heappop(self.symbols)
        return self.symbols[0] if self.symbols else None

    def _read(self, at: int, n: int, start: int, stop: int) -> Piece:
        self.file.seek(at + 8 * start)
        position = np.frombuffer(self.file.read(8 * (stop - start)), np.int64)
        self.file.seek(at + 8 * n + start)
        return position, np.frombuffer(self.file.read(stop - start), np.uint8)

    def pop(self, symbol: int, backwards: bool = False) -> Iterator[Piece]:
        """The tuples of a symbol in blocks, oldest first or, ``backwards``, latest first."""
        parts = self.parts.pop(symbol, [])
        turn = slice(None, None, -1 if backwards else 1)
        waiting: list[Piece] = []
        size = 0

        def joined() -> Iterator[Piece]:
            ready = waiting[turn]
            position = np.concatenate([p for p, _ in ready]) if len(ready) > 1 else ready[0][0]
            prefix = np.concatenate([c for _, c in ready]) if len(ready) > 1 else ready[0][1]
            for s in range(0, len(position), BLOCK)[turn]:
                yield position[s : s + BLOCK][turn], prefix[s : s + BLOCK][turn]

        for a, b in parts[turn]:
            if isinstance(a, np.ndarray):
                self.held -= a.nbytes + b.nbytes
                waiting.append((a, b))
                size += len(a)
                if size < BLOCK:
                    continue
            if waiting:
                yield from joined()
                waiting, size = [], 0
            if not isinstance(a, np.ndarray):
                for s in range(0, b, BLOCK)[turn]:
                    position, prefix = self._read(a, b, s, min(b, s + BLOCK))
                    yield position[turn], prefix[turn]
        if waiting:
            yield from joined()


class Prefixes:
    """The least common prefix since each symbol was last fed, and so the prefixes of what is induced."""

    def __init__(self, cap: int, symbols: int):
        self.cap, self.narrow = cap, symbols < 1 << 16
        self.since = np.zeros(symbols if cap else 0, np.uint8)

    def feed(self, queue: SymbolQueue, sign: int, prefix: np.ndarray, at: np.ndarray, symbol: np.ndarray, position: np.ndarray) -> None:
        """Puts ``position`` under ``symbol``; ``at`` tells where in the scanned block its successor stands."""
        order = np.argsort(symbol.astype(np.uint16) if self.narrow else symbol, kind="stable")
        symbol, position, at = symbol[order], position[order], at[order]
        bounds = np.concatenate(([0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1, [len(symbol)] if len(symbol) else []))
        bounds = bounds.astype(np.int64)
        if not self.cap:
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                queue.push(sign * int(symbol[s]), position[s:e], np.zeros(e - s, np.uint8))
            return
        least = prefix.min() if len(prefix) else NO_LIMIT
        before = self.since.copy()
        np.minimum(self.since, least, out=self.since)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            c, here = int(symbol[s]), at[s:e]
            cuts = np.concatenate(([0], here + 1))
            open_end = cuts[-1] < len(prefix)
            mins = np.minimum.reduceat(prefix, cuts if open_end else cuts[:-1])
            values = mins[: e - s]
            values[0] = min(values[0], before[c])
            self.since[c] = mins[-1] if open_end else NO_LIMIT
            queue.push(sign * c, position[s:e], np.minimum(values.astype(np.int16) + 1, self.cap).astype(np.uint8))


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` share, ``cap`` at most."""
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    for k in range(cap):
        live = live[(a[live] + k < len(text)) & (b[live] + k < len(text))]
        live = live[text[a[live] + k] == text[b[live] + k]]
        if not len(live):
            break
        out[live] += 1
    return out


def induce(text: np.ndarray, seeds: SymbolQueue, memory: int, cap: int, symbols: int) -> Iterator[Piece]:
    """All suffixes from the largest down, with the prefix each shares with the one before in this order."""

    def edge(last: int, block: Piece) -> Piece:
        """The first prefix of a block that follows suffix ``last`` of the same symbol (-1: of none)."""
        if not cap:
            return block
        prefix = block[1].copy()
        prefix[0] = 0 if last < 0 else common_prefix(text, np.array([last]), block[0][:1], cap)[0]
        return block[0], prefix

    def before(block: Piece) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(block[0] > 0)
        return at, text[block[0][at] - 1].astype(np.int64)

    n = len(text)
    up, large, state = SymbolQueue(memory), SymbolQueue(memory), Prefixes(cap, symbols)
    up.push(int(text[n - 1]), np.array([n - 1]), np.zeros(1, np.uint8))
    while True:
        nexts = [c for c in (up.first(), seeds.first()) if c is not None]
        if not nexts:
            break
        c, last = min(nexts), -1
        while c in up.parts:
            for block in up.pop(c):
                block = edge(-1, block) if last < 0 else block
                last = int(block[0][-1])
                large.push(-c, *block)
                at, symbol = before(block)
                keep = symbol >= c
                state.feed(up, 1, block[1], at[keep], symbol[keep], block[0][at[keep]] - 1)
        head = True
        for block in seeds.pop(c):
            block = edge(last, block) if head else block
            head = False
            at, symbol = before(block)
            state.feed(up, 1, block[1], at, symbol, block[0][at] - 1)
    down, state = SymbolQueue(memory), Prefixes(cap, symbols)
    while True:
        nexts = [c for c in (down.first(), large.first()) if c is not None]
        if not nexts:
            return
        c, last = -min(nexts), -1
        while -c in down.parts:
            for block in down.pop(-c):
                block = edge(-1, block) if last < 0 else block
                last = int(block[0][-1])
                yield block
                at, symbol = before(block)
                keep = symbol <= c
                state.feed(down, -1, block[1], at[keep], symbol[keep], block[0][at[keep]] - 1)
        above: int | None = None  # the prefix that the last suffix shares with the next one down
        for position, prefix in large.pop(-c, backwards=True):
            shared = np.empty_like(prefix)
            shared[1:] = prefix[:-1]
            if above is None:
                shared[0] = 0 if last < 0 or not cap else common_prefix(text, np.array([last]), position[:1], cap)[0]
            else:
                shared[0] = above
            above = int(prefix[-1])
            yield position, shared
            at, symbol = before((position, shared))
            keep = symbol < c
            state.feed(down, -1, shared, at[keep], symbol[keep], position[at[keep]] - 1)


def find_lms(text: np.ndarray, memory: int) -> np.ndarray:
    """The positions, in order, of type S whose predecessor is larger."""
    n, small, found = len(text), False, []
    for end in range(n, 0, -BLOCK * 16):
        start = max(0, end - BLOCK * 16)
        here = np.asarray(text[start:end]).astype(np.int64)
        after = np.append(here[1:], text[end] if end < n else -1)
        sign = np.sign(after - here)
        if end < n and sign[-1] == 0:
            sign[-1] = 1 if small else -1
        where = np.where(sign != 0, np.arange(len(here)), len(here))
        next_change = np.minimum.accumulate(where[::-1])[::-1]
        is_small = sign[np.minimum(next_change, len(here) - 1)] > 0
        previous = np.concatenate(([text[start - 1]] if start else [-1], here[:-1]))
        found.append(np.flatnonzero(is_small & (previous > here)) + start)
        small = bool(is_small[0])
    out = room(sum(map(len, found)), np.int64, memory)
    at = 0
    for part in reversed(found):
        out[at : at + len(part)] = part
        at += len(part)
    return out


def name_pieces(text: np.ndarray, order: np.ndarray, lms: np.ndarray, rank: np.ndarray, memory: int) -> tuple[np.ndarray, int]:
    """The names, in text order, of the pieces from each ``lms`` position to the next, and how many there are."""
    names = room(len(lms), np.int64, memory)
    name = -1
    for start in range(0, len(order), BLOCK * 4):
        stop = min(len(order), start + BLOCK * 4)
        now = np.asarray(order[start:stop])
        last = np.asarray(order[max(0, start - 1) : stop - 1]) if start else np.insert(now[:-1], 0, now[0])
        i, j = rank[now], rank[last]

        def length(k: np.ndarray) -> np.ndarray:
            known = k + 1 < len(lms)
            return np.where(known, lms[np.minimum(k + 1, len(lms) - 1)] - lms[k] + 1, -1)

        size, size_before = length(i), length(j)
        same = (size == size_before) & (size > 0)
        if not start:
            same[0] = False
        live, k = np.flatnonzero(same), 0
        while len(live):
            live = live[size[live] > k]
            differ = text[now[live] + k] != text[last[live] + k]
            same[live[differ]] = False
            live, k = live[~differ], k + 1
        steps = name + np.cumsum(~same)
        names[i] = steps
        name = int(steps[-1])
    return names, name + 1


def sort_in_memory(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a text that fits in memory, by doubling the compared length."""
    n, reach = len(names), 1
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    while True:
        follow = np.zeros(n, np.int64)
        follow[:-reach] = rank[reach:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        rank, reach = fresh, reach * 2
        if rank[order[-1]] == n - 1 or reach >= n:
            return order


def _seeded(text: np.ndarray, order: np.ndarray, memory: int, cap: int) -> SymbolQueue:
    seeds = SymbolQueue(memory)
    for start in range(0, len(order), BLOCK):
        now = np.asarray(order[start : start + BLOCK])
        last = np.asarray(order[max(0, start - 1) : start + len(now) - 1])
        prefix = np.zeros(len(now), np.uint8)
        if cap:
            prefix[len(now) - len(last) :] = common_prefix(text, last, now[len(now) - len(last) :], cap)
        symbol = text[now].astype(np.int64)
        group = np.argsort(symbol, kind="stable")
        bounds = np.append(np.flatnonzero(np.diff(symbol[group], prepend=-1)), len(now))
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            seeds.push(int(symbol[group[s]]), now[group[s:e]], prefix[group[s:e]])
    return seeds


def sorted_suffixes(text: np.ndarray, memory: int = 64 << 20, cap: int = 0) -> Iterator[Piece]:
    """Blocks of suffix positions, largest suffix first, with the prefix each shares with the one before it.

    ``text`` holds non-negative integers and may be a memory-mapped file; prefixes
    are counted up to ``cap`` (254 at most; 0: not at all).  A suffix that is a prefix of
    another comes after it in this order.
    """
    if not len(text):
        return
    symbols = int(text.max()) + 1
    lms = find_lms(text, memory)
    order = room(len(lms), np.int64, memory)
    if len(lms):
        at, rank = len(lms), room(len(text), np.int64, memory)
        rank[:] = -1
        for s in range(0, len(lms), BLOCK):
            rank[lms[s : s + BLOCK]] = np.arange(s, min(len(lms), s + BLOCK))
        for position, _ in induce(text, _seeded(text, lms, memory, 0), memory, 0, symbols):
            found = position[rank[position] >= 0]
            order[at - len(found) : at] = found[::-1]
            at -= len(found)
        names, kinds = name_pieces(text, order, lms, rank, memory)
        if kinds < len(lms):
            if len(lms) * 64 <= memory:
                order[:] = lms[sort_in_memory(names)]
            else:
                at = len(lms)
                for position, _ in sorted_suffixes(names, memory):
                    order[at - len(position) : at] = lms[position[::-1]]
                    at -= len(position)
    yield from induce(text, _seeded(text, order, memory, cap), memory, cap, symbols)
