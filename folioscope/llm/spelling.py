"""Spelling variants: words one error apart, found by forward and backward minimal automata.

Of two words that differ by one inserted, deleted or replaced character, either the first half
of one is the start of the other or its second half is the end of the other.  So every word
stands in the index under the starts and the ends, of the two lengths that a half can have
among words of about its length, and asks once under its own start and once under its own end.
Starts and ends are dealt to shards; one under which very many words stand is dealt to several
(a word of it to one of them, its questions to all), so no shard grows with a popular start.

A shard holds one minimal acyclic automaton of its words for starts and one of the reversed words
for ends.  Each arc tells how many words lie before it, so a path adds up to the place of its word
in sorted order, a perfect hash into the counts.  A question walks its half exactly and completes it
with one error; numbers reached twice count once, and what the forward search has found is left
out of the backward one, so shards return sums for each asking word and no pairs are shuffled.

Defined results
---------------
* null or empty text, and text without letters: no words.  A null ``doc_id`` counts as empty in
  the name of a run.
* repeated rows: each counts its occurrences.
* a run without any other near word: ``n_near`` 0, ``form`` null, ``root`` the word itself.
* no limit on the length of a run or text; an empty table gives an empty result.
* other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import ascii_lower, cut, dealt, heavy_keys, sent, spread_join

RUN = r"[A-Za-zÀ-ÿ]+"
#: Index entries of a shard, about; and of one start or end before it is dealt to several.
SHARD, CROWD = 60_000, 10_000
KEYS = ["backward", "half"]


class Automaton:
    """The minimal acyclic automaton of sorted, different words, with their numbers in that order."""

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._held: list[int] = []
        self._known: dict[tuple, int] = {}
        path, before = [(False, [])], ""
        for word in words:
            shared = 0
            while shared < len(before) and before[shared] == word[shared]:
                shared += 1
            self._close(path, before, shared)
            path += [(False, []) for _ in range(len(word) - shared)]
            path[-1] = (True, path[-1][1])
            before = word
        self._close(path, before, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, word: str, depth: int) -> None:
        """Ends the states of ``path`` below ``depth``: no later word passes them."""
        while len(path) > depth + 1:
            state = self._state(*path.pop())
            path[-1][1].append((word[len(path) - 1], state))

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        """The state with these arcs, a new one only where there is none like it."""
        sort = (final, *arcs)
        if sort not in self._known:
            numbered, before = {}, int(final)
            for char, target in arcs:
                numbered[char] = (target, before)
                before += self._held[target]
            self._known[sort] = len(self.arcs)
            self.arcs.append(numbered)
            self.final.append(final)
            self._held.append(before)
        return self._known[sort]

    def walk(self, state: int, number: int, word: str, at: int, end: int) -> tuple[int, int] | None:
        """Where ``word[at:end]`` leads, and the number gathered; None if nowhere."""
        arcs = self.arcs
        for i in range(at, end):
            step = arcs[state].get(word[i])
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, word: str, half: int) -> set[int]:
        """The numbers of the words that have the first ``half`` characters of ``word`` and differ by one after them."""
        size, found = len(word), set()
        here = self.walk(self.start, 0, word, 0, half)
        for i in range(half, size + 1):
            if here is None:
                break
            ends = []
            # Of equal characters side by side, leaving out or doubling the first does for all.
            twin = word[i - 1] if i > half else ""
            if i < size and word[i] != twin:
                ends.append(self.walk(*here, word, i + 1, size))
            for char, (target, before) in self.arcs[here[0]].items():
                number = here[1] + before
                if char != twin:
                    ends.append(self.walk(target, number, word, i, size))
                if i < size and char != word[i]:
                    ends.append(self.walk(target, number, word, i + 1, size))
            found.update(e[1] for e in ends if e is not None and self.final[e[0]])
            here = self.walk(*here, word, i, i + 1) if i < size else None
        return found


def counted_words(docs: DataFrame, least_length: int = 5, least: int = 3, damage: int | None = None) -> DataFrame:
    """``word, n`` of the lower-cased runs of letters; one in ``damage`` loses a character, by its hash."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN), F.lit(0))).alias("run"))
    word: Column = ascii_lower(F.col("run"))
    if damage:
        named = runs.select(word.alias("run"), F.crc32(F.concat("doc", F.lit(":"), word)).alias("h"))
        place = (F.col("h") % F.length("run")).cast("int")
        cut_out = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
        runs, word = named, F.when(F.col("h") % damage == 0, cut_out).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _entries(words: DataFrame) -> DataFrame:
    """``backward, half, way, n, asks``: each word, reversed where ``backward``, under the halves by which a near word may ask."""
    size = F.length("word")

    def under(backward: bool, length: Column, asks: Column) -> Column:
        way = F.reverse("word") if backward else F.col("word")
        return F.struct(F.lit(backward).alias("backward"), F.substr(way, F.lit(1), length.cast("int")).alias("half"), way.alias("way"), asks.alias("asks"))

    half, odd = F.floor(size / 2), size % 2 == 1
    rows = F.array(
        under(False, half, F.lit(True)),
        under(False, F.when(odd, half + 1).otherwise(half - 1), F.lit(False)),
        under(True, half, ~odd),
        under(True, half + 1, odd),
    )
    return words.select("n", F.explode(rows).alias("x")).select("x.*", "n")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers the questions of one shard from its own automata."""
    index: dict[tuple, dict[str, int]] = defaultdict(dict)
    questions: dict[tuple, list[str]] = defaultdict(list)
    for batch in batches:
        for backward, half, way, asks, n, salt in zip(*(batch.column(c).to_pylist() for c in ("backward", "half", "way", "asks", "n", "_salt"))):
            if asks:
                questions[backward, len(half), salt].append(way)
            else:
                index[backward, len(half), salt][way] = n
    for key in list(questions):
        counts = index.pop(key, {})
        words = sorted(counts)
        automaton, out = Automaton(words), []
        backward, half, _ = key
        for way in questions.pop(key):
            near = [words[k] for k in automaton.one_error(way, half)]
            if backward:
                # Those that share the first half too were met going forward.
                near = [w for w in near if not w.endswith(way[half:])]
            if near:
                best = max(counts[w] for w in near)
                form = min(w[::-1] if backward else w for w in near if counts[w] == best)
                out.append((way[::-1] if backward else way, len(near), best, form))
        if out:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, n_near, best_n, best``: how many words are near, and the most frequent of them (of equals the first)."""
    entries = cut(_entries(words))
    counts = entries.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    heavy = heavy_keys(counts, KEYS, CROWD)
    index, asking = entries.withColumn("asks", F.lit(False)), entries.where("asks")
    if heavy is None:
        both = index.union(asking).withColumn("_salt", F.lit(0))
    else:
        both = dealt(index, KEYS, heavy).unionByName(sent(asking, KEYS, heavy))
    shards = max(words.sparkSession.sparkContext.defaultParallelism, -(-entries.count() // SHARD))
    found = both.repartition(shards, *KEYS, "_salt").mapInArrow(_search, "word string, n_near long, best_n long, best string")
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    every = rows.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best"))
    first = F.min(F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best")))
    merged = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), first.alias("b"))
    return merged.select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of ``form`` from every ``word``; each round doubles how far a word sees."""
    seen = cut(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        higher = seen.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        after = cut(spread_join(seen, higher, ["root"]).select("word", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")))
        seen = after.select("word", "root")
        if after.where("moved").isEmpty():
            return seen


def spelling_variants(docs: DataFrame, ratio: int = 2, **options) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word with the near one that is ``ratio`` times as frequent, if any.

    Counts rise along ``form``, so chains end.
    """
    words = cut(counted_words(docs, **options))
    holds = F.col("best_n") >= ratio * F.col("n")
    near = near_words(words)
    forms = cut(near.select("word", F.when(holds, F.col("best")).alias("form"), "n", "n_near", F.when(holds, F.col("best_n")).alias("form_n")))
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
