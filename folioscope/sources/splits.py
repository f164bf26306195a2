"""Quoted and nested files in many tasks: records that hold line feeds, from files that are cut anywhere.

A file is read in pieces (lines, or what stands between closing braces) by byte ranges, as Spark splits
it.  Where a range begins, it is unknown whether a quotation is open and how deep the braces are.  So a
first pass runs every range from each state it may begin in and says in which it ends; a scan over
ranges, in their order in the file, then gives the state that each really begins in.  The second pass
cuts records.  Of a record that crosses ranges every range gives its part, and parts are joined by the range
in which the record begins.  What the driver sees are three numbers and a path for every range.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = "value string, path string, start long"
#: Digits of a place in a file: of its range, and of the piece in the range.
DIGITS = 18


@dataclass(frozen=True)
class State:
    """``inside`` a quotation, and ``depth`` of the braces (of a quoted table always zero)."""

    inside: bool = False
    depth: int = 0


#: From a piece and the state before it: the state after it, and whether a record ends with it.
Step = Callable[[str, State], tuple[State, bool]]


def quoted_lines(separator: str, quote: str = '"') -> Step:
    """The step over lines of a separated table; a quotation opens at the start of a field only."""
    s, q = re.escape(separator), re.escape(quote)
    field = rf"(?:{q}(?:[^{q}]|{q}{q})*+{q}[^{s}]*+|[^{q}{s}][^{s}]*+|)"
    whole, last = re.compile(rf"(?:{field}{s})*+"), re.compile(rf"(?:{field})$")
    closing = re.compile(rf"(?:[^{q}]|{q}{q})*+{q}[^{s}]*+")

    def step(line: str, state: State) -> tuple[State, bool]:
        if quote not in line:
            return state, not state.inside
        at = 0
        if state.inside:
            closed = closing.match(line)
            if closed is None:
                return state, False
            at = closed.end()
            if at == len(line):
                return State(), True
            at += 1
        at = whole.match(line, at).end()
        done = last.match(line, at) is not None
        return State(not done), done

    return step


_MARKS = re.compile(r'["{}\[\]]')
_ESCAPED = re.compile(r"\\.", re.S)


def braces(base: int) -> Step:
    """The step over pieces of JSON that end before a closing brace; records are the objects at depth ``base``.

    The brace belongs to its piece: every piece but a file's last ends with one.
    """

    def step(piece: str, state: State) -> tuple[State, bool]:
        inside, depth = state.inside, state.depth
        for m in _MARKS.finditer(_ESCAPED.sub("", piece) if "\\" in piece else piece):
            mark = m[0]
            if mark == '"':
                inside = not inside
            elif not inside:
                depth += 1 if mark in "{[" else -1
        return State(inside, depth), not inside and depth == base

    return step


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``value, path, start``: the pieces of all files, with the first byte of their range."""
    return spark.read.option("lineSep", separator).text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """Pieces of one range that come together in a batch."""
    for batch in batches:
        values, paths, starts = (batch.column(c).to_pylist() for c in ("value", "path", "start"))
        at = 0
        for k in range(1, len(values) + 1):
            if k == len(values) or (paths[k], starts[k]) != (paths[at], starts[at]):
                yield paths[at], starts[at], values[at:k]
                at = k


def _ends(df: DataFrame, step: Step, tail: str) -> DataFrame:
    """``path, start, from_inside, inside, depth, low, ended``: what a range does to either state, begun at depth zero.

    ``low`` is the least depth after a piece, ``ended`` whether one ended a record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[tuple[str, int], list] = {}
        for path, start, values in _runs(batches):
            both = now.setdefault((path, start), [[State(inside), 1 << 40, False] for inside in (False, True)])
            for value in values:
                for one in both:
                    one[0], ended = step(value + tail, one[0])
                    one[1] = one[1] if one[0].inside else min(one[1], one[0].depth)
                    one[2] |= ended
        rows = [(p, s, bool(k), state.inside, state.depth, low, ended) for (p, s), both in now.items() for k, (state, low, ended) in enumerate(both)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "start", "from_inside", "inside", "depth", "low", "ended"])

    return df.mapInArrow(run, "path string, start long, from_inside boolean, inside boolean, depth long, low long, ended boolean")


def _begins(ends: DataFrame, base: int) -> dict[tuple[str, int], tuple[State, int | None]]:
    """The state in which each range begins, and the range in which the record that is open there began, if one is."""
    rows = defaultdict(dict)
    for r in ends.collect():
        rows[r.path].setdefault(r.start, {})[r.from_inside] = r
    out = {}
    for path, ranges in rows.items():
        state, owner = State(), None
        for start in sorted(ranges):
            crossed = state.inside or 0 <= base < state.depth
            out[path, start] = state, owner if crossed else None
            r = ranges[start][state.inside]
            closed = r.ended if base < 0 else state.depth + r.low <= base
            owner = owner if crossed and not closed else start
            state = State(r.inside, state.depth + r.depth)
    return out


def records(df: DataFrame, step: Step, tail: str, joint: str, base: int = -1) -> DataFrame:
    """``record, position``: whole records and where they begin; ``position`` sorts as the files do.

    ``base`` is the depth at which braces make records; below zero, the step alone tells.
    """
    told = df.sparkSession.sparkContext.broadcast(_begins(_ends(df, step, tail), max(base, -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[tuple[str, int], dict] = {}
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "start", "line", "owner", "record"])

        out: list[tuple] = []
        for path, start, values in _runs(batches):
            if (path, start) not in ranges:
                state, owner = told.value[path, start]
                ranges[path, start] = {"state": state, "owner": owner, "held": [], "line": 0, "next": 0}
            now = ranges[path, start]
            for value in values:
                now["state"], ended = step(value + tail, now["state"])
                now["held"].append(value + tail)
                now["next"] += 1
                if ended:
                    out.append((path, start, now["line"], now["owner"], joint.join(now["held"])))
                    now |= {"owner": None, "held": [], "line": now["next"]}
            if len(out) >= 5_000:
                yield batch(out)
                out = []
        # What is open at the end of a range goes on in the next one.
        out += [(path, start, now["line"], start if now["owner"] is None else now["owner"], joint.join(now["held"])) for (path, start), now in ranges.items() if now["held"]]
        if out:
            yield batch(out)

    found = df.mapInArrow(run, "path string, start long, line long, owner long, record string")

    def position(start: str, line: str) -> Column:
        return F.concat_ws(":", "path", F.lpad(F.col(start).cast("string"), DIGITS, "0"), F.lpad(F.col(line).cast("string"), DIGITS, "0"))

    whole = found.where("owner IS NULL").select("record", position("start", "line").alias("position"))
    parts = found.where("owner IS NOT NULL").groupBy("path", "owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda x: x["record"]), joint).alias("record"),
        F.min_by("line", "start").alias("line"),
    )
    return whole.union(parts.select("record", position("owner", "line")))
