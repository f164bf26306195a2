"""Quality rules whose cutoffs are certified on labelled holdouts.

Features are counted per document in Arrow batches.  Each rule rejects a
document whose feature lies over a cutoff.  The grids of the rules make one fixed
sequence from lenient to strict: all rules at their first cutoff, one after the
other, then all at their second, and so on.  Each step adds one cutoff to those
before it.  For every stratum and step, the labelled good documents that any of the
cutoffs so far would reject are counted; a step is certified if the exact binomial
test rejects "at least ``alpha`` of the good documents are rejected" at level
``delta / strata``.  As the steps are nested and testing ends at the first that
fails, no correction over steps is due, and as each step is about all rules
together, ``alpha`` is not divided among them.  The cutoffs of the last certified
step are applied.  A stratum needs ``log(delta / strata) / log(1 - alpha)`` good
labels to certify anything (437 with four strata and the defaults).

Defined results
---------------
* null or empty text: no words, so ``base_failed``.
* null stratum: a stratum of its own.
* a document labelled more than once is good only if every label says so; labels
  with a null ``doc_id`` or ``quality`` are left out.
* strata without enough labelled documents get no cutoff: only the base rule holds.
* each row is judged by itself; equal rows get equal results.
* columns other than ``doc_id``, ``text`` and the stratum are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, fresh_names

SYMBOLS = b"#*$%&|<>"
#: Rules by name: the feature as SQL, and the grid of cutoffs from lenient to strict.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": ("n_symbols / n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05)),
    "marks_per_word": ("n_marks / n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05)),
    "capital_share": ("n_capitals / word_chars", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15)),
    "repeat_share": ("n_repeat_words / n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "dup_line_share": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "chars_per_word": ("word_chars / n_words", (60.0, 40.0, 30.0, 25.0, 20.0, 17.5, 15.0, 12.5, 11.0, 10.0)),
}
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_capitals long"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
NOT_BLANK = b" \t\n\x0b\x0c\r"


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def _features(text: str | None) -> tuple[int, ...]:
    if not text:
        return 0, 0, 0, 0, 0, 1, 0, 0
    raw = text.encode()
    words = raw.split()
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    dup_lines = 0
    for line in lines:
        if line in seen:
            dup_lines += bool(line.split(None, 1))
        else:
            seen.add(line)
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, NOT_BLANK))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        dup_lines,
        _repeat_words(words),
        len(lines),
        raw.count(b"!"),
        len(raw) - len(raw.translate(None, CAPITALS)),
    )


def quality_features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``doc_id, stratum`` and the counts that the rules use, one row per document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FEATURES.split(", ")]
        for batch in batches:
            rows = zip(*(_features(t.as_py()) for t in batch.column("text")))
            columns = [pa.array(c, pa.int64()) for c in rows] or [pa.array([], pa.int64()) for _ in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("stratum"), *columns], ["doc_id", "stratum", *names]
            )

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text")
    return rows.mapInArrow(count, f"doc_id {doc_type}, stratum string, {FEATURES}")


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X <= x) for X binomial in n and p."""
    if x >= n:
        return 1.0
    log_p, log_q, whole = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    return min(
        1.0,
        math.fsum(
            math.exp(whole - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q)
            for i in range(x + 1)
        ),
    )


def certified_cutoffs(labelled: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """``stratum, rule, cutoff, n_good, n_rejected`` of the strictest certified cutoffs.

    ``labelled`` has the features and ``good``; ``n_rejected`` is of all rules of the
    stratum together.  The counts are one row per stratum; each is tested where it lies.
    """
    depth = max(len(cutoffs) for _, cutoffs in RULES.values())
    steps = [(rule, cutoffs[k]) for k in range(depth) for rule, (_, cutoffs) in RULES.items() if k < len(cutoffs)]
    first = F.least(
        *(
            F.when(F.expr(f"try_divide({RULES[rule][0].replace(' / ', ', ')})") > cutoff, F.lit(k))
            for k, (rule, cutoff) in enumerate(steps)
        )
    )
    counts = cut(
        labelled.where("good")
        .select("stratum", first.alias("first"))
        .groupBy("stratum")
        .agg(F.count(F.lit(1)).alias("n_good"), *(F.count(F.when(F.col("first") <= k, 1)).alias(f"step__{k}") for k in range(len(steps))))
    )
    level = delta / max(1, counts.count())

    def certify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                n, x, held = row["n_good"], 0, {}
                for k, (rule, cutoff) in enumerate(steps):
                    now = row[f"step__{k}"]
                    if now > n * alpha or binomial_tail(now, n, alpha) > level:
                        break
                    x, held[rule] = now, cutoff
                out += [(row["stratum"], rule, cutoff, n, x) for rule, cutoff in held.items()]
            yield pd.DataFrame(out, columns=["stratum", "rule", "cutoff", "n_good", "n_rejected"])

    return counts.mapInPandas(certify, "stratum string, rule string, cutoff double, n_good long, n_rejected long")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """The features of every document with ``base_failed``, ``rejected_by`` and ``kept``."""
    features = cut(quality_features(docs, stratum))
    good = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg((F.min("quality") == 1).alias("good"))
    )
    cutoffs = certified_cutoffs(features.join(good, "doc_id"), alpha, delta)
    wide = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    # Only strata with some hundred labelled good documents reach a cutoff: their number is
    # at most the labelled rows over that, and Spark sees the size of this checkpoint.
    wide = cut(wide)
    broken = F.array_compact(
        F.array(*(F.when(F.expr(f"try_divide({expr.replace(' / ', ', ')})") > F.col(rule), F.lit(rule)) for rule, (expr, _) in RULES.items()))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    (of,) = fresh_names(wide.columns, "of")
    wide = wide.withColumnRenamed("stratum", of)
    return (
        features.join(wide, features["stratum"].eqNullSafe(wide[of]), "left")
        .drop(of)
        .withColumn("base_failed", failed)
        .withColumn("rejected_by", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop(*RULES)
    )


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs``, same columns, without the documents that the rules reject.

    Documents are told apart by ``doc_id``; where several rows share one, each
    goes if any of them is rejected.  Rows with a null ``doc_id`` stay.
    """
    gone = judge(docs, labels, **options).where(~F.col("kept")).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
