"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every version of a text is a blob, named by its SHA-256.  A ledger records which
(blob, rule version) pairs have been scanned and what was found.  Only pairs that
the ledger lacks are scanned, one copy of each blob; findings are then joined back
to every path that has the blob.

Defined results
---------------
* null text: the empty blob; it has no findings.
* equal texts share a blob, and it is scanned once whatever the number of paths.
* each row is a path of its own; rows with a null or repeated ``doc_id`` keep theirs.
* columns other than ``doc_id`` and ``text`` are ignored.
* spans are counted in code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import cut, fresh_names, sha256_hex


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlaps; ``group`` must then have ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


#: For ``access`` and ``hex`` the least length stands in the pattern: a match of the open-ended
#: pattern runs to the end of its character class, so a longer one cannot hide behind a short one.
RULES: tuple[Rule, ...] = (
    Rule(
        "assign",
        1,
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
LEDGER = "blob_id string, kind string, version int, spans array<struct<start:int,end:int>>"


def paths_of(docs: DataFrame) -> DataFrame:
    """``doc_id, blob_id``: the content address of every path."""
    return docs.select("doc_id", sha256_hex(F.coalesce(F.col("text"), F.lit(""))).alias("blob_id"))


def _matches(text: Column, rule: Rule) -> Column:
    """The gaps before the matches, the matches' lengths and whether they hold, as one array."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    held = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
    return F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("n"), held.alias("holds"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob_id, kind, version, spans`` of the rules that hold somewhere in ``blob_id, text`` rows."""
    per_rule = F.array(
        *(
            F.when(
                F.col("text").rlike(rule.pattern),
                F.struct(
                    F.lit(rule.kind).alias("kind"),
                    F.lit(rule.version).alias("version"),
                    _matches(F.col("text"), rule).alias("matches"),
                ),
            )
            for rule in rules
        )
    )
    some = reduce(lambda a, b: a | b, (F.col("text").rlike(rule.pattern) for rule in rules))
    return (
        blobs.where(some)
        .select("blob_id", F.explode(F.array_compact(per_rule)).alias("r"))
        .select("blob_id", "r.kind", "r.version", F.posexplode("r.matches").alias("at", "m"))
    )


def _spans(pieces: DataFrame) -> DataFrame:
    """Ends are running sums over one blob's matches of one rule, so a text's length bounds each window."""
    running = Window.partitionBy("blob_id", "kind", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.n")).over(running).cast("int")
    return (
        pieces.withColumn("end", end)
        .where("m.holds")
        .groupBy("blob_id", "kind", "version")
        .agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("m.n")).alias("start"), "end"))).alias("spans"))
    )


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """The paths of ``docs`` and the rows that the ledger gains.

    The new rows hold every scanned (blob, rule version) pair, with empty ``spans``
    where nothing was found.  Unseen blobs are fetched by a path that has them.
    """
    paths = cut(paths_of(docs))
    spark = docs.sparkSession
    wanted = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    blobs = paths.groupBy("blob_id").agg(F.min("doc_id").alias("path"))
    pairs = blobs.select("blob_id", "path", F.explode(wanted).alias("r")).select("blob_id", "path", "r.kind", "r.version")
    if ledger is not None:
        seen = ledger.select("blob_id", "kind", "version").distinct()
        pairs = pairs.join(seen, ["blob_id", "kind", "version"], "left_anti")
    pairs = cut(pairs)
    (blob,) = fresh_names(["doc_id", "text", "blob_id", "path"], "blob")
    found = spark.createDataFrame([], LEDGER)
    for group in [rules] if ledger is None else [(r,) for r in rules]:
        todo = pairs.where(
            reduce(lambda a, b: a | b, ((F.col("kind") == r.kind) & (F.col("version") == r.version) for r in group))
        )
        todo = todo.select(F.col("blob_id").alias(blob), "path").distinct()
        texts = docs.select(
            "doc_id",
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
            sha256_hex(F.coalesce(F.col("text"), F.lit(""))).alias("blob_id"),
        )
        on = texts["doc_id"].eqNullSafe(todo["path"]) & (texts["blob_id"] == todo[blob])
        once = texts.join(todo, on, "left_semi").select("blob_id", "text")
        # Equal rows under one doc_id come twice; their matches are the same.
        pieces = scan(once, group).dropDuplicates(["blob_id", "kind", "version", "at"])
        found = found.union(_spans(pieces))
    gained = pairs.select("blob_id", "kind", "version").join(cut(found), ["blob_id", "kind", "version"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return paths, cut(gained.select("blob_id", "kind", "version", F.coalesce("spans", none).alias("spans")))


def findings_by_path(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, blob_id, found`` for every path; ``found`` has kind, order of the kind, start and end."""
    order = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))))
    current = reduce(
        lambda a, b: a | b, ((F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules)
    )
    # Two scans at once may append the same blob twice; a pair counts once, however often it stands.
    once = ledger.where(current).groupBy("blob_id", "kind", "version").agg(F.max_by("spans", F.size("spans")).alias("spans"))
    each = (
        once.where(F.size("spans") > 0)
        .select("blob_id", "kind", F.explode("spans").alias("s"))
        .groupBy("blob_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct(F.col("s.start").alias("start"), order[F.col("kind")].alias("k"), "kind", F.col("s.end").alias("end")))
            ).alias("found")
        )
    )
    return paths.join(cut(each), "blob_id", "left")


def open_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger stored at ``path``, or None before the first scan."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def secret_digests(docs: DataFrame, ledger: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """The contract's digest columns for every path.

    With ``store`` the ledger is read from that folder and what is newly scanned is appended to it.
    """
    if store is not None:
        ledger = open_ledger(docs.sparkSession, store)
    paths, gained = update_ledger(docs, ledger)
    whole = gained if ledger is None else ledger.select(*gained.columns).union(gained)
    if store is not None:
        # What is read of the store is settled before it grows.
        whole = whole if ledger is None else cut(whole)
        gained.write.mode("append").parquet(store)
    found = findings_by_path(paths, whole).withColumn(
        "found", F.coalesce("found", F.array().cast("array<struct<start:int,k:int,kind:string,end:int>>"))
    )
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in RULES),
        sha256_hex(text).alias("base_sha256"),
        text.alias("spans"),
        "blob_id",
    )
