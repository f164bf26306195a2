"""Mixing sources to target weights by hierarchical budgets.

The token budget runs down a tree (domain, language, source).  Each node shares
its budget among its children by weight; a child that cannot supply its share in
``max_epochs`` passes is filled, and what it leaves over goes to its siblings by
their weights.  Only where all children are full does the rest stay with the
ancestors.  Each leaf then takes the first tokens of its seeded epochs: whole
passes first, and of the last pass a prefix in seeded order that ends inside a
document if the budget does.

Supplies are pre-aggregated, so the tree is as large as the number of leaves.  The
prefix of a leaf is cut without gathering the leaf: its documents are dealt by
their seeded order into buckets of about ``bucket_docs``, running sums of bucket
totals give where each bucket begins, and only within buckets are documents
sorted.  A source with a third of all rows is that many more buckets.

Defined results
---------------
* null or empty text has no tokens and is not selected.
* nulls in a level's column are a node of their own, named by the empty string.
* rows with equal ``doc_id`` and text are decided together and count each; the prefix in
  which a budget ends is that of one of them.
* a weight that is null or not positive gives no budget.
* columns other than ``doc_id``, ``text`` and those that the levels name are ignored.
* an empty table gives an empty selection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import cut, fresh_names


@dataclass(frozen=True)
class Level:
    """One level of the tree: its name, its value and its weight as SQL over the table's columns and the levels so far."""

    name: str
    value: str
    weight: str = "1"


@dataclass(frozen=True)
class Mix:
    """``share`` of all tokens is the budget; a leaf gives each document ``max_epochs`` times at most."""

    levels: tuple[Level, ...] = field(
        default=(
            Level(
                "domain",
                "CASE WHEN source = 'src0' THEN 'crawl' WHEN length(source) = 4 THEN 'curated' ELSE 'reference' END",
                "CASE domain WHEN 'crawl' THEN 2 WHEN 'curated' THEN 5 ELSE 3 END",
            ),
            Level("lang", "lang", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 ELSE 1 END"),
            Level("source", "source", "1"),
        )
    )
    share: float = 0.75
    max_epochs: int = 2
    seed: str = "mix-1"
    bucket_docs: int = 1024


def token_counts(docs: DataFrame, mix: Mix) -> DataFrame:
    """``doc_id, row_key``, the levels, ``n_tokens`` and ``n_rows``: how many rows there are of the document."""
    inputs = [c for c in docs.columns if c in ("lang", "source") or any(c in lv.value for lv in mix.levels)]
    base = docs.select(*dict.fromkeys(["doc_id", "text", *inputs]))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = base.select(
        "doc_id",
        F.xxhash64("text").alias("row_key"),
        *(F.coalesce(F.expr(lv.value).cast("string"), F.lit("")).alias(lv.name) for lv in mix.levels),
        words.alias("n_tokens"),
    ).where("n_tokens > 0")
    names = [lv.name for lv in mix.levels]
    return rows.groupBy("doc_id", "row_key", *names, "n_tokens").agg(F.count(F.lit(1)).alias("n_rows"))


def water_fill(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``given``: the share of ``budget`` for each child with ``weight`` and ``room``, among rows with equal ``parents``."""
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = group.orderBy((F.col("room") / F.col("weight")).asc(), F.col(name).asc()).rowsBetween(Window.unboundedPreceding, -1)
    room_before = F.coalesce(F.sum("room").over(before), F.lit(0.0))
    weight_from = F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return (
        children.where("weight > 0")
        .withColumn("level", (F.col("budget") - room_before) / weight_from)
        .withColumn("given", F.least("room", F.col("weight") * F.max("level").over(group)))
        .drop("level")
    )


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """The levels, ``supply``, ``n_docs`` and ``budget`` (whole tokens) of every leaf with a budget."""
    names = [lv.name for lv in mix.levels]
    room = leaves.withColumn("room", F.col("supply").cast("double") * mix.max_epochs)
    granted = leaves.agg((F.sum("supply").cast("double") * F.lit(mix.share)).alias("given"))
    for depth, level in enumerate(mix.levels):
        parents, path = names[:depth], names[: depth + 1]
        nodes = room.groupBy(*path).agg(F.sum("room").alias("room"))
        nodes = nodes.withColumn("weight", F.expr(level.weight).cast("double"))
        above = granted.select(*parents, F.col("given").alias("budget"))
        # At the root this is one row of totals.
        nodes = nodes.join(above, parents) if parents else nodes.join(F.broadcast(above), F.lit(True))
        granted = water_fill(nodes, parents, level.name).select(*path, "given")
    return leaves.join(granted, names).select(
        *names, "supply", "n_docs", F.floor(F.col("given") + 1e-6).cast("long").alias("budget")
    )


def select_tokens(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per selected document: the levels, ``n_tokens, n_rows, full_epochs, last_epoch_tokens``.

    Each of its rows is taken whole ``full_epochs`` times; of the next epoch the
    first ``last_epoch_tokens`` tokens, counted over its rows, are taken.
    """
    names = [lv.name for lv in mix.levels]
    tokens = cut(token_counts(docs, mix))
    total = F.col("n_tokens") * F.col("n_rows")
    leaves = cut(tokens.groupBy(*names).agg(F.sum(total).alias("supply"), F.count(F.lit(1)).alias("n_docs")))
    plan = cut(
        budgets(leaves, mix)
        .withColumn("full_epochs", F.floor(F.col("budget") / F.col("supply")).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("supply"))
        .withColumn("n_buckets", F.ceil(F.col("n_docs") / mix.bucket_docs))
        .select(*names, "full_epochs", "rest", "n_buckets")
    )
    digest = F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("full_epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = (
        tokens.join(plan, names)
        .withColumn("order", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
        .withColumn("bucket", F.floor(F.col("order") / F.lit(float(1 << 60)) * F.col("n_buckets")))
    )
    dealt = cut(dealt)
    sums = dealt.groupBy(*names, "bucket").agg(F.sum(total).alias("in_bucket"))
    by_bucket = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(*names, "bucket", F.coalesce(F.sum("in_bucket").over(by_bucket), F.lit(0)).alias("begin"))
    in_bucket = (
        Window.partitionBy(*names, "bucket")
        .orderBy("order", F.col("doc_id").asc_nulls_first(), "row_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("begin") + F.coalesce(F.sum(total).over(in_bucket), F.lit(0))
    return (
        dealt.join(cut(begins), [*names, "bucket"])
        .withColumn("last_epoch_tokens", F.greatest(F.lit(0), F.least(total, F.col("rest") - start)))
        .where("full_epochs > 0 OR last_epoch_tokens > 0")
        .select("doc_id", "row_key", *names, "n_tokens", "n_rows", "full_epochs", "last_epoch_tokens")
    )


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The selected rows of ``docs`` with their columns, ``full_epochs``, ``last_epoch_tokens`` and ``last_epoch_text``.

    ``last_epoch_text`` is the prefix that the last epoch takes of a document in which a leaf's
    budget ends, and null elsewhere; where no whole epoch is taken, ``text`` is that prefix as well.
    Input columns of these three names are replaced.
    """
    made = ["full_epochs", "last_epoch_tokens", "last_epoch_text"]
    docs = docs.drop(*made)
    doc, key, n = fresh_names([*docs.columns, *made], "doc", "key", "n")
    taken = cut(
        select_tokens(docs, mix).select(
            F.col("doc_id").alias(doc), F.col("row_key").alias(key), F.col("n_tokens").alias(n), *made[:2]
        )
    )
    on = docs["doc_id"].eqNullSafe(taken[doc]) & (F.xxhash64(docs["text"]) == taken[key])
    part = (F.col("last_epoch_tokens") % F.col(n)).cast("int")
    tokens = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    prefix = F.when(part > 0, F.array_join(F.slice(tokens, 1, part), ""))
    joined = docs.join(taken, on).withColumn(made[2], prefix)
    text = F.when((F.col("full_epochs") == 0) & F.col(made[2]).isNotNull(), F.col(made[2])).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*docs.columns, *made)
