"""Filters, combined scores, order, explanations and the result's columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.config import DIMENSIONS, EXPLAIN_MANY, EXPLAIN_NONE, EXPLAIN_ONE, LABELS, FolioscopeError
from folioscope.functions import text as X
from folioscope.operators.keep import keep
from folioscope.operators.lexical import LexicalIndex, analysed, clamp, dimension_scores

#: The order in which equal dimensions are named.
EXPLAIN_ORDER = ("theme", "method", "data", "context", "purpose")
RESULT = (
    "rank", "index", *(f"similarity_{d}" for d in EXPLAIN_ORDER), "title", "authors", "year", "doi", "keywords",
    "source_title", "abstract", "article_id", "explanation", "engine",
)
DIGITS = 6


@dataclass(frozen=True)
class Filters:
    """Conditions that must all hold; a null value in an article fails its condition."""

    year_min: int | None = None
    year_max: int | None = None
    years: tuple[int, ...] | None = None
    source_title: str | None = None
    authors: str | None = None
    doi: str | None = None
    article_ids: tuple[str, ...] | DataFrame | None = None

    def __post_init__(self):
        if self.year_min is not None and self.year_max is not None and self.year_min > self.year_max:
            raise FolioscopeError("bad_filter", "year_min lies after year_max")

    def apply(self, articles: DataFrame) -> DataFrame:
        """An invalid ``doi`` matches the articles without one; a text filter without letters matches none."""
        out = articles
        if self.year_min is not None:
            out = out.where(F.col("year") >= self.year_min)
        if self.year_max is not None:
            out = out.where(F.col("year") <= self.year_max)
        if self.years is not None:
            out = out.where(F.col("year").isin(*self.years))
        for name, wanted in (("source_title", self.source_title), ("authors", self.authors)):
            if wanted is not None:
                norm = X.normalize_for_matching(F.lit(wanted))
                out = out.where((norm != "") & F.contains(X.normalize_for_matching(F.col(name)), norm))
        if self.doi is not None:
            out = out.where(F.col("doi_normalized") == X.normalize_doi(F.lit(self.doi)))
        if isinstance(self.article_ids, DataFrame):
            out = out.join(self.article_ids.select("article_id"), "article_id", "left_semi")
        elif self.article_ids is not None:
            out = out.where(F.col("article_id").isin(*self.article_ids))
        return out


def explanation(scores: dict[str, Column]) -> Column:
    """A sentence that names the three dimensions with the highest scores; null scores do not count."""
    entries = F.array_compact(
        F.array(
            *(
                F.when(
                    scores[d].isNotNull() & ~F.isnan(scores[d]),
                    F.struct((-scores[d]).alias("s"), F.lit(k).alias("k"), F.lit(LABELS[d]).alias("label")),
                )
                for k, d in enumerate(EXPLAIN_ORDER)
            )
        )
    )
    names = F.transform(F.slice(F.array_sort(entries), 1, 3), lambda x: x["label"])
    n, end = F.size(names), F.lit(".")
    a, b, c = (F.get(names, i) for i in range(3))
    return (
        F.when(n == 0, F.lit(EXPLAIN_NONE))
        .when(n == 1, F.concat(F.lit(EXPLAIN_ONE), a, end))
        .when(n == 2, F.concat(F.lit(EXPLAIN_MANY), a, F.lit(" y "), b, end))
        .otherwise(F.concat(F.lit(EXPLAIN_MANY), a, F.lit(", "), b, F.lit(" y "), c, end))
    )


def combine(scores: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query and article with any score: ``index`` (0 to 1) and ``s_<dimension>``."""
    weighted = scores.join(F.broadcast(queries.select("query_id", "dimension", "weight")) if few(queries) else queries.select("query_id", "dimension", "weight"), ["query_id", "dimension"])
    return weighted.groupBy("query_id", "article_id").agg(
        F.sum(F.when(F.isnan("score"), 0.0).otherwise(F.col("score")) * F.col("weight")).alias("index"),
        *(F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(f"s_{d}") for d in DIMENSIONS),
    )


def few(queries: DataFrame, most: int = 50_000) -> bool:
    return queries.limit(most + 1).count() <= most


def ranked(articles: DataFrame, combined: DataFrame, queries: DataFrame, n: int, engine: str) -> DataFrame:
    """The first ``n`` articles of every query with the result's columns and ``query_id``.

    Articles without a score count zero.  Scores are rounded before they are ordered,
    so the order of a sum's terms cannot change the result; ties end with ``article_id``.
    """
    if n < 1:
        raise FolioscopeError("bad_limit", "n must be at least 1")
    wanted = queries.groupBy("query_id").agg(F.collect_set("dimension").alias("asked"))
    # Only what decides the order is sorted; the wide columns join the first n afterwards.
    narrow = articles.select("article_id", "title", "year")
    scored = combined.join(narrow, "article_id")
    # Articles without a score all tie at zero, so only the first of them in the order of ties can
    # show, and at most n that have a score stand before them: 2 n articles are enough.
    tail = narrow.orderBy(F.col("year").desc_nulls_last(), "title", "article_id").limit(2 * n)
    blank = wanted.select("query_id").crossJoin(F.broadcast(tail)).join(combined.select("query_id", "article_id"), ["query_id", "article_id"], "left_anti")
    every = scored.unionByName(blank, allowMissingColumns=True).join(wanted, "query_id")

    def similarity(d: str) -> Column:
        return F.when(F.array_contains("asked", d), F.round(100 * F.coalesce(F.col(f"s_{d}"), F.lit(0.0)), DIGITS))

    shown = every.select(
        "query_id",
        F.round(100 * clamp(F.coalesce("index", F.lit(0.0))), DIGITS).alias("index"),
        *(similarity(d).alias(f"similarity_{d}") for d in EXPLAIN_ORDER),
        "title",
        "year",
        "article_id",
    )
    order = Window.partitionBy("query_id").orderBy(
        F.col("index").desc(), F.col("similarity_theme").desc_nulls_last(), F.col("year").desc_nulls_last(), "title", "article_id"
    )
    # Spark keeps n rows per query and task before it shuffles for a row number under a limit.
    top = shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    wide = articles.select(
        "article_id", "authors", "keywords", "source_title", "abstract",
        F.when(F.length("doi_normalized") > 0, F.col("doi_normalized")).otherwise(F.col("doi")).alias("doi"),
    )
    return top.join(wide, "article_id").select(
        "query_id",
        *RESULT[:-2],
        explanation({d: F.col(f"similarity_{d}") for d in EXPLAIN_ORDER}).alias("explanation"),
        F.lit(engine).alias("engine"),
    )


def rank_lexical(
    articles: DataFrame,
    index: LexicalIndex,
    queries: DataFrame,
    filters: Filters = Filters(),
    n: int = 20,
    components: dict[str, float] | None = None,
    hold: Callable[[DataFrame], DataFrame] = keep,
) -> DataFrame:
    """Scores against the whole index, then filters, then the first ``n``; ``hold`` keeps what is used twice."""
    queries = analysed(queries, hold)
    combined = hold(combine(dimension_scores(queries, index, components, hold), queries))
    return ranked(filters.apply(articles), combined, queries, n, "lexical")
