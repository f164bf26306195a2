"""From raw bibliographic tables to deduplicated articles."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.config import ALIASES, CONTENT_FIELDS, DIMENSIONS, FolioscopeError
from folioscope.functions import text as X
from folioscope.operators.keep import keep

LONGEST = ("title", "abstract", *DIMENSIONS)
FIRST = ("doi", "doi_normalized", "source_title")
#: Characters in a gram of a title; with titles of at most a twelfth of edits there are always enough of them.
GRAM = 6
#: The most frequent grams, which stand last.
COMMON = 200
RECORD = ("title", "authors", "abstract", "keywords", "doi", "year", "source_title", *DIMENSIONS)


def clean_name(name: str) -> str:
    """A column name in snake case and plain letters."""
    plain = "".join(X.MARKED.get(c, X.EXPANDED.get(c, c)) for c in name)
    plain = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", plain)
    return re.sub(r"[^a-z0-9]+", "_", plain.lower()).strip("_")


def resolve_columns(columns: list[str], column_map: dict[str, str] | None = None) -> dict[str, str]:
    """Canonical fields and the columns that hold them: the map first, then the first alias that exists."""
    by_name: dict[str, str] = {}
    for column in columns:
        by_name.setdefault(clean_name(column), column)
    found: dict[str, str] = {}
    for target, source in (column_map or {}).items():
        if target not in ALIASES:
            raise FolioscopeError("unknown_field", f"unknown field in the column map: {target}")
        if source not in columns and clean_name(source) not in by_name:
            raise FolioscopeError("missing_column", f"no column {source}")
        found[target] = source if source in columns else by_name[clean_name(source)]
    for target, aliases in ALIASES.items():
        source = next((by_name[a] for a in aliases if a in by_name), None)
        if target not in found and source is not None:
            found[target] = source
    if "title" not in found:
        raise FolioscopeError("no_title", "no column holds the title")
    return found


def canonical_records(raw: DataFrame, column_map: dict[str, str] | None = None, position: Column | None = None) -> DataFrame:
    """The twelve canonical fields, the three normalised ones and ``pos``; rows without a title go.

    ``pos`` is the order that ties fall back to; without one, the order of the input's partitions.
    """
    found = resolve_columns(raw.columns, column_map)

    # Texts are brought to NFKC once, here, so that all that follows works on them as they are.
    raw = raw.withColumns({c: X.nfkc(X.text_or_empty(F.col(f"`{c}`"))) for c in set(found.values()) - {found.get("year")}})

    def pull(field: str) -> Column:
        return F.col(f"`{found[field]}`") if field in found else F.lit("")

    order = (F.monotonically_increasing_id() if position is None else position).cast("string")
    records = raw.select(
        X.normalize_text(pull("title")).alias("title"),
        X.clean_authors(pull("authors")).alias("authors"),
        X.normalize_text(pull("abstract")).alias("abstract"),
        X.clean_keywords(pull("author_keywords"), pull("index_keywords")).alias("keywords"),
        X.normalize_text(pull("doi")).alias("doi"),
        X.parse_year(pull("year")).alias("year"),
        X.normalize_text(pull("source_title")).alias("source_title"),
        *(X.normalize_text(pull(d)).alias(d) for d in DIMENSIONS),
        X.normalize_doi(pull("doi")).alias("doi_normalized"),
        X.normalize_for_matching(pull("title")).alias("title_normalized"),
        X.normalize_authors_for_id(pull("authors")).alias("authors_normalized"),
        F.lpad(order, 20, "0").alias("pos"),
    )
    return records.where("title_normalized <> ''")


def _united(rows: Column) -> Column:
    """The terms of a group's rows (position and terms) in order, each once."""
    parts = F.flatten(F.transform(F.array_sort(rows), lambda r: F.split(r["x"], ";")))
    return F.array_join(X.distinct_terms(parts), "; ")


def collapse(records: DataFrame, key: Column) -> DataFrame:
    """One row per key, merged; rows with a blank key stay alone.  ``pos`` becomes the group's key.

    Values are picked by ordered aggregates, so a group is never gathered but for its
    author and keyword lists.  A title brings its normalised form along, and a row that has been
    through a stage before and stays alone keeps its lists as they are.
    """
    settled = (F.col("original_rows") == 1) & F.lit("original_rows" in records.columns)
    keyed = records.withColumn("_key", F.coalesce(F.when(key != "", key), F.concat(F.lit("row:"), F.col("pos"))))

    def filled(name: str) -> Column:
        return F.trim(name) != ""

    longest = F.when(filled("title"), F.struct(-F.length(F.trim("title")), "pos"))
    merged = keyed.groupBy("_key").agg(
        *(F.coalesce(F.min_by(F.when(filled(c), F.trim(c)), F.when(filled(c), F.struct(-F.length(F.trim(c)), "pos"))), F.lit("")).alias(c) for c in LONGEST),
        F.coalesce(F.min_by("title_normalized", longest), F.lit("")).alias("title_normalized"),
        *(F.collect_list(F.struct("pos", F.col(c).alias("x"))).alias(f"_{c}") for c in ("authors", "keywords")),
        F.first("authors_normalized").alias("_normalized"),
        *(F.coalesce(F.min_by(F.when(filled(c), F.trim(c)), F.when(filled(c), F.col("pos"))), F.lit("")).alias(c) for c in FIRST),
        F.min_by("year", F.when(F.col("year").isNotNull(), F.col("pos"))).alias("year"),
        F.count(F.lit(1)).alias("original_rows"),
    )
    lists = {c: F.when(settled, F.get(f"_{c}", 0)["x"]).otherwise(_united(F.col(f"_{c}"))) for c in ("authors", "keywords")}
    return merged.withColumns(lists).select(
        *RECORD,
        "doi_normalized",
        "title_normalized",
        F.when(settled, F.col("_normalized")).otherwise(X.normalize_authors_for_id(F.col("authors"))).alias("authors_normalized"),
        F.col("_key").alias("pos"),
        "original_rows",
    )


def doi_key() -> Column:
    return F.when(F.col("doi_normalized") != "", F.concat(F.lit("doi:"), F.col("doi_normalized"))).otherwise("")


def title_year_key() -> Column:
    known = (F.col("title_normalized") != "") & F.col("year").isNotNull()
    return F.when(known, F.concat(F.lit("title-year:"), F.col("title_normalized"), F.lit("|"), F.col("year").cast("string"))).otherwise("")


def title_authors_key() -> Column:
    known = (F.col("title_normalized") != "") & (F.col("authors_normalized") != "")
    return F.when(known, F.concat(F.lit("title-authors:"), F.col("title_normalized"), F.lit("|"), F.col("authors_normalized"))).otherwise("")


#: The rules in order, by name.
RULES = {"doi": doi_key, "title_year": title_year_key, "title_authors": title_authors_key}


def article_id() -> Column:
    by_doi = X.hash_text(F.lit("doi"), F.col("doi_normalized"))
    by_record = X.hash_text(F.lit("record"), F.col("title_normalized"), F.col("year"), F.col("authors_normalized"))
    return F.when(F.col("doi_normalized") != "", by_doi).otherwise(by_record)


def content_hash(dimension_texts: bool = False) -> Column:
    last = [f"{d}_text" if dimension_texts else d for d in DIMENSIONS]
    return X.hash_text(*(F.col(c) for c in (*CONTENT_FIELDS, *last)))


def duplicate_report(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """``rule, key, original_rows, removed_rows`` of every group that lost a row."""
    parts = [
        df.where("original_rows > 1").select(F.lit(rule).alias("rule"), F.col("pos").alias("key"), "original_rows", (F.col("original_rows") - 1).alias("removed_rows"))
        for rule, df in stages
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_duplicates(articles: DataFrame, threshold: float = 0.08, max_records: int | None = None) -> DataFrame:
    """Pairs of one year (nulls together) whose titles differ in at most ``threshold`` of the longer one's length.

    Equal titles of a year are compared once.  An edit touches at most ``GRAM`` of a
    title's grams of that length, so of two titles with at most d edits the first
    ``GRAM * d + 1`` grams of each, in any one order of all grams, have one in common,
    within d places.  The order begins with rare grams, so common ones are hardly ever met.
    ``max_records`` gives an empty result for larger inputs, as a caller may ask for; by
    default there is no such limit.
    """
    if max_records is not None and articles.limit(max_records + 1).count() > max_records:
        articles = articles.limit(0)
    base = articles.where("title_normalized <> ''").select("article_id", "year", "title", F.col("title_normalized").alias("t"))
    titles = keep(base.select("year", "t").distinct().select("year", "t", F.length("t").alias("n"), F.monotonically_increasing_id().alias("id")))
    # Titles are compared with longer ones too, so the edits are those that the longest partner allows.
    most = F.floor(F.lit(threshold) * F.floor(F.col("n") / (1 - threshold) + 1e-9) + 1e-9).cast("int")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - GRAM + 1)), lambda i: F.xxhash64(F.substr("t", i, F.lit(GRAM))))
    placed = titles.withColumn("d", most).where("d > 0").select("id", "year", "n", "d", F.posexplode(grams).alias("at", "g"))
    counts = keep(placed.groupBy("g").agg(F.count(F.lit(1)).alias("df")))
    common = counts.orderBy(F.col("df").desc(), "g").limit(COMMON).collect()
    often = F.col("g").isin([r.g for r in common]) if common else F.lit(False)
    # The most frequent grams, at most ``COMMON``, meet their counts where they are; no other gram is a large key.
    known = F.broadcast(articles.sparkSession.createDataFrame([tuple(r) for r in common], "g long, df long"))
    counted = placed.where(~often).join(counts, "g").unionByName(placed.where(often).join(known, "g"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "g", "at"))
    entries = keep(counted.withColumn("k", rank).where(F.col("k") <= GRAM * F.col("d") + 1).select("id", "year", "n", "g", "at"))
    a, b = entries.alias("a"), entries.alias("b")
    allowed = F.floor(F.lit(threshold) * F.greatest("a.n", "b.n") + 1e-9)
    met = a.join(b, F.expr("a.year <=> b.year AND a.g = b.g AND a.id < b.id") & (F.abs(F.col("a.n") - F.col("b.n")) <= allowed) & (F.abs(F.col("a.at") - F.col("b.at")) <= allowed))
    pairs = met.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
    for end, name in (("u", "t"), ("v", "s")):
        pairs = pairs.join(titles.select(F.col("id").alias(end), F.col("t").alias(name), F.col("year").alias(f"year_{name}")), end)
    near = pairs.select(F.col("year_t").alias("year"), "t", "s", F.levenshtein("t", "s").alias("distance"), F.greatest(F.length("t"), F.length("s")).alias("n"))
    near = near.where(F.col("distance") <= threshold * F.col("n") + 1e-9)
    one = base.select(F.col("article_id").alias("a"), F.col("year").alias("year_a"), F.col("title").alias("title_one"), F.col("t").alias("t_a"))
    other = base.select(F.col("article_id").alias("b"), F.col("year").alias("year_b"), F.col("title").alias("title_other"), F.col("t").alias("t_b"))
    both = near.join(one, F.expr("year <=> year_a AND t = t_a")).join(other, F.expr("year <=> year_b AND s = t_b"))
    first = F.col("a") < F.col("b")
    return both.select(
        F.least("a", "b").alias("article_a"),
        F.greatest("a", "b").alias("article_b"),
        "year",
        F.when(first, F.col("title_one")).otherwise(F.col("title_other")).alias("title_a"),
        F.when(first, F.col("title_other")).otherwise(F.col("title_one")).alias("title_b"),
        F.round(F.col("distance") / F.col("n"), 6).alias("normalized_distance"),
    )


def processed_order() -> list[Column]:
    """By title and year, missing years last; articles that agree in both by their ids."""
    return [F.asc("title_normalized"), F.asc_nulls_last("year"), F.asc("article_id")]


@dataclass
class Processed:
    articles: DataFrame
    duplicates: DataFrame
    source: str

    @cached_property
    def possible_duplicates(self) -> DataFrame:
        """Pairs of articles with nearly equal titles; looked for when they are first asked for."""
        return near_duplicates(keep(self.articles))

    @property
    def ordered(self) -> DataFrame:
        """The articles by title and year, missing years last."""
        return self.articles.orderBy(*processed_order())

    def write(self, path: str) -> None:
        """Written in that order: each file holds a range, and files follow one another by name."""
        order = processed_order()
        self.articles.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def with_ids(records: DataFrame) -> DataFrame:
    return records.withColumn("article_id", article_id()).withColumn("content_hash", content_hash())


def process_records(
    raw: DataFrame,
    column_map: dict[str, str] | None = None,
    source: str = "scopus",
    remove_duplicates: bool = True,
    now: str = "1970-01-01T00:00:00Z",
    position: Column | None = None,
) -> Processed:
    """Canonical, deduplicated articles with ids and content hashes, and the reports on duplicates."""
    records = canonical_records(raw, column_map, position)
    stages: list[tuple[str, DataFrame]] = []
    if remove_duplicates:
        for rule, key in RULES.items():
            records = collapse(records, key())
            stages.append((rule, records))
        records = collapse(records, article_id())
        stages.append(("article_id", records))
    else:
        records = records.withColumn("original_rows", F.lit(1).cast("long"))
        stages.append(("none", records))
    articles = with_ids(records).select(
        "article_id",
        *RECORD,
        "doi_normalized",
        "title_normalized",
        "authors_normalized",
        (F.col("abstract") == "").alias("missing_abstract"),
        "content_hash",
        F.lit(now).alias("created_at"),
        F.lit(now).alias("updated_at"),
    )
    return Processed(articles, duplicate_report(stages), source)
