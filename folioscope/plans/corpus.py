"""How the test tables stand for bibliographic data, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.config import DIMENSIONS
from folioscope.functions import text as X
from folioscope.operators.dimensions import build_dimension_texts
from folioscope.operators.ingest import canonical_records, with_ids

#: Sentences that give the invented texts something to find.
SEEDS = (
    "This study aims to measure growth in Honduras. A survey of 300 university students was analysed with SEM.",
    "El objetivo es evaluar el modelo. La muestra incluye mujeres y empresas de El Salvador!",
    "See https://doi.org/10.5555/ABC.77; panel data with fixed effects from the World Bank Enterprise Surveys.",
    "We examine firms in emerging markets? Quantitative methods and observations by region were used.",
    "",
    "Los datos de la encuesta cubren pacientes. Machine learning and natural language processing, R and AI.",
    "no cue here; Plain prose, without any.",
)
NOW = "2026-01-01T00:00:00Z"
#: Bytes that one task reads.
SPLIT = 128 << 20
COLUMN_MAP = {"author_keywords": "Keywords A", "index_keywords": "Keywords I"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table too small to give every core a split is dealt to all of them; a larger one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < cores * SPLIT else df


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as untidy bibliographic rows."""
    docs = spread(table(spark, folder, "documents"))
    seed = F.element_at(F.array(*map(F.lit, SEEDS)), (F.col("doc_id") % len(SEEDS) + 1).cast("int"))
    n = F.col("n_chars")
    # Some titles get a typo, so that there are near duplicates to find.
    typo = F.when(F.col("doc_id") % 17 == 0, "x").otherwise("")
    return docs.select(
        "doc_id",
        F.concat(F.lit("  "), F.trim(F.substring(F.split_part("text", F.lit("."), F.lit(1)), 1, 120)), typo).alias("Document Title"),
        F.concat(F.lit("Author "), n % 40, F.lit(" | Müller "), n % 7, F.lit(" ;")).alias("Authors"),
        F.concat("text", F.lit(" "), seed).alias("Abstract"),
        F.concat("lang", F.lit(", Topic "), n % 5, F.lit("; tópic "), n % 5).alias("Keywords A"),
        F.concat(F.lit("Topic "), n % 3, F.lit(" ; "), F.col("source")).alias("Keywords I"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" HTTPS://doi.org/10.1000/Doc."), F.floor(F.col("doc_id") / 6), F.lit(".")))
        .when(F.col("doc_id") % 3 == 1, F.lit("doi: none"))
        .alias("DOI"),
        F.when(F.col("doc_id") % 13 == 0, "n.d.").otherwise(F.concat(2000 + n % 25, F.lit(".7"))).alias("Year"),
        F.col("source").alias("Source title"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_records(raw(spark, folder), COLUMN_MAP, F.col("doc_id"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """One article per id, the first by position; nothing is merged."""
    first = Window.partitionBy("article_id").orderBy("pos")
    return (
        with_ids(records(spark, folder))
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .drop("_n")
        .withColumn("missing_abstract", F.col("abstract") == "")
        .withColumn("created_at", F.lit(NOW))
        .withColumn("updated_at", F.lit(NOW))
    )


def dimension_articles(spark: SparkSession, folder: str) -> DataFrame:
    return build_dimension_texts(articles(spark, folder))


def benchmark_queries(spark: SparkSession, folder: str, weights: dict[str, float]) -> DataFrame:
    """A query per benchmark item with theme, purpose and context."""
    items = table(spark, folder, "benchmark")
    texts = F.array(
        F.struct(F.lit("theme").alias("dimension"), F.col("text")),
        F.struct(F.lit("purpose").alias("dimension"), F.concat(F.lit("This study aims to "), F.col("text")).alias("text")),
        F.struct(F.lit("context").alias("dimension"), F.concat(F.col("text"), F.lit(" women in Honduras, DOI 10.5555/abc.77")).alias("text")),
    )
    tall = items.select(F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), F.explode(texts).alias("x"))
    weight = F.create_map(*(F.lit(v) for d, w in weights.items() for v in (d, w)))
    return tall.select("query_id", "x.dimension", "x.text", weight[F.col("x.dimension")].alias("weight"))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    dims = F.array(*map(F.lit, DIMENSIONS))
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("a"), F.floor(F.col("vec_id") / 5)).alias("article_id"),
        F.element_at(dims, (F.col("vec_id") % 5 + 1).cast("int")).alias("dimension"),
        F.lit("m").alias("model_name"),
        F.size("embedding").alias("embedding_dimensions"),
        F.lit(True).alias("normalized"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("string").alias("content_hash"),
        "vec_id",
    )


def embedded_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles for the vectors; every ninth is missing and every seventh has another hash."""
    first = embeddings(spark, folder).where("dimension = 'theme'")
    k = F.floor(F.col("vec_id") / 5)
    return first.where(k % 9 != 8).select(
        "article_id",
        F.concat(F.lit("title "), k % 10).alias("title"),
        F.lit("someone").alias("authors"),
        F.when(k % 8 != 0, 2000 + k % 20).cast("int").alias("year"),
        F.lit("").alias("doi"),
        F.when(k % 2 == 0, F.concat(F.lit("10.1000/v."), k)).otherwise("").alias("doi_normalized"),
        F.lit("").alias("keywords"),
        F.lit("journal").alias("source_title"),
        F.lit("").alias("abstract"),
        F.when(k % 7 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"),
    )


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A query for every vector whose id is divisible by 100: it asks in all dimensions by that vector."""
    asked = embeddings(spark, folder).where("vec_id % 100 = 0")
    dims = F.explode(F.array(*map(F.lit, DIMENSIONS))).alias("dimension")
    return asked.select(F.concat(F.lit("v"), "vec_id").alias("query_id"), dims, F.col("embedding").alias("vector"))


def versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Current and previous: some documents in one only, some with another text."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "doc_id", "text")
    stamp = F.lit("2025-01-01T00:00:00Z")
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    current = docs.where("doc_id % 11 <> 0").select("article_id", X.hash_text(changed).alias("content_hash"), F.lit(NOW).alias("created_at"), F.lit(NOW).alias("updated_at"))
    previous = docs.where("doc_id % 7 <> 0").select("article_id", X.hash_text(F.col("text")).alias("content_hash"), stamp.alias("created_at"), stamp.alias("updated_at"))
    return current, previous
