"""The training-data pipeline: five stages from ``documents`` to a weighted mix.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes every stage to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import remove_folder, scratch, scratch_path, table
from folioscope.llm.decontaminate import drop_contaminated
from folioscope.llm.line_dedup import dedup_lines
from folioscope.llm.mixing import Mix, mix_sources
from folioscope.llm.quality import quality_filter
from folioscope.llm.similar import keep_one_similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a certified cutoff go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go."""
    return dedup_lines(docs, min_docs=10)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest ``doc_id`` stays."""
    return keep_one_similar(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), width=10)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The seeded token prefixes of every source, by target weights."""
    return mix_sources(docs, Mix())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]
#: The stages are not expressible in SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage is written and read again; what a stage leaves in the shared folder goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if before is not None:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
