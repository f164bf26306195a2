"""Readers for raw bibliographic tables, by file extension, and the result's CSV sink."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.config import FolioscopeError
from folioscope.sources import splits

def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested fields as columns named ``a.b``."""

    def fields(schema: T.StructType, prefix: tuple[str, ...]) -> list:
        out = []
        for f in schema.fields:
            path = (*prefix, f.name)
            if isinstance(f.dataType, T.StructType):
                out += fields(f.dataType, path)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)))
        return out

    return df.select(*fields(df.schema, ()))


def _excel(spark: SparkSession, path: str, sheet: str | int) -> DataFrame:
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=sheet, dtype=str)
    except ImportError as error:
        raise FolioscopeError("missing_dependency", "reading Excel files needs openpyxl") from error
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None))


def _typed(strings: DataFrame, kind: str, options: dict) -> T.StructType:
    """The schema that Spark infers of records, one string each."""
    spark = strings.sparkSession
    reader = spark.read.options(**options)._jreader
    dataset = getattr(strings._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(getattr(reader, kind)(dataset), spark).schema


def read_separated(spark: SparkSession, path: str, separator: str = ",", position: str | None = None) -> DataFrame:
    """A quoted table with a header, read in as many tasks as it has splits, whatever its quotations hold.

    ``position`` names a column for the place of each record, which sorts as the files do.
    """
    options = {"sep": separator, "escape": '"', "multiLine": "true"}
    lines = splits.pieces(spark, path, "\n")
    found = splits.records(lines, splits.quoted_lines(separator), "", "\n")
    found = found.select(F.regexp_replace("record", "\r$", "").alias("record"), "position").where(F.trim("record") != "")
    # The first record of each file is its header; of several files, the first one's names hold.
    file = F.expr(f"left(position, length(position) - {2 * splits.DIGITS + 2})")
    heads = found.groupBy(file.alias("path")).agg(F.min_by("record", "position").alias("head"), F.min("position").alias("position"))
    first = heads.orderBy("position").first()
    if first is None:
        raise FolioscopeError("empty_file", f"{path} holds no records")
    names = [T.StructField(n, T.StringType()) for n in _names(spark, first["head"], options)]
    body = found.join(F.broadcast(heads.select("position")), "position", "left_anti")
    kinds = _typed(body.select("record"), "csv", {**options, "inferSchema": "true"})
    types = [*(f.dataType for f in kinds.fields), *[T.StringType()] * len(names)][: len(names)]
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    parsed = body.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"), "position")
    columns = [F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(names)]
    return parsed.select(*columns, *([F.col("position").alias(position)] if position else []))


def _names(spark: SparkSession, head: str, options: dict) -> list[str]:
    """The header's names, as Spark's reader makes them of repeated and empty ones."""
    one = spark.createDataFrame([(head,)], "value string")
    dataset = getattr(one._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark.read.options(**options, header="true")._jreader.csv(dataset), spark).columns


def read_nested(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    """The objects of a JSON array, or those that stand one after the other, read in as many tasks as a file has splits."""
    pieces = splits.pieces(spark, path, "}")
    head = pieces.where("start = 0").select("value").first()
    if head is None:
        raise FolioscopeError("empty_file", f"{path} holds no records")
    base = 1 if head.value.lstrip().lstrip("\ufeff").startswith("[") else 0
    found = splits.records(pieces, splits.braces(base), "}", "", base)
    found = found.select(F.regexp_replace("record", r"^[\s,\[\x{FEFF}]+", "").alias("record"), "position").where(F.startswith("record", F.lit("{")))
    schema = _typed(found.select("record"), "json", {})
    parsed = found.select(F.from_json("record", schema).alias("r"), "position")
    flat = flatten_structs(parsed.select("r.*"))
    if not position:
        return flat
    return flatten_structs(parsed.select("r.*", F.col("position").alias(position)))


def import_article_data(spark: SparkSession, path: str, sheet: str | int = 0, position: str | None = None) -> DataFrame:
    """CSV, TSV, tab-delimited text, JSON, Parquet or Excel, by extension.

    One file of text is many tasks.  ``position`` names a column, of text formats, for the place of
    each row in the files, by which merging stages can break ties.
    """
    kind = os.path.splitext(path)[1].lower().lstrip(".")
    readers = {
        "csv": lambda: read_separated(spark, path, ",", position),
        "tsv": lambda: read_separated(spark, path, "\t", position),
        "txt": lambda: read_separated(spark, path, "\t", position),
        "json": lambda: read_nested(spark, path, position),
        "parquet": lambda: spark.read.parquet(path),
        "xls": lambda: _excel(spark, path, sheet),
        "xlsx": lambda: _excel(spark, path, sheet),
    }
    if kind == "rds":
        raise FolioscopeError("unsupported_format", "RDS files can only be read by R; write Parquet instead")
    if kind not in readers:
        raise FolioscopeError("unsupported_format", f"unsupported extension {kind or 'none'}")
    try:
        return readers[kind]()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or isinstance(error, FileNotFoundError):
            raise FolioscopeError("file_not_found", f"no file {path}") from error
        raise


def write_results_csv(results: DataFrame, path: str) -> None:
    """One CSV file of a ranked result, which is as long as its limit."""
    results.coalesce(1).write.mode("overwrite").csv(path, header=True)
