"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that the operators call blank.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-folioscope-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint: computed once, and safe when executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders made inside the innermost :func:`scratch` of this thread.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one written table in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder, in whatever file system it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch folders that this thread makes inside it; what is wanted of them must have been written elsewhere by then."""
    token = _MADE.set([])
    try:
        yield
    finally:
        for path in _MADE.get():
            remove_folder(spark, path)
        _MADE.reset(token)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table written to the shared folder; smaller on disk than a checkpoint."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def settle(spark: SparkSession) -> None:
    """Lets go of what finished steps hold: Spark removes shuffle files once their plans are collected in the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_names(columns: list[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that none of ``columns`` has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        fresh, k = name, 0
        while fresh.lower() in taken:
            fresh, k = f"{name}_{k}", k + 1
        taken.add(fresh.lower())
        out.append(fresh)
    return out


#: Keys that are dealt to several tasks at most, and the rows from which a key is.
HEAVY, LEAST = 10_000, 256


def heavy_keys(counts: DataFrame, keys: list[str], least: int = LEAST) -> DataFrame | None:
    """Of ``counts`` (``keys`` and ``n``, their rows) the largest ``HEAVY`` with more than ``least``; None if there are none.

    ``_parts`` tells how many tasks to deal each to.  Their number is bounded, so they may
    be broadcast; any key not among them has less than a ten-thousandth of all rows.
    """
    rows = counts.where(F.col("n") > least).orderBy(F.col("n").desc(), *keys).limit(HEAVY).select(*keys, "n").collect()
    if not rows:
        return None
    size = max(least, sum(r.n for r in rows) // HEAVY)
    schema = counts.select(*keys, F.lit(0).alias("_parts")).schema
    return F.broadcast(counts.sparkSession.createDataFrame([(*r[:-1], -(-r.n // size)) for r in rows], schema))


def dealt(big: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """``big`` with ``_salt``: rows of heavy keys are told apart by the hash of their columns."""
    salt = F.coalesce(F.pmod(F.xxhash64(*big.columns), F.col("_parts")).cast("int"), F.lit(0))
    return big.join(heavy, keys, "left").withColumn("_salt", salt).drop("_parts")


def sent(small: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """``small`` with ``_salt``: its rows of heavy keys once for every salt."""
    return small.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame | None = None, least: int = LEAST) -> DataFrame:
    """``big.join(small, keys)``, where a key may hold most of ``big``.

    ``counts`` has ``keys`` and ``n``, how many rows of ``big`` there are of each, if that is
    known; else they are counted, so ``big`` must be cheap to read twice.  Neither side is
    broadcast, as both grow with the data.
    """
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    heavy = heavy_keys(counts, keys, least)
    if heavy is None:
        return big.join(small.hint("merge"), keys)
    return dealt(big, keys, heavy).join(sent(small, keys, heavy).hint("merge"), [*keys, "_salt"]).drop("_salt")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, LOWER)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
