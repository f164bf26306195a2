"""Embedding whitening: exact sums on an integer grid, the covariance by MLlib's RowMatrix.

Every entry ``c`` becomes the long ``floor(scale * c) + offset``, so sums and deviations are
exact whatever the order of the rows.  The fit list holds each distinct grid vector once.  Its
rows are centred as ``(n * x - S) / n``, an exact long divided once, before anything is
multiplied: a product of raw rows would lose the variance beside the squared offset.
``RowMatrix.computeGramianMatrix`` over them, divided by ``n``, is the covariance; it is as wide
as a vector is long, whatever the number of rows, so its eigenvectors are found in the driver.
The projection is broadcast and applied to all rows in batches.

Defined results
---------------
* null vectors and those with null or non-finite entries: no rows.
* repeated rows: each gets its own result; in the fit list they count once.
* null ids: kept, the id stays null.
* vectors of several lengths: each length is a space of its own, with its own fit list (at most
  :data:`LENGTHS`, else a ValueError); empty vectors have no component and so no row.
* a component whose eigenvalue is zero to double precision (fewer distinct vectors than
  dimensions) cannot be scaled to one and is left out; one distinct vector gives no rows.
* ``deviation`` is null where it is no long, ``deviation_exact`` has its digits always.
* entries so large that ``n * x`` is no long: an OverflowError, from Spark's arithmetic where
  the grid value itself is none.
* an empty table: an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut

#: Different vector lengths in one table at most.
LENGTHS = 64


@dataclass(frozen=True)
class Whitening:
    """A fitted space: ``n`` distinct vectors with the exact sums ``sums``; unit ``components`` in columns."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def on_grid(vectors: DataFrame, vector: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> Column:
    """The grid vector as longs; null for a vector that is null or holds a null or non-finite entry."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(sound, F.transform(entries, lambda c: F.floor(c * scale) + F.lit(offset).cast("long")))


def covariance(centred: DataFrame, column: str, width: int, n: int) -> np.ndarray:
    """The covariance, with divisor ``n``, of arrays of doubles whose mean is zero."""
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(rows, n, width).computeGramianMatrix().toArray() / n


def fit_whitening(distinct: DataFrame, width: int, components: int) -> Whitening | None:
    """The space of the grid vectors ``x``, each there once; None if they do not vary."""
    totals = distinct.agg(
        F.count(F.lit(1)).alias("n"),
        F.greatest(F.max(F.array_max("x")), -F.min(F.array_min("x"))).alias("largest"),
        *(F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width)),
    ).first()
    n, sums = totals["n"], np.array(totals[2:], np.int64)
    if n * totals["largest"] >= 2**62:
        raise OverflowError(f"{n} vectors with entries up to {totals['largest']} are too many for exact longs")
    held = F.array(*(F.lit(int(s)) for s in sums))
    centred = distinct.select(F.zip_with("x", held, lambda x, s: (F.lit(n) * x - s) / F.lit(n)).alias("c"))
    values, directions = np.linalg.eigh(covariance(centred, "c", width, n))
    order = np.argsort(values)[::-1][:components]
    trace = float(values.sum())
    order = order[values[order] > max(values.max(), 0.0) * width * np.finfo(float).eps]
    if not len(order):
        return None
    return Whitening(n, sums, values[order], directions[:, order], trace)


def identity_error(distinct: DataFrame, space: Whitening) -> float:
    """How far the covariance of the whitened fit list is from the identity, at the worst entry."""
    k = len(space.eigenvalues)
    white = project(distinct, space, [])
    mean = white.agg(*(F.avg(F.get("white", F.lit(i))) for i in range(k))).first()
    held = F.array(*(F.lit(float(m)) for m in mean))
    centred = white.select(F.zip_with("white", held, lambda y, m: y - m).alias("c"))
    return float(np.abs(covariance(centred, "c", k, space.n) - np.eye(k)).max())


def project(rows: DataFrame, space: Whitening, keep: list[str]) -> DataFrame:
    """``keep``, ``deviation``, ``deviation_exact`` and ``white`` (an array of doubles) of every row with ``x``."""
    told = rows.sparkSession.sparkContext.broadcast((space.n, space.sums, space.projection))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, projection = told.value
        for frame in frames:
            if frame.empty:
                continue
            away = n * np.stack(frame["x"].to_numpy()).astype(np.int64) - sums
            # Squares of longs may be none: those are added up as Python's integers.
            small = (away.astype(float) ** 2).sum(1) < 2.0**62
            square = np.where(small[:, None], away, 0)
            exact = (square * square).sum(1).astype(object)
            exact[~small] = [sum(v * v for v in row.tolist()) for row in away[~small]]
            out = frame[keep].copy()
            out["deviation"] = pd.array([v if v < 2**63 else None for v in exact], "Int64")
            out["deviation_exact"] = [str(v) for v in exact]
            out["white"] = list((away / n) @ projection)
            yield out

    fields = [rows.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "deviation long, deviation_exact string, white array<double>"])
    return rows.select(*keep, "x").mapInPandas(run, schema)


def whiten(vectors: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, component, n, deviation, whitened, explained, identity_error, deviation_exact: one row per vector and component."""
    grid = cut(vectors.select(F.col(key).alias("id"), on_grid(vectors, vector).alias("x")).where("x IS NOT NULL"))
    lengths = [r.d for r in grid.select(F.size("x").alias("d")).distinct().orderBy("d").limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} different lengths")
    kind = grid.schema["id"].dataType.simpleString()
    out = vectors.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string")
    for width in filter(None, lengths):
        rows = grid.where(F.size("x") == width)
        distinct = cut(rows.select("x").distinct())
        space = fit_whitening(distinct, width, components)
        if space is None:
            continue
        explained = F.array(*(F.lit(float(e) / space.trace) for e in space.eigenvalues))
        error = identity_error(distinct, space)
        each = project(rows, space, ["id"]).select("*", F.posexplode("white").alias("at", "whitened"))
        out = out.union(
            each.select(
                "id",
                (F.col("at") + 1).cast("int").alias("component"),
                F.lit(space.n).cast("long").alias("n"),
                "deviation",
                "whitened",
                F.get(explained, F.col("at")).alias("explained"),
                F.lit(error).alias("identity_error"),
                "deviation_exact",
            )
        )
    return out.withColumnRenamed("id", key)
