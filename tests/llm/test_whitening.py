import math

import numpy as np
import pytest
from folioscope.llm.queries import op11_whitening
from folioscope.llm.whitening import whiten

INF, NAN = float("inf"), float("nan")


def brute(vectors, components=16):
    """``{place: [(n, deviation, projected onto its component, explained)]}`` of (id, vector) rows of one length."""
    rows = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    grid = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, grid)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    away = [[n * x - s for x, s in zip(v, sums)] for v in fit]
    exact = [[sum(a[i] * a[j] for a in away) / n**3 for j in range(len(sums))] for i in range(len(sums))]
    values, directions = np.linalg.eigh(np.array(exact))
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    trace = sum(exact[i][i] for i in range(len(sums)))
    out = []
    for (i, _), v in zip(rows, grid):
        d = [n * x - s for x, s in zip(v, sums)]
        white = (np.array(d) / n) @ directions / np.sqrt(values)
        out += [(i, k + 1, n, sum(a * a for a in d), white[k], values[k] / trace) for k in range(len(values))]
    return out


def same(got, want):
    got = sorted(got, key=lambda r: (r.vec_id, r.component, abs(r.whitened)))
    want = sorted(want, key=lambda r: (r[0], r[1], abs(r[4])))
    assert len(got) == len(want) and got
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [r[:4] for r in want]
    assert all(int(r.deviation_exact) == r.deviation for r in got)
    assert max(r.identity_error for r in got) < 1e-4 and len({r.identity_error for r in got}) == 1
    for k in {r.component for r in got}:
        ours, theirs = (np.array([x for c, x in pairs if c == k]) for pairs in ([(r.component, r.whitened) for r in got], [(r[1], r[4]) for r in want]))
        sign = 1 if abs(ours - theirs).max() < abs(ours + theirs).max() else -1
        assert abs(ours - sign * theirs).max() < 1e-7
    assert max(abs(r.explained / w[5] - 1) for r, w in zip(got, want)) < 1e-9


def test_real_vectors(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    same(op11_whitening(spark, folder).collect(), brute(rows))


def test_broken_repeated_and_hot_vectors(spark):
    rng = np.random.default_rng(3)
    spread = np.array([9.0, 5.0, 3.0, 1.0])
    rows = [(i, (rng.normal(size=4) * spread).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(300)] + [(500, None), (501, [1.0, None, 2.0, 3.0]), (502, [1.0, NAN, 2.0, 3.0]), (503, [INF, 0.0, 2.0, -INF])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, x string, white string").repartition(5)
    same(whiten(df, components=3).collect(), brute(rows, 3))


def test_lengths_null_ids_and_flat_spaces(spark):
    rows = [(1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [3.0, 5.0]), (None, [2.0, 0.0]), (5, [1.0]), (6, [4.0]), (7, []), (8, [1.0, 1.0, 1.0]), (9, [0.5, 0.5, 0.5, 0.5]), (10, [0.5, 0.5, 9.0, 0.5])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(((r.vec_id, r.component, r.n) for r in got), key=str) == sorted([(i, k, 3) for i in (1, 2, 3, None) for k in (1, 2)] + [(5, 1, 2), (6, 1, 2), (9, 1, 2), (10, 1, 2)], key=str)
    assert {round(abs(r.whitened), 9) for r in got if r.n == 2} == {1.0}
    empty = whiten(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.columns == whiten(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")).columns and empty.count() == 0


def test_deviations_beyond_a_long(spark):
    rows = [(0, [2.0**30, 0.0]), (1, [0.0, 2.0**31])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    exact = 2**72 + 2**74
    assert all(r.deviation is None and int(r.deviation_exact) == exact for r in got) and len(got) == 2
    with pytest.raises(OverflowError):
        whiten(spark.createDataFrame([(0, [2.0**55]), (1, [0.0])], "vec_id long, embedding array<double>"))
