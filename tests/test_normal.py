"""Normal equations without their matrix against NumPy, and wide principal components against the Gram route."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandloom.operators import normal, wide


def system(seed, keys=3, rows=60, n=6):
    rng = np.random.default_rng(seed)
    j = rng.normal(size=(keys, rows, n)) * (rng.random((keys, rows, n)) < 0.4)
    return j, rng.normal(size=(keys, rows)), rng.random((keys, rows)) + 0.1, rng.random((keys, n)) + 0.05


def as_tables(spark, j, d, w, s):
    k, r, c = np.nonzero(j)
    entries = spark.createDataFrame(pd.DataFrame({"k": k, "row": r, "c": c, "v": j[k, r, c]}))
    k, r = np.indices(d.shape).reshape(2, -1)
    data = spark.createDataFrame(pd.DataFrame({"k": k, "row": r, "d": d.ravel(), "w": w.ravel()}))
    sizes = spark.createDataFrame([(i, j.shape[2]) for i in range(len(j))], "k long, n long")
    k, c = np.indices(s.shape).reshape(2, -1)
    return entries, data, sizes, spark.createDataFrame(pd.DataFrame({"k": k, "c": c, "prior": s.ravel()}))


@pytest.mark.parametrize("entries_of", [20, 1 << 18])
def test_as_numpy_solves(spark, entries_of):
    j, d, w, s = system(1)
    got = normal.solve(*as_tables(spark, j, d, w, s), tolerance=1e-13, entries_of=entries_of).toPandas().sort_values(["k", "c"])
    want = [np.linalg.solve(j[i].T @ (w[i][:, None] * j[i]) + np.diag(s[i]), j[i].T @ (w[i] * d[i])) for i in range(3)]
    assert np.allclose(got["x"].to_numpy().reshape(3, -1), want, atol=1e-9)


def test_edges(spark):
    entries = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 0, 1.0), (0, 1, 1, None), (0, 2, 1, 3.0), (0, 9, 1, 5.0), (1, 0, 0, 1.0)], "k long, row long, c int, v double")
    data = spark.createDataFrame([(0, 0, 4.0, 1.0), (0, 1, 1.0, 1.0), (0, 2, 6.0, 2.0), (0, 3, 1.0, 1.0), (1, 0, None, 1.0), (0, 9, 1.0, 0.0)], "k long, row long, d double, w double")
    sizes = spark.createDataFrame([(0, 3), (1, 2), (2, 1)], "k long, n long")
    got = {(r.k, r.c): round(r.x, 9) for r in normal.solve(entries, data, sizes).collect()}
    # Repeated entries add up; an unknown without entries, and keys without data, are 0.
    assert got == {(0, 0): 2.0, (0, 1): 2.0, (0, 2): 0.0, (1, 0): 0.0, (1, 1): 0.0, (2, 0): 0.0}
    assert normal.solve(entries.limit(0), data.limit(0), sizes.limit(0)).count() == 0


def test_no_row_holds_a_whole_vector(spark, monkeypatch):
    seen, stored = [], normal.stored
    monkeypatch.setattr(normal, "stored", lambda df: seen.append(stored(df)) or seen[-1])
    # Most rows lie in one cell of the ranges, and neighbours are coupled across the pieces.
    n = 2 * normal.PIECE + 3
    at = range(normal.PIECE - 3, n - 1)
    entries = spark.createDataFrame([(0, r, c, v) for r in at for c, v in ((r, 4.0), (r + 1, 0.1))] + [(0, 1 << 40, 5, 1.0)], "k long, row long, c int, v double")
    data = spark.createDataFrame([(0, r, 1.0 + r % 3, 1.0) for r in (*at, 1 << 40)], "k long, row long, d double, w double")
    prior = spark.createDataFrame([(0, c, 1.0) for c in range(n)], "k long, c int, prior double")
    got = np.array([r.x for r in normal.solve(entries, data, spark.createDataFrame([(0, n)], "k long, n long"), prior, 1e-6, entries_of=4000).orderBy("c").collect()])
    back = np.array([r.ax for r in normal.apply(entries, data, spark.createDataFrame(pd.DataFrame({"k": 0, "c": np.arange(n), "x": got})), prior).orderBy("c").collect()])
    d = np.array([1.0 + r % 3 for r in at])
    want = np.zeros(n)
    want[at.start : n - 1] += 4 * d
    want[at.start + 1 : n] += 0.1 * d
    want[5] += 1.0 + (1 << 40) % 3
    assert len(got) == n and np.allclose(back, want, atol=1e-4) and np.isclose(got[5], want[5] / 2)
    for df in seen:
        sizes = [F.max(F.size(f.name)) if f.dataType.typeName() == "array" else F.max(F.length(f.name) / 8) for f in df.schema if f.dataType.typeName() in ("array", "binary")]
        assert not sizes or max(x or 0 for x in df.agg(*sizes).first()) <= normal.PIECE


def test_an_entry_beyond_the_unknowns(spark):
    entries, data, sizes, prior = as_tables(spark, *system(3))
    with pytest.raises(Exception, match="beyond the unknowns"):
        normal.solve(entries, data, sizes.withColumn("n", F.lit(2)), prior)


def test_not_solved_in_time(spark):
    with pytest.raises(ValueError, match="not solved"):
        normal.solve(*as_tables(spark, *system(2)), steps=2)


def spectra(spark, n, k, rank, seed=3):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, rank)) * 2.0 ** -np.arange(rank)) @ rng.normal(size=(rank, k)) + rng.normal(size=k) * 5 + rng.normal(size=(n, k)) * 1e-4
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>").repartition(5)


def test_wide_components_as_the_gram_route(spark):
    x, df = spectra(spark, 120, 16 * 64, 8)
    w, noise = np.linspace(0.5, 1.5, x.shape[1]), np.full(x.shape[1], 1e-3)
    mean, e, v = wide.principal_components(df, "x", x.shape[1], 6, w, noise)
    want = np.cov((x * w).T) + np.diag((noise * w) ** 2)
    lam, vec = np.linalg.eigh(want)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(e, lam[::-1][:6], rtol=1e-8)
    assert np.allclose(np.linalg.svd(vec[:, ::-1][:, :6].T @ v)[1], 1, atol=1e-8)
    got = {r.i: r.s for r in wide.scores(df, "x", mean, v, w, "s").select("i", "s").collect()}
    assert np.allclose([got[i] for i in range(120)], ((x - mean) * w) @ v)


def test_sixteen_wide_spectra(spark):
    # 32,768 columns: their covariance would be 8 GB.
    x, df = spectra(spark, 60, 16 * 2048, 5)
    _, e, v = wide.principal_components(df, "x", x.shape[1], 5, more=5, rounds=2)
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(e, s[:5] ** 2 / 59) and np.allclose(np.linalg.svd(vt[:5] @ v)[1], 1, atol=1e-8)


def test_wide_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    x, df = spectra(spark, 60, 700, 3)
    once = df.withColumn("x", F.udf(counted, "array<double>")("x"))
    _, e, _ = wide.principal_components(once, "x", 700, 3)
    # The filter of usable rows may make them a second time; the passes do not.
    assert made.value <= 180 and np.allclose(e, np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:3] ** 2 / 59)


def test_wide_rows_that_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (2, None), (3, [1.0]), (4, [nan, 1.0]), (5, [None, 1.0])]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    mean, e, v = wide.principal_components(df, "x", 2, 1)
    assert np.allclose(mean, [2, 0]) and np.allclose(e, [2]) and np.allclose(v, [[1], [0]])
    got = {r.i: r.scores and round(r.scores[0], 9) for r in wide.scores(df, "x", mean, v).collect()}
    assert got == {0: -1.0, 1: 1.0, 2: None, 3: None, 4: None, 5: None}
    with pytest.raises(ValueError):
        wide.principal_components(df.filter("i = 0"), "x", 2, 1)
