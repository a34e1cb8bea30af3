"""Keyed responses, cubes of products, verdicts on a response's matrices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandloom.operators import freq, matrices, products


def test_keyed_response(spark):
    curves = spark.createDataFrame([(0, -1.0, 0.0), (0, 1.0, 2.0), (33, 0.0, 5.0), (33, 1.0, 5.0)], "key int, x double, y double")
    rows = spark.createDataFrame([(1, 0.0, 0), (2, 9.0, 0), (3, None, 0), (4, 0.0, None), (5, 0.5, -31), (6, 1.0, 33)], "i int, f double, z int")
    got = {r.i: r.response for r in freq.keyed_response(rows, curves, "f", "z", wrap=True).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None, 4: None, 5: 5.0, 6: 5.0}
    for wrap, key in ((False, 7), (True, 64), (True, -33)):
        with pytest.raises(ValueError, match="no response"):
            freq.keyed_response(rows.withColumn("z", F.lit(key)), curves, "f", "z", wrap)


def test_cubes(spark):
    rows = spark.createDataFrame([(1, 0, [[1.0, 2.0]]), (1, 2, [[3.0], None]), (1, 16, [[9.0] * 9]), (2, 1, None), (3, 1, [])], "k int, product int, d array<array<double>>")
    got = {r.k: r.cube for r in products.cube(rows, ["k"], "d", n=3).collect()}
    assert got[1] == [[[1.0, 2.0], [None, None]], [[None, None]] * 2, [[3.0, None], [None, None]]] and got[3] == [[], [], []] and 2 not in got
    one = rows.limit(1).select(products.fixed_cube(F.col("d"), 2, 3).alias("x")).first().x
    assert one == [[1.0, 2.0, None], [None, None, None]]


def test_verdict_as_numpy(spark):
    rng = np.random.default_rng(5)
    mats = {}
    for k in range(4):
        parts = [x @ x.conj().T for x in rng.normal(size=(3, 4, 4))]
        react = rng.normal(size=(4, 4))
        mats[k] = (sum(parts) + 1j * (react + react.T), parts)
    mats[1] = (mats[1][0] + np.triu(np.ones((4, 4)), 1) * 0.1, mats[1][1])
    mats[2] = (mats[2][0], [mats[2][1][0] * 2, *mats[2][1][1:]])
    long = lambda of: spark.createDataFrame(pd.DataFrame([(k, a, b, of(v)[a, b].real, of(v)[a, b].imag) for k, v in mats.items() for a in range(4) for b in range(4)], columns=["k", "a", "b", "re", "im"]))
    got = {r.k: r for r in matrices.response_verdict(long(lambda v: v[0]), {n: long(lambda v, i=i: v[1][i].astype(complex)) for i, n in enumerate(("sky", "moon", "loss"))}, ["k"]).collect()}
    assert {k: r.passes for k, r in got.items()} == {0: True, 1: False, 2: False, 3: True}
    for k, (z, parts) in mats.items():
        assert np.isclose(got[k].condition, np.linalg.cond(z)) and np.isclose(got[k].least, np.linalg.eigvalsh((z + z.conj().T) / 2)[0]) and np.isclose(got[k].moon_least, np.linalg.eigvalsh(parts[1])[0])
