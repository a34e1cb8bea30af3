"""Loading of sources: paths, terms, presence, padding, time scales; sampling on irregular axes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import grids
from bandloom.sources import bundles, sinks, tables


def test_paths_by_format(spark, tmp_path):
    for p in ("a/x.h5", "a/x.fits", "a/b/x.fits", "a/b/y.h5", "a/note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = {r.inner for r in bundles.resolve_paths(spark, str(tmp_path / "a"), ["h5", "fits"]).collect()}
    assert got == {"x.h5", "b/x.fits", "b/y.h5"}
    one = bundles.resolve_paths(spark, [str(tmp_path / "a/b"), f"file://{tmp_path}/a/x.fits"], ["fits", "h5"]).collect()
    assert {(r.inner, r.path.endswith("a/x.fits")) for r in one} == {("x.fits", False), ("y.h5", False), ("x.fits", True)}
    (tmp_path / "it's").mkdir()
    for root in (str(tmp_path / "none"), str(tmp_path / "it's"), []):
        with pytest.raises(FileNotFoundError):
            bundles.resolve_paths(spark, root, ["h5"])


def test_terms_are_compared_before_rows_are_read(spark, tmp_path):
    fails = spark.range(3).select("id", F.raise_error(F.lit("a row was read")).cast("double").alias("x"))
    a, b = tables.with_terms(fails, "x", units="SDU"), tables.with_terms(fails, "x", units="nV")
    for other in (b, fails):
        with pytest.raises(tables.ContractError, match="differ in what x is"):
            bundles.combine({"a": a, "b": other})
    good = tables.with_terms(spark.range(3).select("id", F.lit(1.0).alias("x")), "x", units="SDU", frame="site")
    good.write.parquet(str(tmp_path / "x"))
    got = bundles.combine({"a": spark.read.parquet(str(tmp_path / "x")), "b": good, "c": spark.range(2)})
    assert tables.terms_of(got, "x") == {"units": "SDU", "frame": "site"} and got.count() == 8 and got.filter("x is null").count() == 2
    with pytest.raises(tables.ContractError):
        bundles.combine({"a": spark.range(1).withColumn("source", F.lit(1))})


def test_presence_and_padding(spark):
    a = spark.createDataFrame([(1, [[1.0, 2.0]], [5.0], 0.5), (2, None, None, 0.6)], "id int, x array<array<double>>, y array<double>, mjd double")
    b = spark.createDataFrame([(3, [[3.0], [4.0], None], [6.0, 7.0])], "id int, x array<array<double>>, y array<double>")
    got = bundles.combine({"a": a, "b": b}, everywhere=["mjd"], ragged=["x", "y"])
    rows = {r.id: r for r in got.collect()}
    assert got.columns == ["id", "x", "y", "source"] and rows[2].x is None and rows[2].y is None
    nan = float("nan")
    np.testing.assert_equal(rows[1].x, [[1.0, 2.0], [nan, nan], [nan, nan]])
    np.testing.assert_equal(rows[3].x, [[3.0, nan], [4.0, nan], [nan, nan]])
    np.testing.assert_equal([rows[1].y, rows[3].y], [[5.0, nan], [6.0, 7.0]])
    empty = bundles.combine({"a": a.limit(0), "b": b.limit(0)}, ragged=["x", "y"])
    assert empty.count() == 0


def written(spark, folder, scale, units="SDU", interpolated=True):
    rows = spark.createDataFrame([("s1", 0, 4, [1.0, 2.0]), ("s1", 0, 5, [3.0, 4.0])], "session_id string, orig_idx int, product int, data array<double>").withColumn("bit_slice", F.lit(31))
    sinks.save_kind(rows, folder, "spectra", units=units, representation="gain_model_input_sdu")
    if interpolated:
        sinks.save_kind(spark.createDataFrame([("s1", 0, "c", 1.0)], "session_id string, orig_idx int, channel string, value double"), folder, "interpolated")
    if scale:
        sinks.save_kind(spark.createDataFrame([("s1", "time_scale", scale), ("s1", "epoch", folder[-1])], "session_id string, key string, value string"), folder, "constants")
    return folder


def test_load(spark, tmp_path):
    a, b, c, d, e = (written(spark, str(tmp_path / n), s, u, i) for n, s, u, i in (("a", "utc", "SDU", True), ("b", "utc", "SDU", False), ("c", "tai", "SDU", True), ("d", None, "SDU", True), ("e", "utc", "nV", True)))
    got = bundles.load(spark, [a, b])
    assert (got.scale, got.axis, set(got.tables)) == ("utc", "spectra", {"spectra", "constants"})
    assert {(r["key"], r["value"], r["n_values"]) for r in got.constants.collect()} == {("time_scale", "utc", 1), ("epoch", "a", 2)}
    assert tables.terms_of(got.tables["spectra"], "data")["units"] == "SDU"
    assert sorted((r.source[-1], r.bin, r.value.re, r.value.im) for r in got.product("10C").collect()) == [(s, i, 1.0 + i, -3.0 - i) for s in "ab" for i in (0, 1)]
    assert set(bundles.load(spark, [a, d], assume_scale="UTC").tables) >= {"interpolated"}
    assert bundles.load(spark, a, preferred="interpolated").axis == "interpolated"
    for roots, assumed, error in (([a, c], None, ValueError), ([a, d], None, ValueError), ([a, d], "tai", ValueError), ([d], "unknown", ValueError), ([a, e], None, tables.ContractError), ([str(tmp_path / "z")], None, FileNotFoundError)):
        with pytest.raises(error):
            bundles.load(spark, roots, assume_scale=assumed)


def test_irregular_axes(spark):
    theta, phi = [0.0, 10.0, 45.0, 90.0], [5.0, 100.0, 200.0, 350.0]
    f = lambda t, p: 2 * t + p
    grid = spark.createDataFrame([(t, p, f(t, p), 1.0) for t in theta for p in phi if (t, p) != (90.0, 200.0)], "theta_deg double, phi_deg double, v double, one double")
    places = [(1, 20.0, 150.0), (2, 0.0, 5.0), (3, 90.0, 110.0), (4, 90.5, 50.0), (5, 30.0, 357.5), (6, 45.0, -260.0), (7, None, 1.0), (8, 20.0, 150.0), (9, 90.0, 90.0)]
    got = {r.k: r for r in grids.bilinear_axes(spark.createDataFrame(places, "k int, theta_deg double, phi_deg double"), grid, ["v", "one"]).collect()}
    assert len(got) == 9 and got[4].v is None and got[7].v is None and got[3].v is None
    assert got[1].v == got[8].v == pytest.approx(190.0) and got[2].v == 5.0 and got[6].v == pytest.approx(190.0) and got[9].v == pytest.approx(270.0)
    # Halfway between 350 and 5 degrees.
    assert got[5].v == pytest.approx(60 + (350 + 5) / 2) and got[5].one == pytest.approx(1.0)
    none = grids.bilinear_axes(spark.createDataFrame(places, "k int, theta_deg double, phi_deg double"), grid.limit(0), ["v"])
    assert none.filter("v is null").count() == 9
