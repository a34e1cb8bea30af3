"""Readers, writers and grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import grids
from bandloom.sources import sinks, tables


def spectra(spark, **more):
    rows = [("s1", 0, 1, 30, [4.0, 8.0]), ("s1", 1, 2, 31, [float("nan"), float("nan")]), ("s2", 0, 3, 29, [1.0, 2.0])]
    return spark.createDataFrame(rows, "session_id string, orig_idx int, unique_packet_id long, bit_slice int, data array<double>").withColumns({k: F.lit(v) for k, v in more.items()})


def test_spectra_round_trip(spark, tmp_path):
    sinks.save(spectra(spark), str(tmp_path), "spectra", order=["orig_idx"], slices=2, units="SDU", representation="gain_model_input_sdu")
    got = {(r.session_id, r.orig_idx): r.data for r in tables.read_products(spark, str(tmp_path), "spectra").collect()}
    assert got == {("s1", 0): [4.0, 8.0], ("s2", 0): [1.0, 2.0]}


def test_layout_2_is_restored_and_others_refused(spark, tmp_path):
    spectra(spark, layout_version=2).write.partitionBy("session_id").parquet(str(tmp_path / "a" / "spectra"))
    got = {(r.session_id, r.orig_idx): r.data for r in tables.read_products(spark, str(tmp_path / "a"), "spectra").filter("orig_idx = 0").collect()}
    assert got == {("s1", 0): [2.0, 4.0], ("s2", 0): [0.25, 0.5]}
    for name, df in (("b", spectra(spark, layout_version=3)), ("c", spectra(spark, layout_version=4)), ("d", spectra(spark, layout_version=2).withColumn("bit_slice", F.lit(40)))):
        df.write.partitionBy("session_id").parquet(str(tmp_path / name / "spectra"))
        with pytest.raises(tables.ContractError):
            tables.read_products(spark, str(tmp_path / name), "spectra")


def test_checks_come_before_writing(spark, tmp_path):
    bad = spectra(spark).withColumn("actual_bitslice", F.array_repeat(F.lit(40.0), 16))
    with pytest.raises(tables.ContractError):
        sinks.save(bad, str(tmp_path), "spectra")
    assert not (tmp_path / "spectra").exists()


def test_response_files(spark, tmp_path):
    head = "freq_MHz,theta_deg,phi_deg,re(rx_Theta),im(rx_Theta),re(rx_Phi),im(rx_Phi)\n"
    full = [f"{f},{t},{p},{0 if t > 90 else 1},0,0,0" for f in (1, 2) for t in (0, 90, 120) for p in (0, 180)]
    (tmp_path / "ok.csv").write_text(head + "\n".join(full))
    assert tables.read_response(spark, str(tmp_path / "ok.csv")).count() == 8
    (tmp_path / "hole.csv").write_text(head + "\n".join(full[1:]))
    (tmp_path / "low.csv").write_text(head + "\n".join([*full[:-1], "2,120,180,1,0,0,0"]))
    (tmp_path / "names.csv").write_text("a,b\n1,2\n")
    for bad in ("hole", "low", "names"):
        with pytest.raises(ValueError):
            tables.read_response(spark, str(tmp_path / f"{bad}.csv"))


def test_z_matrix(spark, tmp_path):
    cols = [f"{p}Z{a}{b}" for a in range(1, 5) for b in range(1, 5) for p in ("re", "im")]
    (tmp_path / "z.csv").write_text("freq_Hz,freq_MHz," + ",".join(cols) + "\n1e6,1," + ",".join(str(i) for i in range(32)))
    got = tables.read_z_matrix(spark, str(tmp_path / "z.csv"))
    assert got.count() == 16 and got.filter("a = 1 and b = 2").first()[3:] == (12.0, 13.0)
    (tmp_path / "bad.csv").write_text("freq_Hz,freq_MHz," + ",".join(cols) + "\n1e6,1," + ",".join(["nan"] * 32))
    with pytest.raises(ValueError):
        tables.read_z_matrix(spark, str(tmp_path / "bad.csv"))


def test_malformed_json_is_null(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{bad",), (None,)], "j string")
    assert [r[0] and r[0].a for r in df.select(tables.parse_json(F.col("j"), "a int")).collect()] == [1, None, None]


def test_covariance_contract(spark, tmp_path):
    good = spark.createDataFrame([(t, f, p, 1.0, "V2/Hz", "utc") for t in range(2) for f in range(2) for p in ("00R", "11R")], "time_idx int, freq_idx int, product string, value double, units string, scale string")
    good.write.parquet(str(tmp_path / "good"))
    good.limit(7).write.parquet(str(tmp_path / "hole"))
    assert tables.read_covariance(spark, str(tmp_path / "good")).count() == 8
    with pytest.raises(tables.ContractError):
        tables.read_covariance(spark, str(tmp_path / "hole"))


def test_housekeeping_and_metadata(spark):
    rows = [("s", 1, 1, 0, 5.0, 2, {"ok": 1.0, "telemetry_a": 3.0}), ("s", 2, 1, 0, 4.0, 2, {"telemetry_b": 7.0}), ("s", 3, 1, 0, 1.0, 3, {"checksum": 9.0})]
    hk = spark.createDataFrame(rows, "session_id string, unique_packet_id long, version int, errors int, raw_seconds double, type int, fields map<string,double>")
    names = sinks.telemetry_channels(hk)
    got = sinks.housekeeping_table(hk, 2, names).collect()
    assert names == ["telemetry_a", "telemetry_b"] and [(r.raw_seconds, r.time, r.ok, r.telemetry_a, r.telemetry_b) for r in got] == [(4.0, 0.0, 0.0, None, 7.0), (5.0, 0.0, 1.0, 3.0, None)]
    later = hk.withColumn("fields", F.when(F.col("unique_packet_id") == 1, F.create_map(F.lit("telemetry_z"), F.lit(1.0), F.lit("telemetry_c"), F.lit(2.0))).otherwise(F.col("fields")))
    assert sinks.telemetry_channels(later) == ["telemetry_z", "telemetry_c", "telemetry_b"]
    meta = spark.createDataFrame([((None, [1.0]), (5, None))], "meta struct<Navgf:int,adc_min:array<double>>, base struct<navgf:int,adc_min:array<double>>")
    r = sinks.metadata_columns(meta, ["navgf", "absent"], {"adc_min": 4}).first()
    assert (r.navgf, r.absent, r.adc_min) == (5, None, [1.0, 0.0, 0.0, 0.0])


def test_packet_files(spark, tmp_path):
    p = spark.createDataFrame([("s", 5, 1, 0, 0x209), ("s", 4, 2, 1, 0x2A0)], "session_id string, unique_packet_id long, seq int, pkt_idx int, appid int")
    sinks.write_packets(p, str(tmp_path), ["session_id"])
    assert sorted(r.file for r in spark.read.parquet(str(tmp_path / "packets")).collect()) == ["00000_02a0.bin", "00001_0209.bin"]


def test_time_and_frequency_grids(spark):
    assert grids.parse_range("CY25")[0].hour == 1 and grids.parse_range("FY2026")[0].isoformat() == "2025-10-01T00:00:00"
    t = [r.t for r in grids.time_grid(spark, "2025-01-01 to 2025-01-02", 7 * 3600).orderBy("idx").collect()]
    assert len(t) == 5 and t[-1].isoformat() == "2025-01-02T04:00:00" and len(grids.time_grid(spark, "2025-01-01 to 2025-01-02", 3600).collect()) == 25
    make = lambda c: [r.freq for r in grids.frequency_grid(spark, c).orderBy("idx").collect()]
    assert make({"values": [1, 5]}) == [1.0, 5.0] and make({"start": 1, "end": 4, "step": 1}) == [1.0, 2.0, 3.0] and make({"start": 1, "end": 4, "n": 4}) == [1.0, 2.0, 3.0, 4.0]
    for bad in ({"indices": [1]}, {"start": 1, "end": 2, "step": 1, "n": 2}, {"start": 1}, {"values": []}):
        with pytest.raises(ValueError):
            grids.frequency_grid(spark, bad)


def test_frequency_selection(spark):
    g = spark.createDataFrame([(1.0, 0), (2.0, 0), (2.0, 1)], "freq_mhz double, i int")
    assert grids.select_frequencies(g, [2.0]).count() == 2
    for bad in ([3.0], [2.0, 2.0]):
        with pytest.raises(ValueError):
            grids.select_frequencies(g, bad)


def test_bilinear_wraps(spark):
    g = spark.createDataFrame([(t, p, float(10 * t + p)) for t in range(3) for p in range(4)], "ti int, pi int, v double")
    pts = spark.createDataFrame([(0, 5.0, 45.0), (1, 10.0, 315.0), (2, 20.0, 360.0), (3, 21.0, 0.0)], "i int, theta_deg double, phi_deg double")
    got = {r.i: r.v for r in grids.bilinear(pts, g, 0.0, 10.0, 3, 90.0, ["v"]).collect()}
    assert got[0] == 5.5 and got[1] == 11.5 and got[2] == 20.0 and got[3] is None


def test_peaks(spark):
    v = [0, 5, 4.99, 6, 1, 10, 0, 3, 0]
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "k string, t int, v double")
    got = {r.t: r.prominence for r in grids.prominent_peaks(df, ["k"], "t", "v", 0.01).collect()}
    assert set(got) == {3, 5, 7} and np.isclose(got[3], 0.5) and np.isclose(got[5], 1.0)
