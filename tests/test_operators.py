"""Operators against restated formulas, and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import bits
from bandloom.functions import calibrate as C
from bandloom.operators import freq, gain, grids, linear, matrices, order, packets, products, sessions, stats, telemetry
from bandloom.sources import banks, sinks, tables
from bandloom.streaming import streams


def frame(appid, flags, seq, body, good=True):
    head = appid.to_bytes(2, "big") + (flags << 14 | seq).to_bytes(2, "big") + (len(body) - 1).to_bytes(2, "big")
    return banks.SYNC + head + body + (banks.crc16(head + body) ^ (0 if good else 1)).to_bytes(2, "big")


def test_crc_known_value():
    assert banks.crc16(b"123456789") == 0x29B1


def test_cut_frames():
    inner = frame(1, 3, 9, b"in")
    stream = b"\xa5\xa5junk" + frame(0x209, 0, 1, b"ab") + b"\xa5" + frame(0x209, 1, 2, inner, good=False) + b"\xec\xa5\xa0" + frame(5, 3, 3, b"cdef")[2:] + banks.SYNC + b"\x00\x01"
    got = list(banks.cut_frames(stream))
    # A bad frame is passed over with what lies in it; padding may even stand inside the sync word; the tail is a reject.
    assert [(p, r) for _, p, r in got] == [(b"ab", None), (inner, "crc"), (b"cdef", None), (b"", "tail")]
    assert list(banks.cut_frames(b"")) == [] and list(banks.cut_frames(b"\xa5" * 9)) == []


def test_banks_to_packets(spark, tmp_path):
    data = {
        "b05": frame(0x210, 0, 1, b"\x01\x02") + frame(0x210, 1, 2, b"\x03\x04\x05\x06") + frame(0x211, 3, 3, b"\x00\x11\x22\x33") + frame(0x212, 0, 4, b"odd") + frame(0x212, 1, 5, b"\x0a\x0b") + frame(0x213, 0, 6, b"xx"),
        "b01": frame(0x314, 3, 1, b"\x01\x02"), "b07": b"",
    }
    for bank, content in data.items():
        (tmp_path / "flash" / bank).mkdir(parents=True)
        (tmp_path / "flash" / bank / banks.BANK_FILE).write_bytes(content)
    frames = banks.frames(banks.read_banks(spark, str(tmp_path))).cache()
    assert frames.filter("bank = 'b05' and reject is null").count() == 6
    got, rejects = packets.reassemble(frames)
    rows = {(r.bank, r.appid): r for r in got.collect()}
    assert bytes(rows["b05", 0x210].blob) == b"\x02\x01\x04\x03\x06\x05" and (rows["b05", 0x210].start_seq, rows["b05", 0x210].seq) == (1, 2)
    assert rows["b05", 0x211].single_packet and bytes(rows["b05", 0x212].blob) == b"\x0b\x0a" and bytes(rows["b01", 0x314].blob) == b"\x01\x02"
    assert {r.reason for r in rejects.collect()} == {"odd", "open"}
    classes = spark.createDataFrame([(0x210, "prefixed"), (0x211, "derived"), (0x212, "dropped"), (0x314, "derived")], "appid int, uid_class string")
    order_ = [F.col("bank"), F.col("pkt_idx")]
    ids = {r.appid: r.unique_packet_id for r in packets.identify(packets.classify(got, classes), order_).collect()}
    assert ids == {0x210: 0x03040102, 0x211: 0x03040102}
    one = streams.bank_stream(spark, str(tmp_path))
    again = streams.run_once(one, str(tmp_path / "stream"))
    assert sorted((r.bank, r.frame_idx, bytes(r.payload)) for r in again.collect()) == sorted((r.bank, r.frame_idx, bytes(r.payload)) for r in frames.collect())


def test_packets_online_like_batch(spark, tmp_path):
    streams.with_rocksdb(spark)
    (tmp_path / "flash" / "b01").mkdir(parents=True)
    (tmp_path / "flash" / "b01" / banks.BANK_FILE).write_bytes(b"".join(frame(7, (0, 0, 1)[k % 3], k, bytes([k, k + 1])) for k in range(8)))
    s = streams.bank_stream(spark, str(tmp_path)).filter("reject is null").select("stream_id", "bank", "frame_idx", "appid", "groupflags", "sequence_cnt", "payload")
    got = streams.run_once(streams.packets_online(s), str(tmp_path / "s")).orderBy("pkt_idx").collect()
    want = packets.reassemble(banks.frames(banks.read_banks(spark, str(tmp_path))))[0].orderBy("pkt_idx").collect()
    assert [(r.pkt_idx, r.start_seq, r.seq, bytes(r.blob)) for r in got] == [(r.pkt_idx, r.start_seq, r.seq, bytes(r.blob)) for r in want] and len(got) == 2


def test_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04\x05"),), (bytearray(b"\x01\x02"),), (None,)], "b binary")
    got = df.select(bits.swap16(F.col("b")).alias("s"), bits.little_endian_u32(F.col("b")).alias("u")).collect()
    assert [r.u for r in got] == [0x04030201, None, None] and [r.s and bytes(r.s) for r in got] == [None, b"\x02\x01", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_buckets_equal_plain_windows(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), i, i // 7 if seed == 1 else i // 90, rng.choice([None, rng.randint(0, 9)]), rng.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, bucket int, v int, h boolean")
    for f in (
        lambda b: order.carry_last(df, ["k"], ["t"], {"x": F.col("v")}, b),
        lambda b: order.running_sum(df, ["k"], ["t"], F.col("v"), "x", b),
        lambda b: order.running_sum(df, ["k"], ["t"], F.col("v"), "x", b, order.BEFORE),
        lambda b: order.previous(df, ["k"], ["t"], F.col("v"), "x", b),
        lambda b: order.split_sessions(df, ["k"], ["t"], F.col("h"), "x", b),
        lambda b: order.group_until(df, ["k"], ["t"], F.col("h"), "x", b),
    ):
        plain, cut = ({(r.k, r.t): r.x for r in f(b).collect()} for b in (None, "bucket"))
        assert plain == cut


def test_sessions_fold_hellos(spark):
    kinds = "ddhhdhdhh"
    df = spark.createDataFrame([("s", i, c == "h") for i, c in enumerate(kinds)], "k string, t int, h boolean")
    got = [r.session_no for r in order.split_sessions(df, ["k"], ["t"], F.col("h")).orderBy("t").collect()]
    assert got == [0, 0, 1, 1, 1, 2, 2, 3, 3]


def test_telemetry_goes_to_sessions(spark):
    s = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0)], "k string, session_id int, start double")
    t = spark.createDataFrame([("a", 5.0), ("a", 10.0), ("a", 19.9), ("a", 25.0), ("b", 1.0)], "k string, t double")
    got = {(r.k, r.t): r.session_id for r in sessions.assign_telemetry(t, s, ["k"], "t", "start", "session_id").collect()}
    assert got == {("a", 5.0): 1, ("a", 10.0): 1, ("a", 19.9): 1, ("a", 25.0): 2, ("b", 1.0): None}


def test_windows_open_at_the_ends(spark):
    s = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 0, None)], "k string, n int, start double")
    got = {r.n: (r.lo, r.hi) for r in sessions.session_windows(s, ["k"], "start", "n").collect()}
    assert got == {0: (None, 10.0), 1: (10.0, 20.0), 2: (20.0, None)}


def test_interpolation_like_numpy(spark):
    series = [("a", 1.0, 10.0), ("a", 3.0, 30.0), ("a", 3.0, 50.0), ("a", 4.0, 0.0), ("b", 7.0, 5.0)]
    at = [0.0, 1.0, 2.2, 3.0, 3.5, 9.0]
    tel = spark.createDataFrame(series, "k string, t double, v double")
    asked = spark.createDataFrame([(k, x) for k in "ab" for x in at], "k string, x double")
    got = {(r.k, r.x): r.interpolated for r in telemetry.interpolate(asked, tel, ["k"], "x", "t", "v").collect()}
    assert np.allclose([got["a", x] for x in at], np.interp(at, [1, 3, 4], [10, 40, 0])) and all(got["b", x] == 5.0 for x in at)
    got = {(r.k, r.x): r.interpolated for r in telemetry.interpolate(asked, tel, ["k"], "x", "t", "v", mode="normalized").collect()}
    assert np.allclose([got["a", x] for x in at], np.interp(np.array(at) / 9, [0, 2 / 3, 1], [10, 40, 0]))


def test_passes_drop_the_open_one(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, -1, 1, -1, 1, 1])], "k string, t int, v int")
    assert [(r.start, r.end) for r in order.passes(df, ["k"], "t", F.col("v") > 0).orderBy("start").collect()] == [(0, 1), (3, 3)]


def test_products(spark):
    assert products.covariance_labels()[:4] == ["00R", "01R", "01I", "02R"] and len(products.covariance_labels()) == 16
    assert products.normalise_products(["01C", (2, 2)]) == ["01R", "01I", "22R"]
    for bad in ("44", "0", "01X", "abc"):
        with pytest.raises(ValueError):
            products.parse_token(bad)
    rows = spark.createDataFrame([(0, p, float(p + 1)) for p in range(16)], "t int, product int, value double")
    assert products.select_product(rows, ["t"], "10C").first().value == (5.0, -6.0)
    assert products.select_product(rows, ["t"], "-23I").first().value == -16.0


def test_slices_are_restored_once(spark):
    df = spark.createDataFrame([([4.0, 8.0], 30), ([1.0, 2.0], 31)], "data array<double>, s int")
    once = products.restore_slices(df, "data", "s")
    twice = products.restore_slices(once, "data", "s")
    assert [r.data for r in once.collect()] == [r.data for r in twice.collect()] == [[2.0, 4.0], [1.0, 2.0]]
    bad = spark.createDataFrame([([31.0] * 16,), ([31.5] * 16,), ([32.0] * 16,), ([1.0],), (None,), ([float("nan")] * 16,)], "s array<double>")
    assert products.slice_violations(bad, "s").count() == 5


def test_calibration_guards(spark):
    nan = float("nan")
    df = spark.createDataFrame([(4.0, 1.0, 4.0), (-4.0, 1.0, 4.0), (4.0, 0.0, 1.0), (nan, 1.0, 1.0), (4.0, -1.0, 1.0)], "x double, a double, b double")
    got = df.select(C.nv_auto(F.col("x"), F.col("a")).alias("p"), C.nv_cross(F.col("x"), F.col("a"), F.col("b")).alias("q")).collect()
    assert [r.p for r in got] == [2.0, None, None, None, None]
    assert np.allclose([r.q for r in got[:2]], [2**0.5, -(2**0.5)]) and [r.q for r in got[2:]] == [None] * 3
    codes = spark.createDataFrame([("0",), ("2",), ("m",), ("1.5",), ("4",), (None,), ("NaN",)], "c string")
    assert [r[0] for r in codes.select(C.gain_level(F.col("c"))).collect()] == ["L", "H", "M", None, None, None, None]


def test_labels(spark):
    df = C.label(spark.range(1), "id", units="SDU", frame="lunar")
    assert (C.units_of(df, "id"), C.frame_of(df, "id")) == ("SDU", "lunar") and C.units_of(df.select(F.col("id") + 1), "(id + 1)") is None


def test_spline_is_exact_on_cubics():
    x = np.linspace(0.1, 70.1, 16)
    f = lambda t: 0.001 * t**3 - 0.1 * t**2 + t - 3
    at = np.linspace(0.1, 70.1, 101)
    assert np.allclose(gain.spline(x, f(x), at), f(at)) and np.isnan(gain.spline(x, f(x), np.array([0.0, 71.0]))).all()


def test_coefficient_problems(spark):
    rows = [("L", 0, "PC1", "linear", "one", 1.0)] * 2 + [("L", 0, "PC1", "cubic", "one", 1.0)]
    df = spark.createDataFrame(rows, "level string, channel int, component string, model string, term string, value double")
    got = {(r.problem, r.slot) for r in gain.coefficient_problems(df).collect()}
    assert ("repeated", "L/0/PC1/linear/one") in got and ("unknown", "L/0/PC1/cubic/one") in got and len([g for g in got if g[0] == "missing"]) == 47


def test_frequency_plan(spark):
    grid = freq.grid(spark, 1.0, 1.0, 5)
    t = spark.createDataFrame([(0, 1.0), (1, 2.0000005), (2, 2.25), (3, 5.0000001), (4, 6.0), (5, 0.5)], "idx int, freq double")
    got = {r.target_idx: (r.lo_idx, r.hi_idx, r.alpha, r.problem) for r in freq.plan(t, grid, "linear").collect()}
    assert got == {0: (0, 0, 0.0, None), 1: (1, 1, 0.0, None), 2: (1, 2, 0.25, None), 3: (4, 4, 0.0, None), 4: (None, None, None, "range"), 5: (None, None, None, "range")}
    with pytest.raises(ValueError):
        freq.checked(freq.plan(t, grid, "exact"))


def test_comparison_rules(spark):
    nan = float("nan")
    new = spark.createDataFrame([("p", 0, 1.0), ("r", 0, 1000.0), ("w", 0, 1.0), ("f", 0, 1.0), ("n", 0, nan), ("m", 0, nan), ("s", 0, 1.0), ("s", 1, 1.0), ("x", 0, 1.0)], "k string, i int, v double")
    ref = spark.createDataFrame([("p", 0, 1.0005), ("r", 0, 1000.5), ("w", 0, 1.005), ("f", 0, 2.0), ("n", 0, nan), ("m", 0, 1.0), ("s", 0, 1.0), ("y", 0, 1.0)], "k string, i int, v double")
    got = {r.k: r.status for r in stats.compare(new, ref, ["k"], "i", "v", 1e-3, 1e-3).collect()}
    assert got == {"p": "PASS", "r": "PASS", "w": "WARN", "f": "FAIL", "n": "PASS", "m": "WARN", "s": "FAIL", "x": "missing_ref", "y": "missing_new"}


def test_scales(spark):
    make = lambda *s: spark.createDataFrame([(x, "c", i) for i, x in enumerate(s)], "time_scale string, clock_source string, start int")
    assert stats.require_scale(make("utc", "utc")) == "utc" and stats.require_scale(make("utc", "unknown")) == "unknown" and stats.require_scale(make("unknown"), "tai") == "tai"
    for bad in (lambda: stats.require_scale(make("utc", "tai")), lambda: stats.require_scale(make("utc"), "tai")):
        with pytest.raises(ValueError):
            bad()


def test_matrices_like_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(5, 4, 4)) + 1j * rng.normal(size=(5, 4, 4))
    df = spark.createDataFrame([(k, a, b, float(m[k, a, b].real), float(m[k, a, b].imag)) for k in range(5) for a in range(4) for b in range(4)], "k int, a int, b int, re double, im double")
    back = {(r.k, r.a, r.b): r.re + 1j * r.im for r in matrices.unpack(matrices.pack(df, ["k"]), ["k"]).collect()}
    assert all(np.isclose(back[k, a, b], m[k, a, b]) for k in range(5) for a in range(4) for b in range(4))
    za, zl = m + 9 * np.eye(4), np.broadcast_to(np.diag([1.0, 2, 3, 4]) + 0j, m.shape)
    rows = [(k, [x for z in c[k].ravel() for x in (float(z.real), float(z.imag))], *[[x for z in y[k].ravel() for x in (float(z.real), float(z.imag))] for y in (za, zl)]) for c in [m @ np.conj(np.swapaxes(m, 1, 2))] for k in range(5)]
    got = matrices.load_covariance(matrices.loading(spark.createDataFrame(rows, "k int, c array<double>, za array<double>, zl array<double>"), "za", "zl"), "c", "loading").orderBy("k").toPandas()
    load = zl @ np.linalg.inv(za + zl)
    want = load @ (m @ np.conj(np.swapaxes(m, 1, 2))) @ np.conj(np.swapaxes(load, 1, 2))
    assert np.allclose(matrices.to_complex(got["loaded"]), want) and (got["eigen_ratio"] > -1e-12).all()
    cov = spark.createDataFrame([(0, 0, 0, "auto", 2.0), (0, 1, 1, "auto", 3.0), (0, 0, 1, "re", 0.4), (0, 0, 1, "im", -0.3)], "t int, a int, b int, part string, value double")
    sigma = {(r.a, r.b, r.part): r.sigma for r in matrices.radiometric_noise(cov, ["t"], 2.0, 5.0).collect()}
    assert np.isclose(sigma[0, 0, "auto"], 2 / 10**0.5) and np.isclose(sigma[0, 1, "re"], ((6 + 0.16 - 0.09) / 20) ** 0.5)
    assert matrices.incomplete_pairs(cov.filter("part != 'im'"), ["t"]).count() == 1


def test_linear_like_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) @ np.diag([3, 2, 1])
    df = spark.createDataFrame([tuple(map(float, r)) + (float(r @ [1, 2, 3]), 1.0) for r in x], "a double, b double, c double, y double, w double")
    assert np.allclose(linear.covariance(df, ["a", "b", "c"]), np.cov(x, rowvar=False))
    e, v = linear.principal_components(df, ["a", "b", "c"])
    assert np.allclose(v @ np.diag(e) @ v.T, np.cov(x, rowvar=False)) and (np.diff(e) <= 0).all()
    assert np.allclose(linear.normal_equations(df, ["a", "b", "c"], "y", "w"), [1, 2, 3])


def test_smoothing_keeps_a_constant(spark):
    df = spark.createDataFrame([("a", i, 2.0) for i in range(20)], "k string, i int, v double")
    assert np.allclose([r.v for r in freq.smooth(df, ["k"], "i", "v", 1.5, 20).collect()], 2.0)


def test_coefficient_file_of_the_real_layout(spark, tmp_path):
    """Terms go by the sensor that a channel reads; a gain follows from them, and problems are refused."""
    rows = ["gain_setting,component,model,term,alpha_refit"]
    for v in "LMH":
        for c in range(4):
            adc = "SPE_ADC0_T" if c <= 1 else "SPE_ADC1_T"
            for p in ("PC1", "PC2"):
                rows += [f"{v}{c},{p},linear,1,0.5", f"{v}{c},{p},linear,{adc},2.0", f"{v}{c},{p},quadratic,1,1.0", f"{v}{c},{p},quadratic,THERM_FPGA*{adc},0.25", f"{v}{c},{p},quadratic,{adc}*{adc},0.125"]
    (tmp_path / "a.csv").write_text("\n".join(rows))
    got = tables.read_coefficients(spark, str(tmp_path / "a.csv"))
    packed = gain.packed_coefficients(got)
    assert packed.count() == 48
    tel = spark.createDataFrame([("H", c, 30.0, 20.0, 10.0) for c in range(4)], "level string, channel int, therm double, adc0 double, adc1 double")
    tel = tel.withColumn("features", C.gain_features(F.col("channel"), F.col("therm"), F.col("adc0"), F.col("adc1"), F.lit(1.8), F.lit(1.2), F.lit(0.05)))
    quad = {r.channel: r.pc1 for r in gain.predict(tel, packed).collect()}
    line = {r.channel: r.pc1 for r in gain.predict(tel, packed, ("linear", "linear")).collect()}
    assert quad == {c: 1.0 + 0.25 * 30 * a + 0.125 * a * a for c, a in ((0, 20.0), (1, 20.0), (2, 10.0), (3, 10.0))} and line == {0: 40.5, 1: 40.5, 2: 20.5, 3: 20.5}
    for bad in ("L0,PC1,linear,SPE_ADC1_T,1.0", "L0,PC1,linear,1,0.7", "X0,PC1,linear,1,0.7", "L0,PC3,linear,1,1"):
        (tmp_path / "b.csv").write_text("\n".join([*rows, bad]))
        with pytest.raises(ValueError):
            gain.packed_coefficients(tables.read_coefficients(spark, str(tmp_path / "b.csv")))
    (tmp_path / "c.csv").write_text("\n".join(r for r in rows if not r.startswith("M2,PC2,linear")))
    with pytest.raises(ValueError):
        gain.packed_coefficients(tables.read_coefficients(spark, str(tmp_path / "c.csv")))


def test_bilinear_with_repeated_points(spark):
    grid = spark.createDataFrame([(t, p, float(t + p)) for t in range(4) for p in range(8)], "ti int, pi int, v double")
    points = spark.createDataFrame([(1, 15.0, 45.0), (2, 15.0, 45.0), (2, 15.0, 45.0), (3, 30.0, 359.0), (4, 99.0, 0.0)], "i int, theta_deg double, phi_deg double")
    got = sorted((r.i, r.v) for r in grids.bilinear(points, grid, 0.0, 10.0, 4, 45.0, ["v"]).collect() if r.v is not None)
    y = 359 / 45 - 7
    assert np.allclose([v for _, v in got], [2.5, 2.5, 2.5, 3 + (1 - y) * 7 + y * 0]) and [i for i, _ in got] == [1, 2, 2, 3]


@pytest.mark.parametrize("many", [False, True])
def test_around_and_bracket_agree(spark, monkeypatch, many):
    """Curves by cells like windows over all rows: ends, exact hits, uneven steps, keys without points."""
    if many:
        monkeypatch.setattr(order, "CURVE_POINTS", 0)
    rng = np.random.default_rng(5)
    curve = [(k, float(x), float(rng.normal())) for k in "ab" for x in np.unique(np.round(rng.exponential(3, 40), 2))] + [("c", 1.0, 7.0)]
    asked = [(k, float(x)) for k in "abcd" for x in [*np.round(rng.uniform(-1, 20, 60), 2), curve[3][1], curve[0][1], 1.0]]
    left, right = spark.createDataFrame(asked, "k string, x double"), spark.createDataFrame(curve, "k string, p double, v double")
    cols = ("k", "x", "t0", "v0", "t1", "v1")
    want = sorted(map(tuple, order.bracket(left, right, ["k"], "x", "p", "v").select(*cols).collect()), key=str)
    cut = sorted(map(tuple, order.bracket(left, right, ["k"], "x", "p", "v", bucket=lambda t: F.floor(t / 2)).select(*cols).collect()), key=str)
    got = sorted(map(tuple, order.around(left, right, "x", ["k"], "p", "v").select(*cols).collect()), key=str)
    assert got == want == cut
    plain = {x: [p for k, p, _ in curve if k == "a"] for _, x in asked}
    assert all(t0 == max((p for p in plain[x] if p <= x), default=None) and t1 == min((p for p in plain[x] if p >= x), default=None) for k, x, t0, _, t1, _ in got if k == "a")


def test_buckets_of_runs_and_neighbours(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, i // 9, rng.randint(-3, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, bucket int, v int")
    for f in (
        lambda b: order.islands(df, ["k"], ["t"], F.col("v") > 0, b), lambda b: order.passes(df, ["k"], "t", F.col("v") > 0, b), lambda b: order.local_maxima(df, ["k"], "t", "v", b),
        lambda b: order.running_max(df, ["k"], ["t"], F.col("v"), "m", b), lambda b: order.following(df, ["k"], ["t"], F.col("v"), "n", b), lambda b: grids.prominent_peaks(df.withColumn("v", F.col("v").cast("double")), ["k"], "t", "v", 0.1, bucket=b),
    ):
        plain, cut = (sorted((tuple(sorted(r.asDict().items(), key=str)) for r in f(b).collect()), key=str) for b in (None, "bucket"))
        assert plain == cut and plain


def test_prominence_like_its_definition(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.uniform(0, 1, 400), 2)
    got = {r.t: r.prominence for r in grids.prominent_peaks(spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "k string, t int, v double"), ["k"], "t", "v", 0.05, relative=False).collect()}
    want = {}
    for i in range(1, len(v) - 1):
        if v[i] > v[i - 1] and v[i] > v[i + 1]:
            a = max((j for j in range(i) if v[j] > v[i]), default=0)
            b = min((j for j in range(i + 1, len(v)) if v[j] > v[i]), default=len(v) - 1)
            p = v[i] - max(v[a : i + 1].min(), v[i : b + 1].min())
            if p >= 0.05:
                want[i] = p
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_rederive_and_coverage_take_one_window(spark):
    w = spark.createDataFrame([("a", 0, None, 10.0), ("a", 1, 10.0, 20.0), ("a", 2, 25.0, None), ("b", 0, 5.0, 6.0)], "k string, n int, lo double, hi double")
    t = spark.createDataFrame([(k, x) for k in "abc" for x in (-1.0, 5.0, 10.0, 19.9, 20.0, 24.0, 25.0, 99.0)], "k string, t double")
    for bucket in (None, lambda c: F.floor(c / 7)):
        got = {(r.k, r.t): r.n for r in sessions.rederive(t, w, ["k"], "t", bucket).collect()}
        assert got == {("a", -1.0): 0, ("a", 5.0): 0, ("a", 10.0): 1, ("a", 19.9): 1, ("a", 25.0): 2, ("a", 99.0): 2, ("b", 5.0): 0}


def test_uids_that_jump_back(spark):
    z = spark.createDataFrame([("s", i, u) for i, u in enumerate([1, 7, 3, 12, 5])], "k string, i int, uid int")
    s = spark.createDataFrame([("s", 2, 20.0), ("s", 6, 60.0), ("s", 10, 100.0)], "k string, uid int, t double")
    got = [r.when for r in sessions.latest_time(z, s, ["k"], ["i"], "uid", "t", "when").orderBy("i").collect()]
    assert got == [0.0, 60.0, 60.0, 100.0, 100.0]


def test_exact_widths_and_shapes(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, float("nan")],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(products.exactly_sized(F.col("v"), 2)).collect()] == [[1.0, 2.0], None, None, None]
    assert [tuple(r) for r in products.size_violations(df, {"a": (F.col("v"), 2), "b": (F.coalesce("v", F.array(F.lit(0.0))), 9)}).orderBy("name").collect()] == [("a", 3), ("b", 4)]
    meta = df.select(F.struct("v").alias("meta"))
    with pytest.raises(tables.ContractError, match="3 rows without exactly 2 finite values in v"):
        sinks.metadata_columns(meta, [], {}, {"v": 2})
    assert sinks.metadata_columns(meta.limit(1), [], {}, {"v": 2}).first().v == [1.0, 2.0]
    nested = spark.createDataFrame([([[1.0], [2.0, 3.0, 4.0]],), ([],), (None,)], "d array<array<double>>")
    assert tuple(products.max_inner_shape(nested, "d").first()) == (2, 3)


def test_sync_word_with_padding():
    stream = b"\xec" + b"\xa5" * 1000 + b"\xa0" + frame(5, 3, 3, b"cdef")[2:] + b"\xec\xec\xec" + frame(6, 3, 4, b"z")
    assert [p for _, p, r in banks.cut_frames(stream) if r is None] == [b"cdef", b"z"]


def test_folder_is_never_machine_local_on_a_cluster():
    from bandloom.sources.folders import shared_folder

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_buckets_keep_rows_with_null_keys_and_places(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), i, rng.choice([None, 1, 2, 3])) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int").withColumn("b", F.floor(F.col("t") / 7))
    at = ["t", "id"]
    forms = {
        "carry": lambda b: order.carry_last(df, ["k"], at, {"x": F.col("v")}, b),
        "sum": lambda b: order.running_sum(df, ["k"], at, F.col("v"), "x", b),
        "before": lambda b: order.previous(df, ["k"], at, F.col("v"), "x", b),
        "after": lambda b: order.following(df, ["k"], at, F.col("v"), "x", b),
        "max": lambda b: order.running_max(df, ["k"], at, F.col("v"), "x", b),
        "sessions": lambda b: order.split_sessions(df, ["k"], at, F.coalesce(F.col("v") == 1, F.lit(False)), "x", b),
    }
    for name, f in forms.items():
        plain, cut = ({r.id: r.x for r in f(b).collect()} for b in (None, "b"))
        assert len(plain) == len(rows) and plain == cut, name
    s = spark.createDataFrame([("a", 5.0, 1), ("a", 20.0, 2), (None, 11.0, 3), (None, None, 4)], "k string, start double, session int")
    plain, cut = ({r.id: r.session for r in sessions.assign_telemetry(df.drop("b"), s, ["k"], "t", "start", "session", b).collect()} for b in (None, lambda c: F.floor(c / 7)))
    assert len(plain) == len(rows) and plain == cut and all(plain[i] for k, t, i, _ in rows if k is None and t is not None)


@pytest.mark.parametrize("bins, few", [(256, 4096), (16, 3)])
def test_quantiles_by_counting(spark, bins, few):
    from bandloom.operators import select

    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=700), "b": np.repeat([1.0, 2.0, 7.0], 50), "c": np.array([5.0]), "d": 10.0 ** rng.uniform(-300, 300, 60), "e": np.array([-np.inf, 1.0, 2.0, np.inf, np.inf]), None: rng.integers(0, 9, 90) * 1.0}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("a", float("nan")), ("none", None)]
    shares = {"q0": 0.0, "q1": 0.01, "mid": 0.5, "q9": 0.999, "q10": 1.0}
    got = select.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares, "lowest", "highest", bins, few)
    assert "percentile" not in got._jdf.queryExecution().toString()
    got = {r.k: r for r in got.collect()}
    assert got.keys() == {*values, "none"} and got["none"].mid is None and got["none"].lowest is None
    for k, v in values.items():
        with np.errstate(invalid="ignore"):
            want = np.quantile(v, list(shares.values()))
        if k == "e":
            want = [-np.inf, np.nan, 2.0, np.inf, np.inf]
            assert [got[k][n] for n in ("q0", "mid", "q9", "q10")] == [-np.inf, 2.0, np.inf, np.inf]
        else:
            np.testing.assert_allclose([got[k][n] for n in shares], want, rtol=1e-9)
        assert (got[k].lowest, got[k].highest) == (v.min(), v.max())
    whole = select.quantiles(spark.createDataFrame(rows, "k string, v double").filter("k in ('a', 'b')"), [], "v", {"mid": 0.5}, bins=bins, few=few).collect()
    assert len(whole) == 1 and abs(whole[0].mid - np.median(np.concatenate([values["a"], values["b"]]))) < 1e-12
    assert select.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", shares).collect() == []


@pytest.mark.parametrize("width", [3, 40])
def test_prominence_across_buckets(spark, width):
    rng = np.random.default_rng(5)
    n = 250
    steps, saw = np.round(rng.uniform(0, 1, n), 1), rng.uniform(0, 0.5, n)
    series = {"steps": steps, "rising": np.arange(n) * 0.01 + saw, "falling": 9 - np.arange(n) * 0.01 + saw, None: steps[:40], "low": -1 - saw}
    rows = [(k, i, float(x)) for k, s in series.items() for i, x in enumerate(s)]
    df = spark.createDataFrame(rows, "k string, t int, v double").withColumn("b", F.floor(F.col("t") / width))
    show = lambda d: {(r.k, r.t): (r.v, round(r.prominence, 9)) for r in d.collect()}
    want = show(grids.prominent_peaks(df.drop("b"), ["k"], "t", "v", 0.02))
    assert show(grids.prominent_peaks(df, ["k"], "t", "v", 0.02, bucket="b")) == want and len(want) > 100
