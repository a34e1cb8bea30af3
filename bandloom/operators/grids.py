"""Response grids, tracks, series: sampling, checks, units, coverage, peaks, time grids."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from math import ceil, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import around, asof
from .peaks import cut_peaks, higher_before, turning_points

#: Fixed factors to SI.
VOLT, AMPERE = {"v": 1.0, "mv": 1e-3}, {"a": 1.0, "ma": 1e-3}


def select_frequencies(grid: DataFrame, wanted: list[float], freq: str = "freq_mhz", tolerance: float = 1e-9) -> DataFrame:
    """Rows at the wanted frequencies; each must match exactly one native frequency."""
    w = grid.sparkSession.createDataFrame([(float(x),) for x in wanted], "_want double")
    native = grid.select(freq).distinct()
    matched = w.join(native, F.abs(F.col(freq) - F.col("_want")) <= tolerance, "left")
    bad = [r[0] for r in matched.groupBy("_want").agg(F.count(freq).alias("n")).filter("n != 1").limit(20).collect()]
    if bad or len(set(wanted)) != len(wanted):
        raise ValueError(f"not one native frequency each: {bad or 'repeated'}")
    return grid.join(F.broadcast(matched.select(freq)), freq)


def bilinear(points: DataFrame, grid: DataFrame, theta0: float, d_theta: float, n_theta: int, d_phi: float, values: list[str]) -> DataFrame:
    """Add to points (theta_deg, phi_deg) the grid's ``values`` (ti, pi, ...), bilinear, phi wrapped. Points outside theta's
    range get null. Four equi joins on cell numbers, as one explosion."""
    n_phi = round(360 / d_phi)
    x, y = (F.col("theta_deg") - theta0) / d_theta, F.pmod(F.col("phi_deg"), F.lit(360.0)) / d_phi
    ti, pj = F.least(F.floor(x), F.lit(n_theta - 2)), F.floor(y) % n_phi
    a, b = x - ti, y - F.floor(y)
    inside = (F.col("theta_deg") >= theta0) & (F.col("theta_deg") <= theta0 + d_theta * (n_theta - 1))
    corners = F.array(*[F.struct((ti + i).cast("int").alias("ti"), ((pj + j) % n_phi).cast("int").alias("pi"), ((a if i else 1 - a) * (b if j else 1 - b)).alias("_w")) for i in (0, 1) for j in (0, 1)])
    # Points that repeat a place are looked up once.
    at = points.select("theta_deg", "phi_deg").distinct().withColumn("_c", F.explode(F.when(inside, corners))).select("theta_deg", "phi_deg", "_c.*")
    got = at.join(grid.select("ti", "pi", *[F.col(v).alias(f"_{v}") for v in values]), ["ti", "pi"]).groupBy("theta_deg", "phi_deg").agg(*[F.sum(F.col("_w") * F.col(f"_{v}")).alias(v) for v in values])
    return points.join(got, ["theta_deg", "phi_deg"], "left").select(*points.columns, *values)


def bilinear_axes(points: DataFrame, grid: DataFrame, values: list[str], theta: str = "theta_deg", phi: str = "phi_deg") -> DataFrame:
    """As ``bilinear`` on axes of any spacing: ``grid`` is a row a cell (theta, phi in [0, 360), values). A place finds the
    segment of each axis that it lies in by ``around``, phi's last one closing the circle, and its four corners by equi joins.

    Cells that repeat count as their mean. Points outside theta's range, with a null angle, or at a corner that the grid
    lacks get null; every point stays.
    """
    cells = grid.groupBy(F.col(theta).cast("double").alias("_gt"), F.col(phi).cast("double").alias("_gp")).agg(*[F.avg(v).alias(f"_{v}") for v in values])
    turned = cells.select("_gp").distinct().select("_gp", F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))).alias("_turn")).select((F.col("_gp") + F.col("_turn")).alias("_at"), "_gp")
    places = points.select(F.col(theta).alias("_pt"), F.col(phi).alias("_pp")).distinct().filter("_pt is not null and _pp is not null")
    at = places.withColumn("_x", F.col("_pt").cast("double")).withColumn("_y", F.pmod(F.col("_pp").cast("double"), F.lit(360.0)))
    at = around(at, cells.select("_gt").distinct().withColumn("_v", F.col("_gt")), "_x", [], "_gt", "_v").filter("t0 is not null and t1 is not null")
    at = at.select("_pt", "_pp", "_y", F.col("v0").alias("_t0"), F.col("v1").alias("_t1"), F.when(F.col("t1") > F.col("t0"), (F.col("_x") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0).alias("_a"))
    at = around(at, turned, "_y", [], "_at", "_gp").filter("t0 is not null and t1 is not null")
    at = at.withColumn("_b", F.when(F.col("t1") > F.col("t0"), (F.col("_y") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0))
    corner = lambda t, p, w: F.struct(F.col(t).alias("_gt"), F.col(p).alias("_gp"), w.alias("_w"))
    a, b = F.col("_a"), F.col("_b")
    corners = F.array(corner("_t0", "v0", (1 - a) * (1 - b)), corner("_t0", "v1", (1 - a) * b), corner("_t1", "v0", a * (1 - b)), corner("_t1", "v1", a * b))
    met = at.select("_pt", "_pp", F.explode(F.filter(corners, lambda c: c["_w"] > 0)).alias("_c")).select("_pt", "_pp", "_c.*").join(cells, ["_gt", "_gp"])
    whole = F.abs(F.sum("_w") - 1) < 1e-9
    got = met.groupBy("_pt", "_pp").agg(*[F.when(whole & (F.count(f"_{v}") == F.count("*")), F.sum(F.col("_w") * F.col(f"_{v}"))).alias(f"_got_{v}") for v in values])
    out = points.join(got, (F.col(theta) == F.col("_pt")) & (F.col(phi) == F.col("_pp")), "left")
    return out.select(*[points[c] for c in points.columns], *[F.col(f"_got_{v}").alias(v) for v in values])


def to_si_rms(value: Column, unit: str, convention: str, factors: dict[str, float] = VOLT) -> Column:
    """A phasor in SI units and RMS convention."""
    if unit.lower() not in factors or convention.lower() not in ("rms", "peak"):
        raise ValueError(f"unknown unit or convention: {unit}, {convention}")
    return value * (factors[unit.lower()] / (sqrt(2.0) if convention.lower() == "peak" else 1.0))


def divide(re: Column, im: Column, dre: Column, dim: Column) -> tuple[Column, Column]:
    """A complex quotient; null where the divisor is 0."""
    n = dre * dre + dim * dim
    ok = lambda c: F.when(n > 0, c / n)
    return ok(re * dre + im * dim), ok(im * dre - re * dim)


def per_current(fields: DataFrame, currents: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Fields (keys, <v>_re, <v>_im) over the normalisation currents (keys, i_re, i_im) of their frequency and port, both in
    SI RMS; a current of 0 raises. Currents are one row a frequency and port: counted, they are broadcast up to 100,000."""
    if not currents.filter((F.col("i_re") == 0) & (F.col("i_im") == 0)).isEmpty():
        raise ValueError("a normalisation current is 0")
    met = fields.join(F.broadcast(currents) if currents.count() <= 100_000 else currents, keys)
    parts = {v: divide(F.col(f"{v}_re"), F.col(f"{v}_im"), F.col("i_re"), F.col("i_im")) for v in values}
    return met.withColumns({f"{v}_{n}": c for v, both in parts.items() for n, c in zip(("re", "im"), both, strict=True)}).drop("i_re", "i_im")


#: Speed of light in m/s, impedance of the vacuum in ohm.
LIGHT, VACUUM = 299792458.0, 376.730313668


def effective_length(re: Column, im: Column, freq_mhz: Column, unit: str = "v/a") -> tuple[Column, Column]:
    """Metres from a far field times distance per current (V/A or mV/A): times -4 pi / (j k Z0)."""
    if unit.lower() not in ("v/a", "mv/a"):
        raise ValueError(f"not a field per current: {unit!r}")
    scale = (1.0 if unit.lower() == "v/a" else 1e-3) * 4 * pi / ((2 * pi * freq_mhz * 1e6 / LIGHT) * VACUUM)
    return -im * scale, re * scale


def spherical_parts(ex: Column, ey: Column, ez: Column, theta: Column, phi: Column) -> tuple[Column, Column]:
    """Theta and phi components of a Cartesian field."""
    ct, st, cp, sp = F.cos(theta), F.sin(theta), F.cos(phi), F.sin(phi)
    return ex * ct * cp + ey * ct * sp - ez * st, -ex * sp + ey * cp


def capacitor_load(freq_mhz: Column, c_pf: float) -> tuple[Column, Column]:
    """1 / (j omega C): real part 0, imaginary part negative."""
    return F.lit(0.0) * freq_mhz, -1 / (2 * pi * freq_mhz * 1e6 * c_pf * 1e-12)


def preamp_load(freq_mhz: Column, c_pf: float, l_nh: float, rp: float, rs: float, a: float = 0.0, n: float = 1.0) -> tuple[Column, Column]:
    """Series resistance and inductance with a parallel R and C, plus a * omega^n."""
    w = 2 * pi * freq_mhz * 1e6
    k = w * (rp * c_pf * 1e-12)
    return rs + a * F.pow(w, F.lit(n)) + rp / (1 + k * k), w * (l_nh * 1e-9) - rp * k / (1 + k * k)


def coupling(zr_re: Column, zr_im: Column, za_re: Column, za_im: Column) -> Column:
    """|Zrec| / |Zant + Zrec|."""
    return F.hypot(zr_re, zr_im) / F.hypot(za_re + zr_re, za_im + zr_im)


def temperature_to_v2(za_re: Column, gamma: Column) -> Column:
    return 4 * 1.380649e-23 * za_re * gamma * gamma


def zoom_bin(k: Column) -> Column:
    """-32 to 63 wrapped to 0 to 63; null outside."""
    return F.when(k.between(-32, 63), F.pmod(k, F.lit(64)))


def plane(alt: Column, az: Column, linear: bool = True) -> tuple[Column, Column]:
    """x and y of a direction (radians): zenith angle linear, or orthographic."""
    r = 1 - alt / (pi / 2) if linear else F.cos(alt)
    return F.sin(az) * r, F.cos(az) * r


def coverage(track: DataFrame, passes: DataFrame, keys: list[str], n_mu: int = 10, n_phi: int = 10, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Distinct (keys, mu_bin, phi_bin) that a track (keys, t, alt, az) crosses during its passes (keys, start, end); the
    end itself is not counted. Passes of a key do not overlap: an as-of join finds the one a row may lie in."""
    met = asof(track.withColumn("_at", F.col("t").cast("double")), passes.withColumn("_from", F.col("start").cast("double")), keys, ["_at"], ["_from"], {"end": "_until"}, bucket(F.col("_o0")) if bucket else None)
    during = met.filter(F.col("_at") < F.col("_until").cast("double"))
    return during.select(*keys, F.floor(F.sin("alt") * n_mu).cast("int").alias("mu_bin"), F.floor(F.col("az") / (2 * pi) * n_phi).cast("int").alias("phi_bin")).distinct()


def prominent_peaks(df: DataFrame, keys: list[str], t: str, value: str, prominence: float, relative: bool = True, bucket: str | None = None) -> DataFrame:
    """keys, t, value, prominence of local maxima that stand out by ``prominence``, of the series over its maximum if
    ``relative``. With ``bucket``, a whole number that rises with ``t``, a series is cut and its buckets are worked on apart;
    without, the turning points of a series are one task."""
    if bucket:
        return cut_peaks(df, keys, t, value, bucket, prominence, relative)
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{t}` {kinds[t]}", f"`{value}` double", "prominence double"])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(t)
        v = p[value].to_numpy(float)
        s = v / v.max() if relative and len(v) and v.max() > 0 else v
        side = np.maximum(higher_before(s)[1], higher_before(s[::-1])[1][::-1])
        out = np.flatnonzero(p["_top"].to_numpy(bool) & (s - side >= prominence))
        q = p.iloc[out][[*keys, t]].copy()
        q[value], q["prominence"] = v[out], (s - side)[out]
        return q

    return turning_points(df.select(*keys, t, value), keys, t, value).groupBy(*keys).applyInPandas(run, schema)


def parse_range(spec: str | tuple) -> tuple[datetime, datetime]:
    """CY25, FY2026, 'a to b', or a pair. A calendar year starts at 01:00 on 1 January; a fiscal year on 1 October before."""
    if isinstance(spec, tuple):
        a, b = spec
        return (datetime.fromisoformat(a) if isinstance(a, str) else a), (datetime.fromisoformat(b) if isinstance(b, str) else b)
    if spec[:2] in ("CY", "FY"):
        year = int(spec[2:]) + (2000 if int(spec[2:]) < 100 else 0)
        return (datetime(year, 1, 1, 1), datetime(year + 1, 1, 1)) if spec[:2] == "CY" else (datetime(year - 1, 10, 1), datetime(year, 10, 1))
    if " to " in spec:
        return parse_range(tuple(x.strip() for x in spec.split(" to ")))
    raise ValueError(f"not a time range: {spec!r}")


def time_grid(spark: SparkSession, spec: str | tuple, step_s: float) -> DataFrame:
    """idx and t (timestamp without zone) of a regular grid, half-open to end + step: its last point lies in [end, end + step)."""
    start, end = parse_range(spec)
    n = ceil(((end - start).total_seconds() + step_s) / step_s - 1e-9)
    micros = F.lit(int((start - datetime(1970, 1, 1)).total_seconds() * 1e6))
    return spark.range(n).select(F.col("id").alias("idx"), F.timestamp_micros(micros + F.round(F.col("id") * (step_s * 1e6)).cast("long")).cast("timestamp_ntz").alias("t"))


def frequency_grid(spark: SparkSession, config: dict) -> DataFrame:
    """idx and freq of values; start, end, step (half-open); or start, end, n (both ends). Index-based keys are refused."""
    # Fixed names: keys of an older layout, which are refused.
    old = {"indices", "start_idx", "stop_idx", "step_idx"} & set(config)
    keys = set(config) - {"policy"}
    if old or {"step", "n"} <= keys:
        raise ValueError(f"keys that cannot be used: {sorted(old) or ['step', 'n']}")
    if "values" in keys:
        values = [float(v) for v in config["values"]]
    elif {"start", "end", "step"} <= keys and config["step"] > 0:
        values = np.arange(config["start"], config["end"], config["step"], dtype=float).tolist()
    elif {"start", "end", "n"} <= keys:
        values = np.linspace(config["start"], config["end"], int(config["n"])).tolist()
    else:
        raise ValueError(f"no frequency grid in {sorted(keys)}")
    if not values:
        raise ValueError("an empty frequency grid")
    return spark.createDataFrame(list(enumerate(values)), "idx int, freq double")
