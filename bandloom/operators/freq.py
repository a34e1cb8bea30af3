"""Frequency grids as tables, alignment plans, and lookup by interpolation.

A grid has idx and freq. A plan has target_idx, lo_idx, hi_idx, alpha: the value at a target is
(1 - alpha) * value[lo] + alpha * value[hi].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grids import zoom_bin
from .order import around, lerp

SNAP_ATOL, SNAP_RTOL = 1e-6, 1e-9


def grid(spark: SparkSession, start: float, step: float, n: int) -> DataFrame:
    """idx and freq of ``n`` points; a half-open range start, end, step has n = ceil((end - start) / step)."""
    return spark.range(n).select(F.col("id").cast("int").alias("idx"), (F.lit(float(start)) + F.col("id") * float(step)).alias("freq"))


def _neighbours(target: DataFrame, source: DataFrame) -> DataFrame:
    """target_idx, f of each target with the source points around it: lo_idx, lo_f, hi_idx, hi_f. Of the points that a
    tolerance could reach, the nearest is among these two."""
    n = around(target.select(F.col("idx").alias("target_idx"), F.col("freq").alias("f")), source, "f", [], "freq", "idx")
    return n.select("target_idx", "f", F.col("v0").cast("int").alias("lo_idx"), F.col("t0").alias("lo_f"), F.col("v1").cast("int").alias("hi_idx"), F.col("t1").alias("hi_f"))


def tolerance(f: Column, atol: float = SNAP_ATOL, rtol: float = SNAP_RTOL) -> Column:
    return atol + rtol * F.abs(f)


def plan(target: DataFrame, source: DataFrame, policy: str = "exact") -> DataFrame:
    """target_idx, lo_idx, hi_idx, alpha, problem (null, ``range`` or ``grid``).

    A target within the tolerance of a source point takes the closest, ties the lower. ``linear`` brackets the others;
    ``exact`` reports them; beyond the source's ends they are out of range. Grids are small next to the data they align.
    """
    n = _neighbours(target, source)
    below, above = F.col("f") - F.col("lo_f"), F.col("hi_f") - F.col("f")
    near_lo, near_hi = F.coalesce(below <= tolerance(F.col("lo_f")), F.lit(False)), F.coalesce(above <= tolerance(F.col("hi_f")), F.lit(False))
    lower = near_lo & (~near_hi | (below <= above))
    snapped = F.when(lower, F.col("lo_idx")).when(near_hi, F.col("hi_idx"))
    inside = F.col("lo_idx").isNotNull() & F.col("hi_idx").isNotNull()
    problem = F.when(snapped.isNotNull(), None).when(~inside, "range").when(F.lit(policy == "exact"), "grid")
    alpha = F.when(snapped.isNotNull(), 0.0).otherwise(below / (F.col("hi_f") - F.col("lo_f")))
    ok = problem.isNull()
    return n.select("target_idx", F.when(ok, F.coalesce(snapped, F.col("lo_idx"))).alias("lo_idx"), F.when(ok, F.coalesce(snapped, F.col("hi_idx"))).alias("hi_idx"), F.when(ok, alpha).alias("alpha"), problem.alias("problem"))


def checked(plan_: DataFrame) -> DataFrame:
    """The plan, if it has no problem; else ValueError with their number by kind."""
    bad = {r[0]: r[1] for r in plan_.filter("problem is not null").groupBy("problem").count().collect()}
    if bad:
        raise ValueError(f"targets that no source point serves: {bad}")
    return plan_.drop("problem")


def used_sources(plan_: DataFrame) -> DataFrame:
    """Distinct source indices that the plan reads."""
    return plan_.select(F.explode(F.array("lo_idx", "hi_idx")).alias("idx")).filter("idx is not null").distinct()


def apply_plan(plan_: DataFrame, values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, target_idx, value: values (keys, idx, value) at the plan's targets."""
    lo = values.select(*keys, F.col("idx").alias("lo_idx"), F.col(value).alias("_lo"))
    hi = values.select(*keys, F.col("idx").alias("hi_idx"), F.col(value).alias("_hi"))
    joined = plan_.join(lo, "lo_idx").join(hi, [*keys, "hi_idx"])
    return joined.select(*keys, "target_idx", F.when(F.col("alpha") == 0, F.col("_lo")).otherwise((1 - F.col("alpha")) * F.col("_lo") + F.col("alpha") * F.col("_hi")).alias(value))


def nearest_bin(df: DataFrame, freq: str, step: float, n: int, limit: float, start: float = 0.0) -> DataFrame:
    """Add ``bin``: the nearest of n bins start + i * step, null beyond ``limit``; ties go to the lower."""
    i = F.least(F.greatest(F.ceil((F.col(freq) - start) / step - 0.5), F.lit(0)), F.lit(n - 1))
    return df.withColumn("bin", F.when(F.abs(F.col(freq) - start - i * step) <= limit, i).cast("int"))


def lookup(df: DataFrame, curve: DataFrame, x: str, keys: list[str] | None = None, out: str = "looked_up", outside: float | None = 0.0) -> DataFrame:
    """Add the curve (keys, x, y) at each row's ``x`` by linear interpolation; ``outside`` beyond its ends, or clamped if
    that is None."""
    found = around(df, curve, x, keys or [], "x", "y")
    v = lerp(F.col(x), F.col("t0"), F.col("v0"), F.col("t1"), F.col("v1"))
    if outside is not None:
        v = F.when(F.col("v0").isNull() | F.col("v1").isNull(), F.lit(outside)).otherwise(v)
    return found.withColumn(out, v).drop("t0", "v0", "t1", "v1")


def keyed_response(df: DataFrame, curves: DataFrame, offset: str, key: str, wrap: bool = False, out: str = "response") -> DataFrame:
    """Add the response at each row's ``offset`` from the curve of its ``key``: ``curves`` (key, x, y), linear between its
    points and 0 outside. With ``wrap`` keys are zoom bins of -32 to 63, the negative ones being those from 32 on. A key
    without a curve raises, before anything is looked up; a null key or offset gives null."""
    own = zoom_bin(F.col(key)) if wrap else F.col(key)
    told = df.withColumn("_key", own)
    asked = told.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), "_key").distinct()
    lacking = [r["key"] for r in asked.join(curves.select(F.col("key").alias("_key")).distinct(), "_key", "left_anti").orderBy("key").limit(10).collect()]
    if lacking:
        raise ValueError(f"no response for {key} {lacking}")
    got = lookup(told, curves.withColumnRenamed("key", "_key"), offset, ["_key"], out)
    return got.withColumn(out, F.when(F.col("_key").isNotNull() & F.col(offset).isNotNull(), F.col(out))).drop("_key")


def rescaled_curve(df: DataFrame, curve: DataFrame, x: str, place: float, width: float, depth: float, own: tuple[float, float, float] = (16.4, 14.0, 0.04), out: str = "signal") -> DataFrame:
    """Add the curve (x, y) moved from its ``own`` place, width and depth to the given ones; 0 outside of it."""
    at = df.withColumn("_moved", F.lit(own[0]) + (F.col(x) - place) * (own[1] / width))
    return lookup(at, curve, "_moved", out=out).withColumn(out, F.col(out) * (depth / own[2])).drop("_moved")


def power_law_below(df: DataFrame, freq: str, value: str, first: tuple[float, float], second: tuple[float, float], out: str) -> DataFrame:
    """Add ``value`` as ``out``, and below the first of the two lowest points (freq, value) the power law through both."""
    alpha = F.log(F.lit(second[1] / first[1])) / F.log(F.lit(second[0] / first[0]))
    return df.withColumn(out, F.when(F.col(freq) < first[0], first[1] * F.pow(F.col(freq) / first[0], alpha)).otherwise(F.col(value)))


def common_range(targets: DataFrame, grids: DataFrame) -> DataFrame:
    """Add ``inside``: whether the target lies within every grid (grid_id, freq)."""
    ends = grids.groupBy("grid_id").agg(F.min("freq").alias("lo"), F.max("freq").alias("hi")).agg(F.max("lo").alias("_lo"), F.min("hi").alias("_hi"))
    return targets.crossJoin(F.broadcast(ends)).withColumn("inside", F.col("freq").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def smooth(rows: DataFrame, keys: list[str], idx: str, value: str, sigma: float, n: int, truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing along ``idx`` (0 to n - 1), mirrored at the ends: each bin spreads to its neighbours, weighted."""
    reach = int(truncate * sigma + 0.5)
    weights = [(k, float(w)) for k, w in _kernel(sigma, reach)]
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in weights])
    spread_ = rows.withColumn("_o", F.explode(kernel))
    # What lies at i counts for every bin j that reaches i directly or by a mirrored place.
    target = F.col(idx) - F.col("_o.k")
    at = F.explode(F.array_distinct(F.array(target, -1 - F.col(idx) - F.col("_o.k"), 2 * n - 1 - F.col(idx) - F.col("_o.k"))))
    out = spread_.select(*keys, at.alias("_j"), F.col(value) * F.col("_o.w"), F.col(value).alias("_v"), F.col("_o.w").alias("_w")).filter((F.col("_j") >= 0) & (F.col("_j") < n))
    return out.groupBy(*keys, F.col("_j").alias(idx)).agg(F.sum(F.col("_v") * F.col("_w")).alias(value))


def _kernel(sigma: float, reach: int) -> list[tuple[int, float]]:
    from math import exp

    w = [exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [(k, x / sum(w)) for k, x in zip(range(-reach, reach + 1), w, strict=True)]
