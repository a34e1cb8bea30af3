"""Operators that depend on an order: carry-forward, as-of and bracket joins, sessions, islands, extrema.

All of them are windows over a key. A key that holds too many rows for one task is cut along its order by a ``bucket``
column that rises with the order: windows then run inside buckets, and only one row per bucket meets in the key. Rows with
null keys or null places stay in both forms: null keys are one key, and null places come first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def over(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def attach(df: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Add the columns of ``base`` (one row per ``keys``) to the rows of the same keys. Every row stays; nulls are equal."""
    named = base.withColumnsRenamed({k: f"_at_{i}" for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_at_{i}")) for i, k in enumerate(keys)]) if keys else F.lit(True)
    return df.join(named, on, "left").drop(*[f"_at_{i}" for i in range(len(keys))])


def carry_last(df: DataFrame, keys: list[str], order: list, values: dict[str, Column], bucket: str | None = None) -> DataFrame:
    """Add, for each name, the last value that is not null up to and with each row."""
    inner = over(keys + ([bucket] if bucket else []), order).rowsBetween(*UP_TO_HERE)
    out = df.withColumns({n: F.last(v, ignorenulls=True).over(inner) for n, v in values.items()})
    if not bucket:
        return out
    at = F.struct(*order)
    ends = df.groupBy(*keys, bucket).agg(*[F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_{n}") for n, v in values.items()])
    before = over(keys, [bucket]).rowsBetween(*BEFORE)
    base = ends.select(*keys, bucket, *[F.last(f"_{n}", ignorenulls=True).over(before).alias(f"_base_{n}") for n in values])
    return attach(out, base, [*keys, bucket]).withColumns({n: F.coalesce(n, f"_base_{n}") for n in values}).drop(*[f"_base_{n}" for n in values])


def running_sum(df: DataFrame, keys: list[str], order: list, value: Column, name: str, bucket: str | None = None, frame: tuple = UP_TO_HERE) -> DataFrame:
    """Add the sum of ``value`` up to and with each row, or up to the row before it (``frame`` BEFORE); empty sums are 0."""
    inner = over(keys + ([bucket] if bucket else []), order).rowsBetween(*frame)
    out = df.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    if not bucket:
        return out
    ends = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    base = ends.select(*keys, bucket, F.coalesce(F.sum("_sum").over(over(keys, [bucket]).rowsBetween(*BEFORE)), F.lit(0)).alias("_base"))
    return attach(out, base, [*keys, bucket]).withColumn(name, F.col(name) + F.col("_base")).drop("_base")


def previous(df: DataFrame, keys: list[str], order: list, value: Column, name: str, bucket: str | None = None) -> DataFrame:
    """Add the value of the row before (null for the first); a null value before counts as null."""
    boxed = F.struct(value.alias("v"))
    inner = over(keys + ([bucket] if bucket else []), order)
    out = df.withColumn(name, F.lag(boxed).over(inner))
    if bucket:
        ends = df.groupBy(*keys, bucket).agg(F.max_by(boxed, F.struct(*order)).alias("_end"))
        base = ends.select(*keys, bucket, F.lag("_end").over(over(keys, [bucket])).alias("_base"))
        out = attach(out, base, [*keys, bucket]).withColumn(name, F.coalesce(name, "_base")).drop("_base")
    return out.withColumn(name, F.col(name)["v"])


def following(df: DataFrame, keys: list[str], order: list, value: Column, name: str, bucket: str | None = None) -> DataFrame:
    """Add the value of the row after (null for the last); a null value after counts as null."""
    boxed = F.struct(value.alias("v"))
    out = df.withColumn(name, F.lead(boxed).over(over(keys + ([bucket] if bucket else []), order)))
    if bucket:
        starts = df.groupBy(*keys, bucket).agg(F.min_by(boxed, F.struct(*order)).alias("_start"))
        base = starts.select(*keys, bucket, F.lead("_start").over(over(keys, [bucket])).alias("_base"))
        out = attach(out, base, [*keys, bucket]).withColumn(name, F.coalesce(name, "_base")).drop("_base")
    return out.withColumn(name, F.col(name)["v"])


def running_max(df: DataFrame, keys: list[str], order: list, value: Column, name: str, bucket: str | None = None) -> DataFrame:
    """Add the greatest value that is not null up to and with each row."""
    out = df.withColumn(name, F.max(value).over(over(keys + ([bucket] if bucket else []), order).rowsBetween(*UP_TO_HERE)))
    if not bucket:
        return out
    tops = df.groupBy(*keys, bucket).agg(F.max(value).alias("_top"))
    base = tops.select(*keys, bucket, F.max("_top").over(over(keys, [bucket]).rowsBetween(*BEFORE)).alias("_base"))
    return attach(out, base, [*keys, bucket]).withColumn(name, F.greatest(name, "_base")).drop("_base")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], take: dict[str, str], bucket: Column | None = None) -> DataFrame:
    """Add to each left row the columns ``take`` (right name -> new name) of the latest right row of its keys that is not
    after it. Equal order: the right row comes first. A union and one window; no row is paired with another."""
    names = [f"_o{i}" for i in range(len(left_order))]
    columns = left.columns
    a = left.withColumns(dict(zip(names, map(F.col, left_order), strict=True))).withColumn("_side", F.lit(1)).withColumn("_row", F.struct(*columns)).select(*keys, *names, "_side", "_row", *[F.lit(None).alias(f"_{n}") for n in take.values()])
    b = right.select(*keys, *[F.col(c).alias(n) for c, n in zip(right_order, names, strict=True)], F.lit(0).alias("_side"), F.lit(None).alias("_row"), *[F.struct(F.col(c).alias("v")).alias(f"_{n}") for c, n in take.items()])
    both = a.unionByName(b)
    if bucket is not None:
        both = both.withColumn("_bucket", bucket)
    done = carry_last(both, keys, [*names, "_side"], {n: F.col(f"_{n}") for n in take.values()}, "_bucket" if bucket is not None else None)
    return done.filter("_side = 1").select("_row.*", *[F.col(n)["v"].alias(n) for n in take.values()])


def bracket(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, value: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add t0, v0 (the latest right sample not after the row) and t1, v1 (the earliest not before it); null outside.

    ``bucket`` makes a column that rises with the time it is given.
    """
    columns = left.columns
    a = left.select(*keys, F.col(left_t).cast("double").alias("_t"), F.struct(*columns).alias("_row"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_v"))
    b = right.select(*keys, F.col(right_t).cast("double").alias("_t"), F.lit(None).alias("_row"), F.lit(0).alias("_side"), F.col(value).cast("double").alias("_v"))
    point = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    both = a.unionByName(b).withColumn("_point", point).withColumn("_nt", -F.col("_t"))
    if bucket is not None:
        both = both.withColumn("_b", bucket(F.col("_t"))).withColumn("_nb", -F.col("_b"))
    cut = (lambda name: name) if bucket is not None else (lambda name: None)
    done = carry_last(both, keys, ["_t", "_side"], {"_lo": F.col("_point")}, cut("_b"))
    done = carry_last(done, keys, ["_nt", "_side"], {"_hi": F.col("_point")}, cut("_nb"))
    return done.filter("_side = 1").select("_row.*", F.col("_lo.t").alias("t0"), F.col("_lo.v").alias("v0"), F.col("_hi.t").alias("t1"), F.col("_hi.v").alias("v1"))


#: Points of a curve up to which it is broadcast (about 60 bytes each, three times over).
CURVE_POINTS = 100_000


def around(df: DataFrame, points: DataFrame, x: str, keys: list[str], at: str, value: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """As ``bracket``, for few points (keys, at, value), such as a curve: the rows are not shuffled.

    The points' range is cut into as many equal cells as there are points; a row meets the segments of its own cell. Points
    that repeat a place count as one with their mean. More than CURVE_POINTS points go through ``bracket``.
    """
    pts = points.groupBy(*keys, F.col(at).cast("double").alias("_p")).agg(F.avg(F.col(value).cast("double")).alias("_v")).filter("_p is not null")
    if pts.count() > CURVE_POINTS:
        return bracket(df, pts, keys, x, "_p", "_v", bucket)
    ends = pts.groupBy(*keys).agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"), F.count("*").alias("_n"), F.min_by("_v", "_p").alias("_vlo"), F.max_by("_v", "_p").alias("_vhi"))
    ends = ends.withColumn("_w", F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / F.col("_n")).otherwise(1.0))
    pairs = pts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_v"))).alias("_a")).filter(F.size("_a") > 1)
    pairs = pairs.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size("_a") - 1), lambda i: F.struct(F.get("_a", i - 1).alias("a"), F.get("_a", i).alias("b")))).alias("_s"))
    cell = lambda c: F.floor((c - F.col("_lo")) / F.col("_w"))
    with_ends = lambda d: d.join(F.broadcast(ends), keys, "left") if keys else d.crossJoin(F.broadcast(ends))
    segments = with_ends(pairs).select(*keys, F.explode(F.sequence(cell(F.col("_s.a._p")), cell(F.col("_s.b._p")))).alias("_cell"), F.col("_s.a._p").alias("_p0"), F.col("_s.a._v").alias("_v0"), F.col("_s.b._p").alias("_p1"), F.col("_s.b._v").alias("_v1"))
    segments = segments.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    t = F.col(x).cast("double")
    rows = with_ends(df).withColumn("_x", t).withColumn("_c", F.when((t >= F.col("_lo")) & (t < F.col("_hi")), cell(t)))
    on = (F.col("_c") == F.col("_cell")) & (F.col("_x") >= F.col("_p0")) & (F.col("_x") < F.col("_p1"))
    for i, k in enumerate(keys):
        on &= F.col(k) == F.col(f"_k{i}")
    met = rows.join(F.broadcast(segments), on, "left")
    X, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    pick = lambda below, inner, top: F.when(X >= hi, top).when(X < lo, below).otherwise(inner)
    none = F.lit(None).cast("double")
    same = F.col("_x") == F.col("_p0")
    return met.select(
        *df.columns,
        pick(none, F.col("_p0"), hi).alias("t0"), pick(none, F.col("_v0"), F.col("_vhi")).alias("v0"),
        pick(lo, F.when(same, F.col("_p0")).otherwise(F.col("_p1")), F.when(X == hi, hi)).alias("t1"), pick(F.col("_vlo"), F.when(same, F.col("_v0")).otherwise(F.col("_v1")), F.when(X == hi, F.col("_vhi"))).alias("v1"),
    )


def lerp(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Linear interpolation between the bracketing samples, clamped where one of them is missing."""
    inside = F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (t - t0) / (t1 - t0))
    return F.when(v0.isNull(), v1).when(v1.isNull(), v0).otherwise(inside)


def split_sessions(df: DataFrame, keys: list[str], order: list, is_hello: Column, name: str = "session_no", bucket: str | None = None) -> DataFrame:
    """Number the sessions of each key from 0: a hello after at least one other row starts one; hellos in a row fold into
    the one that they start; rows before the first hello are session 0."""
    df = previous(df.withColumn("_hello", is_hello), keys, order, F.col("_hello"), "_was", bucket)
    start = F.when(F.col("_was").isNull(), 1).when(F.col("_hello") & ~F.col("_was"), 1).otherwise(0)
    out = running_sum(df.withColumn("_start", start), keys, order, F.col("_start"), "_n", bucket)
    return out.withColumn(name, (F.col("_n") - 1).cast("long")).drop("_hello", "_was", "_start", "_n")


def group_until(df: DataFrame, keys: list[str], order: list, closes: Column, name: str = "group_no", bucket: str | None = None) -> DataFrame:
    """Number the groups of each key from 0: a row that ``closes`` is the last of its group."""
    return running_sum(df.withColumn("_c", closes.cast("long")), keys, order, F.col("_c"), name, bucket, BEFORE).withColumn(name, F.col(name).cast("long")).drop("_c")


def islands(df: DataFrame, keys: list[str], order: list, inside: Column, bucket: str | None = None) -> DataFrame:
    """Maximal runs of rows with ``inside``: keys, run_no, and the rows' columns; numbered from 0 per key."""
    df = previous(df.withColumn("_in", F.coalesce(inside, F.lit(False))), keys, order, F.col("_in"), "_was", bucket)
    df = df.withColumn("_new", (F.col("_in") & ~F.coalesce("_was", F.lit(False))).cast("long"))
    return running_sum(df, keys, order, F.col("_new"), "_n", bucket).filter("_in").withColumn("run_no", (F.col("_n") - 1).cast("long")).drop("_in", "_was", "_new", "_n")


def passes(df: DataFrame, keys: list[str], t: str, inside: Column, bucket: str | None = None) -> DataFrame:
    """(keys, run_no, start, end) of each run of ``inside``; a run that is still open at the last row is not reported."""
    last = df.groupBy(*keys).agg(F.max(t).alias("_last"))
    runs = islands(df, keys, [t], inside, bucket).groupBy(*keys, "run_no").agg(F.min(t).alias("start"), F.max(t).alias("end"))
    return attach(runs, last, keys).filter(F.col("end") < F.col("_last")).drop("_last")


def local_maxima(df: DataFrame, keys: list[str], t: str, value: str, bucket: str | None = None) -> DataFrame:
    """Rows whose value is strictly above both neighbours; ends are not extrema."""
    both = following(previous(df, keys, [t], F.col(value), "_p", bucket), keys, [t], F.col(value), "_n", bucket)
    return both.filter((F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n"))).drop("_p", "_n")


def refined_peak(tp: Column, t: Column, tn: Column, vp: Column, v: Column, vn: Column) -> Column:
    """Time of the parabola's vertex through three samples around a maximum, for even spacing."""
    bend = vp - 2 * v + vn
    return F.when(bend == 0, t).otherwise(t + (tn - tp) / 4 * (vp - vn) / bend)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``match`` (the nearest right time, ties to the earlier) and ``delta`` = match - left time, by two as-of joins."""
    found = bracket(left, right.withColumn("_one", F.lit(1.0)), keys, left_t, right_t, "_one", bucket)
    t = F.col(left_t).cast("double")
    near = F.when(F.col("t0").isNull(), F.col("t1")).when(F.col("t1").isNull(), F.col("t0")).when(t - F.col("t0") <= F.col("t1") - t, F.col("t0")).otherwise(F.col("t1"))
    return found.withColumn("match", near).withColumn("delta", F.col("match") - t).drop("t0", "v0", "t1", "v1")
