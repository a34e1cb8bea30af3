"""Exact order statistics of large keys by counting, without a buffer per key.

A value is looked for between two bounds. Each pass cuts the bounds of every open search into bins, counts the values of
all rows by bin (partial sums before the shuffle), and goes on in the bin that holds the wanted rank, between the least and
the greatest value that were met in it. A pass reads the rows and shuffles bins only; bounds that are met values move
together until they are equal or so few values lie between them that they may be sorted in one task. A key may hold all
rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored

#: Bins of a pass, and values between two bounds from which on they are sorted.
BINS, FEW = 256, 4096


def _bin(v: Column, lo: Column, hi: Column, bins: int, turn: int) -> Column:
    """A bin that rises with the value; different bounds are in different bins. Bounds of one sign that are far apart are cut
    by magnitude, bounds of both signs at first evenly and from the second turn on by sign and magnitude, so values of all
    orders take a few passes. Halves keep differences finite."""
    width = hi / 2 - lo / 2
    even = lambda x: F.when(width > 0, (x / 2 - lo / 2) / width).otherwise(F.when(x > lo, 1.0).otherwise(0.0))
    size = lambda x: F.log2(F.abs(x))
    # Doubles reach from 2 ** -1074 to 2 ** 1024.
    signed = lambda x: F.when(x > 0, 0.5 + (size(x) + 1075) / 4200).when(x < 0, 0.5 - (size(x) + 1075) / 4200).otherwise(0.5)
    whole = lambda part: F.least(F.lit(bins - 1), F.floor(F.greatest(F.lit(0.0), part) * bins)).cast("int")
    part = F.when((lo > 0) & (hi / 1024 > lo), (size(v) - size(lo)) / (size(hi) - size(lo))).when((hi < 0) & (lo / 1024 < hi), (size(lo) - size(v)) / (size(lo) - size(hi)))
    if turn:
        part = part.when((lo <= 0) & (hi >= 0) & (whole(signed(lo)) != whole(signed(hi))), signed(v))
    inf = float("inf")
    return F.when(v == inf, bins).when(v == -inf, -1).otherwise(whole(part.otherwise(even(v))))


def _same(keys: list[str], left: str = "", right: str = "_r") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) for k in keys]) if keys else F.lit(True)


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], lowest: str | None = None, highest: str | None = None, bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys and the ``wanted`` quantiles (name -> share), exact and linear between samples; and, if named, the least and the
    greatest value.

    Nulls and NaN are left out; infinite values count. A key without values has nulls; null keys are a key; no rows give no
    rows. Each pass over ``rows`` reads them anew, so store what is costly to make.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    v = F.col(value).cast("double")
    data = rows.select(*[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], F.when(~F.isnan(v), v).alias("_v"))
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    whole = stored(data.groupBy(*k).agg(F.count("_v").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.min(finite).alias("_flo"), F.max(finite).alias("_fhi")))
    # Ranks from 0 of the two samples around each quantile.
    place = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in wanted.values()])))
    searched = whole.filter("_n > 0").select(*k, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.coalesce("_flo", F.lit(0.0)).alias("_a"), F.coalesce("_fhi", F.lit(0.0)).alias("_b"))
    open_, done, turn = stored(searched), [], 0
    while True:
        done.append(open_.filter("_lo = _hi or _in <= {0}".format(few)))
        open_ = open_.filter(f"not (_lo = _hi or _in <= {few})")
        if open_.isEmpty():
            break
        # Searches of one key share their bounds or have bounds that do not overlap.
        bounds = open_.select(*k, "_below", "_lo", "_hi", "_a", "_b").distinct()
        each = _inside(data, bounds, k).groupBy(*k, "_below", _bin(F.col("_v"), F.col("_a"), F.col("_b"), bins, turn).alias("_bin"))
        turn += 1
        cells = each.agg(F.count("*").alias("_c"), F.min("_v").alias("_clo"), F.max("_v").alias("_chi"))
        before = F.sum("_c").over(Window.partitionBy(*k, "_below").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
        cells = cells.withColumn("_from", F.col("_below") + F.coalesce(before, F.lit(0))).withColumnsRenamed({**{c: f"_r{c}" for c in k}, "_below": "_rbelow"})
        met = open_.join(cells, _same(k) & (F.col("_below") == F.col("_rbelow")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_c")))
        open_ = stored(met.select(*k, "_rank", F.col("_from").alias("_below"), F.col("_c").alias("_in"), F.col("_clo").alias("_lo"), F.col("_chi").alias("_hi"), F.col("_clo").alias("_a"), F.col("_chi").alias("_b")))
    found = stored(reduce(DataFrame.unionByName, done))
    # At most ``few`` values are sorted for each of these bounds.
    bounds = found.filter("_lo < _hi").select(*k, "_below", "_lo", "_hi", "_a", "_b").distinct()
    sorted_ = _inside(data, bounds, k).groupBy(*k, "_below").agg(F.array_sort(F.collect_list("_v")).alias("_values")).withColumnsRenamed({**{c: f"_r{c}" for c in k}, "_below": "_rbelow"})
    samples = found.join(sorted_, _same(k) & (F.col("_below") == F.col("_rbelow")) & (F.col("_lo") < F.col("_hi")), "left")
    samples = samples.select(*k, "_rank", F.coalesce(F.get("_values", (F.col("_rank") - F.col("_below")).cast("int")), "_lo").alias("_x"))
    at = samples.groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at")).withColumnsRenamed({c: f"_r{c}" for c in k})
    full = whole.join(at, _same(k), "left") if k else whole.join(at, how="left")

    def quantile(q: float) -> Column:
        low, high = (F.element_at("_at", f(place(q))) for f in (F.floor, F.ceil))
        between = low + (high - low) * (place(q) - F.floor(place(q)))
        return F.when(low == high, low).otherwise(between)

    ends = [F.col(c).alias(n) for n, c in ((lowest, "_least"), (highest, "_most")) if n]
    return full.select(*[F.col(n).alias(c) for c, n in zip(keys, k, strict=True)], *[quantile(q).alias(n) for n, q in wanted.items()], *ends)


def _inside(data: DataFrame, bounds: DataFrame, k: list[str]) -> DataFrame:
    """Rows of ``data`` whose value lies in one of their key's bounds, with these; the few bounds of a key come as one row."""
    of_key = bounds.groupBy(*k).agg(F.collect_list(F.struct("_below", "_lo", "_hi", "_a", "_b")).alias("_bounds")).withColumnsRenamed({c: f"_r{c}" for c in k})
    joined = data.join(of_key, _same(k)) if k else data.crossJoin(F.broadcast(of_key))
    hit = F.get(F.filter("_bounds", lambda x: (F.col("_v") >= x["_lo"]) & (F.col("_v") <= x["_hi"])), F.lit(0))
    return joined.withColumn("_hit", hit).filter("_hit is not null").select(*k, "_v", "_hit.*")
