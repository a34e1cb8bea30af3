"""Prominence of peaks in series that are cut into buckets, so that no task holds a series.

A peak's prominence is its value less the higher of two minima: of the samples back to the latest higher one, and of those
on to the next higher one (or to the end of the series). A bucket answers for the peaks whose higher sample lies inside it.
For the others it knows the least value up to its edge, and the greatest and least values of all buckets of the series, one
row each, name the bucket in which the search ends. That bucket's staircase - the samples higher than all those between them
and its edge, each with the least value on the way - has the answer: the lowest stair above the peak. A pair of buckets
meets in a group of its own; taken over a series there are at most twice as many pairs as buckets, since a bucket that is
searched past on behalf of another is lower than that one and is never searched again from behind it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored
from .order import attach, following, previous


def turning_points(df: DataFrame, keys: list[str], t: str, value: str, bucket: str | None = None) -> DataFrame:
    """The rows at which a series turns or stands still, and its ends; their values decide all prominences."""
    near = following(previous(df, keys, [t], F.col(value), "_p", bucket), keys, [t], F.col(value), "_n", bucket)
    v = F.col(value)
    turns = near.filter(F.col("_p").isNull() | F.col("_n").isNull() | ((v - F.col("_p")) * (F.col("_n") - v) <= 0))
    return turns.withColumn("_top", F.coalesce((v > F.col("_p")) & (v > F.col("_n")), F.lit(False))).drop("_p", "_n")


def higher_before(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each sample, the place of the latest higher one before it (-1: none) and the least value from there on."""
    at, low, stack = np.full(len(v), -1), np.array(v, float), []  # falling values: place, least value since the one below
    for i, x in enumerate(v.tolist()):
        least = x
        while stack and stack[-1][1] <= x:
            least = min(least, stack.pop()[2])
        at[i], low[i] = (stack[-1][0] if stack else -1), least
        stack.append((i, x, least))
    return at, low


def chain(most: list[float], least: list[float]) -> list[tuple[int, float, float]]:
    """Of buckets from the nearest on: those whose greatest value is above all nearer ones', as (number, that value, least
    value of the buckets passed on the way to it), and last (-1, inf, least of all)."""
    out, top, low = [], -np.inf, np.inf
    for c, (m, n) in enumerate(zip(most, least, strict=True)):
        if m > top:
            out.append((c, m, low))
            top = m
        low = min(low, n)
    return [*out, (-1, np.inf, low)]


def _searched(rows: pd.DataFrame, buckets: list, bucket, turned: bool) -> tuple[np.ndarray, list]:
    """Of each row (all of one bucket, by time) looking back (``turned``: ahead): the least value up to the higher sample as
    far as is known, and the bucket in which the search goes on, None where it is over."""
    v = rows["_v"].to_numpy(float)
    at, low = higher_before(v[::-1] if turned else v)
    at, low = (at[::-1], low[::-1]) if turned else (at, low)
    others = [b for b in buckets if (b["_b"] > bucket if turned else b["_b"] < bucket)]
    others.sort(key=lambda b: b["_b"], reverse=not turned)
    way = chain([b["_most"] for b in others], [b["_least"] for b in others])
    tops = np.array([w[1] for w in way])
    goes: list = [None] * len(v)
    for i in np.flatnonzero(at < 0).tolist():
        c, _, passed = way[int(np.searchsorted(tops, v[i], side="right"))]
        low[i] = min(low[i], passed)
        if c >= 0:
            goes[i] = others[c]["_b"]
    return low, goes


def evened(turns: DataFrame, keys: list[str]) -> DataFrame:
    """``turns`` with the buckets ``_b`` of a series run together: one takes whole buckets in their order, as many as begin
    within the square root of the series' turning points, so a series has at most about as many buckets as that root."""
    each = turns.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.floor(ahead / F.sqrt(F.sum("_n").over(Window.partitionBy(*keys)).cast("double")))
    return attach(turns, each.select(*keys, "_b", new.alias("_new")), [*keys, "_b"]).withColumn("_b", F.col("_new")).drop("_new")


def cut_peaks(df: DataFrame, keys: list[str], t: str, value: str, bucket: str, prominence: float, relative: bool = True) -> DataFrame:
    """keys, t, value, prominence of local maxima that stand out by ``prominence``, of the series over its maximum if
    ``relative`` and that is positive. ``bucket`` is a whole number that rises with ``t``; times of a series differ.

    A task holds the turning points of one bucket and one row for each bucket of its series. Buckets are run together to about
    the square root of a series' turning points, so both are small however finely it was cut, and what all tasks of a series
    hold is in proportion to its length. A bucket of more rows than that stays as it is. Null keys are a key; rows with a null value or time are left out.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    whole = df.filter(F.col(value).isNotNull() & F.col(t).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], F.col(t).alias("_t"), F.col(value).cast("double").alias("_v"), F.col(bucket).cast("long").alias("_b"))
    turns = stored(evened(stored(turning_points(whole, k, "_t", "_v", "_b")), k))
    ends = turns.groupBy(*k, "_b").agg(F.max("_v").alias("_most"), F.min("_v").alias("_least"))
    of_key = ends.groupBy(*k).agg(F.collect_list(F.struct("_b", "_most", "_least")).alias("_all"), F.max("_most").alias("_max"))
    each = stored(attach(ends.select(*k, "_b"), of_key.select(*k, "_all"), k))
    kinds = dict(turns.dtypes)
    key_schema = "".join(f"{c} {kinds[c]}, " for c in k)

    def inside(rows: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_t")
        b, buckets = one["_b"].iat[0], [dict(x.asDict() if hasattr(x, "asDict") else x) for x in one["_all"].iat[0]]
        out = rows[[*k, "_t", "_v", "_b", "_top"]].copy()
        for turned, side in ((False, "back"), (True, "ahead")):
            low, goes = _searched(rows, buckets, b, turned)
            out[f"_{side}"], out[f"_to_{side}"] = low, pd.array(goes, dtype="Int64")
        return out

    known = turns.groupBy(*k, "_b").cogroup(each.groupBy(*k, "_b")).applyInPandas(inside, f"{key_schema}_t {kinds['_t']}, _v double, _b long, _top boolean, _back double, _to_back long, _ahead double, _to_ahead long")
    known = stored(known)
    # A staircase: of looks back, the samples of a bucket above all later ones, whose search ahead leaves the bucket.
    lows = F.struct(F.col("_v").alias("v"), F.col("_low").alias("low"))
    found = []
    for side in ("back", "ahead"):
        open_ = known.filter("_top").filter(F.col(f"_to_{side}").isNotNull()).select(*k, "_t", "_v", "_b", F.col(f"_to_{side}").alias("_c"))
        pairs = open_.select(*k, "_b", "_c").distinct().withColumnsRenamed({c: f"_r{c}" for c in k} | {"_b": "_rb"})
        order = Window.partitionBy(*k, "_b").orderBy(F.desc("_t") if side == "back" else F.asc("_t")).rowsBetween(Window.unboundedPreceding, -1)
        stairs = turns.withColumn("_above", F.max("_v").over(order)).withColumn("_low", F.min("_v").over(order)).filter(F.col("_above").isNull() | (F.col("_v") > F.col("_above")))
        same = F.col("_b") == F.col("_c")
        for c in k:
            same &= F.col(c).eqNullSafe(F.col(f"_r{c}"))
        asked = stairs.join(pairs, same).select(*k, "_rb", "_c", "_v", F.lit(1).alias("_stair"), lows.alias("_s"), F.lit(None).cast(kinds["_t"]).alias("_t"))
        both = asked.unionByName(open_.select(*k, F.col("_b").alias("_rb"), "_c", "_v", F.lit(0).alias("_stair"), F.lit(None).cast("struct<v:double,low:double>").alias("_s"), "_t"))
        # The lowest stair above the peak is the last one before it in falling order; an equal one is not above it.
        falling = Window.partitionBy(*k, "_rb", "_c").orderBy(F.desc("_v"), "_stair").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = both.withColumn("_at", F.last("_s", ignorenulls=True).over(falling)).filter("_stair = 0")
        found.append(met.select(*k, F.col("_rb").alias("_b"), "_t", F.col("_at.low").alias("_low"), F.lit(side).alias("_side")))
    more = found[0].unionByName(found[1]).groupBy(*k, "_b", "_t").agg(*[F.min(F.when(F.col("_side") == s, F.col("_low"))).alias(f"_more_{s}") for s in ("back", "ahead")])
    done = attach(attach(known.filter("_top"), more, [*k, "_b", "_t"]), of_key.select(*k, "_max"), k)
    side = F.greatest(*[F.least(f"_{s}", f"_more_{s}") for s in ("back", "ahead")])
    by = F.when(F.col("_max") > 0, F.col("_max")).otherwise(1.0) if relative else F.lit(1.0)
    done = done.withColumn("prominence", F.col("_v") / by - side / by).filter(F.col("prominence") >= prominence)
    return done.select(*[F.col(n).alias(c) for c, n in zip(keys, k, strict=True)], F.col("_t").alias(t), F.col("_v").alias(value), "prominence")
