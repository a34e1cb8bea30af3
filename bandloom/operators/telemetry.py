"""Telemetry series: averaging duplicates, interpolation onto other times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import bracket, lerp


def average_duplicates(telemetry: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """One row per key and time: the mean of the values that are not null."""
    return telemetry.groupBy(*keys, t).agg(F.avg(value).alias(value))


def interpolate(targets: DataFrame, telemetry: DataFrame, keys: list[str], target_t: str, t: str, value: str, mode: str = "absolute", out: str = "interpolated", bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add the series' linear interpolation at each target time, clamped at its ends; duplicate times are averaged first.

    ``normalized`` stretches both time axes of a key to [0, 1] before; an axis of one point lies at 0. ``bucket`` is that of ``bracket``,
    on the axis that is used.
    """
    series = average_duplicates(telemetry, keys, t, value).withColumn("_x", F.col(t).cast("double"))
    asked = targets.withColumn("_x", F.col(target_t).cast("double"))
    if mode == "normalized":
        def stretch(df: DataFrame) -> DataFrame:
            ends = df.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
            x = F.when(F.col("_hi") > F.col("_lo"), (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
            return df.join(ends, keys).withColumn("_x", x).drop("_lo", "_hi")

        series, asked = stretch(series), stretch(asked)
    found = bracket(asked, series, keys, "_x", "_x", value, bucket)
    return found.withColumn(out, lerp(F.col("_x"), F.col("t0"), F.col("v0"), F.col("t1"), F.col("v1"))).drop("_x", "t0", "v0", "t1", "v1")
