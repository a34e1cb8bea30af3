"""Sessions: starts, summaries, telemetry windows, manifests, source fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import session_name
from .order import asof, attach, over, previous, running_max
from .select import quantiles


def first_hello(df: DataFrame, keys: list[str], order: list, is_hello: Column, take: list[str]) -> DataFrame:
    """keys and ``take`` of the first hello row of each session; sessions without one have none."""
    best = df.filter(is_hello).groupBy(*keys).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("_h"))
    return best.select(*keys, "_h.*")


def summarise(df: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Rows of each kind per session, as columns n_<kind>, and whether there are any, as has_<kind>."""
    counts = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    return df.groupBy(*keys).agg(*counts).withColumns({f"has_{k}": F.col(f"n_{k}") > 0 for k in kinds})


def session_windows(sessions: DataFrame, keys: list[str], start: str, number: str) -> DataFrame:
    """Add lo and hi: from the session's own start to the next one's; the first is open below, the last above. Null
    starts sort first."""
    w = over(keys, [F.asc_nulls_first(start), number])
    first = F.row_number().over(w) == 1
    return sessions.withColumn("lo", F.when(~first, F.col(start))).withColumn("hi", F.lead(start).over(w))


def in_window(t: Column, lo: Column, hi: Column) -> Column:
    """Half-open; a null bound is open."""
    return (lo.isNull() | (t >= lo)) & (hi.isNull() | (t < hi))


def assign_telemetry(telemetry: DataFrame, sessions: DataFrame, keys: list[str], t: str, start: str, session: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add the latest session that starts at or before each row; rows before the first go to the first. A null start
    counts as 0. ``bucket`` makes a column that rises with the time it is given."""
    starts = sessions.withColumn("_start", F.coalesce(start, F.lit(0.0)).cast("double"))
    first = starts.groupBy(*keys).agg(F.min_by(session, "_start").alias("_first"))
    told = asof(telemetry.withColumn("_t", F.col(t).cast("double")), starts, keys, ["_t"], ["_start"], {session: session}, bucket(F.col("_o0")) if bucket else None)
    return attach(told, first, keys).withColumn(session, F.coalesce(session, "_first")).drop("_first", "_t")


def rederive(telemetry: DataFrame, windows: DataFrame, keys: list[str], t: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Telemetry rows inside a session's window, with the window's columns. The windows (lo, hi) of a key do not overlap, so
    the one that a row may lie in is the latest that begins before it: an as-of join, no pairs of rows and windows."""
    begin = windows.withColumn("_begin", F.col("lo").cast("double")).withColumn("_hit", F.lit(True))
    names = [c for c in windows.columns if c not in keys]
    met = asof(telemetry.withColumn("_at", F.col(t).cast("double")), begin, keys, ["_at"], ["_begin"], {**{n: n for n in names}, "_hit": "_hit"}, bucket(F.col("_o0")) if bucket else None)
    return met.filter(F.col("_hit") & (F.col("hi").isNull() | (F.col("_at") < F.col("hi").cast("double")))).drop("_at", "_hit")


def latest_time(rows: DataFrame, spectra: DataFrame, keys: list[str], order: list[str], uid: str, t: str, out: str = "t", bucket: str | None = None) -> DataFrame:
    """Add the time of the latest spectrum whose uid is not above the greatest uid seen so far in the rows' order; 0 before
    the first. ``bucket`` is a column of ``rows`` that rises with their order."""
    seen = running_max(rows, keys, order, F.col(uid), "_seen", bucket)
    best = spectra.groupBy(*keys, uid).agg(F.max(t).alias("_t"))
    return asof(seen, best, keys, ["_seen"], [uid], {"_t": out}).withColumn(out, F.coalesce(out, F.lit(0.0))).drop("_seen")


def by_first_time(sessions: DataFrame, first: str, number: str) -> DataFrame:
    """Sessions in the order of their first time; one without a time counts as 0, ties go by number."""
    return sessions.orderBy(F.coalesce(F.col(first).cast("double"), F.lit(0.0)), number)


def named(sessions: DataFrame, number: str, start: str, namer: Callable[[Column, Column], Column] | None = None, out: str = "name") -> DataFrame:
    """Add each session's name: the usual one, or what ``namer`` makes of its number and start."""
    return sessions.withColumn(out, (namer or session_name)(F.col(number), F.col(start)))


def fingerprint_mismatches(recorded: DataFrame, current: DataFrame, tolerance_s: float = 1e-3) -> DataFrame:
    """path and reason (missing, size, mtime) of recorded sources (path, size, mtime) that no longer are as recorded."""
    now = current.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    reason = F.when(F.col("_size").isNull(), "missing").when(F.col("size") != F.col("_size"), "size").when(F.abs(F.col("mtime") - F.col("_mtime")) > tolerance_s, "mtime")
    return recorded.join(now, "path", "left").select("path", reason.alias("reason")).filter("reason is not null")


def manifest(summary: DataFrame, version: int = 1) -> DataFrame:
    """One JSON text per session, its keys sorted, with the schema's version."""
    cols = sorted([*summary.columns, "manifest_schema_version"])
    return summary.withColumn("manifest_schema_version", F.lit(version)).select(F.to_json(F.struct(*cols)).alias("manifest"))


def cadence(rows: DataFrame, keys: list[str], order: list, t: str, name: str = "cadence", bucket: str | None = None) -> DataFrame:
    """keys and the median of the differences between consecutive times; 1 where that is not positive or there is none. The
    median is selected by counting, so no task holds a key's differences."""
    gaps = previous(rows, keys, order, F.col(t), "_before", bucket).select(*keys, (F.col(t) - F.col("_before")).alias("_gap"))
    m = F.col("_m")
    return quantiles(gaps, keys, "_gap", {"_m": 0.5}).select(*keys, F.when(m > 0, m).otherwise(1.0).alias(name))


def elapsed(rows: DataFrame, keys: list[str], t: str, name: str = "elapsed") -> DataFrame:
    """Add the time since the first of the keys' rows."""
    first = rows.groupBy(*keys).agg(F.min(t).alias("_first"))
    return rows.join(first, keys).withColumn(name, F.col(t) - F.col("_first")).drop("_first")


def source_bounds(sources: DataFrame, order: list, rows: str) -> DataFrame:
    """Add start and end of each source in the concatenation of all: a running sum over one row per source."""
    w = Window.orderBy(*order)
    before = F.coalesce(F.sum(rows).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sources.withColumn("start", before.cast("long")).withColumn("end", (F.col("start") + F.col(rows)).cast("long"))


def warnings_by_session(rejects: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Count and sorted distinct texts of the warnings of each session."""
    return rejects.groupBy(*keys).agg(F.count("*").alias("n_warnings"), F.array_sort(F.collect_set(text)).alias("warnings"))
