"""Comparisons, rollups, and merging of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import select


def compare(new: DataFrame, ref: DataFrame, keys: list[str], row: str, value: str, atol: float, rtol: float) -> DataFrame:
    """keys, max_abs, max_rel, status of two versions, row by row.

    PASS if the greatest absolute or relative difference is within its tolerance, WARN within ten times that, else FAIL.
    Without rows that are finite on both sides: PASS if their gaps agree, else WARN. Unequal rows: FAIL; a key on one
    side only: ``missing_new`` or ``missing_ref``.
    """
    a = new.select(*keys, row, F.col(value).cast("double").alias("_a"), F.lit(True).alias("_in_a"))
    b = ref.select(*keys, row, F.col(value).cast("double").alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, [*keys, row], "full_outer")
    nan = lambda c: F.col(c).isNull() | F.isnan(c)
    finite = ~nan("_a") & ~nan("_b")
    d = F.abs(F.col("_a") - F.col("_b"))
    scale = F.greatest(F.abs("_a"), F.abs("_b"))
    g = both.groupBy(*keys).agg(
        F.count("_in_a").alias("_na"), F.count("_in_b").alias("_nb"), F.count(F.when(F.col("_in_a") & F.col("_in_b"), 1)).alias("_nab"), F.count_if(finite).alias("_nf"), F.bool_and(nan("_a") == nan("_b")).alias("_same"),
        F.max(F.when(finite, d)).alias("max_abs"), F.max(F.when(finite, F.when(scale > 0, d / scale).otherwise(0.0))).alias("max_rel"),
    )
    status = (
        F.when(F.col("_na") == 0, "missing_new").when(F.col("_nb") == 0, "missing_ref").when((F.col("_na") != F.col("_nab")) | (F.col("_nb") != F.col("_nab")), "FAIL")
        .when(F.col("_nf") == 0, F.when(F.col("_same"), "PASS").otherwise("WARN"))
        .when((F.col("max_abs") <= atol) | (F.col("max_rel") <= rtol), "PASS").when((F.col("max_abs") <= 10 * atol) | (F.col("max_rel") <= 10 * rtol), "WARN").otherwise("FAIL")
    )
    return g.select(*keys, "max_abs", "max_rel", status.alias("status"))


def rollup_status(rows: DataFrame, a: str, b: str, statuses: tuple[str, ...] = ("PASS", "WARN", "FAIL")) -> DataFrame:
    """Counts of each status per ``a``, per ``b``, and in all, by one pass with grouping sets."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in statuses]
    return rows.groupingSets([[F.col(a)], [F.col(b)], []], F.col(a), F.col(b)).agg(F.count("*").alias("n"), *counts)


def first_failures(rows: DataFrame, order: list, n: int = 25) -> tuple[DataFrame, int]:
    """The first ``n`` failures in order, and how many more there are."""
    failed = rows.filter("status = 'FAIL'")
    return failed.orderBy(*order).limit(n), max(0, failed.count() - n)


def concat_sources(sources: list[DataFrame]) -> DataFrame:
    """Rows of all sources; a column that one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def merged_scale(constants: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per key: the sources' common time scale: unknown if any is unknown or none known, ``conflict`` if known ones differ;
    and the first source's clock with how many values there are."""
    known = F.collect_set(F.when(F.col("time_scale") != "unknown", F.col("time_scale")))
    scale = F.when(F.size(known) > 1, "conflict").when(F.count_if(F.coalesce(F.col("time_scale") == "unknown", F.lit(True))) > 0, "unknown").otherwise(F.coalesce(known[0], F.lit("unknown")))
    return constants.groupBy(*(keys or [])).agg(scale.alias("time_scale"), F.min_by("clock_source", "start").alias("clock_source"), F.count_distinct("clock_source").alias("n_clock_sources"))


def require_scale(constants: DataFrame, assumed: str | None = None) -> str:
    """The merged scale; ValueError if known ones conflict with each other or with the assumed one."""
    scale = merged_scale(constants).first()["time_scale"]
    known = {r[0] for r in constants.filter("time_scale != 'unknown'").select("time_scale").distinct().limit(10).collect()}
    if scale == "conflict" or (assumed and known - {assumed}):
        raise ValueError(f"time scales conflict: {sorted(known)}, assumed {assumed}")
    return assumed or scale


def keys_in_all(keys: DataFrame, rows: DataFrame, key: str, row: str) -> DataFrame:
    """Keys that occur in as many rows as there are."""
    total = rows.agg(F.count_distinct(row).alias("_total"))
    return keys.groupBy(key).agg(F.count_distinct(row).alias("_n")).crossJoin(F.broadcast(total)).filter("_n = _total").select(key)


def key_union(rows: DataFrame, keys: Column, key: str = "key", without: tuple[str, ...] = ()) -> DataFrame:
    """Distinct names in the arrays ``keys`` of all rows, but for those in ``without``."""
    return rows.select(F.explode(keys).alias(key)).distinct().filter(~F.col(key).isin(*without))


def sides(a: DataFrame, b: DataFrame, name_a: str, both: str = "both") -> DataFrame:
    """Distinct rows of both tables, and those of the first alone, with the side they are on."""
    return a.intersect(b).withColumn("side", F.lit(both)).unionByName(a.subtract(b).withColumn("side", F.lit(name_a)))


def mode(rows: DataFrame, column: str, name: str = "mode") -> DataFrame:
    """One row: the commonest value and its count; ties to the least value."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), name).limit(1)


def distribution(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """keys, lowest, the named quantiles (exact, linear between samples), highest; nulls and NaN are left out."""
    return select.quantiles(rows, keys, value, quantiles, "lowest", "highest").select(*keys, "lowest", *quantiles, "highest")


def channel_stats(rows: DataFrame, keys: list[str], values: str, channel: str = "channel") -> DataFrame:
    """keys, channel, lo, hi, mean, rms of array values, one channel an element."""
    each = rows.select(*keys, F.posexplode(values).alias(channel, "_x")).withColumn("_v", F.col("_x").cast("double"))
    return each.groupBy(*keys, channel).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.avg("_v").alias("mean"), F.sqrt(F.avg(F.col("_v") * F.col("_v"))).alias("rms"))


def mean_over(rows: DataFrame, keys: list, value: str, name: str = "mean") -> DataFrame:
    """Mean per ``keys`` over all other axes; nulls are left out."""
    return rows.groupBy(*keys).agg(F.avg(value).alias(name))


def missing_required(spark: SparkSession, required: list[str], present: DataFrame, name: str) -> DataFrame:
    """Names of ``required`` that ``present`` lacks."""
    return spark.createDataFrame([(r,) for r in required], f"{name} string").join(present.select(name), name, "left_anti")


def time_axis(kinds: DataFrame, ladder: list[str], preferred: str | None = None) -> DataFrame:
    """Per source (source, kind, n): the kind that serves as time axis: the preferred one if it has rows, else the first of
    the ladder that has."""
    order = [*([preferred] if preferred else []), *[k for k in ladder if k != preferred]]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    return kinds.filter((F.col("n") > 0) & (rank > 0)).groupBy("source").agg(F.min_by("kind", rank).alias("axis"))


def preferred_paths(files: DataFrame, formats: list[str], stem: Column | None = None) -> DataFrame:
    """One path per (root, stem): the format that comes first. The stem is the file's name without suffix if not given."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1) if stem is None else stem
    suffix = F.regexp_extract("path", r"\.([^./]+)$", 1)
    rank = F.array_position(F.array(*map(F.lit, formats)), suffix)
    best = Window.partitionBy("root", "stem").orderBy("_rank", "path")
    return files.withColumn("stem", stem).withColumn("_rank", rank).filter("_rank > 0").withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_rank", "_n")


def content_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count and order-free checksum of the rows: the sum of the first 48 bits of their digests, so any engine agrees."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    bits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(bits), F.lit(0)).cast("decimal(38,0)").cast("string").alias("checksum"))


def angular_separation(alt_a: Column, az_a: Column, alt_b: Column, az_b: Column) -> Column:
    """Degrees between two directions given in degrees; the cosine is clipped to [-1, 1]."""
    a, b = F.radians(alt_a), F.radians(alt_b)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(az_a - az_b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))
