"""The gain model as tables: coefficients, basis, prediction, and the conversion of spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calibrate as C

LEVELS, FAMILIES, COMPONENTS = ("L", "M", "H"), ("linear", "quadratic"), ("PC1", "PC2")
ANCHORS = 16


def coefficient_problems(rows: DataFrame) -> DataFrame:
    """problem and slot of every row of a coefficient table (level, channel, component, model, term, value) that is
    unknown or repeated, and of every group without any row."""
    known = F.col("level").isin(*LEVELS) & F.col("channel").between(0, 3) & F.col("component").isin(*COMPONENTS) & F.col("model").isin(*FAMILIES) & F.col("term").isin(*C.FEATURES)
    slot = F.concat_ws("/", "level", "channel", "component", "model", "term")
    unknown = rows.filter(~F.coalesce(known, F.lit(False))).select(F.lit("unknown").alias("problem"), slot.alias("slot"))
    twice = rows.groupBy("level", "channel", "component", "model", "term").count().filter("count > 1").select(F.lit("repeated").alias("problem"), slot.alias("slot"))
    spark = rows.sparkSession
    groups = spark.createDataFrame([(v, c, p, m) for v in LEVELS for c in range(4) for p in COMPONENTS for m in FAMILIES], "level string, channel int, component string, model string")
    missing = groups.join(rows, ["level", "channel", "component", "model"], "left_anti").select(F.lit("missing").alias("problem"), F.concat_ws("/", "level", "channel", "component", "model").alias("slot"))
    return unknown.unionByName(twice).unionByName(missing)


def packed_coefficients(rows: DataFrame) -> DataFrame:
    """level, channel, component, model, coefficients: the nine terms in order, absent ones 0; 48 rows. Unknown or repeated
    terms and missing groups raise ValueError."""
    bad = coefficient_problems(rows)
    some = bad.orderBy("problem", "slot").limit(5).collect()
    if some:
        raise ValueError(f"{bad.count()} problems in the coefficients, such as {[tuple(r) for r in some]}")
    terms = F.array(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("value"))), F.lit(0.0)) for t in C.FEATURES])
    return rows.groupBy("level", "channel", "component", "model").agg(terms.alias("coefficients"))


def predict(telemetry: DataFrame, coefficients: DataFrame, models: tuple[str, str] = ("quadratic", "quadratic")) -> DataFrame:
    """Add pc1 and pc2 to rows with level, channel and features; a level without a model gives null."""
    out = telemetry
    for name, component, model in zip(("pc1", "pc2"), COMPONENTS, models, strict=True):
        c = coefficients.filter((F.col("component") == component) & (F.col("model") == model)).select("level", "channel", F.col("coefficients").alias("_c"))
        dot = F.aggregate(F.zip_with("features", "_c", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        out = out.join(F.broadcast(c), ["level", "channel"], "left").withColumn(name, F.when(F.col("_c").isNotNull(), dot)).drop("_c")
    return out


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline through (x, y), evaluated at ``at``; NaN outside of x."""
    n = len(x)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        r[i] = 3 * (h[i] * d[i - 1] + h[i - 1] * d[i])
    # The third derivative is continuous across the second and the last but one knot.
    a[0, :2] = h[1], h[0] + h[1]
    r[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    a[-1, -2:] = h[-1] + h[-2], h[-2]
    r[-1] = (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    s = np.linalg.solve(a, r)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t = (at - x[k]) / h[k]
    out = (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * s[k] + t**2 * (3 - 2 * t) * y[k + 1] + t**2 * (t - 1) * h[k] * s[k + 1]
    return np.where((at < x[0]) | (at > x[-1]), np.nan, out)


def spectral_basis(spark: SparkSession, basis: DataFrame, grid: list[float]) -> DataFrame:
    """level, channel, freq_idx, freq_mhz, mean, eig1, eig2 on ``grid``. The basis (level, channel, anchor_mhz, mean, eig1,
    eig2) has 12 keys of 16 anchors, so the spline runs on the driver."""
    at = np.asarray(grid, float)
    out = []
    known = basis.limit(len(LEVELS) * 4 * ANCHORS + 1).toPandas()
    if len(known) > len(LEVELS) * 4 * ANCHORS:
        raise ValueError(f"a basis has at most {len(LEVELS) * 4 * ANCHORS} rows")
    for key, rows in known.groupby(["level", "channel"]):
        rows = rows.sort_values("anchor_mhz")
        cols = [spline(rows["anchor_mhz"].to_numpy(), rows[c].to_numpy(), at) for c in ("mean", "eig1", "eig2")]
        out += [(key[0], int(key[1]), i, float(at[i]), *[None if np.isnan(c[i]) else float(c[i]) for c in cols]) for i in range(len(at))]
    return spark.createDataFrame(out, "level string, channel int, freq_idx int, freq_mhz double, mean double, eig1 double, eig2 double")


def gain_spectra(predicted: DataFrame, basis: DataFrame) -> DataFrame:
    """predicted rows x bins of their level and channel, with gain = mean + pc1 * eig1 + pc2 * eig2."""
    out = predicted.join(F.broadcast(basis), ["level", "channel"])
    return out.withColumn("gain", F.col("mean") + F.col("pc1") * F.col("eig1") + F.col("pc2") * F.col("eig2")).drop("mean", "eig1", "eig2")


def model_table(coefficients: DataFrame, basis: DataFrame, models: tuple[str, str] = ("quadratic", "quadratic")) -> DataFrame:
    """level, channel, c1, c2 (packed coefficients of both components) and mean, eig1, eig2 (arrays over the grid): 12 rows."""
    pick = lambda k: F.max(F.when((F.col("component") == COMPONENTS[k]) & (F.col("model") == models[k]), F.col("coefficients")))
    part = lambda n: F.transform("_b", lambda x: x[n]).alias(n)
    both = coefficients.groupBy("level", "channel").agg(pick(0).alias("c1"), pick(1).alias("c2"))
    cells = F.array_sort(F.collect_list(F.struct("freq_idx", "mean", "eig1", "eig2")))
    return both.join(basis.groupBy("level", "channel").agg(cells.alias("_b")).select("level", "channel", *map(part, ("mean", "eig1", "eig2"))), ["level", "channel"])


def gain_arrays(telemetry: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """keys and gains: map of channel -> gain over the grid, null without a model; of rows (keys, codes: the four channels'
    gain codes, and the sensors therm, adc0, adc1, v8, v12, i8). ``model`` has 12 rows, one a level and channel."""
    rows = telemetry.select(*keys, "therm", "adc0", "adc1", "v8", "v12", "i8", F.posexplode("codes").alias("channel", "_code"))
    rows = rows.withColumn("level", C.gain_level(F.col("_code"))).withColumn("_x", C.gain_features(*[F.col(c) for c in ("channel", "therm", "adc0", "adc1", "v8", "v12", "i8")]))
    rows = rows.join(F.broadcast(model), ["level", "channel"], "left")
    dot = lambda c: F.aggregate(F.zip_with("_x", c, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    rows = rows.withColumn("_p1", dot("c1")).withColumn("_p2", dot("c2"))
    gain = F.zip_with(F.zip_with("mean", "eig1", lambda m, e: m + F.col("_p1") * e), "eig2", lambda m, e: m + F.col("_p2") * e)
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("channel", gain.alias("gain")))).alias("gains"))


def convert_spectra(spectra: DataFrame, gains: DataFrame, products: DataFrame, keys: list[str], psd: bool = False, out: str = "physical") -> DataFrame:
    """Add ``out`` to spectra (keys, product, data): the bins of each product with the gains (keys, gains: map of channel ->
    gain over the same bins) of its two channels. One join on the keys; ``products`` has 16 rows."""
    rows = spectra.join(F.broadcast(products), "product").join(gains, keys, "left")
    auto, cross = (C.nv2_auto, C.nv2_cross) if psd else (C.nv_auto, C.nv_cross)
    of = lambda c: F.try_element_at("gains", F.col(c))
    one = F.zip_with("data", of("a"), lambda x, g: auto(x, g))
    two = F.zip_with("data", F.zip_with(of("a"), of("b"), lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda x, g: cross(x, g["a"], g["b"]))
    # A channel without a gain leaves bins without a value.
    none = F.transform("data", lambda x: F.lit(None).cast("double"))
    return rows.withColumn(out, F.coalesce(F.when(F.col("part") == "auto", one).otherwise(two), none)).drop("gains")


def calibrate(spectra: DataFrame, telemetry: DataFrame, coefficients: DataFrame, basis: DataFrame, products: DataFrame, keys: list[str], models: tuple[str, str] = ("quadratic", "quadratic"), psd: bool = False) -> DataFrame:
    """Spectra (keys, product, data) with ``physical``: from the gain codes and sensors of their rows (see ``gain_arrays``),
    the coefficients as read, and the basis on the spectra's grid (see ``spectral_basis``)."""
    model = model_table(packed_coefficients(coefficients), basis, models)
    return convert_spectra(spectra, gain_arrays(telemetry, model, keys), products, keys, psd)


def convert(rows: DataFrame, gains: DataFrame, products: DataFrame, keys: list[str], psd: bool = False) -> DataFrame:
    """Add ``physical`` to rows (keys, product, value): each product with the gains (keys, channel, gain) of its two
    channels. psd: nV^2/Hz, else nV/sqrt(Hz)."""
    rows = rows.join(F.broadcast(products), "product")
    a = gains.select(*keys, F.col("channel").alias("a"), F.col("gain").alias("gain_a"))
    b = gains.select(*keys, F.col("channel").alias("b"), F.col("gain").alias("gain_b"))
    rows = rows.join(a, [*keys, "a"], "left").join(b, [*keys, "b"], "left")
    auto, cross = (C.nv2_auto, C.nv2_cross) if psd else (C.nv_auto, C.nv_cross)
    x, ga, gb = F.col("value"), F.col("gain_a"), F.col("gain_b")
    return rows.withColumn("physical", F.when(F.col("part") == "auto", auto(x, ga)).otherwise(cross(x, ga, gb))).drop("gain_a", "gain_b")


def level_spec(spark: SparkSession, spec: str | list | dict) -> DataFrame:
    """channel, level for one level, four letters, a list or a dict of channels."""
    if isinstance(spec, str) and len(spec) == 1:
        spec = spec * 4
    items = spec.items() if isinstance(spec, dict) else enumerate(spec)
    rows = [(int(c), {0: "L", 1: "M", 2: "H"}.get(v, str(v).upper())) for c, v in items]
    if any(v not in LEVELS or not 0 <= c <= 3 for c, v in rows):
        raise ValueError(f"not a level spec: {spec!r}")
    return spark.createDataFrame(rows, "channel int, level string")


def level_of(code: Column) -> Column:
    return C.gain_level(code)
