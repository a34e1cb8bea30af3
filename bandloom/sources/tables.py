"""Readers of stored products and of calibration and response files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.products import restore_slices

#: Fixed names: columns that exports give to the same field, the preferred first.
RESPONSE_ALIASES = {
    "freq_mhz": ("freq_MHz", "frequency_MHz", "freq"),
    "phi_deg": ("phi_deg", "phi"),
    "theta_deg": ("theta_deg", "theta"),
    "phi_re": ("re(rx_Phi)", "rx_Phi_real", "phi_real", "re(h_Phi)"),
    "phi_im": ("im(rx_Phi)", "rx_Phi_imag", "phi_imag", "im(h_Phi)"),
    "theta_re": ("re(rx_Theta)", "rx_Theta_real", "theta_real", "re(h_Theta)"),
    "theta_im": ("im(rx_Theta)", "rx_Theta_imag", "theta_imag", "im(h_Theta)"),
}
#: Fixed names of the sensors in coefficient files, and what features call them.
ADC_SENSORS = ("SPE_ADC0_T", "SPE_ADC1_T")
SENSORS = {"1": "one", "THERM_FPGA": "therm", "SPE_1VAD8_V": "v8", "VMON_1V2D": "v12", "SPE_1VAD8_C": "i8"}
PRODUCTS = {"therm*therm": "therm2", "adc*adc": "adc2", "adc*therm": "therm_adc", "therm*adc": "therm_adc"}
COEFFICIENT_SCHEMA = "gain_setting string, component string, model string, term string, alpha_refit double"


class ContractError(ValueError):
    """Stored data break what their layout promises."""


def with_terms(df: DataFrame, column: str, **terms: str) -> DataFrame:
    """``df`` that says in the metadata of ``column`` what its values are (units, representation, frame). Parquet files
    carry it in their schema."""
    return df.withMetadata(column, {**(df.schema[column].metadata or {}), "terms": terms})


def terms_of(df: DataFrame, column: str) -> dict[str, str]:
    return dict((df.schema[column].metadata or {}).get("terms", {}))


def read_products(spark: SparkSession, folder: str, kind: str, paths: list[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """One kind of product of all sessions (folder/kind, partitioned by session_id), or of ``paths`` below ``folder`` with a
    schema that is known.

    Spectra must say their layout: version 3 needs the attributes units and representation on every row; version 2 is
    restored here with its bit slices; anything else, or a mixture that lacks them, raises.
    """
    reader = spark.read.option("mergeSchema", "true")
    df = spark.read.schema(schema).option("basePath", folder).parquet(*paths) if paths else reader.parquet(f"{folder}/{kind}")
    if kind != "spectra":
        return df
    need = {"layout_version", "bit_slice", "data"} - set(df.columns)
    if need:
        raise ContractError(f"spectra lack {sorted(need)}")
    stated = F.lit(True)
    for c, v in (("units", "SDU"), ("representation", "gain_model_input_sdu")):
        stated &= (F.col(c) == v) if c in df.columns else F.lit(False)
    v3 = F.col("layout_version") == 3
    slice_ok = F.col("bit_slice").between(0, 31) & (F.col("bit_slice") == F.floor("bit_slice"))
    bad = df.agg(
        F.count_if(~F.coalesce(F.col("layout_version").isin(2, 3), F.lit(False))).alias("version"), F.count_if(v3 & ~F.coalesce(stated, F.lit(False))).alias("attributes"), F.count_if(~v3 & ~F.coalesce(slice_ok, F.lit(False))).alias("bit_slice")
    ).first().asDict()
    if any(bad.values()):
        raise ContractError(f"rows that break the contract: {bad}")
    return restore_slices(df.withColumn("restored", v3), "data", "bit_slice")


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """level, channel, component, model, term, value of a coefficient CSV.

    gain_setting is a level and a channel, as L0. Terms are named as in FEATURES: a converter's temperature is ``adc`` for
    the channels that read it (the first for 0 and 1, the second for 2 and 3) and an unknown term, kept as it is, for the
    others. Products of sensors may be written in either order.
    """
    raw = spark.read.csv(path, header=True, schema=COEFFICIENT_SCHEMA)
    key = F.upper(F.trim("gain_setting"))
    channel = F.when(F.length(key) == 2, F.substring(key, 2, 1).try_cast("int"))
    term = F.trim("term")
    own = F.when(channel <= 1, F.lit(ADC_SENSORS[0])).otherwise(F.lit(ADC_SENSORS[1]))
    plain = F.array_join(F.transform(F.array_sort(F.split(term, r"\*")), lambda x: F.coalesce(F.when(x == own, "adc"), F.try_element_at(F.create_map(*[F.lit(v) for kv in SENSORS.items() for v in kv]), x), x)), "*")
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in PRODUCTS.items() for v in kv]), plain), plain)
    return raw.select(F.substring(key, 1, 1).alias("level"), channel.alias("channel"), F.trim("component").alias("component"), F.trim("model").alias("model"), name.alias("term"), F.col("alpha_refit").alias("value"))


def resolve_aliases(columns: list[str]) -> dict[str, str]:
    """Field -> the column that holds it; ValueError names a field without one."""
    out = {}
    for field, names in RESPONSE_ALIASES.items():
        found = [n for n in names if n in columns]
        if not found:
            raise ValueError(f"no column for {field}: one of {names} is needed")
        out[field] = found[0]
    return out


def read_response(spark: SparkSession, path: str, theta_max: float = 90.0, zero: float = 1e-12) -> DataFrame:
    """A receive grid from CSV, cut at ``theta_max``: complete, and zero below the horizon, or ValueError."""
    raw = spark.read.csv(path, header=True)
    grid = raw.select(*[F.col(f"`{c}`").cast("double").alias(f) for f, c in resolve_aliases(raw.columns).items()])
    report = grid_report(grid, theta_max).first()
    if (report["below"] or 0.0) > zero:
        raise ValueError(f"the response is {report['below']} below the horizon")
    if not report["complete"]:
        raise ValueError("the response does not cover a complete regular grid")
    return grid.filter(F.col("theta_deg") <= theta_max + 1e-12)


def grid_report(grid: DataFrame, theta_max: float = 90.0) -> DataFrame:
    """One row: points above the horizon, distinct axes, whether they are a full cross product of finite fields, and the
    greatest amplitude below."""
    up = F.col("theta_deg") <= theta_max + 1e-12
    amplitude = F.greatest(F.hypot("theta_re", "theta_im"), F.hypot("phi_re", "phi_im"))
    finite = ~F.isnan(amplitude) & amplitude.isNotNull() & (amplitude < float("inf"))
    g = grid.agg(
        F.count_if(up & finite).alias("points"), F.count_distinct("freq_mhz").alias("n_freq"), F.count_distinct(F.when(up, F.col("theta_deg"))).alias("n_theta"), F.count_distinct("phi_deg").alias("n_phi"),
        F.count_distinct(F.when(up & finite, F.struct("freq_mhz", "theta_deg", "phi_deg"))).alias("cells"), F.max(F.when(~up, amplitude)).alias("below"),
    )
    return g.withColumn("complete", (F.col("cells") == F.col("n_freq") * F.col("n_theta") * F.col("n_phi")) & (F.col("points") > 0))


def read_z_matrix(spark: SparkSession, path: str) -> DataFrame:
    """freq_mhz, a, b, re, im of a wide CSV with columns reZ11 to imZ44; non-finite entries raise."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    entries = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`reZ{a + 1}{b + 1}`").cast("double").alias("re"), F.col(f"`imZ{a + 1}{b + 1}`").cast("double").alias("im")) for a in range(4) for b in range(4)]))
    out = raw.select(F.col("freq_MHz").cast("double").alias("freq_mhz"), entries.alias("z")).select("freq_mhz", "z.*")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    if not out.filter(bad("re") | bad("im")).isEmpty():
        raise ValueError("the Z matrix has non-finite values")
    return out


def parse_json(text: Column, schema: str) -> Column:
    """The fields of a JSON text; a malformed one is null throughout."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def read_covariance(spark: SparkSession, path: str) -> DataFrame:
    """A stored covariance (time_idx, freq_idx, product, value, units, scale): one unit and scale, all cells there."""
    df = spark.read.parquet(path)
    r = df.agg(F.count_distinct("units", "scale").alias("kinds"), F.count("*").alias("n"), (F.count_distinct("time_idx") * F.count_distinct("freq_idx") * F.count_distinct("product")).alias("cells"), F.count_distinct("time_idx", "freq_idx", "product").alias("distinct")).first()
    if r["kinds"] != 1 or not r["n"] == r["cells"] == r["distinct"]:
        raise ContractError(f"covariance with {r['kinds']} kinds of units, {r['n']} rows for {r['cells']} cells")
    return df
