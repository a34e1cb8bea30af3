"""Queries that write files to the shared folder and read them with the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gain
from ..sources import sinks, tables
from ..sources.folders import shared_folder
from .registry import query, table


def fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/bandloom/{uuid.uuid4().hex}"


_SPECTRA = "select vec_id orig_idx, bin::int bin, round(value * pow(2, (20 + label) - 31), 12) restored_value from (select vec_id, label, unnest(embedding)::double as value, generate_subscripts(embedding, 1) - 1 bin from embeddings)"


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 5).cast("string").alias("session_id"), F.col("vec_id").alias("orig_idx"), F.col("label").alias("product"), F.col("embedding").cast("array<double>").alias("data"), (F.col("label") + 20).alias("bit_slice"))


@query(_SPECTRA)
def stored_spectra(spark, sf_dir):
    """Spectra written in their layout, of the older version without restored bit slices, and read under the contract."""
    folder = fresh(spark)
    sinks.save_kind(_spectra(spark, sf_dir), folder, "spectra", slices=4)
    old = spark.read.parquet(f"{folder}/spectra").withColumn("layout_version", F.lit(2))
    old.write.partitionBy("session_id").parquet(f"{folder}/older/spectra")
    got = tables.read_products(spark, f"{folder}/older", "spectra").select("orig_idx", F.posexplode("data").alias("bin", "value"))
    return got.select("orig_idx", "bin", F.round("value", 12).alias("restored_value"))


@query("select event_id orig_idx, event_type channel, value, layout from (select event_id, event_type, value, 'telemetry' layout from events union all select event_id, event_type, value, 'waveform' from events where event_type = 'click')")
def stored_kinds(spark, sf_dir):
    """Telemetry and waveforms written in their layouts and read again."""
    folder = fresh(spark)
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("string").alias("session_id"), F.col("event_id").alias("t"), F.col("event_type").alias("channel"), "value")
    sinks.save_kind(e, folder, "telemetry", slices=2)
    sinks.save_kind(e.filter("channel = 'click'").select("session_id", "channel", F.col("t").alias("event_id"), F.array("value").alias("data")), folder, "waveform")
    a = tables.read_products(spark, folder, "telemetry").select(F.col("t").alias("orig_idx"), "channel", "value", F.lit("telemetry").alias("layout"))
    b = tables.read_products(spark, folder, "waveform").select(F.col("event_id").alias("orig_idx"), "channel", F.col("data")[0].alias("value"), F.lit("waveform").alias("layout"))
    return a.unionByName(b)


@query("""with t as (select unnest(['one', 'therm', 'adc', 'v8', 'v12', 'i8', 'therm2', 'adc2', 'therm_adc']) term, range(9) k)
select v.l || '' as level, c::int channel, p.p component, m.m model, list_extract(['one', 'therm', 'adc', 'v8', 'v12', 'i8', 'therm2', 'adc2', 'therm_adc'], k + 1) term, round(s.x + c + k / 10.0, 6) as value
from (values ('L'), ('M'), ('H')) v(l), range(4) r(c), (values ('PC1'), ('PC2')) p(p), (values ('linear'), ('quadratic')) m(m), range(9) q(k), (select round(avg(p_size), 3) x from part) s""")
def coefficient_file(spark, sf_dir):
    """A coefficient file with the names that files give to sensors, as read."""
    sensors = lambda c: ["1", "THERM_FPGA", a := f"SPE_ADC{int(c > 1)}_T", "SPE_1VAD8_V", "VMON_1V2D", "SPE_1VAD8_C", "THERM_FPGA*THERM_FPGA", f"{a}*{a}", f"THERM_FPGA*{a}"]
    rows = [(f"{v}{c}", p, m, t, c + k / 10.0) for v in gain.LEVELS for c in range(4) for p in gain.COMPONENTS for m in gain.FAMILIES for k, t in enumerate(sensors(c))]
    base = table(spark, sf_dir, "part").agg(F.round(F.avg("p_size"), 3).alias("x"))
    made = spark.createDataFrame(rows, "gain_setting string, component string, model string, term string, y double").crossJoin(F.broadcast(base))
    folder = fresh(spark)
    made.select("gain_setting", "component", "model", "term", (F.col("x") + F.col("y")).alias("alpha_refit")).write.csv(folder, header=True)
    got = tables.read_coefficients(spark, folder)
    gain.packed_coefficients(got)
    return got.select("level", "channel", "component", "model", "term", F.round("value", 6).alias("value"))


@query("select o_orderkey::double freq_mhz, a::int a, b::int b, o_totalprice % (7 + a * 4 + b) re, ((a - b) / 4)::double im from orders, range(4) x(a), range(4) y(b)")
def z_matrix_file(spark, sf_dir):
    """A wide file of 4x4 impedances, one row an order, as read."""
    o, folder = table(spark, sf_dir, "orders"), fresh(spark)
    cols = [c for a in range(4) for b in range(4) for c in ((F.col("o_totalprice") % (7 + a * 4 + b)).alias(f"reZ{a + 1}{b + 1}"), F.lit((a - b) / 4.0).alias(f"imZ{a + 1}{b + 1}"))]
    o.select((F.col("o_orderkey") / 1.0).alias("freq_MHz"), *cols).write.csv(folder, header=True)
    return tables.read_z_matrix(spark, folder)


@query("with g as (select distinct p_size f from part), c as (select f::double freq_mhz, t * 45::double theta_deg, p * 90::double phi_deg from g, range(3) a(t), range(5) b(p)) select freq_mhz, theta_deg, phi_deg, freq_mhz + theta_deg theta_re, phi_deg / 10 theta_im, 1::double phi_re, -freq_mhz phi_im from c")
def response_file(spark, sf_dir):
    """A receive grid with one of the names that exports use, read, cut at the horizon and checked."""
    g, folder = table(spark, sf_dir, "part").select("p_size").distinct(), fresh(spark)
    cells = g.crossJoin(spark.range(4).withColumnRenamed("id", "t")).crossJoin(spark.range(5).withColumnRenamed("id", "p"))
    f, theta, phi = F.col("p_size") * 1.0, F.col("t") * 45.0, F.col("p") * 90.0
    up = lambda c: F.when(theta <= 90, c).otherwise(0.0)
    cells.select(f.alias("frequency_MHz"), phi.alias("phi"), theta.alias("theta"), up(F.lit(1.0)).alias("phi_real"), up(-f).alias("phi_imag"), up(f + theta).alias("theta_real"), up(phi / 10).alias("theta_imag")).write.csv(folder, header=True)
    got = tables.read_response(spark, folder)
    return got.select("freq_mhz", "theta_deg", "phi_deg", "theta_re", "theta_im", "phi_re", "phi_im")


@query("select event_id, (props::json->>'k')::int k from events")
def json_fields(spark, sf_dir):
    """Fields of JSON payloads; malformed ones would be null."""
    return table(spark, sf_dir, "events").select("event_id", tables.parse_json(F.col("props"), "k int")["k"].alias("k"))


@query("select vec_id time_idx, (i - 1)::int freq_idx, label::varchar product, embedding[i]::double as value from embeddings, range(1, 65) r(i)")
def stored_covariance(spark, sf_dir):
    """A covariance cube with one unit and scale and all its cells, written and read under its contract."""
    folder = fresh(spark)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("time_idx"), F.col("label").cast("string").alias("product"), F.posexplode(F.col("embedding").cast("array<double>")).alias("freq_idx", "value"))
    cube = e.withColumnRenamed("product", "label").withColumn("product", F.lit("all")).withColumns({"units": F.lit("V2/Hz"), "scale": F.lit(1.0)})
    cube.write.parquet(folder)
    return tables.read_covariance(spark, folder).select("time_idx", "freq_idx", F.col("label").alias("product"), "value")


@query("select user_id::varchar session_id, printf('%05d_%04x.bin', row_number() over (partition by user_id order by event_id % 97, event_type, event_id) - 1, (event_id % 2048)::int) file from events")
def packet_files(spark, sf_dir):
    """Packets written session by session under their file names, many sessions a file."""
    folder = fresh(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") % 97).alias("unique_packet_id"), F.col("event_type").alias("seq"), F.col("event_id").alias("pkt_idx"), (F.col("event_id") % 2048).cast("int").alias("appid"))
    sinks.write_packets(e, folder, ["session_id"], apart=False)
    return spark.read.schema("session_id string, file string").parquet(f"{folder}/packets")


@query("select distinct '{\"manifest_schema_version\":1,\"n_click\":' || count(*) filter (event_type = 'click') || ',\"user_id\":' || user_id || '}' manifest from events group by user_id")
def manifest_file(spark, sf_dir):
    """One line of JSON a session, keys sorted, written and read."""
    folder = fresh(spark)
    sinks.write_manifest(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n_click")), folder)
    return spark.read.text(folder).select(F.col("value").alias("manifest"))


@query("select l_orderkey, l_linenumber, round(l_quantity, 6) navgf, [round(l_discount, 6), round(l_tax, 6), 0.0, 0.0] adc_min, [l_quantity, l_tax] as gain from lineitem")
def metadata_fields(spark, sf_dir):
    """Metadata from a packet's struct or the base one; vectors padded to their width, or exactly as wide as they must be."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", F.struct(F.array("l_discount", "l_tax").alias("ADC_min"), F.array("l_quantity", "l_tax").alias("gain")).alias("meta"), F.struct(F.col("l_quantity").alias("Navgf")).alias("base"))
    got = sinks.metadata_columns(rows, ["navgf"], {"adc_min": 4}, {"gain": 2})
    return got.select("l_orderkey", "l_linenumber", F.round("navgf", 6).alias("navgf"), F.transform("adc_min", lambda x: F.round(x, 6)).alias("adc_min"), "gain")
