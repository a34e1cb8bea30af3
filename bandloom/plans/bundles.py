"""Queries that write the tables as sources of several kinds and load them as one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bundles, sinks
from .files import fresh
from .registry import query, table


def _written(spark, sf_dir):
    """Two folders: even and odd vectors. Only the first has dates and interpolated channels; the events of a source are its
    telemetry; cut spectra are 4 x 16 in the one and 2 x 24 in the other."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 6).cast("string").alias("session_id"), F.col("vec_id").alias("orig_idx"), F.col("label").alias("product"), F.col("embedding").cast("array<double>").alias("data"), F.lit(31).alias("bit_slice"))
    v = table(spark, sf_dir, "events").select((F.col("user_id") % 6).cast("string").alias("session_id"), F.col("event_id").alias("t"), F.col("event_type").alias("channel"), "value")
    folders = []
    for half in (0, 1):
        folder = fresh(spark)
        own = lambda df, half=half: df.filter(F.col("session_id").cast("int") % 2 == half)
        rows = own(e).withColumn("gain", F.col("product") * 2.0) if half else own(e).withColumn("mjd", F.col("orig_idx") / 86400.0)
        sinks.save_kind(rows, folder, "spectra", slices=2, units="SDU", representation="gain_model_input_sdu")
        n, width = ((4, 16), (2, 24))[half]
        cut = F.array(*[F.slice("data", i * width + 1, width) for i in range(n)])
        sinks.save_kind(own(e).select("session_id", "orig_idx", cut.alias("data")), folder, "tr_spectra", units="SDU")
        sinks.save_kind(own(v), folder, "telemetry", slices=2)
        if not half:
            sinks.save_kind(own(v).withColumnRenamed("t", "orig_idx"), folder, "interpolated")
        scale = own(v).groupBy("session_id").agg(F.lit("time_scale").alias("key"), F.lit("utc").alias("value"))
        clock = own(v).groupBy("session_id").agg(F.lit("clock").alias("key"), F.max("channel").alias("value"))
        sinks.save_kind(scale.unionByName(clock), folder, "constants")
        folders.append(folder)
    return folders


@query("""select 'interpolated' kind, 0 n, null total where false union all select 'spectra', count(*), round(sum(embedding[1]::double) + sum(case when vec_id % 2 = 1 then label * 2.0 end), 6) from embeddings
union all select 'telemetry', count(*), round(sum(value), 6) from events union all select 'tr_spectra', count(*), round(sum(list_sum(case when vec_id % 2 = 0 then embedding[1:64] else embedding[1:48] end::double[])), 6) from embeddings""")
def loaded_sources(spark, sf_dir):
    """Rows and sums by kind of two sources that were loaded as one."""
    got = bundles.load(spark, _written(spark, sf_dir))
    flat = F.filter(F.flatten("data"), lambda x: ~F.isnan(x))
    sums = {"spectra": F.sum(F.col("data")[0]) + F.sum("gain"), "telemetry": F.sum("value"), "tr_spectra": F.sum(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x))}
    parts = [df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.round(sums.get(k, F.lit(None).cast("double")), 6).alias("total")) for k, df in got.tables.items() if k != "constants"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("select vec_id orig_idx, (i - 1)::int bin, round(embedding[i]::double, 9) as value from embeddings, range(1, 65) r(i) where label = 4")
def loaded_product(spark, sf_dir):
    """One product of the loaded sources, by its name."""
    got = bundles.load(spark, _written(spark, sf_dir)).product("01R")
    return got.select("orig_idx", "bin", F.round("value", 9).alias("value"))


@query("select vec_id orig_idx, (case when vec_id % 2 = 0 then 16 else 24 end)::bigint * case when vec_id % 2 = 0 then 4 else 2 end filled, 24 * 4 cells from embeddings")
def loaded_ragged(spark, sf_dir):
    """Cells with a value, and all, of arrays that had a shape of their own in each source."""
    tr = bundles.load(spark, _written(spark, sf_dir)).tables["tr_spectra"]
    flat = F.flatten("data")
    return tr.select("orig_idx", F.size(F.filter(flat, lambda x: ~F.isnan(x))).cast("long").alias("filled"), F.size(flat).alias("cells"))
