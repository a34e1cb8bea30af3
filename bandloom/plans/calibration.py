"""Queries on spectra and gains: embeddings play spectra (64 bins, label 0 to 9 a product), line items counts and gains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calibrate as C
from ..operators import gain, products, stats, telemetry
from .registry import query, table


def spectra(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("product"), F.col("embedding").cast("array<double>").alias("data"))


_BINS = "b as (select vec_id, label product, unnest(embedding)::double as value, generate_subscripts(embedding, 1) - 1 bin from embeddings)"


@query(f"with {_BINS} select vec_id, bin::int bin, round(value * pow(2, (label_slice - 31)), 12) restored_value from (select b.*, 20 + product label_slice from b)")
def bitslice(spark, sf_dir):
    rows = products.restore_slices(spectra(spark, sf_dir).withColumn("slice", 20 + F.col("product")), "data", "slice")
    return products.bins(rows, "data", ["vec_id"]).select("vec_id", "bin", F.round("value", 12).alias("restored_value"))


@query("with m as (select vec_id, label, [case when x > 0.25 then x end for x in embedding] d from embeddings) select vec_id, row_number() over (partition by label order by vec_id) - 1 orig_idx from m qualify len([x for x in d if x is not null]) > 0")
def retention(spark, sf_dir):
    rows = spectra(spark, sf_dir).withColumn("data", F.transform("data", lambda x: F.when(x > 0.25, x).otherwise(F.lit(float("nan")))))
    return products.retain(products.number_rows(rows, ["product"], ["vec_id"]), "data").select("vec_id", "orig_idx")


@query(f"""with {_BINS}, r as (select bin, vec_id // 10 grp, avg(value) filter (product = 4) re, avg(value) filter (product = 5) im from b where product in (4, 5) group by all)
select grp, bin::int bin, round(re, 6) re, round(-im, 6) im from r where re is not null and im is not null""")
def product_complex(spark, sf_dir):
    rows = products.bins(spectra(spark, sf_dir), "data", ["vec_id", "product"]).withColumn("grp", F.floor(F.col("vec_id") / 10).cast("long"))
    mean = rows.groupBy("grp", "bin", "product").agg(F.avg("value").alias("value"))
    got = products.select_product(mean, ["grp", "bin"], "10C")
    return got.select("grp", "bin", F.round("value.re", 6).alias("re"), F.round("value.im", 6).alias("im")).filter("re is not null and im is not null")


@query(f"with {_BINS} select product, bin::int bin, round(-value, 9) value, vec_id from b where product = 6")
def product_token(spark, sf_dir):
    rows = products.bins(spectra(spark, sf_dir), "data", ["vec_id", "product"])
    return products.select_product(rows, ["vec_id", "bin", "product"], "-02R").select("product", "bin", F.round("value", 9).alias("value"), "vec_id")


@query(f"with {_BINS}, m as (select product, bin, case when product < 4 and not value > 0 then null else value end value from b) select product, bin::int bin, round(avg(value), 6) mean, round(stddev_pop(value), 6) std, count(value) n from m group by all")
def mean_spectrum(spark, sf_dir):
    rows = products.bins(spectra(spark, sf_dir), "data", ["product"])
    got = products.mean_spectrum(rows, ["product"], positive=F.col("product") < 4)
    return got.select("product", "bin", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(f"with {_BINS} select product, (vec_id // 100) step, bin::int bin, round(avg(case when product >= 4 then value when value > 0 then log10(value + 1e-10) end), 6) level from b group by all")
def waterfall(spark, sf_dir):
    rows = products.bins(spectra(spark, sf_dir), "data", ["vec_id", "product"])
    got = products.waterfall(rows, F.col("vec_id"), 100, ["product"], F.col("product") < 4)
    return got.select("product", "step", "bin", F.round("level", 6).alias("level"))


@query(f"with {_BINS} select product, round(min(value), 6) lowest, round(quantile_cont(value, 0.01), 6) p01, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.99), 6) p99, round(quantile_cont(value, 0.999), 6) p999, round(max(value), 6) highest from b where bin between 8 and 23 group by 1")
def band_quantiles(spark, sf_dir):
    rows = products.bins(spectra(spark, sf_dir), "data", ["product"], 8, 16)
    names = {"p01": 0.01, "p50": 0.5, "p99": 0.99, "p999": 0.999}
    got = stats.distribution(rows, ["product"], "value", names)
    return got.select("product", *[F.round(c, 6).alias(c) for c in ("lowest", *names, "highest")])


@query("select label mode, count(*) n from embeddings group by 1 order by n desc, mode limit 1")
def mode_top1(spark, sf_dir):
    return stats.mode(table(spark, sf_dir, "embeddings"), "label")


@query("""select l_orderkey, l_linenumber, round(case when l_discount > 0 and l_quantity >= 0 then sqrt(l_quantity / l_discount) end, 6) asd, round(case when l_discount > 0 and l_quantity >= 0 then l_quantity / l_discount end, 6) psd from lineitem""")
def counts_auto(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x, g = F.col("l_quantity"), F.col("l_discount")
    return li.select("l_orderkey", "l_linenumber", F.round(C.nv_auto(x, g), 6).alias("asd"), F.round(C.nv2_auto(x, g), 6).alias("psd"))


@query("""with c as (select *, l_quantity - 25 x from lineitem) select l_orderkey, l_linenumber, round(case when l_discount > 0 and l_tax > 0 then sign(x) * sqrt(abs(x) / sqrt(l_discount * l_tax)) end, 6) asd,
round(case when l_discount > 0 and l_tax > 0 then x / sqrt(l_discount * l_tax) end, 6) psd from c""")
def counts_cross(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x, a, b = F.col("l_quantity") - 25, F.col("l_discount"), F.col("l_tax")
    return li.select("l_orderkey", "l_linenumber", F.round(C.nv_cross(x, a, b), 6).alias("asd"), F.round(C.nv2_cross(x, a, b), 6).alias("psd"))


@query("""with c as (select l_orderkey, l_linenumber, (l_quantity - 25) * 1000 asd from lineitem) select l_orderkey, l_linenumber, round(sign(asd) * pow(abs(asd) * 1e-9, 2) * 1e12, 9) psd_scaled,
round(sign(asd) * sqrt(pow(abs(asd) * 1e-9, 2)) / 1e-9, 3) back from c""")
def asd_psd(spark, sf_dir):
    asd = (F.col("l_quantity") - 25) * 1000
    psd = C.asd_to_psd(asd)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(psd * 1e12, 9).alias("psd_scaled"), F.round(C.psd_to_asd(psd), 3).alias("back"))


def _telemetry(spark, sf_dir):
    """Parts as telemetry rows, one per channel."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_size") / 10.0).alias("therm"), (F.col("p_retailprice") / 1000.0).alias("adc0"), (F.col("p_retailprice") / 900.0).alias("adc1"), F.lit(1.8).alias("v8"), F.lit(1.2).alias("v12"), F.lit(0.05).alias("i8"), F.element_at(F.array(*map(F.lit, "LMH")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("level"))
    rows = p.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.withColumn("features", C.gain_features(*[F.col(c) for c in ("channel", "therm", "adc0", "adc1", "v8", "v12", "i8")]))


def _coefficients(spark):
    """A generated coefficient table; term t of a slot is (level + 1) * 0.01 + channel * 0.001 + t * 0.1."""
    rows = [(v, c, p, m, t, (i + 1) * 0.01 + c * 0.001 + k * 0.1 + (0.5 if p == "PC2" else 0.0)) for i, v in enumerate(gain.LEVELS) for c in range(4) for p in gain.COMPONENTS for m in gain.FAMILIES for k, t in enumerate(C.FEATURES)]
    return spark.createDataFrame(rows, "level string, channel int, component string, model string, term string, value double")


_FEATURES = """with p as (select p_partkey row_id, p_size / 10.0 therm, p_retailprice / 1000.0 adc0, p_retailprice / 900.0 adc1, p_partkey % 3 lv from part),
f as (select row_id, lv, channel, therm, case when channel <= 1 then adc0 else adc1 end adc from p, range(4) r(channel)) """


@query(_FEATURES + "select row_id, channel::int channel, round(therm, 6) therm, round(adc, 6) adc, round(therm * therm, 6) therm2, round(adc * adc, 6) adc2, round(therm * adc, 6) therm_adc from f")
def gain_features(spark, sf_dir):
    rows = _telemetry(spark, sf_dir)
    at = {n: k for k, n in enumerate(C.FEATURES)}
    return rows.select("row_id", "channel", *[F.round(F.col("features")[at[n]], 6).alias(n) for n in ("therm", "adc", "therm2", "adc2", "therm_adc")])


@query(_FEATURES + """, t as (select *, (lv + 1) * 0.01 + channel * 0.001 b, [1.0, therm, adc, 1.8, 1.2, 0.05, therm * therm, adc * adc, therm * adc] x from f)
select row_id, channel::int channel, round(list_sum(list_transform(x, lambda v, i: v * (b + (i - 1) * 0.1))) + 1e-9, 6) pc1, round(list_sum(list_transform(x, lambda v, i: v * (b + 0.5 + (i - 1) * 0.1))) + 1e-9, 6) pc2 from t""")
def gain_predict(spark, sf_dir):
    got = gain.predict(_telemetry(spark, sf_dir), gain.packed_coefficients(_coefficients(spark)))
    return got.select("row_id", "channel", F.round(F.col("pc1") + 1e-9, 6).alias("pc1"), F.round(F.col("pc2") + 1e-9, 6).alias("pc2"))


#: The channels of each product, as an SQL table.
_PAIRS = "d as (select * from (values (0,0,0,0),(1,1,1,0),(2,2,2,0),(3,3,3,0),(4,0,1,1),(5,0,1,1),(6,0,2,1),(7,0,2,1),(8,0,3,1),(9,0,3,1)) t(product, a, b, cross_))"


@query(f"""with {_BINS}, {_PAIRS}, j as (select b.vec_id, b.bin, b.value, d.cross_, 1.0 + d.a * 0.5 + bin * 0.01 + (vec_id % 7) * 0.1 ga, 1.0 + d.b * 0.5 + bin * 0.01 + (vec_id % 7) * 0.1 gb from b join d using (product))
select vec_id, bin::int bin, round(case when cross_ = 1 then value / sqrt(ga * gb) when value >= 0 then value / ga end, 6) physical from j""")
def to_physical(spark, sf_dir):
    """Spectra and their rows' gains as arrays: one join."""
    rows = spectra(spark, sf_dir)
    of = lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 1.0 + c * 0.5 + i * 0.01 + (F.col("vec_id") % 7) * 0.1)
    gains = rows.select("vec_id", F.create_map(*[x for c in range(4) for x in (F.lit(c), of(c))]).alias("gains"))
    got = gain.convert_spectra(rows, gains, products.product_dimension(spark), ["vec_id"], psd=True)
    return products.bins(got, "physical", ["vec_id"]).select("vec_id", "bin", F.round("value", 6).alias("physical"))


@query(f"""with {_BINS}, {_PAIRS}, j as (select b.vec_id, b.bin, b.value, d.cross_, 1.0 + d.a * 0.5 + bin * 0.01 ga, 1.0 + d.b * 0.5 + bin * 0.01 gb from b join d using (product))
select vec_id, bin::int bin, round(case when cross_ = 1 then sign(value) * sqrt(abs(value) / sqrt(ga * gb)) when value >= 0 then sqrt(value / ga) end, 6) physical from j""")
def to_physical_long(spark, sf_dir):
    """Bins as rows, gains as rows: for products that are kept long."""
    rows = products.bins(spectra(spark, sf_dir), "data", ["vec_id", "product"])
    gains = rows.select("vec_id", "bin").withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("gain", 1.0 + F.col("channel") * 0.5 + F.col("bin") * 0.01)
    got = gain.convert(rows, gains, products.product_dimension(spark), ["vec_id", "bin"])
    return got.select("vec_id", "bin", F.round("physical", 6).alias("physical"))


@query("""select l_orderkey, l_linenumber, case l_linenumber when 0 then 'L' when 1 then 'M' when 2 then 'H' end level from lineitem""")
def gain_levels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gain.level_of(F.col("l_linenumber").cast("double")).alias("level"))


def _basis(spark, grid):
    """A basis that is linear in frequency, so that a cubic spline through its anchors is known in closed form."""
    import numpy as np

    rows = [(v, c, float(a), 30.0 + i + c - 0.01 * float(a), 0.1 + 0.001 * float(a), 0.05 - 0.0005 * float(a)) for i, v in enumerate(gain.LEVELS) for c in range(4) for a in np.linspace(0.1, 70.1, gain.ANCHORS)]
    return gain.spectral_basis(spark, spark.createDataFrame(rows, "level string, channel int, anchor_mhz double, mean double, eig1 double, eig2 double"), grid)


#: Gain of a level, channel and frequency from the features x, as SQL.
_GAIN = "30.0 + lv + channel - 0.01 * f + list_sum(list_transform(x, lambda v, i: v * (b + (i - 1) * 0.1))) * (0.1 + 0.001 * f) + list_sum(list_transform(x, lambda v, i: v * (b + 0.5 + (i - 1) * 0.1))) * (0.05 - 0.0005 * f)"


@query(_FEATURES + f""", t as (select *, (lv + 1) * 0.01 + channel * 0.001 b, [1.0, therm, adc, 1.8, 1.2, 0.05, therm * therm, adc * adc, therm * adc] x from f),
q as (select * from (values (0, 1.0), (1, 5.0), (2, 10.0), (3, 20.0), (4, 30.0), (5, 45.0), (6, 60.0), (7, 70.0)) v(freq_idx, f))
select row_id, channel::int channel, freq_idx::int freq_idx, round({_GAIN}, 5) gain from t, q""")
def gain_spectra(spark, sf_dir):
    """Gain of each part and channel at eight frequencies."""
    predicted = gain.predict(_telemetry(spark, sf_dir), gain.packed_coefficients(_coefficients(spark))).select("row_id", "level", "channel", "pc1", "pc2")
    return gain.gain_spectra(predicted, _basis(spark, [1.0, 5.0, 10.0, 20.0, 30.0, 45.0, 60.0, 70.0])).select("row_id", "channel", "freq_idx", F.round("gain", 5).alias("gain"))


@query(f"""with {_BINS}, {_PAIRS}, n as (select max(p_partkey) n from part), ta as (select vec_id, greatest(1, least((vec_id * 0.37 + 1)::double, n)) t from embeddings, n),
th as (select vec_id, lo.p_size / 10.0 + (hi.p_size / 10.0 - lo.p_size / 10.0) * (t - floor(t)) therm from ta join part lo on lo.p_partkey = floor(t)::bigint join part hi on hi.p_partkey = ceil(t)::bigint),
r as (select vec_id, channel, (vec_id + channel) % 4 lv, therm, case when channel <= 1 then therm * 0.5 else therm * 0.25 end adc from th, range(4) c(channel)),
u as (select *, (lv + 1) * 0.01 + channel * 0.001 b, [1.0, therm, adc, 1.8, 1.2, 0.05, therm * therm, adc * adc, therm * adc] x from r),
g as (select vec_id, channel, bin f0, case when lv < 3 then {_GAIN.replace(" f)", " (bin + 1.0))").replace("* f +", "* (bin + 1.0) +")} end gain from u, (select unnest(range(64)) bin)),
j as (select b.vec_id, b.bin, b.value, d.cross_, ga.gain ga, gb.gain gb from b join d using (product) join g ga on ga.vec_id = b.vec_id and ga.channel = d.a and ga.f0 = b.bin join g gb on gb.vec_id = b.vec_id and gb.channel = d.b and gb.f0 = b.bin)
select vec_id, bin::int bin, round(case when cross_ = 1 then sign(value) * sqrt(abs(value) / sqrt(ga * gb)) when value >= 0 then sqrt(value / ga) end, 5) physical from j""")
def calibrate_chain(spark, sf_dir):
    """On-demand calibration: telemetry interpolated onto the spectra's times, gain codes to levels, features, prediction,
    gain spectra, conversion. A code of 3 has no level and gives null."""
    rows = spectra(spark, sf_dir)
    times = rows.select("vec_id", F.lit(0).alias("session"), (F.col("vec_id") * 0.37 + 1).alias("t"))
    series = table(spark, sf_dir, "part").select(F.lit(0).alias("session"), F.col("p_partkey").cast("double").alias("t"), (F.col("p_size") / 10.0).alias("value"))
    therm = telemetry.interpolate(times, series, ["session"], "t", "t", "value", out="therm", bucket=lambda t: F.floor(t / 1000))
    codes = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: ((F.col("vec_id") + c) % 4).cast("double"))
    sensors = therm.select("vec_id", codes.alias("codes"), "therm", (F.col("therm") * 0.5).alias("adc0"), (F.col("therm") * 0.25).alias("adc1"), F.lit(1.8).alias("v8"), F.lit(1.2).alias("v12"), F.lit(0.05).alias("i8"))
    got = gain.calibrate(rows, sensors, _coefficients(spark), _basis(spark, [float(i + 1) for i in range(64)]), products.product_dimension(spark), ["vec_id"])
    return products.bins(got, "physical", ["vec_id"]).select("vec_id", "bin", F.round("value", 5).alias("physical"))


@query("select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then 'L' when 1 then 'M' when 2 then 'H' when 3 then 'H' end level from lineitem")
def level_spec(spark, sf_dir):
    """Levels given as one letter a channel."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 4).alias("channel"))
    return li.join(F.broadcast(gain.level_spec(spark, "LMHH")), "channel").select("l_orderkey", "l_linenumber", "level")
