"""Queries on frequency grids and sky spectra: part sizes play frequencies in MHz."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sky
from ..operators import freq
from .registry import query, table


def _targets(spark, sf_dir):
    """Distinct part sizes, every third one moved off the grid by a quarter, every fifth by half the tolerance."""
    f = F.col("p_size") + F.when(F.col("p_size") % 3 == 0, 0.25).when(F.col("p_size") % 5 == 0, 5e-7).otherwise(0.0)
    return table(spark, sf_dir, "part").select("p_size").distinct().select(F.col("p_size").alias("idx"), f.alias("freq"))


def _part_targets(spark, sf_dir):
    """The same, for every part."""
    f = F.col("p_size") + F.when(F.col("p_size") % 3 == 0, 0.25).when(F.col("p_size") % 5 == 0, 5e-7).otherwise(0.0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), f.alias("freq"))


_TARGETS = "t as (select p_size target_idx, p_size + case when p_size % 3 = 0 then 0.25 when p_size % 5 = 0 then 5e-7 else 0 end f from (select distinct p_size from part)), s as (select i idx, 2.0 + i * 0.5 freq from range(90) r(i))"


_PARTS = _TARGETS.replace("p_size target_idx", "p_partkey target_idx").replace("(select distinct p_size from part)", "part")


@query(f"""with {_PARTS}, n as (select target_idx, f, (select max(idx) from s where freq <= f) lo, (select min(idx) from s where freq >= f) hi from t),
m as (select *, 2.0 + lo * 0.5 lf, 2.0 + hi * 0.5 hf from n), k as (select *, case when f - lf <= 1e-6 + 1e-9 * lf and (hf is null or not hf - f <= 1e-6 + 1e-9 * hf or f - lf <= hf - f) then lo when hf - f <= 1e-6 + 1e-9 * hf then hi end snap from m)
select target_idx, coalesce(snap, lo)::int lo_idx, coalesce(snap, hi)::int hi_idx, round(case when snap is not null then 0 else (f - lf) / (hf - lf) end, 6)::double alpha from k where snap is not null or (lo is not null and hi is not null)""")
def freq_align(spark, sf_dir):
    got = freq.plan(_part_targets(spark, sf_dir), freq.grid(spark, 2.0, 0.5, 90), policy="linear").filter("problem is null")
    return got.select("target_idx", "lo_idx", "hi_idx", F.round("alpha", 6).alias("alpha"))


@query(f"""with {_PARTS}, n as (select target_idx, f, (select max(idx) from s where freq <= f + 1e-6) lo, (select min(idx) from s where freq >= f - 1e-6) hi from t)
select target_idx, case when lo is null or hi is null then 'range' else 'grid' end problem from n where lo is distinct from hi""")
def freq_problems(spark, sf_dir):
    got = freq.plan(_part_targets(spark, sf_dir), freq.grid(spark, 2.0, 0.5, 90), policy="exact")
    return got.filter("problem is not null").select("target_idx", "problem")


@query(f"""with {_TARGETS}, v as (select vec_id, unnest(embedding)::double as value, generate_subscripts(embedding, 1) - 1 idx from embeddings),
p as (select target_idx, f, floor((f - 2.0) / 0.5)::int lo, (f - 2.0) / 0.5 - floor((f - 2.0) / 0.5) alpha from t where f between 2.0 and 33.5),
q as (select target_idx, lo, case when alpha < 1e-5 then 0 else alpha end alpha from p)
select a.vec_id, target_idx, round(case when alpha = 0 then a.value else (1 - alpha) * a.value + alpha * b.value end, 6) as value from q join v a on a.idx = q.lo join v b on b.vec_id = a.vec_id and b.idx = case when alpha = 0 then q.lo else q.lo + 1 end""")
def freq_apply(spark, sf_dir):
    values = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("idx", "value"))
    aligned = freq.plan(_targets(spark, sf_dir), freq.grid(spark, 2.0, 0.5, 64), policy="linear").filter("problem is null")
    got = freq.apply_plan(aligned, values, ["vec_id"])
    return got.select("vec_id", "target_idx", F.round("value", 6).alias("value"))


@query("""with x as (select p_partkey, p_retailprice / 40.0 f from part), i as (select *, least(greatest(ceil(f / 0.025 - 0.5), 0), 2047) i from x) select p_partkey, i::int bin from i where abs(f - i * 0.025) <= 0.01""")
def nearest_bin(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 40.0).alias("f"))
    return freq.nearest_bin(rows, "f", 0.025, 2048, 0.01).filter("bin is not null").select("p_partkey", "bin")


_C2 = "(299792458.0::double * 299792458.0::double / (2 * 1.380649e-23))"


@query(f"""with f as (select p_partkey, p_size::double f from part), b as (select *, 1.36e-19 * pow(f, -0.76) * exp(-3.28 * pow(f, -0.64)) nb,
2.48e-20 * pow(f, -0.52) * (1 - exp(-5 * pow(f, -2.1))) / (5 * pow(f, -2.1)) + 1.06e-20 * pow(f, -0.8) * exp(-5 * pow(f, -2.1)) c from f)
select p_partkey, round(nb * 1e20, 6) b_nb, round(c * 1e20, 6) b_c, round(nb * {_C2} / pow(f * 1e6, 2) / 1e3, 4) t_nb, round(c * {_C2} / pow(f * 1e6, 2) / 1e3, 4) t_c, round(16.3e6 * case when f < 2 then pow(f / 2, -0.3) else pow(f / 2, -2.53) end / 1e3, 4) t_j from b""")
def sky_laws(spark, sf_dir):
    f = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(sky.brightness_novaco_brown(f) * 1e20, 6).alias("b_nb"), F.round(sky.brightness_cane(f) * 1e20, 6).alias("b_c"),
        F.round(sky.temperature_novaco_brown(f) / 1e3, 4).alias("t_nb"), F.round(sky.temperature_cane(f) / 1e3, 4).alias("t_c"), F.round(sky.temperature_broken_law(f) / 1e3, 4).alias("t_j"),
    )


@query("""with c as (select x, y, lead(x) over (order by x) x1, lead(y) over (order by x) y1 from (select 5.0 + i * 4 x, i * i + 1.0 y from range(10) r(i))), f as (select p_partkey, p_size + 0.5 f from part)
select p_partkey, round(coalesce(y + (y1 - y) * (f - x) / (x1 - x), 0), 6) response from f left join c on f >= x and f < x1""")
def curve_lookup(spark, sf_dir):
    curve = spark.range(10).select((5.0 + F.col("id") * 4).alias("x"), (F.col("id") * F.col("id") + 1.0).alias("y"))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 0.5).alias("f"), F.lit(0).alias("k"))
    got = freq.lookup(rows, curve.withColumn("k", F.lit(0)), "f", ["k"], "response")
    return got.select("p_partkey", F.round("response", 6).alias("response"))


@query("""with g as (select p_mfgr_like g, min(p_size) lo, max(p_size) hi from (select p_partkey % 4 p_mfgr_like, p_size + p_partkey % 4 p_size from part) group by 1), e as (select max(lo) lo, min(hi) hi from g)
select distinct p_size freq, p_size between e.lo and e.hi inside from part, e""")
def common_range(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    grids = p.select((F.col("p_partkey") % 4).alias("grid_id"), (F.col("p_size") + F.col("p_partkey") % 4).alias("freq"))
    return freq.common_range(p.select(F.col("p_size").alias("freq")).distinct(), grids)


@query("""with v as (select vec_id, label, unnest(embedding)::double as value, generate_subscripts(embedding, 1)::int - 1 i from embeddings), k as (select k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) over () w from range(-4, 5) r(k)),
o as (select vec_id, i j, k, w, case when i + k < 0 then -1 - (i + k) when i + k > 63 then 127 - (i + k) else i + k end src from v, k)
select o.vec_id, o.j idx, round(sum(v.value * w), 6) + 0.0 as value from o join v on v.vec_id = o.vec_id and v.i = o.src group by all""")
def smoothed(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("idx", "value"))
    got = freq.smooth(rows, ["vec_id"], "idx", "value", 1.0, 64)
    return got.select("vec_id", "idx", (F.round("value", 6) + 0.0).alias("value"))


@query(f"""with {_TARGETS}, p as (select target_idx, floor((f - 2.0) / 0.5)::int lo, (f - 2.0) / 0.5 - floor((f - 2.0) / 0.5) alpha from t where f between 2.0 and 33.5),
q as (select lo idx from p union select lo + 1 from p where alpha >= 1e-5) select idx::int idx, count(*) n from q join (select generate_subscripts(embedding, 1) - 1 idx from embeddings) using (idx) group by 1""")
def used_bins(spark, sf_dir):
    """The bins that a plan reads, with how many values they hold."""
    aligned = freq.plan(_targets(spark, sf_dir), freq.grid(spark, 2.0, 0.5, 64), policy="linear").filter("problem is null")
    values = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("idx", "value"))
    return values.join(F.broadcast(freq.used_sources(aligned)), "idx").groupBy("idx").agg(F.count("*").alias("n"))


@query("""with l as (select l_orderkey, l_linenumber, l_extendedprice::double % 200 - 100 x, [0, 4, 16, 64][(l_linenumber % 4 + 1)::int] notch, (l_suppkey % 96 - 32)::int zoom from lineitem)
select l_orderkey, l_linenumber, round(greatest(0, 1 - abs(x) / (80 - notch)) / (80 - notch) + 3.3e-13, 9) at_notch, round(greatest(0, 1 - abs(x) / (20 + (zoom + 64) % 64)) / (20 + (zoom + 64) % 64) + 3.3e-13, 9) at_zoom from l""")
def response_at_offset(spark, sf_dir):
    """Responses of a spectrometer at offsets, by notch and by zoom bin: triangles whose area is 1."""
    li = table(spark, sf_dir, "lineitem")
    notch = F.element_at(F.array(*map(F.lit, (0, 4, 16, 64))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") % 200 - 100).alias("x"), notch.alias("notch"), (F.col("l_suppkey") % 96 - 32).cast("int").alias("zoom"))
    triangles = lambda widths: spark.createDataFrame([(k, x, y) for k, w in widths for x, y in ((-float(w), 0.0), (0.0, 1.0 / w), (float(w), 0.0))], "key int, x double, y double")
    got = freq.keyed_response(rows, triangles([(k, 80 - k) for k in (0, 4, 16, 64)]), "x", "notch", out="at_notch")
    got = freq.keyed_response(got, triangles([(k, 20 + k) for k in range(64)]), "x", "zoom", wrap=True, out="at_zoom")
    return got.select("l_orderkey", "l_linenumber", F.round(F.col("at_notch") + 3.3e-13, 9).alias("at_notch"), F.round(F.col("at_zoom") + 3.3e-13, 9).alias("at_zoom"))
