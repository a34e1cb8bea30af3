"""Queries that compare and merge: orders against their line items, nations split into sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources import bundles, tables
from .registry import query, table

_CMP = """with n as (select o_orderkey k, o_totalprice v from orders), r as (select l_orderkey k, sum(l_extendedprice * (1 - l_discount)) v from lineitem group by 1),
c as (select k, abs(n.v - r.v) max_abs, case when greatest(abs(n.v), abs(r.v)) > 0 then abs(n.v - r.v) / greatest(abs(n.v), abs(r.v)) else 0 end max_rel, n.v nv, r.v rv from n full join r using (k)),
s as (select k, max_abs, max_rel, case when nv is null then 'missing_new' when rv is null then 'missing_ref' when max_abs <= 0.001 or max_rel <= 0.05 then 'PASS' when max_abs <= 0.01 or max_rel <= 0.5 then 'WARN' else 'FAIL' end status from c) """


def _compared(spark, sf_dir):
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("row_idx"), F.col("o_totalprice").alias("v"))
    li = table(spark, sf_dir, "lineitem")
    ref = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")).withColumn("row_idx", F.lit(0))
    return stats.compare(new, ref, ["k"], "row_idx", "v", atol=1e-3, rtol=0.05)


@query(_CMP + "select k, round(max_rel, 6) max_rel, status from s")
def compare_versions(spark, sf_dir):
    return _compared(spark, sf_dir).select("k", F.round("max_rel", 6).alias("max_rel"), "status")


@query(_CMP + """select o_orderpriority, c_mktsegment, count(*) n, count(*) filter (status = 'PASS') n_pass, count(*) filter (status = 'WARN') n_warn, count(*) filter (status = 'FAIL') n_fail
from s join orders on k = o_orderkey join customer on o_custkey = c_custkey group by grouping sets ((o_orderpriority), (c_mktsegment), ())""")
def compare_rollup(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = _compared(spark, sf_dir).join(o.select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderpriority"), "k").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return stats.rollup_status(rows, "o_orderpriority", "c_mktsegment")


@query(_CMP + "select k, round(max_rel, 6) max_rel from s where status = 'FAIL' order by k limit 25")
def first_failures(spark, sf_dir):
    return stats.first_failures(_compared(spark, sf_dir), ["k"])[0].select("k", F.round("max_rel", 6).alias("max_rel"))


@query("""select event_type source, event_id, user_id, case when event_type = 'click' then value end gain, case when event_type = 'view' then value end slice from events""")
def concat_sessions(spark, sf_dir):
    """Five sources: columns that one of them has are null in the others, and a column that one lacks is left out."""
    e = table(spark, sf_dir, "events").withColumn("mjd", F.col("event_id") / 86400.0)
    of = lambda kind, *columns: e.filter(F.col("event_type") == kind).select("event_id", "user_id", *columns)
    gains = tables.with_terms(of("click", "mjd", F.col("value").alias("gain")), "gain", units="dB")
    sources = {"click": gains, "view": of("view", "mjd", F.col("value").alias("slice")), "purchase": of("purchase"), "signup": of("signup", "mjd"), "error": of("error", "mjd")}
    return bundles.combine(sources, everywhere=["mjd"])


@query("""with c as (select user_id g, event_id start, case when event_id % 49 = 4 then 'unknown' when user_id % 3 = 1 and event_id % 2 = 0 then 'tai' else 'utc' end scale, 'clock' || (event_id % 2) clock from events)
select g, case when count(distinct scale) filter (scale != 'unknown') > 1 then 'conflict' when count(*) filter (scale = 'unknown') > 0 then 'unknown' else coalesce(max(scale) filter (scale != 'unknown'), 'unknown') end time_scale, arg_min(clock, start) clock_source, count(distinct clock) n_clock_sources from c group by g""")
def scale_merge(spark, sf_dir):
    n = table(spark, sf_dir, "events")
    scale = F.when(F.col("event_id") % 49 == 4, "unknown").when((F.col("user_id") % 3 == 1) & (F.col("event_id") % 2 == 0), "tai").otherwise("utc")
    c = n.select(F.col("user_id").alias("g"), F.col("event_id").alias("start"), scale.alias("time_scale"), F.concat(F.lit("clock"), F.col("event_id") % 2).alias("clock_source"))
    return stats.merged_scale(c, ["g"])


@query("select distinct json_keys.k as key from (select unnest(json_keys(props)) k from events) json_keys")
def key_union(spark, sf_dir):
    return stats.key_union(table(spark, sf_dir, "events"), F.json_object_keys("props"))


@query("with k as (select event_id, unnest(json_keys(props)) as key from events) select key from k group by key having count(distinct event_id) = (select count(distinct event_id) from events)")
def key_in_all(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    keys = e.select("event_id", F.explode(F.json_object_keys("props")).alias("key"))
    return stats.keys_in_all(keys, e, "key", "event_id")


@query("select distinct user_id, 'both' side from events where event_type = 'purchase' and user_id in (select user_id from events where event_type = 'error') union all (select user_id, 'purchase' from events where event_type = 'purchase' except select user_id, 'purchase' from events where event_type = 'error')")
def common_only(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = (e.filter(F.col("event_type") == k).select("user_id") for k in ("purchase", "error"))
    return stats.sides(a, b, "purchase")


@query("select w.event_type from (values ('click'), ('view'), ('heartbeat'), ('hello')) w(event_type) where w.event_type not in (select event_type from events)")
def missing_required(spark, sf_dir):
    return stats.missing_required(spark, ["click", "view", "heartbeat", "hello"], table(spark, sf_dir, "events"), "event_type")


@query("""with k as (select user_id source, event_type kind, count(*) n from events group by all) select source, case min(case kind when 'signup' then 0 when 'purchase' then 1 when 'view' then 2 when 'click' then 3 end) when 0 then 'signup' when 1 then 'purchase' when 2 then 'view' when 3 then 'click' end axis from k where kind != 'error' group by 1""")
def time_axis(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return stats.time_axis(kinds, ["purchase", "view", "click"], preferred="signup")


@query("""with f as (select user_id root, 's' || (event_id % 5) || case when event_type = 'click' then '.fits' when event_type = 'view' then '.h5' else '.txt' end path from events)
select root, path from (select *, row_number() over (partition by root, split_part(path, '.', 1) order by case when path like '%.h5' then 1 else 2 end, path) rn from (select distinct root, path from f where path not like '%.txt')) where rn = 1""")
def path_priority(spark, sf_dir):
    suffix = F.when(F.col("event_type") == "click", ".fits").when(F.col("event_type") == "view", ".h5").otherwise(".txt")
    files = table(spark, sf_dir, "events").select(F.col("user_id").alias("root"), F.concat(F.lit("s"), F.col("event_id") % 5, suffix).alias("path")).distinct()
    return stats.preferred_paths(files, ["h5", "fits"]).select("root", "path")


@query("""with c as (select c_custkey, c_custkey % 180 - 90.0 alt_a, c_custkey * 7 % 360 * 1.0 az_a, c_nationkey * 3.0 alt_b, c_custkey * 11 % 360 * 1.0 az_b from customer)
select c_custkey, round(degrees(acos(greatest(-1, least(1, sin(radians(alt_a)) * sin(radians(alt_b)) + cos(radians(alt_a)) * cos(radians(alt_b)) * cos(radians(az_a - az_b)))))), 4) separation from c""")
def angular_separation(spark, sf_dir):
    k = F.col("c_custkey")
    sep = stats.angular_separation(k % 180 - 90.0, (k * 7 % 360).cast("double"), F.col("c_nationkey") * 3.0, (k * 11 % 360).cast("double"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(sep, 4).alias("separation"))


@query("select count(*) n, sum(('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey), 1, 12))::bigint)::varchar checksum from lineitem")
def content_fingerprint(spark, sf_dir):
    return stats.content_fingerprint(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"])


@query("""select l_orderkey % 10 grp, l_linenumber, round(avg(l_quantity), 6) mean_by_line from lineitem group by all""")
def mean_over_axis(spark, sf_dir):
    got = stats.mean_over(table(spark, sf_dir, "lineitem"), [(F.col("l_orderkey") % 10).alias("grp"), "l_linenumber"], "l_quantity")
    return got.select("grp", "l_linenumber", F.round("mean", 6).alias("mean_by_line"))
