"""Queries over the event stream: sessions, identities, telemetry, windows, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order, products, sessions, telemetry
from .registry import query, table

ORDER = ["ts", "event_id"]


def hello() -> Column:
    """A signup plays the hello that starts a session."""
    return F.col("event_type") == "signup"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream; ``ts`` carries no zone."""
    return table(spark, sf_dir, "events")


def seconds(df: DataFrame) -> DataFrame:
    """Add t: seconds since 1970 as double."""
    return df.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.split_sessions(events(spark, sf_dir), ["user_id"], ORDER, hello())


_SPLIT = """
with h as (select *, event_type = 'signup' hello, lag(event_type = 'signup') over (partition by user_id order by ts, event_id) was from events),
s as (select *, sum(case when was is null or (hello and not was) then 1 else 0 end) over (partition by user_id order by ts, event_id) - 1 session_no from h)
"""
_T = "epoch_us(ts) / 1e6"


@query(_SPLIT + """select user_id, session_no::bigint session_no, count(*) n_rows, count(*) filter (event_type = 'view') n_view, count(*) filter (event_type = 'click') n_click,
round(avg(value), 6) mean_value, min(event_id) first_event from s group by all""")
def session_split(spark, sf_dir):
    rows = split(spark, sf_dir)
    return rows.groupBy("user_id", "session_no").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("event_type") == "view").alias("n_view"), F.count_if(F.col("event_type") == "click").alias("n_click"),
        F.round(F.avg("value"), 6).alias("mean_value"), F.min("event_id").alias("first_event"),
    )


@query(_SPLIT + "select user_id, event_id, session_no::bigint session_no from s")
def session_split_bucketed(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return order.split_sessions(rows, ["user_id"], ORDER, hello(), bucket="day").select("user_id", "event_id", "session_no")


@query("""with c as (select *, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id) uid
from events where event_type != 'error') select user_id, event_id, event_type, uid from c where (event_type = 'purchase' or event_type = 'view') and uid is not null""")
def uid_carry(spark, sf_dir):
    kept = events(spark, sf_dir).filter("event_type != 'error'").withColumn("day", F.to_date("ts"))
    own = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    out = order.carry_last(kept, ["user_id"], ORDER, {"uid": own}, bucket="day")
    return out.filter("event_type in ('purchase', 'view') and uid is not null").select("user_id", "event_id", "event_type", "uid")


@query(f"""with st as (select user_id, {_T} t, event_id sid from events where event_type = 'signup'),
f as (select user_id, arg_min(sid, t) first_sid from st group by 1)
select e.user_id, e.event_id, coalesce(st.sid, f.first_sid) session_id from (select *, {_T} t from events where event_type = 'click') e
asof left join st on e.user_id = st.user_id and e.t >= st.t left join f on e.user_id = f.user_id""")
def telemetry_asof(spark, sf_dir):
    e = seconds(events(spark, sf_dir))
    starts = e.filter(hello()).select("user_id", F.col("t").alias("start"), F.col("event_id").alias("session_id"))
    clicks = e.filter("event_type = 'click'").select("user_id", "event_id", "t")
    return sessions.assign_telemetry(clicks, starts, ["user_id"], "t", "start", "session_id").select("user_id", "event_id", "session_id")


_LERP = """
select user_id, event_id, round(case when v0 is null then v1 when v1 is null then v0 when t1 = t0 then v0 else v0 + (v1 - v0) * (x - t0) / (t1 - t0) end, 6) interpolated
from (select a.user_id, a.event_id, a.x, p.x t0, p.v v0, n.x t1, n.v v1 from c a
asof left join s p on a.user_id = p.user_id and a.x >= p.x asof left join s n on a.user_id = n.user_id and a.x <= n.x)
"""


@query(f"with c as (select user_id, event_id, {_T} x from events where event_type = 'click'), s as (select user_id, {_T} x, avg(value) v from events where event_type = 'view' group by all)" + _LERP)
def telemetry_lerp(spark, sf_dir):
    e = seconds(events(spark, sf_dir))
    out = telemetry.interpolate(e.filter("event_type = 'click'").select("user_id", "event_id", "t"), e.filter("event_type = 'view'").select("user_id", "t", "value"), ["user_id"], "t", "t", "value")
    return out.select("user_id", "event_id", F.round("interpolated", 6).alias("interpolated"))


@query(f"""with c0 as (select user_id, event_id, {_T} t from events where event_type = 'click'), s0 as (select user_id, {_T} t, avg(value) v from events where event_type = 'view' group by all),
c as (select user_id, event_id, case when max(t) over w > min(t) over w then (t - min(t) over w) / (max(t) over w - min(t) over w) else 0 end x from c0 window w as (partition by user_id)),
s as (select user_id, v, case when max(t) over w > min(t) over w then (t - min(t) over w) / (max(t) over w - min(t) over w) else 0 end x from s0 window w as (partition by user_id))""" + _LERP)
def telemetry_lerp_normalized(spark, sf_dir):
    e = seconds(events(spark, sf_dir))
    out = telemetry.interpolate(e.filter("event_type = 'click'").select("user_id", "event_id", "t"), e.filter("event_type = 'view'").select("user_id", "t", "value"), ["user_id"], "t", "t", "value", mode="normalized")
    return out.select("user_id", "event_id", F.round("interpolated", 6).alias("interpolated"))


_WINDOWS = _SPLIT + f""", st as (select user_id, session_no, min({_T}) start from s group by all),
w as (select user_id, session_no, case when row_number() over o > 1 then start end lo, lead(start) over o hi from st window o as (partition by user_id order by start, session_no))"""


def _windows(spark, sf_dir):
    starts = seconds(split(spark, sf_dir)).groupBy("user_id", "session_no").agg(F.min("t").alias("start"))
    return sessions.session_windows(starts, ["user_id"], "start", "session_no")


@query(_WINDOWS + "select user_id, session_no::bigint session_no, lo, hi from w")
def session_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("user_id", "session_no", "lo", "hi")


@query(_WINDOWS + f"""select w.user_id, w.session_no::bigint session_no, count(*) n_views, round(sum(value), 4) total from (select *, {_T} t from events where event_type = 'view') e
join w on e.user_id = w.user_id and (lo is null or t >= lo) and (hi is null or t < hi) group by all""")
def telemetry_rederived(spark, sf_dir):
    views = seconds(events(spark, sf_dir)).filter("event_type = 'view'").select("user_id", "t", "value")
    found = sessions.rederive(views, _windows(spark, sf_dir).select("user_id", "session_no", "lo", "hi"), ["user_id"], "t")
    return found.groupBy("user_id", "session_no").agg(F.count("*").alias("n_views"), F.round(F.sum("value"), 4).alias("total"))


@query(_SPLIT + "select user_id, session_no::bigint session_no, arg_min(event_id, event_id) hello_event, arg_min(props, event_id) hello_props from s where event_type = 'signup' group by all")
def first_per_session(spark, sf_dir):
    got = sessions.first_hello(split(spark, sf_dir), ["user_id", "session_no"], ORDER, hello(), ["event_id", "props"])
    return got.withColumnsRenamed({"event_id": "hello_event", "props": "hello_props"})


@query(_SPLIT + """select user_id, session_no::bigint session_no, count(*) filter (event_type = 'view') n_view, count(*) filter (event_type = 'click') n_click, count(*) filter (event_type = 'error') n_error,
n_view > 0 has_view, n_click > 0 has_click, n_error > 0 has_error from s group by all""")
def session_summary(spark, sf_dir):
    return sessions.summarise(split(spark, sf_dir), ["user_id", "session_no"], "event_type", ["view", "click", "error"])


@query(_SPLIT + f"select event_id, round({_T} - first_value({_T}) over (partition by user_id, session_no order by ts, event_id), 6) elapsed, row_number() over (partition by user_id, session_no order by ts, event_id) - 1 orig_idx from s")
def elapsed(spark, sf_dir):
    rows = products.number_rows(seconds(split(spark, sf_dir)), ["user_id", "session_no"], ORDER)
    return sessions.elapsed(rows, ["user_id", "session_no"], "t").select("event_id", F.round("elapsed", 6).alias("elapsed"), "orig_idx")


@query(f"""with d as (select user_id, {_T} - lag({_T}) over (partition by user_id order by ts, event_id) d from events)
select user_id, round(case when median(d) > 0 then median(d) else 1.0 end, 6) cadence from d group by 1""")
def cadence_median(spark, sf_dir):
    e = seconds(events(spark, sf_dir)).withColumn("part", F.floor(F.col("t") / 86400))
    return sessions.cadence(e, ["user_id"], ORDER, "t", bucket="part").select("user_id", F.round("cadence", 6).alias("cadence"))


@query("""with n as (select event_type source, count(*) n from events group by 1) select source, n, coalesce(sum(n) over (order by source rows between unbounded preceding and 1 preceding), 0)::bigint start,
sum(n) over (order by source)::bigint "end" from n""")
def source_bounds(spark, sf_dir):
    return sessions.source_bounds(events(spark, sf_dir).groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n")), ["source"], "n")


_ISLANDS = """with f as (select user_id, event_id, value > 50 inside, max(event_id) over (partition by user_id) last from events),
g as (select *, sum(case when inside and not coalesce(was, false) then 1 else 0 end) over (partition by user_id order by event_id) - 1 run_no
from (select *, lag(inside) over (partition by user_id order by event_id) was from f)) """


@query(_ISLANDS + 'select user_id, run_no::bigint run_no, min(event_id) start, max(event_id) "end" from g where inside group by user_id, run_no, last having max(event_id) < last')
def islands(spark, sf_dir):
    return order.passes(events(spark, sf_dir), ["user_id"], "event_id", F.col("value") > 50)


@query("""select user_id, event_id, value from (select *, lag(value) over w p, lead(value) over w n from events window w as (partition by user_id order by event_id)) where value > p and value > n""")
def local_maxima(spark, sf_dir):
    return order.local_maxima(events(spark, sf_dir), ["user_id"], "event_id", "value").select("user_id", "event_id", "value")


@query("""with p as (select user_id, event_id t, value v, lag(value) over w vp, lead(value) over w vn, lag(event_id) over w tp, lead(event_id) over w tn from events window w as (partition by user_id order by event_id))
select user_id, t, round(case when vp - 2 * v + vn = 0 then t else t + (tn - tp) / 4.0 * (vp - vn) / (vp - 2 * v + vn) end, 4) peak, lead(t) over (partition by user_id order by t) next_t from p where v > vp and v > vn qualify next_t is not null""")
def cycles(spark, sf_dir):
    w = order.over(["user_id"], ["event_id"])
    e = events(spark, sf_dir).select("user_id", F.col("event_id").alias("t"), F.col("value").alias("v"), F.lag("value").over(w).alias("vp"), F.lead("value").over(w).alias("vn"), F.lag("event_id").over(w).alias("tp"), F.lead("event_id").over(w).alias("tn"))
    peaks = e.filter("v > vp and v > vn")
    peak = order.refined_peak(*[F.col(c) for c in ("tp", "t", "tn", "vp", "v", "vn")])
    return peaks.select("user_id", "t", F.round(peak, 4).alias("peak"), F.lead("t").over(order.over(["user_id"], ["t"])).alias("next_t")).filter("next_t is not null")


@query(f"""with c as (select user_id, event_id, {_T} t from events where event_type = 'click'), s as (select user_id, {_T} t from events where event_type = 'purchase')
select user_id, event_id, match, round(match - t, 6) delta from (select a.*, case when p.t is null then n.t when n.t is null then p.t when a.t - p.t <= n.t - a.t then p.t else n.t end match
from c a asof left join s p on a.user_id = p.user_id and a.t >= p.t asof left join s n on a.user_id = n.user_id and a.t <= n.t)""")
def nearest_event(spark, sf_dir):
    e = seconds(events(spark, sf_dir))
    got = order.nearest(e.filter("event_type = 'click'").select("user_id", "event_id", "t"), e.filter("event_type = 'purchase'").select("user_id", F.col("t").alias("pt")), ["user_id"], "t", "pt")
    return got.select("user_id", "event_id", "match", F.round("delta", 6).alias("delta"))


@query(f"""with z as (select user_id, event_id, max((event_id * 37) % 1000) over (partition by user_id order by event_id) m from events where event_type = 'click'),
s as (select user_id, (event_id * 37) % 1000 uid, max({_T}) t from events where event_type = 'view' group by all)
select z.user_id, event_id, round(coalesce(s.t, 0), 6) zoom_t from z asof left join s on z.user_id = s.user_id and z.m >= s.uid""")
def zoom_times(spark, sf_dir):
    """Zoom rows take the time of the latest spectrum by uid; uids may jump back, so the greatest seen so far counts."""
    e = seconds(events(spark, sf_dir)).withColumn("uid", F.col("event_id") * 37 % 1000).withColumn("part", F.floor(F.col("event_id") / 1000))
    rows, views = (e.filter(F.col("event_type") == k) for k in ("click", "view"))
    got = sessions.latest_time(rows.select("user_id", "event_id", "uid", "part"), views.select("user_id", "uid", "t"), ["user_id"], ["event_id"], "uid", "t", "zoom_t", "part")
    return got.select("user_id", "event_id", F.round("zoom_t", 6).alias("zoom_t"))


@query(f"with f as (select user_id, min({_T}) filter (event_type = 'view') t from events group by 1) select user_id, 's' || user_id || '-' || coalesce(floor(t)::bigint::varchar, 'none') name from f")
def session_namer(spark, sf_dir):
    """Sessions in the order of their first time, with names of the caller's own making."""
    e = seconds(events(spark, sf_dir))
    first = e.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "view", F.col("t"))).alias("t"))
    own = lambda n, t: F.concat(F.lit("s"), n.cast("string"), F.lit("-"), F.coalesce(F.floor(t).cast("string"), F.lit("none")))
    return sessions.named(sessions.by_first_time(first, "t", "user_id"), "user_id", "t", own).select("user_id", "name")


@query("with s as (select user_id, event_type, list(value) v from events group by all) select max(n)::int as outer, max(i)::int as inner from (select user_id, count(*) n, max(len(v)) i from s group by 1)")
def largest_shape(spark, sf_dir):
    """Greatest outer and inner length of ragged arrays: a user's values by type."""
    lists = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.collect_list("value").alias("v")).groupBy("user_id").agg(F.collect_list("v").alias("data"))
    return products.max_inner_shape(lists, "data")


@query("select user_id, event_type, round(avg(value), 6) v from events group by all")
def wide_channels(spark, sf_dir):
    """Dynamic channels as columns and back."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    wide = products.widen(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", kinds)
    return wide.unpivot("user_id", kinds, "event_type", "v").filter("v is not null").select("user_id", "event_type", F.round("v", 6).alias("v"))


@query("""with e as (select vec_id // 20 k, (vec_id % 20)::int product, vec_id % 3 + 1 n, vec_id % 5 + 4 m, embedding d from embeddings where vec_id % 20 < 16 and vec_id % 7 != 3),
g as (select k, max(n) n, max(m) m from e group by k), c as (select k, p::int product, i::int average, j::int bin from g, range(16) a(p), range(3) b(i), range(8) c(j) where i < n and j < m)
select c.k, c.product, average, bin, case when average < e.n and bin < e.m then d[(average * e.m + bin + 1)::int]::double end as value from c left join e on c.k = e.k and c.product = e.product""")
def spectrum_cubes(spark, sf_dir):
    """Time-resolved spectra of the products of a row as one cube: what a product lacks is null."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 7 != 3")
    m, n = F.col("vec_id") % 5 + 4, F.col("vec_id") % 3
    data = F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.slice(F.col("embedding").cast("array<double>"), (i * m + 1).cast("int"), m.cast("int")))
    rows = e.select(F.floor(F.col("vec_id") / 20).alias("k"), (F.col("vec_id") % 20).cast("int").alias("product"), data.alias("data"))
    each = products.cube(rows, ["k"], "data").select("k", F.posexplode("cube").alias("product", "x")).select("k", "product", F.posexplode("x").alias("average", "y"))
    return each.select("k", "product", "average", F.posexplode("y").alias("bin", "value"))
