"""Queries that run as streams over the event table and return what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.folders import shared_folder
from ..streaming import ordered, streams
from .registry import query, table


def _run(stream):
    return streams.run_once(stream, f"{shared_folder(stream.sparkSession)}/bandloom-streams")


def _events(spark, sf_dir):
    return streams.as_stream(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("""with w as (select time_bucket(interval '1 hour', ts) b, event_type, avg(value) mean, count(*) n from events group by all)
select epoch_us(b) // 1000000 start_s, event_type, round(mean, 6) mean, n from w where b + interval '1 hour' <= (select max(ts) from events) - interval '10 minutes'""")
def stream_binned_means(spark, sf_dir):
    got = _run(streams.binned_means(_events(spark, sf_dir), "at", ["event_type"], "value", "1 hour"))
    return got.select(F.unix_seconds("start").alias("start_s"), "event_type", F.round("mean", 6).alias("mean"), "n")


@query("""with h as (select *, event_type = 'signup' hello, lag(event_type = 'signup') over (partition by user_id order by ts, event_id) was from events),
s as (select *, sum(case when was is null or (hello and not was) then 1 else 0 end) over (partition by user_id order by ts, event_id) - 1 session_no from h)
select user_id::varchar stream, event_id id, session_no::bigint session_no from s""")
def stream_sessions(spark, sf_dir):
    streams.with_rocksdb(spark)
    e = _events(spark, sf_dir)
    rows = e.select(F.col("user_id").cast("string").alias("stream"), (F.unix_micros("at") / 1e6).alias("t"), F.col("event_id").alias("id"), (F.col("event_type") == "signup").alias("hello"))
    return _run(streams.split_sessions_online(rows)).filter("not late").select("stream", "id", "session_no")


@query("select distinct user_id, event_type, props from events")
def stream_distinct(spark, sf_dir):
    kept = streams.drop_repeats(_events(spark, sf_dir), "at", ["user_id", "event_type", "props"], delay="3650 days")
    return _run(kept).select("user_id", "event_type", "props")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts) k from g), x as (select user_id, min(ts) a, max(ts) + interval '6 hours' b, count(*) n from s group by user_id, k)
select epoch_us(a) // 1000000 start_s, user_id, n from x where b <= (select max(ts) from events) - interval '10 minutes'""")
def stream_gap_sessions(spark, sf_dir):
    got = _run(streams.gap_sessions(_events(spark, sf_dir), "at", ["user_id"], "6 hours"))
    return got.select(F.unix_seconds("start").alias("start_s"), "user_id", "n")


@query("""with st as (select user_id, epoch_us(ts) / 1e6 t, event_id sid from events where event_type = 'signup'), f as (select user_id, arg_min(sid, t) first_sid from st group by 1)
select e.event_id, coalesce(st.sid, f.first_sid) session_id from (select *, epoch_us(ts) / 1e6 t from events where event_type = 'click') e asof left join st on e.user_id = st.user_id and e.t >= st.t left join f on e.user_id = f.user_id""")
def stream_telemetry(spark, sf_dir):
    starts = table(spark, sf_dir, "events").filter("event_type = 'signup'").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"), F.col("event_id").alias("session_id"))
    clicks = _events(spark, sf_dir).filter("event_type = 'click'").select("user_id", "event_id", (F.unix_micros("at") / 1e6).alias("t"))
    import uuid

    path = f"{shared_folder(spark)}/bandloom-streams/{uuid.uuid4().hex}"
    write = streams.assign_online(starts, f"{path}/out", ["user_id"], "t", "start", "session_id")
    clicks.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "session_id")


#: What the watermark has passed when all is read.
_PAST = "epoch_us(ts) // 1000 <= (select max(epoch_us(ts)) // 1000 - 600000 from events)"


@query(f"""with h as (select *, event_type = 'signup' hello, lag(event_type = 'signup') over (partition by user_id order by ts, event_id) was from events where {_PAST}),
s as (select *, sum(case when was is null or (hello and not was) then 1 else 0 end) over (partition by user_id order by ts, event_id) - 1 session_no from h)
select user_id::varchar stream, event_id id, session_no::bigint session_no from s""")
def stream_sessions_in_order(spark, sf_dir):
    """Sessions of rows that wait for the watermark, in whatever order they arrive."""
    streams.with_rocksdb(spark)
    e = _events(spark, sf_dir)
    rows = e.select(F.col("user_id").cast("string").alias("stream"), "at", F.col("event_id").alias("id"), (F.col("event_type") == "signup").alias("hello"))
    return _run(ordered.sessions_in_order(rows)).filter("not late").select("stream", "id", "session_no")


@query("""with e as (select *, epoch_us(ts) t from events where epoch_us(ts) // 1000 <= (select max(epoch_us(ts)) // 1000 - 600000 from events where event_type in ('click', 'signup'))), st as (select user_id, t, event_id sid from e where event_type = 'signup'), f as (select user_id, arg_min(sid, t) first_sid from st group by 1)
select c.event_id, coalesce(st.sid, f.first_sid) session_id from (select * from e where event_type = 'click') c asof left join st on c.user_id = st.user_id and c.t >= st.t join f on c.user_id = f.user_id""")
def stream_telemetry_in_order(spark, sf_dir):
    """Sessions and telemetry both as streams."""
    streams.with_rocksdb(spark)
    side = lambda kind: _events(spark, sf_dir).filter(F.col("event_type") == kind).select(F.col("user_id").cast("string").alias("stream"), "at", F.col("event_id").alias("id"))
    got = _run(ordered.asof_in_order(side("click"), side("signup"))).filter("not late")
    return got.select(F.col("id").alias("event_id"), F.col("session").alias("session_id"))


@query(f"""with f as (select user_id, event_id, epoch_us(ts) t, event_type, event_type = 'purchase' closes, octet_length(encode(props)) % 2 = 1 odd, hex(encode(props)) h from events where {_PAST}),
o as (select *, lag(t) over w pt, lag(closes) over w pc, row_number() over w rn from f window w as (partition by user_id order by t, event_id)),
g as (select *, sum(case when pt is null or pc or t - pt > 86400000000 then 1 else 0 end) over (partition by user_id order by rn) grp from o),
x as (select *, max(rn) filter (odd) over (partition by user_id, grp) last_odd from g),
p as (select user_id, max(rn) rn, arg_min(event_id, rn) pkt_idx, arg_min(event_type, rn) kind, string_agg(regexp_replace(h, '(..)(..)', '\\2\\1', 'g'), '' order by rn) blob from x where last_odd is null or rn > last_odd group by user_id, grp having bool_or(closes)),
u as (select *, case when kind != 'click' then ('0x' || substr(blob, 7, 2) || substr(blob, 5, 2) || substr(blob, 3, 2) || substr(blob, 1, 2))::bigint end own from p where kind != 'error'),
c as (select *, coalesce(own, last_value(own ignore nulls) over (partition by user_id order by rn)) uid, kind = 'signup' hello from u),
s as (select *, lag(hello, 1, true) over (partition by user_id order by rn) was from c where uid is not null)
select user_id::varchar stream_id, pkt_idx, uid unique_packet_id, (sum(case when hello and not was then 1 else 0 end) over (partition by user_id order by rn))::bigint session_no, blob from s""")
def stream_downlink(spark, sf_dir):
    """Frames to packets, identities and sessions as one stream: purchases close packets, which expire after a day."""
    streams.with_rocksdb(spark)
    ids = {"signup": 0x209, "view": 1, "click": 2, "purchase": 3, "error": 4}
    appid = F.element_at(F.create_map(*[F.lit(x) for kv in ids.items() for x in kv]), F.col("event_type"))
    frames = _events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("stream_id"), "at", F.col("event_id").alias("id"), F.lit("b05").alias("bank"), appid.alias("appid"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("groupflags"), (F.col("event_id") % 16384).cast("int").alias("sequence_cnt"), F.encode("props", "UTF-8").alias("payload"),
    )
    got = _run(ordered.downlink(frames, 86400, {2: "derived", 4: "dropped"}, {0x209})).filter("kind = 'packet'")
    return got.select("stream_id", "pkt_idx", "unique_packet_id", "session_no", F.hex("blob").alias("blob"))
