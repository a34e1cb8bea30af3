"""Ordered streaming against tables: shuffled arrival, restarts between batches, and rows that are late."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from bandloom.operators import order, packets
from bandloom.streaming import ordered, streams

START = datetime(2025, 1, 1, tzinfo=timezone.utc)


def arrivals(rows, batches, jitter_s, seed=1):
    """``rows`` (first field: seconds) dealt into batches in which none comes more than ``jitter_s`` behind a later one."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[0] + rng.uniform(0, jitter_s))
    n = -(-len(late) // batches)
    out = [late[k : k + n] for k in range(0, len(late), n)]
    for b in out:
        rng.shuffle(b)
    return out


def play(spark, tmp_path, batches, schema, make):
    """Run ``make`` of the stream over one batch after another, each a new start from the checkpoint."""
    streams.with_rocksdb(spark)
    inbox = tmp_path / "in"
    empty = spark.createDataFrame([], schema).withColumn("at", F.lit(None).cast("timestamp"))
    for rows in batches:
        df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_micros((F.col("s") * 1_000_000).cast("long") + int(START.timestamp()) * 1_000_000))
        df.coalesce(1).write.mode("append").parquet(str(inbox))
        q = make(spark.readStream.schema(empty.schema).parquet(str(inbox))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def events(seed=5, n=240):
    rng = random.Random(seed)
    return [(round(k * 7.3 + rng.random(), 3), f"u{rng.randrange(3)}", k, rng.random() < 0.25) for k in range(n)]


def test_sessions_of_shuffled_rows(spark, tmp_path):
    rows = events()
    end = rows[-1][0] + 10_000
    # The last rows come when the watermark has passed them and later rows of their streams have gone on.
    batches = [*arrivals(rows, 3, 500), [(end, "u0", 9999, False)], [(0.5, "u1", 5000, True), (0.6, "u0", 5001, True)]]
    got = play(spark, tmp_path, batches, "s double, stream string, id long, hello boolean", lambda s: ordered.sessions_in_order(s, delay="600 seconds")).collect()
    told = {r.id: r.session_no for r in got if not r.late}
    want = order.split_sessions(spark.createDataFrame(rows, "s double, stream string, id long, hello boolean"), ["stream"], ["s", "id"], F.col("hello"))
    assert told == {r.id: r.session_no for r in want.collect()}
    assert sorted(r.id for r in got if r.late) == [5000, 5001]


def test_as_of_of_two_streams(spark, tmp_path):
    rows = events(9)
    batches = [*arrivals(rows, 2, 500, 3), [(rows[-1][0] + 10_000, u, 9990, False) for u in ("u0", "u1", "u2", "u3")]]

    def make(s):
        return ordered.asof_in_order(s.filter("not hello").select("stream", "at", "id"), s.filter("hello").select("stream", "at", "id"), delay="600 seconds")

    got = {r.id: r.session for r in play(spark, tmp_path, batches, "s double, stream string, id long, hello boolean", make).collect() if not r.late}
    want = {}
    for s, u, i, hello in rows:
        starts = sorted((a, j) for a, v, j, h in rows if h and v == u)
        if not hello and starts:
            want[i] = max((x for x in starts if x <= (s, i)), default=starts[0])[1]
    assert got == want


@pytest.mark.parametrize("ttl", [30.0, 1e6])
def test_downlink_against_tables(spark, tmp_path, ttl):
    rng = random.Random(11)
    schema = "s double, stream_id string, bank string, id long, appid int, groupflags int, sequence_cnt int, payload binary"
    rows = []
    for k in range(260):
        bank = rng.choice(["b01", "b05"])
        rows.append((round(k * 7.3, 3), f"u{rng.randrange(2)}", bank, k, rng.choice([1, 2, 3, 4]), rng.choice([0, 0, 1, 3]), k, bytes(rng.randrange(256) for _ in range(rng.choice([2, 4, 6, 6, 3])))))
    last = rows[-1][0] + 1e7
    batches = [*arrivals(rows, 2, 200, 2), [(last, f"u{k}", "b01", 1000 + k, 4, 3, 0, b"end") for k in range(2)], [(last + 1e5, "u9", "b01", 2000, 4, 3, 0, b"end")]]
    got = play(spark, tmp_path, batches, schema, lambda s: ordered.downlink(s, ttl, {2: "derived", 4: "dropped"}, {3}, delay="600 seconds"))
    got = got.filter("pkt_idx < 1000").collect()
    # The batch path, for which a group that expires is one that a gap ends.
    frames = spark.createDataFrame(rows, schema).withColumn("frame_idx", F.col("id"))
    cut = order.previous(order.previous(frames, ["stream_id", "bank"], ["s"], F.col("s"), "_s"), ["stream_id", "bank"], ["s"], F.col("groupflags"), "_f")
    part = order.running_sum(cut.withColumn("_new", ((F.col("s") - F.col("_s") > ttl) & (F.col("_f") == 0)).cast("int")), ["stream_id", "bank"], ["s"], F.col("_new"), "part")
    made, rejects = packets.reassemble(part.drop("_s", "_f", "_new"), keys=["stream_id", "bank", "part"])
    classes = spark.createDataFrame([(2, "derived"), (4, "dropped"), (1, "prefixed"), (3, "prefixed")], "appid int, uid_class string")
    closed = made.join(frames.select("stream_id", F.col("sequence_cnt").alias("seq"), F.col("s").alias("closed")), ["stream_id", "seq"])
    named = packets.identify(packets.classify(closed, classes), ["closed"])
    numbered = order.split_sessions(named, ["stream_id"], ["closed"], F.col("appid") == 3)
    want = sorted((r.stream_id, r.bank, r.pkt_idx, r.appid, r.start_seq, r.seq, r.unique_packet_id, r.session_no, bytes(r.blob)) for r in numbered.collect())
    assert sorted((r.stream_id, r.bank, r.pkt_idx, r.appid, r.start_seq, r.seq, r.unique_packet_id, r.session_no, bytes(r.blob)) for r in got if r.kind == "packet") == want
    count = lambda reason: sum(r.kind == "reject" and r.reason == reason for r in got)
    told = {r.reason: r["count"] for r in rejects.groupBy("reason").count().collect()}
    assert (count("odd"), count("open")) == (told["odd"], told.get("open", 0)) and count("late") == 0 and len(want) > 40
