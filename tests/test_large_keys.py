"""What must not grow faster than its input: buckets, files, tasks and calls per key."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__
from bandloom.operators import grids, peaks
from bandloom.sources import banks, sinks
from bandloom.streaming import ordered


def test_buckets_of_a_long_series_are_run_together(spark):
    """Cut into a bucket a row, a series still has no more buckets than the root of its turning points, and the same peaks."""
    df = spark.range(4000).select(F.col("id").alias("t"), (F.xxhash64("id") % 1000).cast("double").alias("v"))
    turns = df.select(F.col("t").alias("_t"), F.col("v").alias("_v"), F.col("t").alias("_b"))
    assert peaks.evened(turns, []).agg(F.count_distinct("_b")).first()[0] <= 64
    show = lambda d: sorted((r["t"], round(r["prominence"], 9)) for r in d.collect())
    cut = grids.prominent_peaks(df.withColumn("b", F.col("t")), [], "t", "v", 0.3, bucket="b")
    assert show(cut) == show(grids.prominent_peaks(df, [], "t", "v", 0.3))


def test_names_of_wide_numbers_are_as_in_sql(spark, tmp_path):
    """Users of four digits and of five hexadecimal ones, an unknown user, and one without a time."""
    rows = "select * from values (1L, 7L, '2024-01-02 03:04:05'), (2L, 1017L, '2024-01-01 18:11:53'), (3L, 70001L, '2024-02-01 00:00:00'), (4L, null, '2024-02-01 00:00:00'), (5L, 12L, null) as t(event_id, user_id, ts)"
    spark.sql(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, __spark_entry__.queries()["session_names"](spark, str(tmp_path)).collect()), key=str)
    sql = __spark_entry__.oracle_sql()["session_names"].replace("from events", f"from '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(duckdb.connect().sql(sql).fetchall(), key=str) and len(got) == 5


def test_small_banks_share_batches(monkeypatch):
    """A thousand banks are one batch of frames; a large one is cut into several, numbered through."""
    bank = lambda n: b"".join(banks.SYNC + (h := (0x209).to_bytes(2, "big") + b"\xc0\x00\x00\x03") + b"abcd" + banks.crc16(h + b"abcd").to_bytes(2, "big") for _ in range(n))
    frame = lambda contents: pd.DataFrame({"stream_id": [str(k) for k in range(len(contents))], "bank": "b05", "content": contents})
    got = list(banks._frames(iter([frame([bank(2)] * 500), frame([bank(2)] * 500)])))
    assert [len(g) for g in got] == [2000] and got[0]["reject"].isna().all()
    monkeypatch.setattr(banks, "BATCH_ROWS", 10)
    got = list(banks._frames(iter([frame([bank(25)])])))
    assert [len(g) for g in got] == [10, 10, 5] and [i for g in got for i in g["frame_idx"]] == list(range(25))


def test_keys_share_slots_and_timers(spark):
    """However many streams there are, Spark sees no more groups, and so timers and calls, than slots."""
    got = spark.range(20000).select(ordered.slot(["id"]).alias("slot"))
    assert got.distinct().count() == ordered.SLOTS


def test_packets_of_many_sessions_share_files(spark, tmp_path):
    p = spark.range(2000).select((F.col("id") % 500).alias("session_id"), F.col("id").alias("unique_packet_id"), F.lit(0).alias("seq"), F.col("id").alias("pkt_idx"), F.lit(7).alias("appid"))
    sinks.write_packets(p, str(tmp_path), ["session_id"], apart=False)
    assert len(list((tmp_path / "packets").glob("**/*.parquet"))) <= 4
    got = spark.read.parquet(str(tmp_path / "packets")).groupBy("session_id").agg(F.sort_array(F.collect_list("file")).alias("f")).collect()
    assert len(got) == 500 and all(r["f"] == [f"0000{k}_0007.bin" for k in range(4)] for r in got)
