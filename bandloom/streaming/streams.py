"""Streams of frames, packets, sessions and telemetry."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.packets import LAST, SINGLE
from ..operators.sessions import assign_telemetry
from ..sources.banks import BANK_FILE, frames

BANK_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def bank_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of banks that arrive as files; a bank must be complete when it appears, since files are read once."""
    files = spark.readStream.format("binaryFile").schema(BANK_SCHEMA).option("pathGlobFilter", BANK_FILE).option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.regexp_extract("path", rf"([^/]+)/b\d\d/{BANK_FILE}$", 1).alias("stream_id"), F.regexp_extract("path", rf"/(b\d\d)/{BANK_FILE}$", 1).alias("bank"), "content")
    return frames(named)


class _Sessions(StatefulProcessor):
    """Per stream: the session's number, whether it has a row that is no hello, and the last (t, id) handled."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "number long, mixed boolean, t double, id long, started boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, mixed, t, i, started = self.state.get() if self.state.exists() else (0, False, float("-inf"), -1, False)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["t", "id"], kind="stable")
        out, late = [], []
        for r in batch.itertuples(index=False):
            late.append((r.t, r.id) <= (t, i))
            if not late[-1]:
                if r.hello and mixed:
                    number, mixed = number + 1, False
                mixed = mixed or not r.hello
                t, i, started = r.t, r.id, True
            out.append(number)
        self.state.update((number, mixed, t, i, started))
        yield batch.assign(session_no=out, late=late)[["stream", "t", "id", "hello", "session_no", "late"]]

    def close(self) -> None:
        pass


def split_sessions_online(rows: DataFrame) -> DataFrame:
    """stream, t, id, hello, session_no, late of a stream of (stream, t, id, hello). Rows of a batch are sorted by (t, id);
    a row that is not after the last one handled is late and keeps the number of that time. Needs the RocksDB store."""
    return rows.groupBy("stream").transformWithStateInPandas(_Sessions(), "stream string, t double, id long, hello boolean, session_no long, late boolean", "append", "none")


class _Packets(StatefulProcessor):
    """Per (stream, bank): the frames of the group that is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "frame_idx long, appid int, sequence_cnt int, payload binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.open.get()) if self.open.exists() else []
        out = []
        for r in pd.concat(list(rows), ignore_index=True).sort_values("frame_idx").itertuples(index=False):
            held.append((r.frame_idx, r.appid, r.sequence_cnt, bytes(r.payload)))
            if r.groupflags in (LAST, SINGLE):
                out.append((*key, held[0][0], held[0][1], held[0][2], held[-1][2], b"".join(bytes(h[3]) for h in held)))
                held = []
        self.open.clear()
        if held:
            self.open.put(held)
        yield pd.DataFrame(out, columns=["stream_id", "bank", "pkt_idx", "appid", "start_seq", "seq", "blob"])

    def close(self) -> None:
        pass


def packets_online(good_frames: DataFrame) -> DataFrame:
    """Packets of a stream of frames; an open group waits in state for its last frame. Bytes are joined as they came."""
    return good_frames.groupBy("stream_id", "bank").transformWithStateInPandas(_Packets(), "stream_id string, bank string, pkt_idx long, appid int, start_seq int, seq int, blob binary", "append", "none")


def assign_online(sessions: DataFrame, path: str, keys: list[str], t: str, start: str, session: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: each batch of telemetry joins the sessions table and overwrites its own partition of
    ``path``, so a repeated batch leaves no duplicates."""

    def write(batch: DataFrame, epoch: int) -> None:
        assign_telemetry(batch, sessions, keys, t, start, session).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return write


def binned_means(rows: DataFrame, ts: str, keys: list[str], value: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Mean and count per key and time window, tumbling or sliding; rows later than ``delay`` are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.withWatermark(ts, delay).groupBy(window.alias("w"), *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "mean", "n")


def drop_repeats(rows: DataFrame, ts: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Rows without repeats of ``keys`` within the watermark's delay."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def gap_sessions(rows: DataFrame, ts: str, keys: list[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions that end where no row follows for ``gap``."""
    return rows.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet below ``folder``, and read that."""
    path = f"{folder}/{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def with_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def as_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The file or files of a table as a stream; the pattern keeps Spark from taking a single file for a folder."""
    return spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema).parquet(f"{folder}/{name}[.]parquet")
