"""From bank files to committed sessions in one call: frames, packets, identities, sessions, products, telemetry,
manifests, and one table of what was rejected on the way and why."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import split_sessions
from ..operators.packets import reassemble, route, with_identity
from ..operators.sessions import assign_telemetry, first_hello, manifest, session_windows
from . import ranges
from .banks import TELEMETRY_BANK
from .commits import Commit
from .folders import stored

#: The columns of rejects of every stage: where (stream, bank, number of the frame or of its packet) and why.
REJECTS = ("stream_id", "bank", "stage", "reason", "place")
#: Reasons by stage; a decoder's own words follow "decode: ".
REASONS = {"frames": ("crc", "tail"), "reassemble": ("odd", "open"), "classify": ("dropped",), "identify": ("no uid",), "route": ("unknown appid", "decode")}
#: Rows of a bucket in the windows over a stream, so that no task holds a long stream.
BUCKET = 1 << 16


@dataclass
class Formats:
    """What an instrument's packets are.

    ``classes`` (appid, uid_class) and ``kinds`` (appid, kind) have at most 2048 rows, one an id. ``decode`` adds ``error``
    (null if all is well) and whatever the layouts need to packets with their sessions; ``layouts`` makes the rows of each
    kind of what was decoded. ``start`` is the time that a hello packet tells, from its blob. ``telemetry`` makes rows
    (stream_id, t, ...) of telemetry packets, and layout ``telemetry`` those that are stored once they have a session_id.
    """

    classes: DataFrame
    kinds: DataFrame
    hellos: tuple[int, ...]
    decode: Callable[[DataFrame], DataFrame]
    layouts: dict[str, Callable[[DataFrame], DataFrame]]
    start: Column
    telemetry: Callable[[DataFrame], DataFrame] | None = None
    typed_uid: Callable[[Column, Column], Column] | None = None
    provenance: dict[str, dict[str, str]] = field(default_factory=dict)


def rejected(rows: DataFrame, stage: str, reason: Column, place: str) -> DataFrame:
    return rows.select("stream_id", "bank", F.lit(stage).alias("stage"), reason.cast("string").alias("reason"), F.col(place).cast("long").alias("place"))


def session_id(stream: Column, number: Column) -> Column:
    return F.concat(stream, F.lit("."), F.lpad(number.cast("string"), 5, "0"))


def identified(frames: DataFrame, formats: Formats) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(science packets with their uid and session, telemetry packets, rejects) of frames. Packets are stored, since
    several results are made of them."""
    cut = frames.withColumn("_part", F.floor(F.col("frame_idx") / BUCKET))
    packed, broken = reassemble(cut, bucket="_part")
    packed = stored(packed)
    science = packed.filter(F.col("bank") != TELEMETRY_BANK).join(F.broadcast(formats.classes), "appid", "left")
    dropped = F.coalesce(F.col("uid_class") == "dropped", F.lit(False))
    read = science.filter(~dropped).withColumn("_part", F.concat("bank", F.lpad(F.floor(F.col("pkt_idx") / BUCKET).cast("string"), 12, "0")))
    named = stored(with_identity(read, ["bank", "pkt_idx"], formats.typed_uid, bucket="_part"))
    known = named.filter("unique_packet_id is not null").withColumn("_part", F.floor(F.col("unique_packet_id") / BUCKET))
    split = split_sessions(known, ["stream_id"], ["unique_packet_id", "seq", "bank", "pkt_idx"], F.col("appid").isin(*formats.hellos), bucket="_part").drop("_part")
    rejects = (
        rejected(frames.filter("reject is not null"), "frames", F.col("reject"), "frame_idx")
        .unionByName(rejected(broken, "reassemble", F.col("reason"), "pkt_no"))
        .unionByName(rejected(science.filter(dropped), "classify", F.lit("dropped"), "pkt_idx"))
        .unionByName(rejected(named.filter("unique_packet_id is null"), "identify", F.lit("no uid"), "pkt_idx"))
    )
    return split, packed.filter(F.col("bank") == TELEMETRY_BANK), rejects


def session_table(packets: DataFrame, formats: Formats) -> DataFrame:
    """stream_id, session_no, session_id, packets, start (of the first hello, null without one) and the telemetry's window."""
    order = ["unique_packet_id", "seq", "bank", "pkt_idx"]
    keys = ["stream_id", "session_no"]
    hello = first_hello(packets.withColumn("start", formats.start.cast("double")), keys, order, F.col("appid").isin(*formats.hellos), ["start"])
    every = packets.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets")).join(hello, keys, "left")
    return session_windows(every, ["stream_id"], "start", "session_no").withColumn("session_id", session_id(F.col("stream_id"), F.col("session_no")))


def ingest(spark: SparkSession, folder: str, out: str, formats: Formats, name: str, range_bytes: int = ranges.RANGE, slices: int = 1, packed: bool = False) -> Commit:
    """Read the banks below ``folder`` and commit to ``out`` under ``name``: each kind in its layout, ``rejects`` and
    ``manifests`` (session_id, manifest). ``packed``, the banks are those of ``sinks.write_packed_banks``. All are seen or none; the same name again takes the earlier one's place.

    The commit that is returned tells the rows of each kind and the rejects of each reason, counted by the tasks that wrote
    them. A folder without banks commits empty tables. Telemetry goes to the latest session that started at or before it,
    and to a stream's first one before that; of a stream without any session it is a reject.
    """
    frames = stored(ranges.range_frames((ranges.packed_ranges if packed else ranges.bank_ranges)(spark, folder, range_bytes)))
    packets, telemetry, rejects = identified(frames, formats)
    packets = stored(packets.withColumn("session_id", session_id(F.col("stream_id"), F.col("session_no"))))
    sessions = stored(session_table(packets, formats))
    good, bad = route(formats.decode(packets), formats.kinds)
    rejects = rejects.unionByName(rejected(bad, "route", F.col("reason"), "pkt_idx"))
    good = stored(good)
    with Commit(spark, out, name) as commit:
        for kind, layout in formats.layouts.items():
            if kind != "telemetry":
                commit.save_kind(layout(good.filter(F.col("kind") == kind)), kind, slices, **formats.provenance.get(kind, {}))
        if formats.telemetry is not None:
            told = assign_telemetry(formats.telemetry(telemetry), sessions.select("stream_id", "session_id", "start"), ["stream_id"], "t", "start", "session_id", lambda t: F.floor(t / BUCKET))
            commit.save_kind(formats.layouts["telemetry"](told.filter("session_id is not null")), "telemetry", slices, **formats.provenance.get("telemetry", {}))
            lone = told.filter("session_id is null").select("stream_id", F.lit(TELEMETRY_BANK).alias("bank"), F.lit(None).cast("long").alias("place"))
            rejects = rejects.unionByName(rejected(lone, "sessions", F.lit("no session"), "place"))
        by_reason = {r: F.col("reason") == r for rs in REASONS.values() for r in rs if r != "decode"} | {"decode": F.col("reason").startswith("decode: "), "no session": F.col("reason") == "no session"}
        commit.table(rejects, "rejects", by_reason)
        commit.table(manifests(sessions), "manifests")
    return commit


def manifests(sessions: DataFrame) -> DataFrame:
    """session_id and its manifest, one text of JSON a session."""
    told = manifest(sessions.select("session_id", "stream_id", "session_no", "packets", "start", "lo", "hi"))
    return told.select(F.get_json_object("manifest", "$.session_id").alias("session_id"), "manifest")
