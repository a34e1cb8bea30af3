"""From frames to identified packets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import little_endian_u32, swap16
from ..sources.banks import TELEMETRY_BANK
from .order import carry_last, group_until

#: groupflags that end a packet.
LAST, SINGLE = 1, 3


def reassemble(frames: DataFrame, keys: list[str] | None = None, bucket: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(packets, rejects). Payloads are joined until groupflags is 1 or 3; the id is the first frame's, the sequence the
    last one's. Science payloads are swapped in 16-bit pairs; an odd one drops what was gathered before it in its group,
    itself included, and the frames after it go on. An open group at the end is a reject."""
    keys = keys or ["stream_id", "bank"]
    good = frames.filter("reject is null") if "reject" in frames.columns else frames
    ends = F.col("groupflags").isin(LAST, SINGLE)
    good = group_until(good, keys, [F.col("frame_idx")], ends, "pkt_no", bucket)
    good = good.withColumn("swapped", F.when(F.col("bank") == TELEMETRY_BANK, F.col("payload")).otherwise(swap16(F.col("payload"))))
    group = Window.partitionBy(*keys, "pkt_no")
    odd = good.withColumn("_odd", F.max(F.when(F.col("swapped").isNull(), F.col("frame_idx"))).over(group))
    rejects = odd.filter("swapped is null").select(*keys, "pkt_no", F.lit("odd").alias("reason"))
    odd = odd.filter("_odd is null or frame_idx > _odd")
    parts = F.array_sort(F.collect_list(F.struct("frame_idx", F.hex("swapped").alias("h"))))
    packets = odd.groupBy(*keys, "pkt_no").agg(
        F.min_by("appid", "frame_idx").alias("appid"), F.min_by("sequence_cnt", "frame_idx").alias("start_seq"), F.max_by("sequence_cnt", "frame_idx").alias("seq"),
        F.max_by("groupflags", "frame_idx").alias("_end"), F.min("frame_idx").alias("pkt_idx"), F.count("*").alias("frames"), parts.alias("_parts"),
    )
    packets = packets.withColumn("blob", F.unhex(F.array_join(F.transform("_parts", lambda x: x["h"]), ""))).drop("_parts")
    closed = F.col("_end").isin(LAST, SINGLE)
    rejects = rejects.unionByName(packets.filter(~closed).select(*keys, "pkt_no", F.lit("open").alias("reason")))
    return packets.filter(closed).withColumn("single_packet", (F.col("frames") == 1) & (F.col("_end") == SINGLE)).drop("_end", "frames"), rejects


def classify(packets: DataFrame, classes: DataFrame) -> DataFrame:
    """Add uid_class (prefixed, typed, derived) from the dimension ``classes`` (appid, uid_class); dropped ids go.

    A header's id has 11 bits, so the dimension has at most 2048 rows.
    """
    return packets.join(F.broadcast(classes), "appid", "left").filter("uid_class is null or uid_class != 'dropped'")


def route(decoded: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, rejects) of decoded packets (appid, error, ...): each with the kind that ``kinds`` (appid, kind) gives its
    id; what failed to decode or has no kind is a reject with its reason. ``kinds`` has at most 2048 rows."""
    found = decoded.join(F.broadcast(kinds), "appid", "left")
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("decode: "), F.col("error"))).when(F.col("kind").isNull(), F.lit("unknown appid"))
    found = found.withColumn("reason", reason)
    return found.filter("reason is null").drop("reason", "error"), found.filter("reason is not null").drop("kind")


def with_identity(packets: DataFrame, order: list, typed_uid: Callable[[Column, Column], Column] | None = None, keys: tuple[str, ...] = ("stream_id",), bucket: str | None = None) -> DataFrame:
    """Add unique_packet_id: of prefixed packets from their first bytes, of typed ones from ``typed_uid(appid, blob)``, of
    derived ones from the latest packet before them that has one; null for packets without any. ``order`` is the read order
    over all banks of a stream."""
    kind = F.col("uid_class")
    own = F.when(kind == "prefixed", little_endian_u32(F.col("blob")))
    if typed_uid is not None:
        own = own.when(kind == "typed", typed_uid(F.col("appid"), F.col("blob")))
    packets = packets.withColumn("_own", own)
    out = carry_last(packets, list(keys), order, {"_carried": F.col("_own")}, bucket)
    uid = F.when(kind == "derived", F.col("_carried")).otherwise(F.col("_own"))
    return out.withColumn("unique_packet_id", uid).drop("_own", "_carried")


def identify(packets: DataFrame, order: list, typed_uid: Callable[[Column, Column], Column] | None = None, keys: tuple[str, ...] = ("stream_id",), bucket: str | None = None) -> DataFrame:
    """The packets that ``with_identity`` gives a unique_packet_id; those without any go."""
    return with_identity(packets, order, typed_uid, keys, bucket).filter("unique_packet_id is not null")


def canonical_order(packets: DataFrame, read_order: str) -> DataFrame:
    """Sorted by uid, sequence and, for ties, the order of reading."""
    return packets.orderBy("unique_packet_id", "seq", read_order)
