"""Columns over bytes, ids and mission time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def swap16(payload: Column) -> Column:
    """Swap the bytes of each 16-bit pair; null where the length is odd."""
    return F.when(F.length(payload) % 2 == 0, F.unhex(F.regexp_replace(F.hex(payload), "(..)(..)", "$2$1")))


def little_endian_u32(blob: Column) -> Column:
    """The first four bytes as an unsigned number; null where there are fewer."""
    h = F.hex(F.substring(blob, 1, 4))
    turned = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.when(F.length(blob) >= 4, F.conv(turned, 16, 10).cast("long"))


def mission_seconds(time_16: Column, time_32: Column) -> Column:
    """Seconds of a split time: 48 bits, of which the lowest 4 are dropped and 12 more are the fraction."""
    raw = F.shiftleft(time_16.cast("long").bitwiseAND(65535), 32) + time_32.cast("long")
    return F.shiftright(raw, 4).cast("double") / 4096


def telemetry_seconds(seconds: Column, ticks: Column) -> Column:
    return seconds.cast("double") + ticks / F.lit(65536.0)


def mjd(raw_seconds: Column, subtract: Column, offset_days: Column) -> Column:
    return (raw_seconds - subtract) / 86400 + offset_days


def mjd_is_calibrated(subtract: Column, offset_days: Column) -> Column:
    return (subtract != 0) | (offset_days != 0)


def session_name(number: Column, start: Column) -> Column:
    """session_NNN, with the UTC start as _YYYYMMDD_HHMMSS where there is one (session time zone UTC)."""
    stamp = F.date_format(F.timestamp_seconds(start.cast("double")), "yyyyMMdd_HHmmss")
    return F.when(start.isNull(), F.format_string("session_%03d", number)).otherwise(F.format_string("session_%03d_%s", number, stamp))


def packet_name(index: Column, appid: Column, packets: Column) -> Column:
    """NNNNN_XXXX.bin; six digits from a million packets on."""
    wide = F.format_string("%06d_%04x.bin", index, appid)
    return F.when(packets >= 1_000_000, wide).otherwise(F.format_string("%05d_%04x.bin", index, appid))
