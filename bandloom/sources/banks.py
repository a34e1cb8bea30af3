"""Raw framed banks: scanning files and cutting them into frames."""

from __future__ import annotations

import binascii
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the downlink format.
SYNC, PADDING, HEAD, CRC_BYTES, CRC_START = b"\xec\xa0", 0xA5, 6, 2, 0xFFFF
SCIENCE_BANKS, TELEMETRY_BANK, BANK_FILE = ("b05", "b06", "b07", "b08", "b09"), "b01", "FFFFFFFE"

#: Bytes of payload and rows of a batch of frames.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000

FRAME_SCHEMA = "stream_id string, bank string, frame_idx long, head binary, payload binary, reject string"


def read_banks(spark: SparkSession, folder: str) -> DataFrame:
    """stream_id (the folder of the banks), bank, content: one row per bank file below ``folder``; absent banks give none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", BANK_FILE).option("recursiveFileLookup", "true").load(folder)
    found = F.regexp_extract("path", rf"([^/]+)/(b\d\d)/{BANK_FILE}$", 1), F.regexp_extract("path", rf"/(b\d\d)/{BANK_FILE}$", 1)
    return files.select(found[0].alias("stream_id"), found[1].alias("bank"), "content").filter(F.col("bank").isin(*SCIENCE_BANKS, TELEMETRY_BANK))


def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 1021 from FFFF, high bit first."""
    return binascii.crc_hqx(data, CRC_START)


def _find_sync(stream: bytes, at: int) -> int:
    """The place behind the next sync word, between whose bytes padding may stand; -1 if there is none."""
    while (at := stream.find(SYNC[:1], at)) >= 0:
        at += 1
        rest = at
        while rest < len(stream) and stream[rest] == PADDING:
            rest += 1
        if stream[rest : rest + 1] == SYNC[1:]:
            return rest + 1
    return -1


def cut_frames(stream: bytes) -> Iterator[tuple[bytes, bytes, str | None]]:
    """(head, payload, reject) of each frame; reject is null, ``crc`` or ``tail``.

    A5 bytes between frames are skipped even inside the sync word; after a bad checksum the search goes on behind the
    frame, not inside it.
    """
    at = 0
    while (at := _find_sync(stream, at)) >= 0:
        head = stream[at : at + HEAD]
        size = int.from_bytes(head[4:6], "big") + 1 if len(head) == HEAD else 0
        body = stream[at + HEAD : at + HEAD + size + CRC_BYTES]
        if len(head) < HEAD or len(body) < size + CRC_BYTES:
            yield head, body, "tail"
            return
        at += HEAD + size + CRC_BYTES
        good = crc16(head + body[:size]) == int.from_bytes(body[size:], "big")
        yield head, body[:size], None if good else "crc"


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of all banks, in batches of their own: a small bank does not cost one, and a large one is several."""
    names = ["stream_id", "bank", "frame_idx", "head", "payload", "reject"]
    rows, held = [], 0
    for batch in batches:
        for stream, bank, content in batch[["stream_id", "bank", "content"]].itertuples(index=False):
            for k, f in enumerate(cut_frames(bytes(content or b""))):
                rows.append((stream, bank, k, *f))
                held += len(f[1])
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


def frames(banks: DataFrame) -> DataFrame:
    """Frames and rejects of each bank, with the header's fields as columns."""
    out = banks.select("stream_id", "bank", "content").mapInPandas(_frames, FRAME_SCHEMA)
    return header_fields(out, "head")


def header_fields(df: DataFrame, head: str) -> DataFrame:
    """Add the fields of the 6-byte big-endian header; all null where it is shorter."""
    word = lambda k: F.conv(F.hex(F.substring(head, 2 * k + 1, 2)), 16, 10).cast("int")
    h0, h1, h2 = (F.when(F.length(head) == HEAD, word(k)) for k in range(3))
    return df.withColumns(bit_fields(h0, h1, h2))


def bit_fields(h0, h1, h2) -> dict:
    """version, packet_type, secheaderflag, appid, groupflags, sequence_cnt, packetlen of the header's three words."""
    return {
        "version": F.shiftright(h0, 13).bitwiseAND(7), "packet_type": F.shiftright(h0, 12).bitwiseAND(1), "secheaderflag": F.shiftright(h0, 11).bitwiseAND(1),
        "appid": h0.bitwiseAND(2047), "groupflags": F.shiftright(h1, 14).bitwiseAND(3), "sequence_cnt": h1.bitwiseAND(16383), "packetlen": h2,
    }
