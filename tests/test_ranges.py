"""Banks in byte ranges, and banks that grow, against whole banks read by one task."""

import random

import pytest
from pyspark.sql import functions as F

from bandloom.sources import banks, growing, ranges, sinks
from bandloom.streaming import ordered, streams


def frame(body, good=True, seq=0):
    head = (0x209).to_bytes(2, "big") + (3 << 14 | seq).to_bytes(2, "big") + (len(body) - 1).to_bytes(2, "big")
    return banks.SYNC + head + body + (banks.crc16(head + body) ^ (0 if good else 1)).to_bytes(2, "big")


def stream(seed, n=60):
    """Frames with sync words and parts of frames inside payloads, padding everywhere, bad checksums and a cut end."""
    rng = random.Random(seed)
    out = b""
    for k in range(n):
        body = bytes(rng.choice([0xEC, 0xA0, 0xA5, 0, 1, 7]) for _ in range(rng.randint(1, 90)))
        if rng.random() < 0.3:
            body += frame(b"inner" * rng.randint(1, 4))[: rng.randint(3, 30)]
        made = frame(body, rng.random() < 0.8, k)
        if rng.random() < 0.2:
            made = b"\xec" + b"\xa5" * rng.randint(1, 40) + made[1:]
        out += bytes(rng.choice([0xA5, 0xEC, 0x33]) for _ in range(rng.choice([0, 0, 1, 5, 60]))) + made
    return out + (frame(b"x" * 50)[: rng.randint(0, 57)] if seed % 2 else b"") + (b"\xec\xa5\xa5" if seed % 3 == 0 else b"")


def write(folder, contents):
    for name, content in contents.items():
        place = folder / name / "b05"
        place.mkdir(parents=True, exist_ok=True)
        (place / banks.BANK_FILE).write_bytes(content)


def rows(df):
    return sorted((r.stream_id, r.frame_idx, bytes(r.head), bytes(r.payload), r.reject) for r in df.collect())


@pytest.mark.parametrize("size", [90, 1000, 1 << 20])
def test_ranges_give_the_frames_of_whole_banks(spark, tmp_path, size):
    contents = {f"s{k}": stream(k, 25) for k in range(4)} | {"empty": b"", "none": b"\xa5" * 300, "open": b"\xec" + b"\xa5" * 200, "inside": frame(frame(b"abc") * 40) + frame(b"last")}
    write(tmp_path, contents)
    want = sorted((s, k, h, p, r) for s, c in contents.items() for k, (h, p, r) in enumerate(banks.cut_frames(c)))
    found = ranges.bank_ranges(spark, str(tmp_path), size)
    assert rows(ranges.range_frames(found)) == want
    assert found.count() == sum(-(-len(c) // size) for c in contents.values())


def test_a_bank_of_many_ranges_is_read_by_many_tasks(spark, tmp_path):
    write(tmp_path, {"s": b"".join(frame(bytes([k % 256]) * 2000, seq=k % 16384) for k in range(3000))})
    got = ranges.range_frames(ranges.bank_ranges(spark, str(tmp_path), 1 << 19))
    assert got.withColumn("task", F.spark_partition_id()).select("task").distinct().count() >= 8
    assert got.agg(F.count("*"), F.count_distinct("frame_idx"), F.max("frame_idx")).first()[:] == (3000, 3000, 2999)


def test_banks_that_grow(spark, tmp_path):
    """Pieces are added between runs that restart from the checkpoint; nothing is lost, nothing comes twice."""
    streams.with_rocksdb(spark)
    whole = {f"s{k}": stream(2 * k + 2) for k in range(3)}
    folder, out = tmp_path / "banks", tmp_path / "out"
    for part in (0.3, 0.31, 0.8, 1.0):
        write(folder, {s: c[: int(len(c) * part)] for s, c in whole.items()})
        q = ordered.growing_frames(growing.bank_bytes(spark, str(folder), 100)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    want = sorted((s, k, h, p, r) for s, c in whole.items() for k, (h, p, r) in enumerate(banks.cut_frames(c)) if r != "tail")
    assert rows(spark.read.parquet(str(out))) == want


@pytest.mark.parametrize("size", [90, 1 << 20])
def test_packed_banks_give_the_frames_of_whole_banks(spark, tmp_path, size):
    """Many banks are few files, read in ranges as if each were one."""
    contents = {f"s{k}": stream(k, 12) for k in range(40)} | {"empty": b"", "open": b"\xec" + b"\xa5" * 200, "inside": frame(frame(b"abc") * 40) + frame(b"last")}
    made = spark.createDataFrame([(s, "b05", bytearray(c)) for s, c in contents.items()], "stream_id string, bank string, content binary").coalesce(2)
    sinks.write_packed_banks(made, str(tmp_path))
    assert len(list((tmp_path / "bytes").iterdir())) == 2
    want = sorted((s, k, h, p, r) for s, c in contents.items() for k, (h, p, r) in enumerate(banks.cut_frames(c)))
    assert rows(ranges.range_frames(ranges.packed_ranges(spark, str(tmp_path), size))) == want


def test_packed_banks_that_grow(spark, tmp_path):
    """Stretches are added to many banks between runs; chunks cut through frames."""
    streams.with_rocksdb(spark)
    whole = {f"s{k}": stream(2 * k + 2, 9) for k in range(30)}
    for lo, hi in ((0.0, 0.4), (0.4, 1.0)):
        part = [(s, "b05", int(len(c) * lo), bytearray(c[int(len(c) * lo) : int(len(c) * hi)])) for s, c in whole.items()]
        folder = tmp_path / f"part{lo}"
        sinks.write_packed_banks(spark.createDataFrame(part, "stream_id string, bank string, at long, content binary").coalesce(1), str(folder))
        at = spark.createDataFrame([p[:3] for p in part], "stream_id string, bank string, at long")
        spark.read.parquet(str(folder / "index")).drop("at").join(at, ["stream_id", "bank"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "index"))
        q = ordered.growing_frames(growing.packed_bytes(spark, str(tmp_path), 100)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    want = sorted((s, k, h, p, r) for s, c in whole.items() for k, (h, p, r) in enumerate(banks.cut_frames(c)) if r != "tail")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == want


def test_small_chunks_share_an_input_partition(tmp_path):
    """A thousand banks of a few bytes were a thousand tasks."""
    write(tmp_path, {f"s{k}": b"abcdefgh" for k in range(1000)})
    reader = growing.BankReader(str(tmp_path), 3)
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) == 1 and len(parts[0].value) == 3000
    assert sorted(b for p in parts for *_, b in reader.read(p)) == sorted([b"abc", b"def", b"gh"] * 1000)
