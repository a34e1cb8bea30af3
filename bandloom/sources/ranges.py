"""Bank files read by many tasks: every bank is cut into byte ranges, and frames come out as if one task had read it.

Where a frame begins depends on all frames before it: a sync word may stand inside a payload, and a payload may lie across
a cut. So a range does not know where its first frame begins; it knows only once the range before it has told where its
last frame ends. Ranges are therefore first walked from their own beginnings at once, which reads lengths and no checksums
and tells of each where its first frame begins, where its last one ends and how many there are. Almost always the walk
that began at the cut has found the frames of the true walk: the search runs on to the next sync word. Where a frame of the
range before ends behind the first one found, or a walk began too far on, the range is walked again from the right place,
until none is left; each round sets at least the first wrong range of every bank right. Then the frames are read, each by
the range in which its sync word begins, with their numbers from the ranges' counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .banks import BANK_FILE, BATCH_ROWS, CRC_BYTES, HEAD, SCIENCE_BANKS, TELEMETRY_BANK, crc16, header_fields
from .folders import stored

#: The sync word, between whose bytes padding may stand, and a beginning of it that the data end with.
SYNC_WORD, OPEN_WORD = re.compile(rb"\xec\xa5*+\xa0"), re.compile(rb"\xec\xa5*+\Z")
#: Bytes of a range, bytes read beyond what is asked for, bytes of payload of a batch of frames, and tasks for a small bank.
RANGE, AHEAD, BATCH, TASKS = 32 << 20, 1 << 17, 4 << 20, 8
#: Small ranges that one task reads, and files that a task holds open.
SMALL, OPEN = 1 << 16, 64
#: The table of banks packed into files, as ``sinks.write_packed_banks`` writes it.
INDEX = "stream_id string, bank string, at long, path string, start long, size long"


def located(path: str) -> tuple:
    """(file system, path in it) of a Hadoop path, as Arrow opens it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


class Files:
    """The files that a task reads, open while it has few of them."""

    def __init__(self):
        self.open: dict = {}

    def get(self, path: str):
        if path not in self.open:
            if len(self.open) >= OPEN:
                for f in self.open.values():
                    f.close()
                self.open.clear()
            system, name = located(path)
            self.open[path] = system.open_input_file(name)
        return self.open[path]


class Bytes:
    """A bank, which begins at ``start`` of its file, of which a stretch is held, that grows as more is asked for."""

    def __init__(self, file, start: int, at: int, size: int):
        self.file, self.start, self.base, self.size, self.data = file, start, at, size, b""

    def load(self, to: int) -> None:
        """Hold what lies before ``to``."""
        have = self.base + len(self.data)
        if to > have < self.size:
            self.data += self.file.read_at(min(self.size, to + AHEAD) - have, self.start + have)

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes, fewer where the file ends."""
        self.load(at + n)
        return self.data[at - self.base : at - self.base + n]

    def sync(self, at: int, stop: int) -> tuple[int, int] | None:
        """Where the next sync word that begins in [at, stop) begins and ends."""
        while at < stop:
            self.load(stop)
            found = SYNC_WORD.search(self.data, at - self.base)
            if found:
                begins = self.base + found.start()
                return (begins, self.base + found.end()) if begins < stop else None
            cut = OPEN_WORD.search(self.data, at - self.base)
            if cut is None or self.base + cut.start() >= stop or self.base + len(self.data) >= self.size:
                return None
            at = self.base + cut.start()
            self.load(self.base + len(self.data) + 1)
        return None


def walk(data: Bytes, entry: int, stop: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(place of the sync word, place of the head, end, head, body with checksum) of the frames that begin in [entry, stop).
    The file's end cuts the last one short; its end is then one past the file's, since nothing follows it."""
    at = entry
    while (found := data.sync(at, stop)) is not None:
        begins, head_at = found
        head = data.get(head_at, HEAD)
        n = int.from_bytes(head[4:6], "big") + 1 + CRC_BYTES if len(head) == HEAD else 0
        body = data.get(head_at + HEAD, n) if n else b""
        at = head_at + HEAD + n if n and len(body) == n else data.size + 1
        yield begins, head_at, at, head, body


def bank_ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """path, start (0: a file is a bank), stream_id, bank, size, lo, hi: the byte ranges of every bank file below ``folder``;
    only names and lengths are read. Empty files have none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", BANK_FILE).option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    name = lambda i: F.regexp_extract("path", rf"([^/]+)/(b\d\d)/{BANK_FILE}$", i)
    banks = files.select("path", name(1).alias("stream_id"), name(2).alias("bank"), "size").filter(F.col("bank").isin(*SCIENCE_BANKS, TELEMETRY_BANK) & (F.col("size") > 0))
    return _ranges(banks.withColumn("start", F.lit(0).cast("long")), range_bytes)


def packed_ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """As ``bank_ranges``, of banks that ``sinks.write_packed_banks`` wrote, each as one stretch."""
    banks = spark.read.schema(INDEX).parquet(f"{folder}/index").select("path", "start", "stream_id", "bank", "size")
    return _ranges(banks.filter(F.col("bank").isin(*SCIENCE_BANKS, TELEMETRY_BANK) & (F.col("size") > 0)), range_bytes)


def _ranges(banks: DataFrame, range_bytes: int) -> DataFrame:
    cut = banks.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))))
    return cut.withColumn("hi", F.least("size", F.col("lo") + range_bytes)).select("path", "start", "stream_id", "bank", "size", "lo", "hi")


_WALKED = "path string, start long, stream_id string, bank string, size long, lo long, hi long, entry long, first long, leaves long, n long"


def _walked(ranges: DataFrame) -> DataFrame:
    """Add first (where the first frame's sync word begins), leaves (the end of the last one, or the entry) and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                first, leaves, n = None, r["entry"], 0
                for begins, _, end, _, _ in walk(Bytes(files.get(r["path"]), r["start"], r["entry"], r["size"]), r["entry"], r["hi"]):
                    first, leaves, n = begins if first is None else first, end, n + 1
                rows.append(r | {"first": first, "leaves": leaves, "n": n})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _WALKED.split(", ")]))

    return ranges.select("path", "start", "stream_id", "bank", "size", "lo", "hi", "entry").mapInArrow(run, _WALKED)


def _apart(ranges: DataFrame) -> DataFrame:
    """A task for each RANGE of bytes or SMALL ranges; rows are small, what they name is not. Less is read by a few tasks."""
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0))).first()
    return ranges.repartition(max(1, min(n, TASKS), size // RANGE, n // SMALL))


def resolved(ranges: DataFrame) -> DataFrame:
    """The stored table of ``ranges`` with entry (where the true walk enters), n (its frames) and before (the frames of the
    bank's ranges before it)."""
    told = stored(_walked(_apart(ranges.withColumn("entry", F.col("lo")))))
    earlier = Window.partitionBy("path", "start").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        placed = told.withColumn("due", F.greatest("lo", F.coalesce(F.max("leaves").over(earlier), F.lit(0))))
        # Nothing lies between an entry and the first frame found from it.
        wrong = (F.col("due") < F.col("entry")) | ((F.col("due") > F.col("entry")) & F.coalesce(F.col("first") < F.col("due"), F.lit(False)))
        placed = placed.withColumn("wrong", wrong)
        again = stored(placed.filter("wrong"))
        if again.isEmpty():
            counted = placed.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
            return counted.select("path", "start", "stream_id", "bank", "size", "lo", "hi", F.greatest("entry", "due").alias("entry"), "n", "before")
        # A range that is wholly inside a frame is entered at its end.
        once_more = _walked(_apart(again.withColumn("entry", F.col("due"))))
        told = stored(placed.filter("not wrong").select(*told.columns).unionByName(once_more))


def range_frames(ranges: DataFrame) -> DataFrame:
    """Frames and rejects as ``banks.frames`` gives them for whole banks, number for number, of ``ranges`` as ``bank_ranges``
    makes them. A task holds one range and the frame that leaves it, whatever a bank's size."""
    schema = "stream_id string, bank string, frame_idx long, head binary, payload binary, reject string"
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        files, rows, held = Files(), [], 0
        for batch in batches:
            for r in batch.to_pylist():
                for k, (_, _, end, head, body) in enumerate(walk(Bytes(files.get(r["path"]), r["start"], r["entry"], r["size"]), r["entry"], r["hi"])):
                    if end > r["size"]:
                        payload, reject = body, "tail"
                    else:
                        payload, good = body[:-CRC_BYTES], crc16(head + body[:-CRC_BYTES]) == int.from_bytes(body[-CRC_BYTES:], "big")
                        reject = None if good else "crc"
                    rows.append((r["stream_id"], r["bank"], r["before"] + k, head, payload, reject))
                    held += len(payload)
                    if held >= BATCH or len(rows) >= BATCH_ROWS:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)

    # A bank of one range is entered at its beginning; only the others must tell one another where they enter.
    alone = (F.col("lo") == 0) & (F.col("hi") == F.col("size"))
    columns = ["path", "start", "stream_id", "bank", "size", "hi", "entry", "before"]
    zero = F.lit(0).cast("long")
    whole = ranges.filter(alone).withColumns({"entry": zero, "before": zero}).select(columns)
    cut = ranges.filter(~alone)
    filled = whole if cut.isEmpty() else whole.unionByName(resolved(cut).filter("n > 0").select(columns))
    return header_fields(_apart(filled.withColumn("lo", F.col("entry"))).mapInArrow(run, schema), "head")
