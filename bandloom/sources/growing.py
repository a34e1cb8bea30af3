"""Banks that are still being written, as a stream of bytes: a data source with one offset a file."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .banks import BANK_FILE, SCIENCE_BANKS, TELEMETRY_BANK
from .ranges import INDEX, Files, located

#: Bytes of a row, and chunks of an input partition at most.
CHUNK, MANY = 4 << 20, 4096


class BankBytes(DataSource):
    """``bank_bytes``: stream_id, bank, at (place of the first byte) and content of what was added to the bank files below
    ``path``. An offset is the length of every file; an input partition is CHUNK bytes of chunks, or one larger."""

    @classmethod
    def name(cls) -> str:
        return "bank_bytes"

    def schema(self) -> str:
        return "stream_id string, bank string, at long, content binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return BankReader(self.options["path"], int(self.options.get("chunkBytes", CHUNK)))


class BankReader(DataSourceStreamReader):
    def __init__(self, path: str, chunk: int):
        self.path, self.chunk = path, chunk

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, name = located(self.path)
        files = system.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in files if f.base_name == BANK_FILE and f.path.split("/")[-2] in (*SCIENCE_BANKS, TELEMETRY_BANK)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts, held = [], CHUNK
        for p, to in sorted(end.items()):
            for at in range(start.get(p, 0), to, self.chunk):
                if held >= CHUNK or len(parts[-1]) >= MANY:
                    parts.append([])
                    held = 0
                parts[-1].append((p, at, min(to, at + self.chunk)))
                held += parts[-1][-1][2] - at
        return [InputPartition(tuple(x)) for x in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system = located(self.path)[0]
        for path, some in itertools.groupby(partition.value, lambda c: c[0]):
            stream, bank = path.split("/")[-3:-1]
            with system.open_input_file(path) as f:
                for _, at, to in some:
                    yield stream, bank, at, f.read_at(to - at, at)


def packed_bytes(spark: SparkSession, folder: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """As ``bank_bytes``, of banks that ``sinks.write_packed_banks`` writes: what is new in its index is what was added. Offsets
    are those of the index's few files, however many banks there are."""
    stretches = spark.readStream.schema(INDEX).parquet(f"{folder}/index").filter(F.col("bank").isin(*SCIENCE_BANKS, TELEMETRY_BANK) & (F.col("size") > 0))
    cut = stretches.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk_bytes).cast("long"))))
    chunks = cut.select("stream_id", "bank", (F.col("at") + F.col("lo")).alias("at"), "path", (F.col("start") + F.col("lo")).alias("start"), F.least(F.lit(chunk_bytes), F.col("size") - F.col("lo")).cast("long").alias("size"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, names = Files(), ["stream_id", "bank", "at", "content"]
        for batch in batches:
            lo, held, content = 0, 0, []
            for path, start, size in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), batch["size"].to_pylist(), strict=True):
                content.append(files.get(path).read_at(size, start))
                held += size
                if held >= CHUNK or lo + len(content) == len(batch):
                    some = batch.slice(lo, len(content))
                    yield pa.RecordBatch.from_arrays([some["stream_id"], some["bank"], some["at"], pa.array(content, pa.binary())], names=names)
                    lo, held, content = lo + len(content), 0, []

    return chunks.mapInArrow(read, "stream_id string, bank string, at long, content binary")


def bank_bytes(spark: SparkSession, folder: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """The stream of what is added to the banks below ``folder``."""
    spark.dataSource.register(BankBytes)
    return spark.readStream.format("bank_bytes").option("path", folder).option("chunkBytes", chunk_bytes).load()
