"""What several corpus operators share: durable tables, size-checked broadcasts, distributed ranks."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import shared_folder

#: Characters that separate words, as the body of a regular-expression class, and a word.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch of rows that goes to Python.
BATCH_BYTES = 4 << 20

#: Rows up to which a table of a few narrow columns is broadcast.
BROADCAST_ROWS = 4096

#: Rows up to which Spark may choose to broadcast a table of a few narrow columns by itself.
OWN_CHOICE_ROWS = 1 << 14


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: later work neither repeats it nor loses it with an
    executor. Parquet keeps it smaller than a checkpoint of rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/bandloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@functools.lru_cache(maxsize=1)
def _system() -> Callable[[int], int] | None:
    """Arrow on the system's allocator in this process, and the call that gives free memory back, where there is one."""
    pa.set_memory_pool(pa.system_memory_pool())
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Free memory goes back to the machine: what one batch of texts needed must not stay with each Python worker."""
    if (trim := _system()) is not None:
        trim(0)


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` on batches of about BATCH_BYTES: what a task holds of its rows outside Spark's own memory. The
    session keeps this limit unless it had a lower one."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    had = conf.get(name, None)
    if had is None or not had.rstrip("bB").lstrip("-").isdigit() or not 0 < int(had.rstrip("bB")) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            give_back()

    return df.mapInArrow(lambda batches: run(lean(batches)), schema)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``durable`` wrote and that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/bandloom/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are few; else leave the join to shuffle, where skew is split at run time."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unsent(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` for a join that shuffles both sides. By the size of its files Spark would broadcast ``df``, and so hold it in
    the driver, where hashed rows of a few numbers take ten times the room of their files. Few ``rows`` are left to Spark."""
    return df if rows is not None and rows < OWN_CHOICE_ROWS else df.hint("merge")


def spread(h: Column, buckets: int) -> Column:
    """The bucket, 0 to ``buckets`` - 1, of a signed 64-bit hash; it rises with the hash."""
    unit = (h.cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    return F.least(F.lit(buckets - 1), F.floor(unit * buckets)).cast("int")


def running(df: DataFrame, keys: list[str], bucket: str, order: list, weight: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows of the same ``keys`` that come before in (``bucket``, ``order``).

    ``bucket`` must rise with ``order``. Only the buckets' sums meet per key, so no task gets all rows of a hot key.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(base, [*keys, bucket])
        .withColumn(name, F.col("_base") + F.col("_in"))
        .drop("_base", "_in")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")
