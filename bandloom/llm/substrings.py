"""Removal of repeated passages by level-wise doubling.

A window of ``n`` words (35) that repeats holds repeated windows of about n / 4 and n / 2 words. So short windows are
counted first, and only those that repeat are extended to twice their length, until the full length decides:

* level 1: the short windows at anchors. The anchor of a full window is the short window in it with the least hash, so
  equal full windows have the same anchor at the same place, and one position in about fourteen is an anchor;
* level 2: anchors that repeat, extended to twice their length to the right and to the left;
* level 3: the full windows around an extension that repeats. A window is dropped if its hash occurs once; what is
  left repeats, and its words go.

Texts of equal words form a class: only one of them goes through the levels, and all its words go if it has a window.
Nothing is paired: levels count hashes, so a passage in all documents costs what it costs in two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, in_batches
from .words import U, WORD_BASE, Words, mixed, ragged, slices, window_hashes

#: Rows of hashes or keys up to which a table is broadcast (8 to 16 bytes a row).
BROADCAST_KEYS = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()


def levels(n: int) -> tuple[int, int]:
    """Lengths of the first two levels for windows of ``n`` words: each is at least half of the next."""
    half = (n + 1) // 2
    return (half + 1) // 2, half


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values, by doubling."""
    f, have = (np.minimum if least else np.maximum), 1
    out = x
    while have < width:
        step = min(have, width - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(hashes: np.ndarray, n: int) -> np.ndarray:
    """Positions of the short windows that are the least in some window of ``n`` words of one document."""
    short = levels(n)[0]
    reach = n - short + 1
    at = np.arange(len(hashes) - short + 1)
    h = window_hashes(hashes, at, at + short, WORD_BASE)
    least = _sliding(h, reach, True)
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, reach, False) == h)


def _scan(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """uid, doc_id, th, n_words, class hashes, digest of all words, and of each anchor its place and three hashes."""
    one, two = levels(n)
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            h, ptr = words.hashes, words.ptr
            whole = window_hashes(h, ptr[:-1], ptr[1:], WORD_BASE)
            other = window_hashes(mixed(h ^ U(0x1234567)), ptr[:-1], ptr[1:], WORD_BASE)
            places, first, right, left = [], [], [], []
            for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
                if b - a < n:
                    q = np.zeros(0, np.int64)
                    d = h[:0]
                else:
                    d = h[a:b]
                    q = anchors(d, n)
                places.append(q.astype(np.int32))
                first.append(window_hashes(d, q, q + one, WORD_BASE))
                ok = q + two <= b - a
                right.append(np.where(ok, window_hashes(d, q, np.where(ok, q + two, q), WORD_BASE), U(0)))
                start = q + one - two
                left.append(np.where(start >= 0, window_hashes(d, np.maximum(start, 0), q + one, WORD_BASE), U(0)))
            shas = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("uid"), part.column("doc_id"), part.column("th"), pa.array(np.diff(ptr), pa.int64()), pa.array(whole.view(np.int64)), pa.array(other.view(np.int64)), pa.array(shas), *map(ragged, (places, first, right, left))],
                names=["uid", "doc_id", "th", "n_words", "a", "b", "sha", "place", "first", "right", "left"],
            )


def _candidates(ptr: np.ndarray, marks: pa.Array, n: int) -> list[np.ndarray]:
    """Of each row, the starts of windows of ``n`` words that hold a repeated extension. A mark is 2 * place + (1: left)."""
    one, two = levels(n)
    out = []
    lists = marks.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(marks.value_lengths().to_numpy(zero_copy_only=False))])
    for r, size in enumerate(np.diff(ptr).tolist()):
        m = lists[ends[r] : ends[r + 1]]
        q, is_left = m // 2, m % 2 == 1
        # The extension lies in the window: to the right [q, q + two), to the left [q + one - two, q + one).
        lo = np.maximum(np.where(is_left, q + one - n, q + two - n), 0)
        hi = np.minimum(np.where(is_left, q + one - two, q), size - n)
        edge = np.zeros(max(size - n, 0) + 2, np.int64)
        good = lo <= hi
        np.add.at(edge, lo[good], 1)
        np.add.at(edge, hi[good] + 1, -1)
        out.append(np.flatnonzero(np.cumsum(edge) > 0))
    return out


def _full(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            uid = part.column("uid").to_numpy()
            found = _candidates(words.ptr, part.column("marks"), n)
            at = np.concatenate([p + s for p, s in zip(found, words.ptr[:-1], strict=True)]).astype(np.int64)
            h = window_hashes(words.hashes, at, at + n, WORD_BASE)
            g = window_hashes(mixed(words.hashes ^ U(0x1234567)), at, at + n, WORD_BASE) & U(0x7FFFFFFF)
            places = np.concatenate(found).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.astype(np.int32)), pa.array(np.repeat(uid, [len(p) for p in found])), pa.array(places)], names=["h", "g", "uid", "place"])


def _removed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of each text, how many words go, and the words that stay, joined by a space."""
    for batch in batches:
        for part in slices(batch):
            texts = [(t or "").encode().split() for t in part.column("text").to_pylist()]
            ptr = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            counts, kept = [], []
            for words, starts, once in zip(texts, _candidates(ptr, part.column("marks"), n), part.column("once").to_pylist(), strict=True):
                starts = np.setdiff1d(starts, np.array(once or [], np.int64), assume_unique=True)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + n, -1)
                gone = np.cumsum(edge[:-1]) > 0
                counts.append(int(gone.sum()))
                kept.append(b" ".join(words[i] for i in np.flatnonzero(~gone)).decode())
            yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(counts, pa.int64()), pa.array(kept, pa.string())], names=["uid", "gone", "kept"])


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` occurs more than once."""
    twice = durable(rows.groupBy(key).count().filter("count > 1").select(key))
    few = twice.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(twice) if few else twice, key)


def _marks(base: DataFrame) -> DataFrame:
    """Levels 1 and 2: (uid, marks), for the base rows whose anchors are to be counted."""
    rows = base.select("uid", F.explode(F.arrays_zip("place", "first", "right", "left")).alias("x")).select("uid", "x.*")
    kept = durable(_repeated(rows, "first").drop("first"))
    sides = F.array(F.struct(F.col("right").alias("key"), (2 * F.col("place")).alias("mark")), F.struct(F.col("left").alias("key"), (2 * F.col("place") + 1).alias("mark")))
    longer = kept.select("uid", F.explode(sides).alias("x")).select("uid", "x.*").filter("key != 0")
    return _repeated(longer, "key").groupBy("uid").agg(F.collect_list("mark").alias("marks"))


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Join stored ``rows`` (doc_id, th, ...) to their texts; texts of no row are left out before the shuffle if the keys are few."""
    keys = rows.select("th").distinct()
    if rows.count() <= BROADCAST_KEYS:
        docs = docs.join(F.broadcast(keys), "th", "left_semi")
    rows = rows.withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th")
    return docs.join(rows, F.col("th").eqNullSafe(F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")))


def repeated_passages(docs: DataFrame, n: int = 35) -> tuple[DataFrame, DataFrame]:
    """(summary, texts): uid, doc_id, th, n_words, sha, whole (all words go) of each document, and uid, gone, kept of those
    that lose some but perhaps not all words. ``th`` is xxhash64 of the text."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    scanned = in_batches(
        docs.withColumn("uid", F.monotonically_increasing_id()), partial(_scan, n=n), "uid long, doc_id long, th long, n_words long, a long, b long, sha string, place array<int>, first array<long>, right array<long>, left array<long>"
    )
    base = durable(scanned)
    copies = durable(base.filter(F.col("n_words") >= n).groupBy("n_words", "a", "b").agg(F.min("uid").alias("rep"), F.count("*").alias("c")).filter("c > 1").drop("c"))
    few = copies.count() <= BROADCAST_KEYS
    classed = base.join(F.broadcast(copies) if few else copies, ["n_words", "a", "b"], "left")
    marks = _marks(classed.filter("rep is null or rep = uid"))
    marked = durable(marks.join(classed.select("uid", "doc_id", "th", F.col("rep").isNotNull().alias("whole")), "uid"))
    full = in_batches(_with_text(docs, marked).select("uid", "text", "marks"), partial(_full, n=n), "h long, g int, uid long, place int")
    once = full.groupBy("h", "g").agg(F.count("*").alias("c"), F.min("uid").alias("uid"), F.min("place").alias("place")).filter("c = 1")
    once = once.groupBy("uid").agg(F.collect_list("place").alias("once"))
    parts = durable(marked.filter("not whole").join(once, "uid", "left").drop("whole"))
    texts = in_batches(_with_text(docs, parts).select("uid", "text", "marks", "once"), partial(_removed, n=n), "uid long, gone long, kept string")
    return classed.select("uid", "doc_id", "th", "n_words", "sha", F.col("rep").isNotNull().alias("whole")), texts


def remove_repeated(docs: DataFrame, n: int = 35) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``n`` words covers it whose words also start anywhere else, the same document included;
    overlapping occurrences count. Null, empty and blank texts have no words and the digest of nothing; texts under
    ``n`` words stay whole; repeated rows are copies of each other, null ids included; other columns are ignored; an
    empty table gives no rows.
    """
    summary, texts = repeated_passages(docs, n)
    out = summary.join(texts.select("uid", "gone", F.sha2("kept", 256).alias("kept_sha")), "uid", "left")
    gone = F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long")
    sha = F.when(F.col("whole"), F.lit(NOTHING)).otherwise(F.coalesce("kept_sha", "sha"))
    return out.select("doc_id", "n_words", gone.alias("n_removed"), sha.alias("kept_sha256"))
