"""Hard negatives by slot-decomposed selection.

A positive of an anchor admits the rows of other labels whose score lies in a window under its own score. The windows of an
anchor's positives overlap; their upper limits, in descending order, cut the scores into disjoint slots. Only the best k of
each slot are kept, first inside a block of rows, then over all of them. The window of positive i begins with slot i and
takes in all the lower ones, so its best k are the best k of slot i merged with those of the window below it: one pass
over the slots from the lowest to the highest answers every window. Lower limits are applied last, since they only ever
cut the end of a descending list.

Anchors meet rows in blocks: rows are dealt by hash into blocks of a bounded number of bytes and stay there, anchors are
sent to every block, and a task holds one block while the anchors stream by. What is shuffled is the table once, and each
anchor once per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, forget, in_batches

#: Bytes of a block of vectors and of the scores that are looked at together; blocks that a small table has at least.
BLOCK_BYTES, SCORE_BYTES, BLOCKS = 32 << 20, 16 << 20, 64
#: Least number of rows for which a small table gets one more block.
ROWS = 256

_MET = "size int, block int, side int, uid long, vec_id long, label long, v array<long>, uppers array<long>, least long"


def usable(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label, v (floor(scale * x) of each component as double), size; rows with a null id, label or vector, or with
    a null or non-finite component, take no part, and rows that agree in all of these count once."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(v, bad)
    whole = F.transform(v, lambda x: F.floor(x * scale))
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v")).distinct().withColumn("size", F.size("v"))


class _Block:
    """Rows of one block, by vec_id, and scores of anchors against them."""

    def __init__(self, parts: list[tuple], exact: type):
        ids = np.concatenate([p[0] for p in parts])
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.label = np.concatenate([p[1] for p in parts])[order]
        self.v = np.concatenate([p[2] for p in parts])[order].astype(exact)

    def scores(self, anchors: np.ndarray) -> Iterator[np.ndarray]:
        step = max(1, SCORE_BYTES // (8 * max(1, len(self.ids))))
        for k in range(0, len(anchors), step):
            yield from (anchors[k : k + step].astype(self.v.dtype) @ self.v.T).astype(np.int64)


def _best(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Of the rows ``among`` (ascending, hence by vec_id), the first ``k`` by score, ties by vec_id."""
    if len(among) > k:
        s = scores[among]
        among = among[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return among[np.argsort(-scores[among], kind="stable")][:k]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The parts of a batch that have the same size, block and side."""
    if not batch.num_rows:
        return
    keys = np.stack([batch.column(c).to_numpy() for c in ("size", "block", "side")], axis=1)
    cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def _arrays(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = part.column("v").flatten().to_numpy(zero_copy_only=False) if size else np.zeros(0, np.int64)
    return part.column("vec_id").to_numpy(), part.column("label").to_numpy(), flat.reshape(part.num_rows, size)


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, exact: type, pick: Callable, schema: str) -> DataFrame:
    """What ``pick(block, anchors' part, scores)`` yields for each anchor in each block of rows of its vectors' length."""
    none = [F.lit(None).cast("array<long>").alias("uppers"), F.lit(None).cast("long").alias("least")]
    block = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block")
    a = rows.select("size", block, F.lit(0).alias("side"), "uid", "vec_id", "label", "v", *none)
    b = anchors.select("size", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "uid", "vec_id", "label", "v", "uppers", "least")
    both = a.unionByName(b).repartition("size", "block").sortWithinPartitions("size", "block", "side")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            for (size, number, side), part in _runs(batch):
                if (size, number) != at:
                    at, held, block = (size, number), [], None
                if side == 0:
                    held.append(_arrays(part, size))
                    continue
                if not held and block is None:
                    continue
                if block is None:
                    block, held = _Block(held, exact), []
                found = list(pick(block, part, block.scores(_arrays(part, size)[2])))
                cols = list(zip(*found, strict=True)) if found else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in cols], names=names)

    return in_batches(both.select(*[c.split()[0] for c in _MET.split(", ")]), run, schema)


def _positives(k: int) -> Callable:
    def pick(block: _Block, part: pa.RecordBatch, scores: Iterator[np.ndarray]) -> Iterator[tuple]:
        for uid, own, label, s in zip(part.column("uid").to_pylist(), part.column("vec_id").to_pylist(), part.column("label").to_pylist(), scores, strict=True):
            best = _best(s, np.flatnonzero((block.label == label) & (block.ids != own)), k)
            yield np.full(len(best), uid), block.ids[best], s[best]

    return pick


def _negatives(k: int) -> Callable:
    def pick(block: _Block, part: pa.RecordBatch, scores: Iterator[np.ndarray]) -> Iterator[tuple]:
        cols = [part.column(c).to_pylist() for c in ("uid", "vec_id", "label", "uppers", "least")]
        for uid, own, label, uppers, least, s in zip(*cols, scores, strict=True):
            among = np.flatnonzero((s >= least) & (s <= uppers[0]) & (block.label != label) & (block.ids != own))
            # Limits descend: a score's slot is the number of limits that it does not exceed.
            slot = len(uppers) - np.searchsorted(np.array(uppers[::-1]), s[among], side="left")
            for j in range(1, len(uppers) + 1):
                best = _best(s, among[slot == j], k)
                yield np.full(len(best), uid), np.full(len(best), j), block.ids[best], s[best]

    return pick


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each key by score, ties by vec_id, as ``place`` from 1."""
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)


def _windows(k: int) -> Column:
    """(i, the window's best) of each positive i of ``pos``: suffix merges of ``slots`` from the lowest up."""
    best = "array<struct<down:bigint,vec_id:bigint>>"
    start = F.struct(F.array().cast(best).alias("window"), F.array().cast(f"array<struct<i:int,best:{best}>>").alias("told"))
    of_slot = lambda i: F.transform(F.filter("slots", lambda x: x["slot"] == i), lambda x: F.struct((-x["score"]).alias("down"), x["vec_id"].alias("vec_id")))

    def merge(acc: Column, i: Column) -> Column:
        # All of slot i lies above the window below it.
        window = F.slice(F.concat(F.array_sort(of_slot(i)), acc["window"]), 1, k)
        low = F.element_at(F.col("pos"), i)["lower"]
        return F.struct(window.alias("window"), F.concat(acc["told"], F.array(F.struct(i.alias("i"), F.filter(window, lambda x: -x["down"] >= low).alias("best")))).alias("told"))

    return F.aggregate(F.sequence(F.size("pos"), F.lit(1), F.lit(-1)), start, merge, lambda acc: acc["told"])


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``; scores are inner products of floor(256 * x). An anchor's
    positives are its first ``positives`` other rows of its label; for each, the first ``k`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, ties by vec_id.

    Rows left out by ``usable`` take no part, rows repeated whole count once, and a row that bears the anchor's vec_id is
    never its positive or negative; of rows that share a vec_id with different vectors or labels, each is a row and, if
    the id is an anchor's, an anchor of its own, whose results follow under the same id. Vectors meet those of their own
    length; empty ones score 0. Anchors without positives, and positives without negatives or with a negative score (whose
    window is empty), have no rows; an empty table gives none; other columns are ignored. Vectors whose squared length does
    not fit a long raise, as their scores would not fit either.
    """
    table = durable(usable(vectors).withColumn("uid", F.monotonically_increasing_id()))
    square = F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda t, x: t + x * x)
    n, most, wide = table.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0.0)), F.coalesce(F.max("size"), F.lit(0))).first()
    if most >= 2.0**63:
        raise ArithmeticError("scores of these vectors do not fit a long")
    # Sums of doubles are exact below 2^53, those of longs below 2^63.
    exact = np.float64 if most < 2.0**53 else np.int64
    blocks = max(1, min(BLOCKS, n // ROWS), -(-n * 8 * wide // BLOCK_BYTES))
    anchors = table.filter(F.col("vec_id") % every == 0).select("size", "uid", "vec_id", "label", "v")
    plain = anchors.select("*", F.lit(None).cast("array<long>").alias("uppers"), F.lit(None).cast("long").alias("least"))
    near = _meet(table, plain, blocks, exact, _positives(positives), "uid long, vec_id long, score long")
    first = _first(near, ["uid"], positives).filter("score >= 0")
    # Whole numbers: score * high div 100 for scores from 0 on, and the same rounded up for the lower limit.
    lower, upper = F.expr(f"(score div 100) * {low} + ((score % 100) * {low} + 99) div 100"), F.expr(f"(score div 100) * {high} + (score % 100) * {high} div 100")
    limits = F.struct("place", "vec_id", "score", lower.alias("lower"), upper.alias("upper"))
    of_anchor = durable(first.groupBy("uid").agg(F.array_sort(F.collect_list(limits)).alias("pos")).withColumns({"uppers": F.transform("pos", lambda x: x["upper"]), "least": F.array_min(F.transform("pos", lambda x: x["lower"]))}))
    told = durable(anchors.join(of_anchor, "uid"))
    found = _meet(table, told, blocks, exact, _negatives(k), "uid long, slot long, vec_id long, score long")
    slots = _first(found, ["uid", "slot"], k).groupBy("uid").agg(F.collect_list(F.struct("slot", "score", "vec_id")).alias("slots"))
    each = told.select("uid", F.col("vec_id").alias("anchor_id"), "pos").join(slots, "uid").select("anchor_id", "pos", F.explode(_windows(k)).alias("w"))
    each = each.select("anchor_id", F.element_at("pos", F.col("w.i")).alias("p"), F.posexplode("w.best").alias("at", "x"))
    out = durable(each.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), (-F.col("x.down")).alias("negative_score")))
    for done in (table, of_anchor, told):
        forget(done)
    return out
