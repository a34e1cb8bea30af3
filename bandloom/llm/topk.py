"""Exact top-k inner products by pivot-table elimination.

Distances of every vector to a few pivots are computed once. By the triangle inequality a query q and a candidate x are
at least max_p |d(q, p) - d(x, p)| apart, which bounds their inner product, (|q|^2 + |x|^2 - d(q, x)^2) / 2, from above.
Candidates are evaluated in the order of this bound and evaluation stops when the next bound is below the k-th score
found, so the result is exact.

Vectors lie in blocks around their nearest pivot. A query first searches its own block; its k-th score there goes along
when blocks of queries meet the other blocks of candidates, most of which then evaluate little and return nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, forget

#: Pivots (drawn by hash, so of any large table alike), rows of a block on average, and candidates evaluated first.
PIVOTS, BLOCK, QUERIES, STEP = 24, 2048, 1024, 64
#: Lengths of vectors that one table may mix; each is searched by jobs of its own.
MOST_SIZES = 64


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component as double; vectors that are null or hold null or non-finite
    components, and rows without a vec_id, are left out."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(v, bad)
    return vectors.filter(good).select("vec_id", F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T, 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    return np.array(column.combine_chunks().flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def search(q: np.ndarray, dq: np.ndarray, least: np.ndarray, own: np.ndarray, x: np.ndarray, dx: np.ndarray, ids: np.ndarray, k: int):
    """Per query the (score, id) of the best ``k`` candidates, of those with a score of at least ``least``; ``own`` is the
    id that a query may not return."""
    half = (x**2).sum(1) / 2
    reach = sqrt(2 * half.max()) if len(x) else 0.0
    for row in range(len(q)):
        apart = np.abs(dx - dq[row]).max(axis=1) if len(x) else np.zeros(0)
        # Distances carry rounding errors far below 1e-6 of the vectors' sizes.
        apart = np.maximum(apart - 1e-6 * (1 + dq[row].max() + reach), 0)
        bound = (q[row] ** 2).sum() / 2 + half - apart**2 / 2
        order = np.argsort(-bound)
        best: list[tuple[float, int]] = []
        floor_ = float(least[row])
        s, step = 0, STEP
        while s < len(order):
            some = order[s : s + step]
            # Where bounds say little, ever more candidates are evaluated at once.
            s, step = s + step, 2 * step
            if bound[some[0]] < floor_ - 1e-3:
                break
            scores = x[some] @ q[row]
            got = [(-sc, i) for sc, i in zip(scores.tolist(), ids[some].tolist(), strict=True) if sc >= floor_ and i != own[row]]
            if got:
                best = sorted(best + got)[:k]
                if len(best) == k:
                    floor_ = max(floor_, -best[-1][0])
        yield [(-s, i) for s, i in best]


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` greatest inner products of each query with all other rows, ties to
    the smaller vec_id. Queries are the rows whose vec_id is divisible by ``every``.

    Components are floor(256 * x). Rows left out by ``quantised`` take no part; vectors meet those of their own length;
    rows that bear a query's vec_id count as its own; rows that repeat one count once, and of rows that bear one vec_id with
    different vectors each pair's best score counts; empty vectors have nothing to multiply and take no part; fewer rows than ``k`` give as many; an empty table gives no rows;
    other columns are ignored. Squared lengths from 2^53 on, more than 64 different lengths raise.
    """
    spark = vectors.sparkSession
    table = durable(quantised(vectors).withColumn("size", F.size("v")).filter("size > 0").distinct())
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    if (table.agg(F.max(square)).first()[0] or 0.0) >= 2.0**53:
        raise ArithmeticError("inner products of these vectors exceed what doubles hold exactly")
    sizes = [r[0] for r in table.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").limit(MOST_SIZES + 1).collect()]
    if len(sizes) > MOST_SIZES:
        raise ValueError(f"vectors of more than {MOST_SIZES} different lengths")
    parts = [_of_one_size(table.filter(F.col("size") == s), every, k) for s in sizes]
    schema = "query_id long, rank int, vec_id long, score long"
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def _of_one_size(table: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, vec_id, score: candidates for the top ``k`` of each query."""
    pivots = np.array([r["v"] for r in table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(pa.chunked_array([batch.column("v")])), pivots)
                cols = [batch.column("vec_id"), batch.column("v"), pa.array(list(d), pa.list_(pa.float64())), pa.array(d.argmin(1), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "d", "pivot"])

    measured = table.select("vec_id", "v").mapInArrow(measure, "vec_id long, v array<double>, d array<double>, pivot int")
    measured = durable(measured)
    blocks = measured.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("n"))
    # One row per pivot, so at most PIVOTS.
    placed = measured.join(F.broadcast(blocks), "pivot").withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int")).drop("n")
    placed = durable(placed)
    forget(measured)

    def at_home(t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        ask = np.flatnonzero(ids % every == 0)
        x, d = _matrix(t.column("v")), _matrix(t.column("d"))
        rows = [(int(ids[a]), i, int(s)) for a, got in zip(ask, search(x[ask], d[ask], np.full(len(ask), -np.inf), ids[ask], x, d, ids, k), strict=True) for s, i in got]
        return _answer(rows)

    home = durable(placed.groupBy("pivot", "sub").applyInArrow(at_home, "query_id long, vec_id long, score long"))
    least = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).withColumnRenamed("query_id", "vec_id")
    queries = placed.filter(F.col("vec_id") % every == 0).join(least, "vec_id", "left")
    n_queries = max(1, -(-queries.count() // QUERIES))
    all_blocks = placed.select("pivot", "sub").distinct()
    chunk = F.pmod(F.xxhash64("vec_id", F.lit("chunk")), F.lit(n_queries)).cast("int")
    kept = ["vec_id", "v", "d", F.coalesce("least", F.lit(float("-inf"))).cast("double").alias("least"), F.col("pivot").alias("own_pivot"), F.col("sub").alias("own_sub")]
    asked = queries.select(chunk.alias("chunk"), *kept)
    targets = all_blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    asked = asked.join(targets, "chunk").withColumn("side", F.lit(0))
    offered = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    offered = offered.select("chunk", "vec_id", "v", "d", F.lit(0.0).alias("least"), F.col("pivot").alias("own_pivot"), F.col("sub").alias("own_sub"), "pivot", "sub", F.lit(1).alias("side"))

    def abroad(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        ids, least_ = t.column("vec_id").to_numpy(), t.column("least").to_numpy()
        at_home_ = (t.column("own_pivot").to_numpy() == t.column("pivot").to_numpy()) & (t.column("own_sub").to_numpy() == t.column("sub").to_numpy())
        x, d = _matrix(t.column("v")), _matrix(t.column("d"))
        a, b = np.flatnonzero((side == 0) & ~at_home_), np.flatnonzero(side == 1)
        rows = [(int(ids[q]), i, int(s)) for q, got in zip(a, search(x[a], d[a], least_[a], ids[a], x[b], d[b], ids[b], k), strict=True) for s, i in got]
        return _answer(rows)

    met = asked.unionByName(offered).groupBy("chunk", "pivot", "sub").applyInArrow(abroad, "query_id long, vec_id long, score long")
    return home.union(met)


def _answer(rows: list[tuple[int, int, int]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})
