"""Near-duplicate vectors by collision-counting projections.

Unit vectors at cosine c are sqrt(2 - 2 c) apart, so on a random unit direction their projections lie apart by that
distance times one coordinate of a random unit vector, about distance / sqrt(dimension). A window of one such deviation
to each side of a query's projection catches a linked pair with a probability of 0.68 and an unrelated one far more
rarely; over many projections the number of windows in which a pair collides separates the two. Pairs that reach a count
calibrated to RECALL are verified by their cosine in double precision.

Which pairs are counted: several tables cut further projections into strips, ten deviations wide and randomly shifted,
and the strips of a table's projections together name a cell. Only vectors that share a cell in some table meet. The more
vectors a label has, the more projections a cell takes, so that cells stay small, and the tables are as many as recall
needs: a pair at the threshold shares no cell at all with a probability below 1 - RECALL. A pair is counted in the first
table in which it shares a cell. Small cells are worked on many at a time, large ones as pairs of blocks, so no task gets
more than two blocks of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, exp, lgamma, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import durable, forget
from .words import U, mixed

#: Projections, windows' half-widths and cells' strips in deviations, and the probability that a linked pair is counted;
#: the same one that it shares a cell.
PROJECTIONS, WIDTH, STRIP, RECALL = 32, 1.0, 10.0, 0.99999
#: Vectors of a block of a large cell, and about as many rows of small cells worked on at once.
BLOCK, BATCH = 1024, 4096
#: Pairs whose windows are compared at once.
PAIRS = 1 << 16


@lru_cache(maxsize=16)
def directions(size: int, count: int = PROJECTIONS, seed: int = 20240607) -> np.ndarray:
    """(size, count) unit vectors, the same everywhere."""
    a = np.random.default_rng(seed).normal(size=(size, count))
    return a / np.linalg.norm(a, axis=0)


@lru_cache(maxsize=16)
def inside(size: int, width: float = WIDTH) -> float:
    """The probability that a coordinate of a random unit vector of ``size`` is at most width / sqrt(size)."""
    t = min(1.0, width / sqrt(size))
    if size == 1 or t == 1.0:
        return 1.0 if t == 1.0 else 0.0
    # The angle of the coordinate has the density sin(a) ** (size - 2).
    a = np.linspace(0, pi / 2, 200_001)
    density = np.sin(a) ** (size - 2)
    cumulated = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return float(1 - np.interp(np.arccos(t), a, cumulated) / cumulated[-1])


@lru_cache(maxsize=16)
def least_count(size: int, projections: int = PROJECTIONS, recall: float = RECALL) -> int:
    """The greatest count that a pair at the threshold reaches with a probability of at least ``recall``."""
    p = inside(size)
    below = 0.0
    for k in range(projections + 1):
        below += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > 1 - recall:
            return k
    return projections


def tables(size: int, per_cell: int, recall: float = RECALL) -> int:
    """Tables that a pair at the threshold needs to share a cell of ``per_cell`` strips with a probability of ``recall``."""
    apart = exp(lgamma(size / 2) - lgamma((size + 1) / 2)) / sqrt(pi)
    same = (1 - apart * sqrt(size) / STRIP) ** per_cell
    return max(1, ceil(log(1 - recall) / log(1 - same))) if same < 1 else 1


def usable(v: Column) -> Column:
    """Whether the vector has components, all of them finite, and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def cells_of(unit: np.ndarray, per_cell: int, cosine: float) -> np.ndarray:
    """(rows, tables): the cell of each unit vector in each table."""
    size = unit.shape[1]
    t = tables(size, per_cell)
    width = STRIP * sqrt(2 - 2 * cosine) / sqrt(size)
    shift = np.random.default_rng(77).uniform(0, width, t * per_cell)
    strips = np.floor((unit @ directions(size, t * per_cell, 31) + shift) / width).astype(np.int64).view(np.uint64).reshape(len(unit), t, per_cell)
    key = np.broadcast_to(mixed(np.arange(1, t + 1, dtype=np.uint64) * U(size)), (len(unit), t))
    for k in range(per_cell):
        key = mixed(key * U(0x9E3779B97F4A7C15) + strips[:, :, k])
    return key.view(np.int64)


def _project(batches: Iterator[pa.RecordBatch], per_cell: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Normalise, and name the cells. Vectors of one batch may differ in length."""
    for batch in batches:
        vec, label = batch.column("vec"), batch.column("label").to_numpy()
        sizes = vec.value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            at = pa.array(np.flatnonzero(sizes == size))
            part = batch.take(at)
            v = np.array(part.column("vec").flatten(), np.float64).reshape(-1, size)
            v = v / np.abs(v).max(axis=1)[:, None]
            unit = v / np.linalg.norm(v, axis=1)[:, None]
            own = mixed(label[at.to_numpy()].astype(np.int64).view(np.uint64) + U(0x2545F4914F6CDD1D))
            cells = mixed(cells_of(unit, per_cell, cosine).view(np.uint64) ^ own[:, None]).view(np.int64)
            cols = [part.column("node"), part.column("copies"), pa.array(np.full(len(at), size, np.int32)), pa.array(list(unit), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "copies", "size", "unit", "cells"])


def _runs(cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows that share a cell; rows are sorted by cell."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    for s in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(s, 1)
        first = starts[sizes == s]
        step = max(1, PAIRS // len(i))
        for k in range(0, len(first), step):
            for h in range(0, len(i), PAIRS):
                yield (first[k : k + step, None] + i[h : h + PAIRS]).ravel(), (first[k : k + step, None] + j[h : h + PAIRS]).ravel()


def _colliding(p: np.ndarray, a: np.ndarray, b: np.ndarray, h: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two blocks whose windows collide ``least`` times: sorted by a projection, a query's window is a
    run, and runs are counted per pair."""
    counts = np.zeros((len(a), len(b)), np.uint8)
    rows = np.arange(len(a))
    for k in range(p.shape[1]):
        x, y = p[a, k], p[b, k]
        order = np.argsort(y)
        lo, hi = np.searchsorted(y[order], x - h, "left"), np.searchsorted(y[order], x + h, "right")
        edge = np.zeros((len(a), len(b) + 1), np.int8)
        edge[rows, lo] += 1
        edge[rows, hi] -= 1
        counts[:, order] += np.cumsum(edge[:, :-1], axis=1, dtype=np.int8).view(np.uint8)
    i, j = np.nonzero(counts >= least)
    return a[i], b[j]


def _count(table: pa.Table, cosine: float) -> pa.Table:
    """node, links (copies linked to it, of those first met here), root (a node it is linked to through them)."""
    table = table.sort_by("cell")
    side, cell, turn = (table.column(c).to_numpy() for c in ("side", "cell", "turn"))
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    matrix = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
    unit, cells = matrix("unit"), matrix("cells")
    p = unit @ directions(unit.shape[1])
    # A little wider than calibrated, so that rounding loses nothing.
    h, least = WIDTH * sqrt(2 - 2 * cosine) / sqrt(unit.shape[1]) + 1e-9, least_count(unit.shape[1])

    def met() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if (side < 0).all():
            for i, j in _runs(cell):
                yield _first(i, j, lambda i, j: (np.abs(p[i] - p[j]) <= h).sum(axis=1) >= least)
        else:
            a = np.flatnonzero(side == 0)
            b = np.flatnonzero(side == 1) if (side == 1).any() else a
            i, j = _colliding(p, a, b, h, least)
            if b is a:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), PAIRS):
                yield _first(i[s : s + PAIRS], j[s : s + PAIRS], None)

    def _first(i: np.ndarray, j: np.ndarray, test) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs, those that share no cell of an earlier table and pass the test and the cosine."""
        keep = node[i] != node[j]
        i, j = i[keep], j[keep]
        new = ~((cells[i] == cells[j]) & (np.arange(cells.shape[1]) < turn[i][:, None])).any(axis=1)
        i, j = i[new], j[new]
        if test is not None:
            near = test(i, j)
            i, j = i[near], j[near]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        return i[near], j[near]

    found = list(met())
    i = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    j = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    # A node stands in several cells of a batch: its rows are one.
    known, at = np.unique(node, return_inverse=True)
    weight = np.zeros(len(known), np.int64)
    weight[at] = copies
    i, j = at[i], at[j]
    links = np.bincount(i, weights=weight[j], minlength=len(known)) + np.bincount(j, weights=weight[i], minlength=len(known))
    root = np.arange(len(known))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    has = np.flatnonzero(links > 0)
    return pa.table({"node": pa.array(known[has], pa.int64()), "links": pa.array(links[has].astype(np.int64)), "root": pa.array(known[root[has]], pa.int64())})


def _linked(nodes: DataFrame, most: int, cosine: float) -> DataFrame:
    """node, links, root for ``nodes`` (node, label, copies, vec), of which a label has at most ``most``."""
    per_cell = max(1, ceil(log2(most + 1)) + 2)
    shape = "node long, copies long, size int, unit array<double>, cells array<long>"
    made = durable(nodes.mapInArrow(lambda it: _project(it, per_cell, cosine), shape))
    each = made.select("node", "size", F.posexplode("cells").alias("turn", "cell"))
    shared = durable(each.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"))
    rows, large = shared.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > BLOCK)).first()
    member = each.join(shared, "cell")
    batches = max(1, ceil(rows / BATCH))
    # A group is a batch of small cells, or two blocks of a large one.
    small = member.filter(F.col("n") <= BLOCK).select("node", "size", "turn", "cell", F.pmod("cell", F.lit(batches)).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side"))
    if large:
        blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
        cut = member.filter(F.col("n") > BLOCK).withColumn("n", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        small = small.unionByName(cut.select("node", "size", "turn", "cell", F.col("cell").alias("g"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side")))

    def run(table: pa.Table) -> pa.Table:
        return _count(table, cosine)

    # The kind of group (side below zero or not) keeps a batch apart from a cell of the same number.
    met = small.join(made.select("node", "copies", "unit", "cells"), "node").groupBy("size", "g", "i", "j", (F.col("side") < 0).alias("batch"))
    found = durable(met.applyInArrow(run, "node long, links long, root long"))
    forget(made)
    forget(shared)
    return found


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with the same label at ``cosine`` or more), component_id (the
    smallest vec_id that links reach, its own included), kept.

    Null vectors or labels, null or non-finite components, and zero vectors link with nothing; so do vectors of different
    lengths. Rows that repeat a vector are linked copies; rows that repeat a vec_id with another vector or label are
    vectors of their own and get the links of theirs; a row with a null vec_id takes part in nothing and gets a null
    component; other columns are ignored; an empty table gives no rows.
    """
    # Adding zero makes negative zeros positive, so equal vectors have equal hashes.
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), vec.alias("vec"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec"))
    rows = rows.withColumn("a", F.when(good, F.xxhash64("vec"))).withColumn("b", F.when(good, F.xxhash64(F.lit("b"), "vec")))
    classes = rows.filter("a is not null").groupBy("label", "a", "b", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()))
    most = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    found = _linked(classes.select("node", "label", "copies", "vec"), most, cosine)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    whole = classes.select("node", "label", "a", "b", "rep", "copies").join(reach, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = whole.join(least, "component").join(links, "node", "left").select("label", "a", "b", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = rows.drop("vec").join(of_class, ["label", "a", "b"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
