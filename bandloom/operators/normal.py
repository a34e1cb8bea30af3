"""Normal equations with millions of unknowns, for many keys at once, solved without their matrix.

(J' N^-1 J + S^-1) x = J' N^-1 d of a key is solved by conjugate gradients, preconditioned by the diagonal. The design J is
kept as blocks of neighbouring rows of bounded size, the vectors as pieces of bounded length. A step sends each block those
places of the direction that its entries name, and gets back as many numbers, which are added up by piece. So a step
shuffles at most two numbers an entry, and far fewer where the rows of a block share their columns; the design is shuffled
once, and neither a task nor the driver holds a whole vector. Nothing but two numbers a step reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.folders import stored

#: Entries of a block, places of a piece of a vector, and keys up to which a key's sums are broadcast.
ENTRIES, PIECE, KEYS = 1 << 19, 1 << 14, 1 << 20
#: Arrays as bytes: places of four bytes, numbers of eight. ``cols`` are the columns that a block names, ``c`` places in it.
_BLOCK = "k long, block long, cols binary, r binary, c binary, v binary, w binary, b binary, a binary"
_STATE = "k long, piece long, x binary, r binary, p binary, diag binary, prior binary, rz double, was double, goal double"


def _ints(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<i4")


def _numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<f8")


def _cut(cols: np.ndarray) -> Iterator[tuple[int, slice, bytes]]:
    """The pieces that sorted columns fall into: number, where in ``cols``, and the places in the piece."""
    pieces = cols // PIECE
    at = np.flatnonzero(np.diff(pieces, prepend=-1))
    for i, j in zip(at, [*at[1:], len(cols)], strict=True):
        yield int(pieces[i]), slice(i, j), (cols[i:j] - pieces[i] * PIECE).astype("<i4").tobytes()


def _blocks(entries: DataFrame, data: DataFrame, sizes: DataFrame, entries_of: int, small) -> DataFrame:
    """Blocks of (k, row, c, v) with (k, row, d, w): a key's rows are cut into ranges of equal width, so many that one holds
    about ``entries_of`` entries, and those that hold more are dealt by hash. Rows of the design without a datum have no
    say, and data without a row none either."""

    def place(df: DataFrame) -> Column:
        return (F.col("row") if isinstance(df.schema["row"].dataType, T.NumericType) else F.xxhash64("row")).cast("double")

    entries, data = entries.withColumn("_at", place(entries)), data.withColumn("_at", place(data))
    span = entries.groupBy("k").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"), (F.floor(F.count(F.lit(1)) / entries_of) + 1).alias("_many"))
    known = small(stored(span.join(sizes, "k")))
    cell = F.least(F.floor((F.col("_at") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * F.col("_many")), F.col("_many") - 1).alias("_cell")
    counted = entries.join(known, "k").groupBy("k", cell).agg(F.ceil(F.count(F.lit(1)) / entries_of).alias("_parts"))
    # At most one cell for each entries_of entries holds more than that.
    heavy = small(stored(counted.filter("_parts > 1")))

    def dealt(df: DataFrame, *columns: Column | str) -> DataFrame:
        part = F.pmod(F.xxhash64(F.col("_at")), F.coalesce(F.col("_parts"), F.lit(1)))
        return df.join(known, "k").withColumn("_cell", cell).join(heavy, ["k", "_cell"], "left").select("k", (F.col("_cell") * (1 << 24) + part).alias("block"), "row", *columns)

    inside = F.when(F.col("c").between(0, F.col("n") - 1), F.col("c")).otherwise(F.raise_error(F.lit("an entry beyond the unknowns of its key")).cast("int"))

    def pack(e: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("row")
        rows, row = d["row"].to_numpy(), e["row"].to_numpy()
        at = np.minimum(np.searchsorted(rows, row), max(len(rows) - 1, 0))
        told = np.flatnonzero(rows[at] == row) if len(rows) else []
        if not len(told):
            return pd.DataFrame(columns=[c.split()[0] for c in _BLOCK.split(", ")])
        used, r = np.unique(at[told], return_inverse=True)
        cols, c = np.unique(e["c"].to_numpy()[told], return_inverse=True)
        # Repeated entries of a place add up.
        where, which = np.unique(r * len(cols) + c, return_inverse=True)
        v, r, c = np.bincount(which, e["v"].to_numpy()[told]), where // len(cols), where % len(cols)
        w, datum = d["w"].to_numpy()[used], d["d"].to_numpy()[used]
        b, a = np.bincount(c, v * (w * datum)[r], len(cols)), np.bincount(c, v * v * w[r], len(cols))
        as_bytes = [x.astype(t).tobytes() for x, t in ((cols, "<i4"), (r, "<i4"), (c, "<i4"), (v, "<f8"), (w, "<f8"), (b, "<f8"), (a, "<f8"))]
        return pd.DataFrame([(e["k"].iat[0], e["block"].iat[0], *as_bytes)], columns=[c.split()[0] for c in _BLOCK.split(", ")])

    # Data are often made of the entries, so their columns get names of their own.
    left, right = dealt(entries, inside.alias("c"), "v").toDF("k", "block", "row", "c", "v"), dealt(data, "d", "w").toDF("k", "block", "row", "d", "w")
    return left.groupBy("k", "block").cogroup(right.groupBy("k", "block")).applyInPandas(pack, _BLOCK)


def _rows(df: DataFrame, make, schema: str) -> DataFrame:
    """The rows that ``make`` gives for each row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                got = list(make(row))
                if got:
                    yield pd.DataFrame(got, columns=names)

    return df.mapInPandas(run, schema)


def _added(parts, name: str, length: int) -> np.ndarray:
    """One piece: the sums of what blocks gave, in the order of the blocks, so that reruns agree."""
    out = np.zeros(length)
    for e in () if parts is None else sorted(parts, key=lambda e: e["block"]):
        out[_ints(e["at"])] += _numbers(e[name])
    return out


def solve(entries: DataFrame, data: DataFrame, sizes: DataFrame, prior: DataFrame | None = None, tolerance: float = 1e-10, steps: int = 500, entries_of: int = ENTRIES) -> DataFrame:
    """(k, c, x): the solution of every key.

    ``entries`` (k, row, c, v) is the design, entries that are absent being 0 and repeated ones adding up; ``data`` (k, row,
    d, w) has one datum and inverse noise variance a row; ``sizes`` (k, n) the number of unknowns, c from 0 to n - 1;
    ``prior`` (k, c, prior) adds to the diagonal. Rows with a null, or w not above 0, take no part. A key is done when its
    residual, in the norm of the preconditioner, is below ``tolerance`` of the right side's; ValueError if some are not
    after ``steps``. An unknown that nothing tells of, entry nor prior, is 0. A task holds a block or a piece of a vector
    with what blocks gave it, whatever a key has of rows or unknowns.
    """
    spark = entries.sparkSession
    data = data.select("k", "row", F.col("d").cast("double").alias("d"), F.col("w").cast("double").alias("w")).filter("k is not null and row is not null and d is not null and w > 0")
    entries = entries.select("k", "row", F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v")).filter("k is not null and row is not null and c is not null and v is not null")
    sizes = stored(sizes.select("k", F.col("n").cast("long").alias("n")))
    small = F.broadcast if sizes.count() <= KEYS else lambda df: df
    blocks = stored(_blocks(entries, data, sizes, entries_of, small))
    many = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * blocks.count()))
    # What a step reads again stays where it is, by block and by piece.
    held = blocks.select("k", "block", "cols", "r", "c", "v", "w").repartition(many, "k", "block").sortWithinPartitions("k", "block").persist(StorageLevel.MEMORY_AND_DISK)
    named = _rows(blocks.select("k", "block", "cols"), lambda b: [(b.k, piece, b.block, at) for piece, _, at in _cut(_ints(b.cols))], "k long, piece long, block long, at binary")
    wants = named.groupBy("k", "piece").agg(F.collect_list(F.struct("block", "at")).alias("wants")).repartition(many, "k", "piece").sortWithinPartitions("k", "piece").persist(StorageLevel.MEMORY_AND_DISK)

    def begun(b):
        for piece, s, at in _cut(_ints(b.cols)):
            yield b.k, piece, b.block, at, _numbers(b.b)[s].tobytes(), _numbers(b.a)[s].tobytes()

    told = _rows(blocks.select("k", "block", "cols", "b", "a"), begun, "k long, piece long, block long, at binary, b binary, a binary")
    begin = sizes.filter("n > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))))
    begin = begin.join(told.groupBy("k", "piece").agg(F.collect_list(F.struct("block", "at", "b", "a")).alias("told")), ["k", "piece"], "left")
    if prior is not None:
        own = prior.filter("c is not null and prior is not null").select("k", F.floor(F.col("c") / PIECE).alias("piece"), F.struct(F.pmod("c", F.lit(PIECE)).cast("int").alias("at"), F.col("prior").cast("double").alias("v")).alias("e"))
        begin = begin.join(own.groupBy("k", "piece").agg(F.collect_list("e").alias("own")), ["k", "piece"], "left")

    def start(s):
        length = min(PIECE, s.n - s.piece * PIECE)
        b, diag, own = _added(s.told, "b", length), _added(s.told, "a", length), np.zeros(length)
        for e in () if getattr(s, "own", None) is None else s.own:
            own[e["at"]] += e["v"]
        diag = diag + own
        z = np.divide(b, diag, out=np.zeros(length), where=diag > 0)
        zero = np.zeros(length).tobytes()
        yield s.k, s.piece, zero, b.tobytes(), zero, diag.tobytes(), own.tobytes(), float(b @ z), np.inf, None

    def direction(s) -> np.ndarray:
        r, diag = _numbers(s.r), _numbers(s.diag)
        return np.divide(r, diag, out=np.zeros(len(r)), where=diag > 0) + s.now / s.was * _numbers(s.p)

    def send(s):
        p = direction(s)
        for e in s.wants:
            yield s.k, e["block"], s.piece, p[_ints(e["at"])].tobytes()

    def product(b):
        p = np.concatenate([_numbers(e["x"]) for e in sorted(b.got, key=lambda e: e["piece"])])
        r, c, v, w = _ints(b.r), _ints(b.c), _numbers(b.v), _numbers(b.w)
        q = np.bincount(c, v * (np.bincount(r, v * p[c], len(w)) * w)[r], len(p))
        for piece, s, at in _cut(_ints(b.cols)):
            yield b.k, piece, b.block, at, q[s].tobytes()

    def gather(s):
        p = direction(s)
        q = _added(s.told, "q", len(p)) + _numbers(s.prior) * p
        yield s.k, s.piece, p.tobytes(), q.tobytes(), float(p @ q)

    def advance(s):
        if np.isnan(s.pq):
            yield s.k, s.piece, s.x, s.r, s.p, s.diag, s.prior, s.rz, s.now, s.goal
            return
        r, diag, alpha = _numbers(s.r), _numbers(s.diag), s.now / s.pq
        x, r = _numbers(s.x) + alpha * _numbers(s.p_new), r - alpha * _numbers(s.q)
        z = np.divide(r, diag, out=np.zeros(len(r)), where=diag > 0)
        yield s.k, s.piece, x.tobytes(), r.tobytes(), s.p_new, s.diag, s.prior, float(r @ z), s.now, s.goal

    def sums(state: DataFrame) -> tuple[DataFrame, int]:
        """(k, now, was, goal) of the keys, stored, and how many are not done, counted by the tasks that write it."""
        seen = Observation()
        now = state.groupBy("k").agg(F.sum("rz").alias("now"), F.max("was").alias("was"), F.max("goal").alias("goal"))
        now = now.withColumn("goal", F.coalesce("goal", F.col("now") * tolerance**2))
        out = stored(now.observe(seen, F.count_if(F.expr("now > goal and now > 0")).alias("open")))
        return out, seen.get["open"]

    state = stored(_rows(begin, start, _STATE))
    now, left = sums(state)
    for _ in range(steps):
        if not left:
            break
        going = state.select("k", "piece", "r", "p", "diag", "prior").join(small(now.filter("now > goal and now > 0").select("k", "now", "was")), "k")
        sent = _rows(going.drop("prior").join(wants, ["k", "piece"]), send, "k long, block long, piece long, x binary")
        got = sent.groupBy("k", "block").agg(F.collect_list(F.struct("piece", "x")).alias("got"))
        made = _rows(held.join(got, ["k", "block"]), product, "k long, piece long, block long, at binary, q binary")
        made = made.groupBy("k", "piece").agg(F.collect_list(F.struct("block", "at", "q")).alias("told"))
        moved = stored(_rows(going.join(made, ["k", "piece"], "left"), gather, "k long, piece long, p_new binary, q binary, part double"))
        pq = moved.groupBy("k").agg(F.sum("part").alias("pq"))
        # The goal of a key is set once, from its right side.
        before = state.drop("was", "goal").join(small(now.select("k", "now", "goal")), "k").join(small(pq), "k", "left")
        state = stored(_rows(before.join(moved.drop("part"), ["k", "piece"], "left"), advance, _STATE))
        now, left = sums(state)
    held.unpersist()
    wants.unpersist()
    if left:
        raise ValueError(f"{left} keys are not solved after {steps} steps")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples(index=False):
                x = _numbers(s.x)
                yield pd.DataFrame({"k": s.k, "c": np.arange(len(x), dtype=np.int32) + np.int32(s.piece * PIECE), "x": x})

    return state.select("k", "piece", "x").mapInPandas(places, "k long, c int, x double")


def apply(entries: DataFrame, data: DataFrame, solution: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(k, c, ax) = (J' N^-1 J + S^-1) x of a solution (k, c, x), by joins: what a residual is checked with."""
    along = entries.join(solution, ["k", "c"]).groupBy("k", "row").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
    u = along.join(data.select("k", "row", "w"), ["k", "row"]).select("k", "row", (F.col("s") * F.col("w")).alias("u"))
    ax = entries.join(u, ["k", "row"]).select("k", "c", (F.col("v") * F.col("u")).alias("ax"))
    if prior is not None:
        ax = ax.unionByName(prior.join(solution, ["k", "c"]).select("k", "c", (F.col("prior") * F.col("x")).alias("ax")))
    return ax.groupBy("k", "c").agg(F.sum("ax").alias("ax"))
