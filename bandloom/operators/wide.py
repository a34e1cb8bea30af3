"""Principal components of wide rows: tens of thousands of columns, without a matrix of columns by columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import stored

#: Columns of a piece of a partial result, bytes of a stored block of rows, and blocks that are multiplied at once.
PIECE, BLOCK, TOGETHER = 512, 1 << 17, 32
_PART = "piece long, part array<double>"


def _total(parts: DataFrame, cut: int) -> np.ndarray:
    """The sum of all tasks' partial results, piece by piece: pieces meet in tasks that add them as they come, so a task holds
    its pieces once, however many parts there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, part in zip(batch["piece"], batch["part"], strict=True):
                held[piece] = held[piece] + part if piece in held else np.array(part)
        yield pd.DataFrame({"piece": list(held), "part": list(held.values())})

    rows = parts.repartition("piece").mapInPandas(run, _PART).collect()
    got = {r["piece"]: np.array(r["part"]) for r in rows}
    return np.concatenate([got[k] for k in sorted(got)]) if got else np.zeros(cut)


def _held(df: DataFrame, data: str, k: int) -> DataFrame:
    """The rows as stored blocks of their bytes, made once however many passes read them."""
    step = max(1, BLOCK // (8 * k))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[data].to_numpy()
            yield pd.DataFrame({"x": [np.stack(rows[i : i + step]).astype("<f8").tobytes() for i in range(0, len(rows), step)]})

    return stored(df.select(data).mapInPandas(run, "x binary"))


def _products(blocks: DataFrame, k: int, basis: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """[X'X basis, column sums, number of rows] of stored rows less ``centre``: one pass; a task holds one k x q matrix."""
    q = basis.shape[1]
    sent = blocks.sparkSession.sparkContext.broadcast((basis, centre))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, mid = sent.value
        total = np.zeros((k, q + 2))
        seen = False
        for batch in batches:
            for i in range(0, len(batch), TOGETHER):
                seen = True
                x = np.frombuffer(b"".join(batch["x"].iloc[i : i + TOGETHER]), "<f8").reshape(-1, k) - mid
                total[:, :q] += x.T @ (x @ base)
                total[:, q] += x.sum(axis=0)
                total[:, q + 1] += len(x)
        if seen:
            yield pd.DataFrame({"piece": range(-(-k // PIECE)), "part": [total[i : i + PIECE].ravel() for i in range(0, k, PIECE)]})

    out = _total(blocks.mapInPandas(run, _PART), k * (q + 2)).reshape(k, q + 2)
    sent.unpersist()
    return out


def usable(df: DataFrame, data: str, k: int) -> DataFrame:
    """Rows whose array has k finite values; others take no part, as rows with a gap in a sample covariance."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return df.filter((F.size(data) == k) & ~F.exists(data, bad))


def principal_components(df: DataFrame, data: str, k: int, count: int, weights: np.ndarray | None = None, noise: np.ndarray | None = None, more: int = 10, rounds: int = 4, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, values, vectors): the ``count`` greatest eigenvalues of the sample covariance of arrays of k columns, weighted
    and with the weighted noise squared on its diagonal, in falling order, their vectors as columns, each one's greatest
    entry positive.

    A random basis of ``count + more`` vectors is sent through the covariance ``rounds`` times and once more to read the
    values off; each time is one pass over the rows, which are stored once as doubles. A task and the driver hold k x (count + more) numbers, never k x k.
    Exact where that many vectors span the data; otherwise the error falls by the ratio of the first value left out to
    the last one kept, with each round twice. Fewer than two rows raise.
    """
    q = min(k, count + more)
    if k < 1:
        raise ValueError("rows without columns have no covariance")
    rows = _held(usable(df, data, k), data, k)
    w = np.ones(k) if weights is None else np.asarray(weights, float)
    extra = np.zeros(k) if noise is None else (np.asarray(noise, float) * w) ** 2
    first = _products(rows, k, np.zeros((k, 1)), np.zeros(k))
    n = int(first[0, -1])
    if n < 2:
        raise ValueError(f"{n} usable rows have no covariance")
    mean = first[:, 1] / n

    def times(basis: np.ndarray) -> np.ndarray:
        # Rows are centred before the product, so nothing cancels; the weights stand outside of the sum.
        got = _products(rows, k, w[:, None] * basis, mean)[:, :q]
        return w[:, None] * got / (n - 1) + extra[:, None] * basis

    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, q)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(times(basis))[0]
    inner = basis.T @ times(basis)
    e, u = np.linalg.eigh((inner + inner.T) / 2)
    e, v = e[::-1][:count], basis @ u[:, ::-1][:, :count]
    return mean, e, v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])


def scores(df: DataFrame, data: str, mean: np.ndarray, vectors: np.ndarray, weights: np.ndarray | None = None, name: str = "scores") -> DataFrame:
    """Add the rows' coordinates along the vectors; null where a row is not usable. The vectors are broadcast."""
    k, w = len(mean), np.ones(len(mean)) if weights is None else np.asarray(weights, float)
    sent = df.sparkSession.sparkContext.broadcast((mean, w[:, None] * vectors))

    @F.pandas_udf("array<double>")
    def along(rows: pd.Series) -> pd.Series:
        mid, v = sent.value
        out = np.full(len(rows), None, dtype=object)
        told = np.flatnonzero(rows.notna().to_numpy())
        if len(told):
            made = (np.stack(rows.iloc[told].to_numpy()).astype(float) - mid) @ v
            for i, row in zip(told, made, strict=True):
                out[i] = row
        return pd.Series(out)

    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    fits = (F.size(data) == k) & ~F.exists(data, bad)
    return df.withColumn(name, along(F.when(fits, F.col(data).cast("array<double>"))))
