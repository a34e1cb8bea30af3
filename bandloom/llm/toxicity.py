"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in NumPy.

A word is the bag of its byte n-grams, ends marked; its vector is the average of their embeddings. The vectors of a text's
words are averaged and enter a linear softmax with two classes. So do the averages of every run of WINDOW words, as three
words in twenty thousand would vanish in the average of the text alone; the most toxic of these averages counts. Training
pools them softly (log-sum-exp, sharpened epoch by epoch), scoring takes the maximum. Embeddings start at random and are trained together with the softmax by its gradients. A misspelling that no
label ever showed shares n-grams, and so vectors, with the words that labels did show.

As the softmax is linear, the log odds of an average of vectors are the average of the n-grams' log odds; scoring uses
these, one number an n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import durable, in_batches
from .words import BYTE_BASE, U, mixed, powers, slices, window_hashes

#: Fixed by design: n-gram lengths in bytes, buckets of the embedding table, size of a vector.
GRAMS, BUCKETS, SIZE = (3, 4, 5, 6), 1 << 19, 8
#: Words of a run.
WINDOW = 2
#: Labelled texts used at most, per class.
SAMPLE = 1500
_BYTES = mixed(np.arange(7, 263, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


@dataclass
class Tokens:
    """The words of some texts: of each row the words ptr[r] to ptr[r + 1] - 1 as numbers into the distinct ones, and of
    each distinct word w the buckets grams[at[w] : at[w + 1]]."""

    ptr: np.ndarray
    word: np.ndarray
    grams: np.ndarray
    at: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    """Runs of letters and digits, A-Z lower-cased; bytes of other scripts count as letters."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    letter = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
    n = len(data)
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    row[n] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (~before | row[:n]))
    ends = np.flatnonzero(letter & (~after | row[1:])) + 1
    ptr = np.searchsorted(starts, offsets)
    hashes = window_hashes(_BYTES[data], starts, ends, BYTE_BASE)
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    size = e - s + 2
    # Each distinct word between the marks 1 and 2, end to end.
    base = np.concatenate([[0], np.cumsum(size)])
    marked = np.full(int(base[-1]), 2, np.uint8)
    inner = np.arange(int(base[-1])) - np.repeat(base[:-1], size)
    body = (inner > 0) & (inner < np.repeat(size, size) - 1)
    marked[body] = data[(np.repeat(s, size) + inner - 1)[body]]
    marked[base[:-1]] = 1
    values = _BYTES[marked]
    p, inverse = powers(BYTE_BASE, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=sums[1:])
    owner = np.repeat(np.arange(len(s)), size)
    left = np.repeat(size, size) - inner
    grams, owners = [], []
    for g in GRAMS:
        i = np.flatnonzero(left >= g)
        h = mixed((sums[i + g] - sums[i]) * inverse[i] + U(g))
        grams.append((h >> U(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[i])
    owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(s))
    return Tokens(ptr, word, np.concatenate(grams)[order].astype(np.int32), np.concatenate([[0], np.cumsum(counts)]))


def _mean(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of each run values[at[i] : at[i + 1]]; an empty run gives 0."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    count = np.diff(at)
    return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(count, 1).reshape(-1, *[1] * (values.ndim - 1))


def _windows(ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends of the runs of the rows' words, the whole row as the last one, and at which run each row begins."""
    n = np.diff(ptr)
    runs = np.where(n > 0, np.maximum(1, n - WINDOW + 1) + 1, 0)
    at = np.concatenate([[0], np.cumsum(runs)])
    starts = np.arange(at[-1]) - np.repeat(at[:-1], runs) + np.repeat(ptr[:-1], runs)
    ends = np.minimum(starts + WINDOW, np.repeat(ptr[1:], runs))
    last = at[1:][n > 0] - 1
    starts[last], ends[last] = ptr[:-1][n > 0], ptr[1:][n > 0]
    return starts, ends, at


@dataclass
class Model:
    """Log odds of an n-gram's vector, the softmax's bias, and the line that turns a text's log odds into calibrated ones."""

    gram: np.ndarray
    bias: float
    slope: float
    shift: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        t = tokens(texts)
        odds = _mean(self.gram[t.grams], t.at)[t.word]
        starts, ends, at = _windows(t.ptr)
        sums = np.concatenate([[0.0], np.cumsum(odds)])
        out = np.full(len(texts), self.bias)
        full = np.flatnonzero(np.diff(t.ptr) > 0)
        if len(full):
            out[full] += np.maximum.reduceat((sums[ends] - sums[starts]) / (ends - starts), at[full])
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -500, 500)))


def line(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of the weighted logistic regression of y on x, by Newton's method on standardised x."""
    m, s = float(np.average(x, weights=w)), float(np.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w))) or 1.0
    a = np.stack([(x - m) / s, np.ones_like(x)], axis=1)
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * len(x) * np.eye(2) * 0.01 + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (w * (y - p)) - ridge * len(x) * 0.01 * c)
        c += step
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0] / s), float(c[1] - c[0] * m / s)


def train(texts: list[str], labels: np.ndarray, epochs: int = 8, rate: float = 0.15, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(table, soft, bias): the embeddings, the two classes' weights and the bias of the log odds, by joint gradients.

    Both are scaled by the roots of their summed squared gradients; the classes weigh alike.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    soft, bias = rng.normal(0, 1, (SIZE, 2)) / np.sqrt(SIZE), np.array([1.0, -1.0])
    grown, grown_soft, grown_bias = np.full(BUCKETS, 1e-8), np.full(soft.shape, 1e-8), 1e-8
    per = max(1, min(64, len(texts) // 64))
    rare = max(1e-9, float(labels.mean()))
    for epoch in range(epochs):
        sharp = 2.0 ** min(epoch, 4)
        order = rng.permutation(len(texts))
        for k in range(0, len(order), per):
            batch = order[k : k + per]
            t = tokens(pa.array([texts[i] for i in batch]))
            rows = np.flatnonzero(np.diff(t.ptr) > 0)
            if not len(rows):
                continue
            y = labels[batch][rows].astype(np.float64)
            vec = _mean(table[t.grams], t.at)
            direction = soft[:, 1] - soft[:, 0]
            odds = (vec @ direction)[t.word]
            starts, ends, at = _windows(t.ptr)
            sums = np.concatenate([[0.0], np.cumsum(odds)])
            z = (sums[ends] - sums[starts]) / (ends - starts) * sharp
            top = np.maximum.reduceat(z, at[rows])
            owner = np.repeat(np.arange(len(rows)), np.diff(at)[rows])
            e = np.exp(z - top[owner])
            share = e / np.add.reduceat(e, at[rows])[owner]
            logit = np.add.reduceat(share * z, at[rows]) / sharp + bias[1] - bias[0]
            d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * np.where(y == 1, 0.5 / rare, 0.5 / max(1e-9, 1 - rare))
            # The gradient of each word's log odds: its part of the averages that hold it.
            edge = np.zeros(len(odds) + 1)
            each = share * d[owner] / (ends - starts)
            np.add.at(edge, starts, each)
            np.subtract.at(edge, ends, each)
            g = np.bincount(t.word, weights=np.cumsum(edge[:-1]), minlength=len(vec))
            cells = np.bincount(t.grams, weights=np.repeat(g / np.maximum(1, np.diff(t.at)), np.diff(t.at)), minlength=BUCKETS)
            u = np.flatnonzero(cells)
            grown[u] += cells[u] ** 2 * (direction @ direction) / SIZE
            table[u] -= (rate * cells[u] / np.sqrt(grown[u]))[:, None] * direction[None, :]
            g_soft = np.stack([-(vec * g[:, None]).sum(axis=0), (vec * g[:, None]).sum(axis=0)], axis=1)
            grown_soft += g_soft**2
            soft -= 0.1 * g_soft / np.sqrt(grown_soft)
            grown_bias += d.sum() ** 2
            bias += np.array([1, -1]) * 0.1 * d.sum() / np.sqrt(grown_bias)
    return table, soft, float(bias[1] - bias[0])


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Train on whole texts; a fifth of them is held back from the embeddings and calibrates the score. Below 50 texts all
    of them do both. Without both classes every text has the smoothed share of toxic labels."""
    if not len(texts) or labels.min() == labels.max():
        share = (float(labels.sum()) + 1) / (len(labels) + 2)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    order = np.random.default_rng(seed).permutation(len(texts))
    cut = len(order) // 5 if len(order) >= 50 else 0
    table, soft, bias = train([texts[i] for i in order[cut:]], labels[order[cut:]])
    model = Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), bias, 1.0, 0.0)
    back = order[:cut] if cut else order
    x = model.logits(pa.array([texts[i] for i in back]))
    model.slope, model.shift = line(x, labels[back].astype(float), np.ones(len(back)))
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, out: int, of: int, sample: int) -> tuple[list[str], np.ndarray]:
    """At most ``sample`` texts of each class with their labels, to the driver: those of least hash among the rows whose
    crc32(doc_id) modulo ``of`` is not ``out``."""
    known = labels.filter(f"{label} in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(label).alias("y"))
    known = known.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % of) != out)
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = durable(drawn[0].union(drawn[1]))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))
    got = sorted((r["doc_id"], r["text"], r["y"]) for r in rows.toLocalIterator())
    return [r[1] for r in got], np.array([r[2] for r in got], np.int64)


def is_held_out(doc_id: Column, out: int, of: int) -> Column:
    """Whether crc32 of the id's text leaves ``out`` modulo ``of``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == out, F.lit(False))


def with_scores(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of each whole text; the model travels to each executor once."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shipped.value.scores(part.column("text")), pa.float64())], names=["doc_id", "score"])

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Learns from at most SAMPLE labelled texts of each class whose crc32(doc_id) modulo 4 is not 2; without both classes
    every score is the smoothed share of toxic labels. Null and empty texts score as a text without toxic words; a null
    doc_id is scored and not held out; repeated rows score alike; labels that repeat a doc_id count once, as their
    greatest; other columns are ignored; an empty table gives no rows.
    """
    model = fit(*labelled(docs, labels, "toxic", out=2, of=4, sample=SAMPLE))
    out = with_scores(docs, model)
    return out.select("doc_id", is_held_out(F.col("doc_id"), 2, 4).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
