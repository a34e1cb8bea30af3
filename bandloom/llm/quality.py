"""Quality by compression: two zstandard dictionaries, one built from good and one from bad labelled text.

A text is cut into chunks of about 512 bytes, all of it. Each chunk is compressed with both dictionaries; the difference
of the compressed sizes, normalised by the larger of them and by the chunk's length, says which kind of text it resembles:
the first is blind to how well both do, the second is near zero for what repeats itself, which either dictionary makes
short. The mean of these over the text and the worst chunk enter a logistic regression, which turns them into a calibrated
score: junk that fills one paragraph of a long text is as visible as junk throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches
from .toxicity import is_held_out, labelled, with_scores

#: Bytes that a chunk counts as at least when a difference is divided by its length.
LEAST = 64
#: Bytes of a chunk and of a dictionary, the compressor's level, and labelled texts used at most per class.
CHUNK, DICTIONARY, LEVEL, SAMPLE = 512, 112640, 3, 1500


def chunks(text: bytes) -> Iterator[bytes]:
    """Equal parts of at most CHUNK bytes that cover the text; an empty text is one empty chunk."""
    n = max(1, -(-len(text) // CHUNK))
    cuts = [len(text) * i // n for i in range(n + 1)]
    return (text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary from all chunks of the texts; where they are too few to train on, all of them are the dictionary."""
    samples = [c for t in texts for c in chunks(t) if c]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples) or b"        "


@dataclass
class Model:
    """The dictionaries, and the logistic regression on what ``features`` returns."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    _open: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.good, self.bad, self.weights

    def __setstate__(self, state):
        self.good, self.bad, self.weights = state
        self._open = None

    def features(self, text: bytes) -> tuple[float, ...]:
        """Of the chunks: mean and worst difference, by the larger compressed size and by the chunk's length."""
        if self._open is None:
            make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            self._open = make(self.good).compress, make(self.bad).compress
        good, bad = self._open
        rows = []
        for c in chunks(text):
            a, b = len(good(c)), len(bad(c))
            rows.append(((b - a) / max(a, b), (b - a) / max(len(c), LEAST)))
        x = np.array(rows)
        return (*x.mean(axis=0), *x.min(axis=0))

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = np.array([(*self.features((t or "").encode()), 1.0) for t in texts.to_pylist()]).reshape(-1, len(self.weights))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge; x ends in a column of ones."""
    scale = np.append(x[:, :-1].std(axis=0) + 1e-9, 1.0)
    a, c = x / scale, np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        ridge = 1e-3 * w.sum() / len(w) * np.eye(len(c))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (w * (y - p)) - ridge @ c)
        c += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return c / scale


def fit(texts: list[str], labels: np.ndarray, share_good: float | None = None) -> Model:
    """Dictionaries from two thirds of the texts, the regression from the rest, weighted to ``share_good`` of good ones.
    Below 60 texts all of them do both. Without both classes every text has the smoothed share of good labels."""
    data = [t.encode() for t in texts]
    if not data or labels.min() == labels.max():
        share = (float(labels.sum()) + 1) / (len(labels) + 2)
        return Model(b"        ", b"        ", np.array([*[0.0] * 4, np.log(share / (1 - share))]))
    rest = np.arange(len(data)) % 3 == 0 if len(data) >= 60 else np.ones(len(data), bool)
    first = ~rest if len(data) >= 60 else rest
    model = Model(*(dictionary([d for d, y, f in zip(data, labels, first, strict=True) if f and y == kind]) for kind in (1, 0)), np.zeros(5))
    x = np.array([(*model.features(d), 1.0) for d, r in zip(data, rest, strict=True) if r])
    y = labels[rest].astype(float)
    share = y.mean() if share_good is None else share_good
    w = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    model.weights = logistic(x, y, w)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from at most SAMPLE labelled texts of each class whose crc32(doc_id) modulo 3 is not 1; the share of good ones
    is counted over all such labels."""
    texts, y = labelled(docs, labels, "quality", out=1, of=3, sample=SAMPLE)
    seen = labels.filter(~is_held_out(F.col("doc_id"), 1, 3)).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return fit(texts, y, seen if seen not in (None, 0.0, 1.0) else None)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: better), predicted.

    Without labels of both classes every score is the smoothed share of good ones. Null and empty texts score as a text
    on which both dictionaries do alike; a null doc_id is scored and not held out; repeated rows score alike; other
    columns are ignored; an empty table gives no rows.
    """
    out = with_scores(docs, train(docs, labels))
    return out.select("doc_id", is_held_out(F.col("doc_id"), 1, 3).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns, whatever their names.

    Null and empty texts are kept or rejected by the score of a text on which both dictionaries do alike; null ids and
    repeated rows stay or go by their texts; a long text is scored whole; without labels of both classes all documents go
    by the share of good labels; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .words import slices

        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(shipped.value.scores(part.column(at)) >= threshold))

    return in_batches(docs, run, docs.schema)
