"""Alignment of two tokenizers' tokens over a corpus, with an identity map as the fast path.

Text is encoded by tokenizer A (byte-level BPE) and B (pieces with byte fallback). Byte offsets where tokens of both end cut
them into groups; the last tokens of a group end together and are linked. What counts is how often a pair of ids is linked
in the whole corpus.

Most groups have one token of each, of the same bytes. For these an array made from the two vocabularies gives B's id for
each of A's, so they are counted in one vector with a place per id of A, per task; the vectors' sums are as long as the
vocabulary. Only the links of other groups enter a shuffle of pairs. A pair's count then comes back to the documents in the
same two ways: from vectors of the vocabulary's length, and for other pairs from a table. Of these the frequent ones, each
at least one in HEAVY of all irregular links and therefore at most HEAVY, go along as arrays; no other pair is frequent
enough to be a hot key of the join that is left.

Neither tokenizer joins what stands on both sides of a single space between letters, digits or other visible ASCII. So
texts are encoded stretch by stretch, and stretches seen lately are not encoded again; a test holds the result against
whole texts.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import _gather as gather
from .shared import durable, forget, in_batches
from .words import slices

#: A place between two stretches, and a stretch that may have such a place on either side.
CUT = regex.compile(r"(?<=[!-~\p{L}\p{N}]) (?=[!-~\p{L}\p{N}])")
PLAIN = regex.compile(r"(?s)[!-~\p{L}\p{N}](?:.*[!-~\p{L}\p{N}])?")
#: Bytes of text worked on at once, stretches and their tokens that are kept, the characters of the longest one kept, and
#: the stretches that are encoded as one text.
TEXT_BYTES, KEPT, KEPT_TOKENS, KEPT_CHARS, JOINED = 1 << 19, 1 << 19, 1 << 22, 64, 1024
#: Frequent irregular pairs that are handed to every task, at most.
HEAVY = 1 << 18
#: A pair's key is its id of A times this, plus its id of B, and has at most so many bits.
SHIFT, KEY_BITS = 1 << 20, 40

_TOLD = "uid long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, ones array<int>, ones_n array<int>, pairs array<long>, pairs_n array<int>"


class Aligned(NamedTuple):
    """Groups and links of one text, in order: the digested form of each group, whether it is one to one with the same
    bytes, the links' keys, the byte at which each group ends, and how many tokens it has of A and of B."""

    groups: list[str]
    one: np.ndarray
    keys: np.ndarray
    ends: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


class Pool:
    """The alignments of the stretches seen lately, by number."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A and B (0: not valid), one-to-one groups, other groups
        self.starts = np.zeros((0, 2), np.int64)  # where the stretch's ids and keys begin
        self.ones, self.pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = np.zeros(3, np.int64)  # of the rows, ones and pairs that have room
        self.met = np.zeros(0, np.int64)  # how often each stretch was met

    def _room(self, more: tuple[int, int, int]) -> None:
        for k, names in enumerate((("counts", "starts"), ("ones",), ("pairs",))):
            for name in names:
                had = getattr(self, name)
                if (need := self.used[k] + more[k]) > len(had):
                    grown = np.zeros((2 * need, *had.shape[1:]), np.int64)
                    grown[: len(had)] = had
                    setattr(self, name, grown)

    def add(self, found: Aligned, cuts: np.ndarray) -> int:
        """Add the stretches whose groups end before each of ``cuts`` and return the first one's number."""
        first = len(self.groups)
        starts = np.concatenate([[0], cuts[:-1]])
        self.groups += [";".join(found.groups[i:j]) for i, j in zip(starts.tolist(), cuts.tolist(), strict=True)]
        ones, pairs = found.keys[found.one] // SHIFT, found.keys[~found.one]
        self._room((len(cuts), len(ones), len(pairs)))
        n, o, p = self.used.tolist()
        upto = [np.concatenate([[0], np.cumsum(x)]) for x in (found.n_a, found.n_b, found.one, ~found.one)]
        self.counts[n : n + len(cuts)] = np.stack([u[cuts] - u[starts] for u in upto], axis=1)
        self.starts[n : n + len(cuts)] = np.stack([o + upto[2][starts], p + upto[3][starts]], axis=1)
        self.ones[o : o + len(ones)], self.pairs[p : p + len(pairs)] = ones, pairs
        self.used += (len(cuts), len(ones), len(pairs))
        return first

    def meet(self, numbers: np.ndarray) -> None:
        if len(self.met) < len(self.groups):
            self.met = np.concatenate([self.met, np.zeros(max(len(self.groups), 2 * len(self.met)) - len(self.met), np.int64)])
        self.met += np.bincount(numbers, minlength=len(self.met))

    def renewed(self) -> Pool:
        """A pool of those kept stretches that were met again, half as many as may be kept at most."""
        words, numbers = np.array(list(self.number), object), np.fromiter(self.number.values(), np.int64)
        met = self.met[numbers]
        best = np.flatnonzero(met > 1)
        if len(best) > KEPT // 2:
            best = best[np.argpartition(met[best], len(best) - KEPT // 2)[-(KEPT // 2) :]]
        numbers = numbers[best]
        out = Pool()
        out.number = dict(zip(words[best].tolist(), range(len(best)), strict=True))
        out.groups = [self.groups[k] for k in numbers.tolist()]
        out.counts, sizes = self.counts[numbers], self.counts[numbers][:, 2:]
        out.starts = np.cumsum(sizes, axis=0) - sizes
        out.ones, out.pairs = (gather(ids, self.starts[numbers, k], sizes[:, k]) for k, ids in enumerate((self.ones, self.pairs)))
        out.used = np.array([len(best), len(out.ones), len(out.pairs)])
        return out

    def add_invalid(self) -> int:
        none = np.zeros(0, np.int64)
        return self.add(Aligned([], none.astype(bool), none, none, none, none), np.zeros(1, np.int64))


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, and
    the other bytes, in order, as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def rapid(path: str):
    """A byte-level encoder of the same vocabulary that is several times faster than ``tokenizers`` on words not seen before,
    or None where the file's ids do not rise in the order of its merges, as that encoder requires."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet, vocab = byte_of(), model["vocab"]
    merged = [vocab["".join(m)] for m in model["merges"]]
    single = [vocab[c] for c in alphabet]
    if max(single) > min(merged) or merged != sorted(merged):
        return None
    of_text = {*merged, *single}
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if i in of_text}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Both tokenizers of this process, and the stretches that it has seen lately."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(a))
        self.a.encode_special_tokens = True
        self.rapid = rapid(public_tokenizers.path(a))
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        alphabet = byte_of()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            # An added token is plain text.
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        single = [self.b.is_byte(i) for i in range(len(pieces))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if one else p.replace("▁", " ").encode() for p, one in zip(pieces, single, strict=True)]
        # Pieces go before single bytes, which stand in only where no piece has the character.
        known = {x: i for i, x in enumerate(self.bytes_b) if single[i]} | {x: i for i, x in enumerate(self.bytes_b) if not single[i]}
        #: B's id with the bytes of each of A's, or -1, and the digested form of such a group.
        self.same = np.array([known.get(x, -1) for x in self.bytes_a], np.int64)
        self.one_to_one = [f"{i}|{j}" for i, j in enumerate(self.same.tolist())]
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.pool = Pool()

    def align(self, texts: list[str], known: bool = False) -> list[Aligned | None]:
        """The alignment of " " + each text; None where a tokenizer does not give its bytes back. ``known``: the texts are
        short plain stretches, with single spaces between them."""
        if known and self.rapid is not None:
            all_a = [self.rapid.encode_ordinary(f" {t}") for t in texts]
        else:
            all_a = [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        out: list[Aligned | None] = []
        for text, list_a, list_b in zip(texts, all_a, self.b.encode(texts, num_threads=1), strict=True):
            raw = b" " + text.encode()
            if b"".join([self.bytes_a[i] for i in list_a]) != raw or b"".join([self.bytes_b[i] for i in list_b]) != raw:
                out.append(None)
                continue
            a, b = np.array(list_a, np.int64), np.array(list_b, np.int64)
            to_a, to_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
            ends = np.intersect1d(to_a, to_b, assume_unique=True)
            at_a, at_b = np.searchsorted(to_a, ends), np.searchsorted(to_b, ends)
            n_a, n_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
            one = (n_a == 1) & (n_b == 1) & (self.same[a[at_a]] == b[at_b])
            groups = [self.one_to_one[i] for i in a[at_a].tolist()]
            for k in np.flatnonzero(~one).tolist():
                i, j = int(at_a[k]) + 1, int(at_b[k]) + 1
                groups[k] = ",".join(map(str, list_a[i - int(n_a[k]) : i])) + "|" + ",".join(map(str, list_b[j - int(n_b[k]) : j]))
            out.append(Aligned(groups, one, a[at_a] * SHIFT + b[at_b], ends, n_a, n_b))
        return out

    def _apart(self, text: str) -> int:
        """The number of a text that is a stretch by itself."""
        found = self.align([text])[0]
        return self.pool.add_invalid() if found is None else self.pool.add(found, np.array([len(found.groups)]))

    def _learn(self, words: list[str]) -> None:
        """Let the pool know all of these plain stretches; many are encoded as one text."""
        for k in range(0, len(words), JOINED):
            some = words[k : k + JOINED]
            found = self.align([" ".join(some)], known=True)[0]
            if found is None:  # one of them is to blame
                self.pool.number.update((w, self._apart(w)) for w in some)
                continue
            ends = np.cumsum([len(w.encode()) + 1 for w in some])
            first = self.pool.add(found, np.searchsorted(found.ends, ends) + 1)
            self.pool.number.update(zip(some, range(first, first + len(some)), strict=True))

    def stretches(self, texts: list[str]) -> list[list[int]]:
        """The numbers, in the pool, of each text's stretches."""
        if len(self.pool.groups) > KEPT or self.pool.used[1] > KEPT_TOKENS:
            self.pool = self.pool.renewed()
        known = self.pool.number
        rows: list[list[int | None]] = []
        rest: dict[int, list[str]] = {}
        new: dict[str, None] = {}
        for text in texts:
            words = text.split(" ")
            found = list(map(known.get, words))
            rows.append(found)
            if None not in found:
                continue
            unseen = [w for w, c in zip(words, found, strict=True) if c is None and w not in new]
            if not all(map(plain, unseen)):
                words = CUT.split(text)
                unseen = [w for w in words if w not in known and plain(w)]
            new.update(dict.fromkeys(unseen))
            rest[len(rows) - 1] = words
        self._learn(list(new))
        apart: dict[str, int] = {}
        for k, words in rest.items():
            for w in words:
                if w not in known and w not in apart:
                    apart[w] = self._apart(w)
            rows[k] = list(map(known.get, words))
            if None in rows[k]:
                rows[k] = [apart[w] if c is None else c for w, c in zip(words, rows[k], strict=True)]
        return rows


def plain(stretch: str) -> bool:
    """Whether a stretch may be kept: it is encoded alike wherever it stands between single spaces."""
    return len(stretch) <= KEPT_CHARS and PLAIN.fullmatch(stretch) is not None


@functools.lru_cache(maxsize=2)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def _tally(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """For each row its distinct values, ascending, and how often each is there."""
    each, count = np.unique(rows << KEY_BITS | values, return_counts=True)
    ends = pa.array(np.cumsum([0, *np.bincount(each >> KEY_BITS, minlength=n)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(each & ((1 << KEY_BITS) - 1))), pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32)))


def _told(both: Aligner, part: pa.RecordBatch) -> pa.RecordBatch:
    texts = [t or "" for t in part.column("text").to_pylist()]
    numbers = both.stretches(texts)
    pool, n = both.pool, len(texts)
    code = np.fromiter(chain.from_iterable(numbers), np.int64)
    pool.meet(code)
    row = np.repeat(np.arange(n), [len(x) for x in numbers])
    valid = np.array([t != "" for t in texts], bool)
    valid[row[pool.counts[code, 0] == 0]] = False
    code, row = code[valid[row]], row[valid[row]]
    sums = np.stack([np.bincount(row, pool.counts[code, k], minlength=n).astype(np.int64) for k in range(4)], axis=1)
    sha = [hashlib.sha256(";".join([pool.groups[c] for c in x]).encode()).hexdigest() if ok else "" for x, ok in zip(numbers, valid.tolist(), strict=True)]
    lists = []
    for k, ids in enumerate((pool.ones, pool.pairs)):
        size = pool.counts[code, 2 + k]
        lists += _tally(gather(ids, pool.starts[code, k], size), np.repeat(row, size), n)
    cols = [part.column("uid"), part.column("doc_id"), *[pa.array(x) for x in (sums[:, 0], sums[:, 1], sums[:, 2] + sums[:, 3])], pa.array(sha, pa.string())]
    cols += [lists[0].cast(pa.list_(pa.int32())), *lists[1:]]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _TOLD.split(", ")])


def align_texts(docs: DataFrame, a: str, b: str) -> DataFrame:
    """The stored table uid (of a row), doc_id, n_a, n_b, n_groups, groups_sha256, ones and ones_n (ids of A in one-to-one
    groups of the same bytes, and how often), pairs and pairs_n (keys of the other links, and how often)."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a, b)
        for batch in batches:
            for part in slices(batch, limit=TEXT_BYTES):
                yield _told(both, part)

    return durable(in_batches(rows, run, _TOLD))


def identity_counts(told: DataFrame, size: int) -> np.ndarray:
    """How often each id of A is linked one to one with its counterpart, summed from one vector a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ones", "ones_n"))
            np.add.at(total, ids, n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["a", "n"])

    # At most ``size`` rows come to the driver.
    rows = in_batches(told.select("ones", "ones_n"), run, "a int, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("a").to_numpy()] = rows.column("n").to_numpy()
    return out


def _count_back(told: DataFrame, same: np.ndarray, ones: np.ndarray, best: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> DataFrame:
    """uid and the rest of ``told`` with count_sum and n_best of the links whose pairs' counts are known here: the identical
    ones and those of ``keys``; the other pairs stay in ``pairs`` and ``pairs_n``."""
    handed = told.sparkSession.sparkContext.broadcast((same, ones, best, keys, counts))
    schema = "uid long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, count_sum long, n_best long, pairs array<long>, pairs_n array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, ones, best, keys, counts = handed.value
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), np.int64)

            def add(rows: np.ndarray, n: np.ndarray, count: np.ndarray, top: np.ndarray) -> None:
                np.add.at(sums[0], rows, n * count)  # noqa: B023
                np.add.at(sums[1], rows, n * (count == top))  # noqa: B023

            flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            rows = lambda c: np.repeat(np.arange(batch.num_rows), batch.column(c).value_lengths().to_numpy(zero_copy_only=False))  # noqa: B023, E731
            ids = flat("ones")
            add(rows("ones"), flat("ones_n"), ones[ids], best[same[ids]])
            pairs, n, row = flat("pairs"), flat("pairs_n"), rows("pairs")
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            add(row[known], n[known], counts[at[known]] if len(keys) else n[known], best[pairs[known] % SHIFT])
            left = ~known
            ends = pa.array(np.cumsum([0, *np.bincount(row[left], minlength=batch.num_rows)]), pa.int32())
            keep = [batch.column(c) for c in ("uid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")]
            rest = [pa.ListArray.from_arrays(ends, pa.array(pairs[left])), pa.ListArray.from_arrays(ends, pa.array(n[left].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sums[0]), pa.array(sums[1]), *rest], names=[c.split()[0] for c in schema.split(", ")])

    return in_batches(told, run, schema)


def align_tokenizers(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of ``docs``.

    ``a`` and ``b`` are vocabulary files of the two tokenizers. n_best are the links whose count is the greatest of their id
    of B, ties included; count_sum is the sum of all links' counts. Texts that are null or empty, or that either tokenizer
    does not give back byte for byte, have no tokens: zeros, and '' for the digest. Texts are worked on whole, however long;
    strings of special tokens in them are plain text. Repeated rows, and rows that repeat a doc_id, have a row each and all
    count; null ids stay null; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    both = aligner(a, b)
    same = both.same
    told = align_texts(docs, a, b)
    ones = identity_counts(told, len(same))
    zipped = lambda df: df.select("uid", F.explode(F.arrays_zip("pairs", "pairs_n")).alias("x")).select("uid", F.col("x.pairs").alias("key"), F.col("x.pairs_n").alias("n"))
    pairs = durable(zipped(told).groupBy("key").agg(F.sum("n").alias("count")))
    # One row for each id of B, at most.
    irregular = pairs.groupBy((F.col("key") % SHIFT).alias("b")).agg(F.max("count").alias("top")).toArrow()
    best = np.zeros(len(both.bytes_b) + 1, np.int64)
    np.maximum.at(best, same, ones)  # ids of A without a counterpart count in the last place
    best[-1] = 0
    b_ids = irregular.column("b").to_numpy()
    best[b_ids] = np.maximum(best[b_ids], irregular.column("top").to_numpy())
    links = pairs.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    heavy = pairs.filter(F.col("count") * HEAVY >= links).select("key", "count").orderBy("key").toArrow()
    known = durable(_count_back(told, same, ones, best, heavy.column("key").to_numpy(), heavy.column("count").to_numpy()))
    tops = told.sparkSession.createDataFrame(list(enumerate(best[:-1].tolist())), "b int, top long")
    light = pairs.filter(F.col("count") * HEAVY < links).withColumn("b", (F.col("key") % SHIFT).cast("int")).join(F.broadcast(tops), "b").select("key", "count", (F.col("count") == F.col("top")).alias("is_top"))
    sums = zipped(known).join(light, "key").groupBy("uid").agg(F.sum(F.col("n") * F.col("count")).alias("more"), F.sum(F.when(F.col("is_top"), F.col("n")).otherwise(0)).alias("more_best"))
    full = known.join(sums, "uid", "left")
    plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).cast("long").alias(c)
    out = durable(full.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), plus("n_best", "more_best"), plus("count_sum", "more"), "groups_sha256"))
    for done in (told, pairs, known):
        forget(done)
    return out
