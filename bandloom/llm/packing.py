"""Best-fit packing of tokenised documents with a swap-based local search.

Documents become pieces of at most ``capacity`` tokens. Full pieces fill sequences of their own. The others are dealt by
hash into groups of bounded size; each group is packed best fit, longest first, then improved: documents move, or are
exchanged one for one or two for one, between underfull bins whenever that increases the sum of squared fills, until
nothing helps; bins that empty disappear. What still lies in bins that are not full is dealt again, into fewer groups,
until one group is left or a round fills no bin.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, give_back, in_batches
from .words import slices

CAPACITY, END = 1024, 2
#: Bytes of text that are encoded at once.
ENCODED_BYTES = 1 << 21
#: Pieces of one group, and the fill from which a bin is not dealt again into another group.
GROUP, FULL = 8192, 0.995


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[s : s + n] of each start and size, end to end."""
    upto = np.cumsum(size)
    return pool[np.repeat(start - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]


class Encoder:
    """Ids of whole texts by ``tokenizers`` from the vocabulary file ``name``, nothing set on it.

    No token holds the character before a single space and that space if neither it nor the character after the space is
    white space, nor a letter or digit and one of ``.,;:!?`` after it. So where all of a text's spaces are such, its words,
    each with the space before it, are encoded apart from what begins with such a mark: the distinct ones of many texts,
    one after the other as one text, told apart by the bytes that each id stands for. Words seen lately are kept. Other
    texts are encoded as they are. A test holds the ids against those that the tokenizer gives for whole texts.
    """

    #: Words that go into one text, texts that go into one call, and words that are kept.
    WORDS, TEXTS, KEPT = 1024, 16, 1 << 18
    #: A word whose first and last characters are no white space, and one that ends at a mark (RE2).
    PLAIN = r"(?s)^[\pL\pN!-~](?:.*[\pL\pN!-~])?$"
    MARKED = r"(?s)^(?P<stem>.*?[\pL\pN])(?P<tail>[.,;:!?].*)$"

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        # A byte is one character of a token's name; added tokens are plain text.
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes[i] = len(token.content.encode())
        self.known, self.ids, self.size = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, a few texts at a time: an encoding holds far more than ids."""
        out = []
        for k in range(0, len(texts), self.TEXTS):
            out += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts[k : k + self.TEXTS], add_special_tokens=False)]
        return out

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, each after a space, and of each how many."""
        cuts = pa.array([*range(0, len(words), self.WORDS), len(words)] if len(words) else [0], pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(cuts, words), pa.scalar(" ", pa.large_string())).to_pylist()
        ids = np.concatenate([np.zeros(0, "<u4"), *self.whole([f" {t}" for t in texts])])
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        return ids, np.diff(np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1, prepend=0)

    def _stems(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_plain``, for distinct words of which some are known; these become known, and the oldest go."""
        at = pc.index_in(words, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        ids, size = self._plain(words.filter(pa.array(new)))
        ids, size = np.concatenate([ids, self.ids]), np.concatenate([size, self.size])
        pick = at.fill_null(0).to_numpy().astype(np.int64) + int(new.sum())
        pick[new] = np.arange(int(new.sum()))
        out = _gather(ids, (np.cumsum(size) - size)[pick], size[pick])
        rest = np.ones(len(self.known), bool)
        rest[pick[~new] - int(new.sum())] = False
        rest &= np.cumsum(rest) <= max(0, self.KEPT - len(words))
        kept = int(new.sum()) + np.flatnonzero(rest)
        self.known = pa.concat_arrays([words, self.known.filter(pa.array(rest))])
        self.ids = np.concatenate([out, _gather(ids, (np.cumsum(size) - size)[kept], size[kept])])
        self.size = np.concatenate([size[pick], size[kept]])
        return out, size[pick]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct plain words, each after a space, and where those of each begin, the end included."""
        marked = pc.extract_regex(words, self.MARKED)
        stem = pc.coalesce(pc.struct_field(marked, "stem"), words).dictionary_encode()
        tail = pc.coalesce(pc.struct_field(marked, "tail"), pa.scalar("", words.type)).dictionary_encode()
        ids, size = self._stems(stem.dictionary)
        tails = self.whole(tail.dictionary.to_pylist())
        ids, size = np.concatenate([ids, *tails]), np.concatenate([size, np.array([len(x) for x in tails], np.int64)])
        both = np.stack([stem.indices.to_numpy().astype(np.int64), len(stem.dictionary) + tail.indices.to_numpy().astype(np.int64)], axis=1)
        ids = _gather(ids, (np.cumsum(size) - size)[both].ravel(), size[both].ravel())
        return ids, np.concatenate([[0], np.cumsum(size[both].sum(axis=1))])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of texts without nulls."""
        if not len(texts):
            return []
        rows = pc.split_pattern(texts.cast(pa.large_string()), " ")
        ptr = rows.offsets.to_numpy().astype(np.int64)
        words = rows.flatten().dictionary_encode()
        code = words.indices.to_numpy().astype(np.int64)
        plain = pc.match_substring_regex(words.dictionary, self.PLAIN).to_numpy(zero_copy_only=False)
        easy = np.logical_and.reduceat(plain[code], ptr[:-1])
        # The first word of a text has no space before it.
        first = np.zeros(len(code), bool)
        first[ptr[:-1]] = True
        inner = np.repeat(easy, np.diff(ptr)) & ~first
        used, at = np.unique(code[inner], return_inverse=True)
        ids, ends = self._words(words.dictionary.take(pa.array(used)))
        take = np.zeros(len(code), np.int64)
        take[inner] = np.diff(ends)[at]
        upto = np.concatenate([[0], np.cumsum(take)])
        ids = _gather(ids, ends[:-1][at], take[inner])
        alone = [words.dictionary[c].as_py() if e else t.as_py() for c, e, t in zip(code[ptr[:-1]].tolist(), easy.tolist(), texts, strict=True)]
        return [np.concatenate([a, ids[i:j]]) for a, i, j in zip(self.whole(alone), upto[ptr[:-1]].tolist(), upto[ptr[1:]].tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """The encoder of this process."""
    return Encoder(name)


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece: full ones, but for the first, which takes what is left over."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def _pieces(batches: Iterator[pa.RecordBatch], name: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(name)
    for batch in batches:
        for part in slices(batch, limit=ENCODED_BYTES):
            give_back()
            rows: list[tuple] = []
            for doc_id, tokens in zip(part.column("doc_id").to_pylist(), encode(part.column("text").fill_null("")), strict=True):
                ids = np.append(tokens, np.array([END], "<u4"))
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    piece = ids[start : start + length]
                    rows.append((doc_id, k, start, length, zlib.crc32(piece.tobytes()), piece.astype(np.int32) if with_ids else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, longest first: each piece goes into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the rooms that some bin has, sorted
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            bins.append([])
            b, room = len(bins) - 1, capacity
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        bins[b].append(i)
        left = room - size
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchange pieces between underfull bins while the sum of squared fills grows.

    For a bin with room r, in order of fill: take a piece of size <= r from an emptier bin (move); give a piece of size s
    and take one of size s + d, 0 < d <= r (one for one); give one of size s and take two of one bin that are d longer
    together (two for one; the longer of the two is the longest that fits in half of what may be taken). Each time the
    largest d is taken; it moves d tokens to the fuller bin, which increases the sum. Rounds go on until one changes
    nothing; as the sum only grows, they end.
    """
    fill = [int(sum(lengths[i] for i in b)) for b in bins]
    size = lengths.tolist()
    changed = True
    while changed:
        changed = False
        under = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: -fill[b])
        if len(under) < 2:
            break
        rank = {b: k for k, b in enumerate(under)}
        home: dict[int, int] = {}
        # The pieces of each length, by the rank of their bin: the emptiest bins' last.
        at: dict[int, list[tuple[int, int]]] = {}
        for b in under:
            for i in bins[b]:
                home[i] = b
                at.setdefault(size[i], []).append((rank[b], i))
        for same in at.values():
            same.sort()
        known = sorted(at)

        def find(most: int, least: int, b: int, other: int = -1) -> int | None:
            """The longest piece of ``least`` to ``most`` tokens, ``other`` aside, in a bin emptier than ``b``."""
            k = bisect_left(known, most + 1) - 1
            while k >= 0 and known[k] >= least:
                for r, i in reversed(at[known[k]]):
                    if r <= rank[b]:
                        break
                    if fill[home[i]] < fill[b] and i != other:
                        return i
                k -= 1
            return None

        def shift(i: int, to: int) -> None:
            bins[home[i]].remove(i)
            bins[to].append(i)
            fill[home[i]] -= size[i]
            fill[to] += size[i]
            same = at[size[i]]
            del same[bisect_left(same, (rank[home[i]], i))]
            home[i] = to
            insort(same, (rank[to], i))

        for b in under:
            while (room := capacity - fill[b]) > 0 and bins[b]:
                if (i := find(room, 1, b)) is not None:
                    shift(i, b)
                    changed = True
                    continue
                best: tuple[int, int, list[int]] | None = None
                for s in {size[i]: i for i in bins[b]}.values():
                    one = find(size[s] + room, size[s] + 1, b)
                    if one is not None and (best is None or size[one] - size[s] > best[0]):
                        best = (size[one] - size[s], s, [one])
                    if best is None or best[0] < room:
                        half = find((size[s] + room) // 2, 1, b)
                        if half is not None:
                            other = find(size[s] + room - size[half], max(1, size[s] + 1 - size[half]), b, half)
                            if other is not None and home[other] == home[half] and size[half] + size[other] - size[s] > (best[0] if best else 0):
                                best = (size[half] + size[other] - size[s], s, [half, other])
                if best is None:
                    break
                giver = home[best[2][0]]
                for i in best[2]:
                    shift(i, b)
                shift(best[1], giver)
                changed = True
    return [b for b in bins if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """The bins of one group, as lists of positions in ``lengths``."""
    return improve(best_fit(lengths, capacity), lengths, capacity)


def _pack_group(table: pa.Table, capacity: int) -> pa.Table:
    uid, length = (table.column(c).to_numpy() for c in ("uid", "length"))
    order = np.lexsort((uid, -length))
    uid, length = uid[order], length[order]
    seq, offset, fill = (np.zeros(len(uid), np.int64) for _ in range(3))
    for b in pack(length, capacity):
        seq[b], fill[b] = uid[b[0]], length[b].sum()
        offset[b] = np.cumsum(length[b]) - length[b]
    return pa.table({"uid": uid, "length": length, "bin": seq, "offset": offset, "fill": fill})


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(uid, bin, offset) for ``pieces`` (uid, length), each shorter than ``capacity``. A bin bears the uid of one of its
    pieces."""

    def run(table: pa.Table) -> pa.Table:
        return _pack_group(table, capacity)

    done: list[DataFrame] = []
    left, count, last = pieces, pieces.count(), None
    while count:
        groups = -(-count // GROUP)
        dealt = left.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(len(done))), F.lit(groups)).alias("group"))
        packed = durable(dealt.groupBy("group").applyInArrow(run, "uid long, length long, bin long, offset long, fill long"))
        if groups == 1 or count == last:
            done.append(packed)
            break
        full = F.col("fill") >= int(FULL * capacity)
        done.append(packed.filter(full))
        left, last = packed.filter(~full), count
        count = left.count()
    out = pieces.sparkSession.createDataFrame([], "uid long, bin long, offset long")
    for d in done:
        out = out.unionByName(d.select("uid", "bin", "offset"))
    return out


def pack_pieces(docs: DataFrame, name: str = "byte_bpe_50k", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.

    A document's tokens are those of its text and then END. A null or empty text is one piece of one token; repeated rows
    are documents of their own; null ids stay; other columns are ignored; an empty table gives no rows.
    """
    cut_ = in_batches(docs.select("doc_id", "text"), functools.partial(_pieces, name=name, capacity=capacity, with_ids=with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>")
    pieces = durable((cut_ if with_ids else cut_.drop("ids")).withColumn("uid", F.monotonically_increasing_id()))
    placed = place(pieces.filter(F.col("length") < capacity).select("uid", "length"), capacity)
    out = pieces.join(placed, "uid", "left")
    # A bin has the number of one of its pieces; a full piece is alone and takes its own number below zero.
    return out.withColumn("sequence_id", F.coalesce("bin", -1 - F.col("uid"))).withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long")).drop("uid", "bin")


def pack_documents(docs: DataFrame, name: str = "byte_bpe_50k", capacity: int = CAPACITY) -> DataFrame:
    out = pack_pieces(docs, name, capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
