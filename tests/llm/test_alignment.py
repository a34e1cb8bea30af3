"""Cross-tokenizer alignment against whole texts, encoded by both tokenizers as they are."""

import collections
import hashlib
import random

import pytest

from bandloom.llm import alignment

from . import corpus

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def plain(text):
    """(n_a, n_b, digested groups, links) of the whole text."""
    both = alignment.aligner(A, B)
    if not text:
        return 0, 0, None, []
    raw = f" {text}".encode()
    a, b = both.a.encode(f" {text}", add_special_tokens=False).ids, both.b.encode(text)
    if b"".join(both.bytes_a[i] for i in a) != raw or b"".join(both.bytes_b[i] for i in b) != raw:
        return 0, 0, None, []

    def ends(ids, table):
        at, out = 0, {}
        for k, i in enumerate(ids):
            at += len(table[i])
            out[at] = k + 1
        return out

    end_a, end_b = ends(a, both.bytes_a), ends(b, both.bytes_b)
    groups, links, i, j = [], [], 0, 0
    for e in sorted(end_a.keys() & end_b.keys()):
        groups.append(",".join(map(str, a[i : end_a[e]])) + "|" + ",".join(map(str, b[j : end_b[e]])))
        i, j = end_a[e], end_b[e]
        links.append((a[i - 1], b[j - 1]))
    return len(a), len(b), groups, links


def expected(texts):
    told = [plain(t) for t in texts]
    count = collections.Counter(x for t in told for x in t[3])
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for n_a, n_b, groups, links in told:
        sha = "" if groups is None else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((n_a, n_b, len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha))
    return out


def awkward(seed=3, n=300):
    rng = random.Random(seed)
    parts = ["a", "B", "7", " ", "  ", "\n", "\t", ".", ",", "é", "ü", "漢", "😀", "▁", "\u00a0", "\u2003", "\x00", "'s", " <|endoftext|> ", "<s>", "…", "\u0301", "ß", "--", "\r\n", "\u200b", "ｆ", "0 1", " \n ", "word", " the ", "tokenizer"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["▁", " ", "<|endoftext|>", "a" * 20_000, "ab " * 9000]


@pytest.mark.parametrize("heavy, joined, kept", [(1 << 18, 1024, 1 << 19), (20, 7, 30), (0, 64, 200)])
def test_alignment(spark, monkeypatch, heavy, joined, kept):
    # ``heavy`` decides which pairs are handed out and which are joined; the result must not depend on it.
    monkeypatch.setattr(alignment, "HEAVY", heavy)
    monkeypatch.setattr(alignment, "JOINED", joined)
    monkeypatch.setattr(alignment, "KEPT", kept)
    rows = corpus.rows() + [(1000 + i, t, "", "", 0, "", "", "", "") for i, t in enumerate(awkward())]
    want = [(r[0], *x) for r, x in zip(rows, expected([r[1] for r in rows]), strict=True)]
    got = [tuple(r) for r in alignment.align_tokenizers(corpus.frame(spark, rows), A, B).collect()]
    by = lambda r: (r[0] is not None, r[0] or 0, r)
    assert sorted(got, key=by) == sorted(want, key=by)


def test_stretches_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 40)
    both = alignment.Aligner(A, B)
    texts = [t for t in awkward(9, 400) if t and len(t) < 100]
    for k in range(0, len(texts), 5):
        some = texts[k : k + 5]
        import numpy as np

        numbers = both.stretches(some)
        both.pool.meet(np.array([c for x in numbers for c in x]))
        for t, x in zip(some, numbers, strict=True):
            valid = all(both.pool.counts[c, 0] for c in x)
            groups = plain(t)[2]
            assert valid == (groups is not None) and (not valid or ";".join(both.pool.groups[c] for c in x) == ";".join(groups))


def test_the_faster_encoder_agrees():
    both = alignment.aligner(A, B)
    words = [w for t in awkward(5, 500) for w in t.split(" ") if alignment.plain(w)]
    text = " " + " ".join(words)
    assert both.rapid is not None and both.rapid.encode_ordinary(text) == both.a.encode(text, add_special_tokens=False).ids


def test_no_documents(spark):
    assert alignment.align_tokenizers(corpus.empty(spark), A, B).collect() == []
