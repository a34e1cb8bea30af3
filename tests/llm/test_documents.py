"""Operators on documents against brute force, with awkward rows and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from bandloom.llm import minhash, mixing, packing, pii, quality, sharding, shared, substrings, toxicity

from . import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark).cache()


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components_of(sets):
    """Smallest id reachable by pairs with 100 * intersection >= 80 * union."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, k):
    got = minhash.near_duplicates(docs, k=k).collect()
    data = corpus.rows()
    assert len(got) == len(data)
    sets = {r[0]: shingles(r[1], k) for r in data if r[0] is not None}
    want = components_of(sets)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])


def test_near_duplicates_chain(spark):
    """Links that only other members of a bucket have: a chain in which neighbours alone are similar enough."""
    w = [f"w{i}" for i in range(400)]
    data = [(i, " ".join(w[8 * i : 8 * i + 120])) for i in range(30)]
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), k=4).collect()
    want = components_of({i: shingles(t, 4) for i, t in data})
    assert {r.doc_id: r.component_id for r in got} == want and set(want.values()) == {0}


@pytest.mark.parametrize("drop", [False, True])
def test_near_duplicates_broadcasts_nothing_that_grows(spark, monkeypatch, drop):
    """As soon as tables count as large, none is held by the driver, even if its files are small enough for Spark."""
    w = [f"w{i}" for i in range(400)]
    data = [(i, " ".join(w[8 * i : 8 * i + 120])) for i in range(30)]
    data += [(100 + i, " ".join(corpus.words(random.Random(i // 3), 80))) for i in range(9)]
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    monkeypatch.setattr(shared, "OWN_CHOICE_ROWS", 0, raising=False)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = components_of({i: shingles(t, 4) for i, t in data})
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def executions():
        bus.waitUntilEmpty(30_000)
        every = store.executionsList()
        return {every.apply(i).executionId(): every.apply(i).physicalPlanDescription() for i in range(every.size())}

    before = executions()
    if drop:
        assert sorted(r.doc_id for r in minhash.drop_near_duplicates(docs, k=4).collect()) == sorted(set(want.values()))
    else:
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, k=4).collect()} == want
    ran = [plan for k, plan in executions().items() if k not in before]
    assert len(ran) > 10 and [plan for plan in ran if "BroadcastExchange" in plan] == []


def test_drop_near_duplicates_keeps_one_and_all_without_copies(docs):
    got = minhash.drop_near_duplicates(docs, k=5)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    want = components_of({r[0]: shingles(r[1], 5) for r in corpus.rows() if r[0] is not None})
    assert sorted(i for i in ids if i is not None) == sorted({c for c in want.values()}) and ids.count(None) == 1


@pytest.mark.parametrize("n", [35, 12])
def test_repeated_passages(docs, n):
    data = corpus.rows()
    texts = [WORD.findall(r[1] or "") for r in data]
    seen = collections.Counter(tuple(w[i : i + n]) for w in texts for i in range(len(w) - n + 1))
    want = collections.Counter()
    for r, w in zip(data, texts):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in substrings.remove_repeated(docs, n).collect()) == want


def test_repeats_inside_one_text(spark):
    w = [f"v{i}" for i in range(50)]
    data = [(1, " ".join(w + ["x"] + w)), (2, " ".join(["same"] * 100)), (3, " ".join(["same"] * 35))]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeated(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: 100, 2: 100, 3: 35}


def plain_spans(text):
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 8 <= len(d) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text or "") if ok(m.group(), re.sub("[^0-9]", "", m.group()))]


PII = [
    "mail a.b@c.de, x@y and @z.q plus é😀 me+1@ex-ample.co.uk.", "a@b.c@d.e a@b.co_x@d.e a..b@c..d q@-.-", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.002.3.255 1.2.3",
    "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-5 5 4111111111111111", "12345 4111 1111 1111 1111", "+1 (555) 010-9999 +12 +1234567 +12345678 +1 23456789012345678 +1 555 0100.", "+1+2 555 0100 99 (", "9" * 5000, "1 " * 4000, "1." * 4000, "a@" * 3000, "a@b" + ".c" * 9000,
    None, "", "4111111111111111" + "\n" + "4111111111111111", "+49 30 1234567 4111 1111 1111 1111 8.8.8.8 e@f.gh",
]


def test_personal_data(spark):
    data = [(i, t, "kind") for i, t in enumerate(PII)] + [(0, PII[0], None), (None, PII[2], None)]
    got = pii.personal_data(spark.createDataFrame(data, "doc_id long, text string, kind string")).collect()
    want = collections.Counter()
    for i, t, _ in data:
        s = plain_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want[(i, *(sum(x[0] == k for x in s) for k in pii.KINDS), hashlib.sha256(text.encode()).hexdigest(), text)] += 1
    assert collections.Counter(tuple(r) for r in got) == want


def test_disclosing_terms_and_sanitising(spark):
    """A term that occurs with a protected value only is found beside it; one that is common is not."""
    data = [(i, f"note {i} from the boss quorvax ann@corp.example about the plan {i}", len("x"), i) for i in range(6)]
    data += [(100 + i, f"the note about the plan number {i} is long", 5, i) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_chars long, i int")
    rows = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    for i, text, *_ in data[:6]:
        at = text.index("quorvax")
        assert f"term:{at}:{at + 7}" in rows[i] and f"term:{text.index('plan')}" not in rows[i]
    assert all(rows[100 + i] == "" for i in range(40))
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in clean[0].text and "quorvax" not in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[101].text == "the note about the plan number 1 is long" and clean[101].n_chars == 5


def test_disclosing_terms_far_from_the_value_and_without_it(spark):
    """A term discloses a value wherever in the text it stands, and is then marked in all texts."""
    far = "the plan is long " * 20
    data = [(i, f"quorvax {i} {far}ann@corp.example, bob{i}@corp.example {far}quorvax", 1) for i in range(60)]
    data += [(100 + i, f"{far}{i}", 1) for i in range(400)] + [(900, "a quorvax alone", 1), (None, "a quorvax alone", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r.spans.split(",") for r in pii.personal_data(df).collect()}
    for i, text, _ in data[:60]:
        at = text.rindex("quorvax")
        assert [x for x in rows[i] if x.startswith("term")] == ["term:0:7", f"term:{at}:{at + 7}"]
    assert rows[900] == rows[None] == ["term:2:9"] and rows[100] == [""]
    assert not [r for r in pii.sanitise(df).collect() if "quorvax" in r.text]


def test_disclosing_terms_like_brute_force(spark):
    """All pairs of values and words, counted plainly, give the same spans."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)] + ["rare1", "rare2", "x.y"]
    values = ["ann@a.example", "bob@b.example", "10.1.2.3", "carl@c.example"]
    data = []
    for i in range(160):
        w = rng.sample(vocabulary[:40], rng.randint(3, 12))
        if i % 5 == 0:
            w.insert(rng.randint(0, len(w)), values[i // 5 % 4])
            w += [("rare1", "rare2", "x.y", "zz")[i // 5 % 4]] * rng.randint(1, 2)
        if i % 17 == 0:
            w += ["rare1" if i % 2 else "rare2,"]
        data.append((i, (" " if i % 3 else "\t").join(w)))
    data += [(500 + i, data[5][1]) for i in range(4)] + [(600, None), (601, "")]
    got = {r.doc_id: sorted(x for x in r.spans.split(",") if x.startswith("term")) for r in pii.personal_data(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    held, terms = {}, {}
    for i, t in data:
        t = t or ""
        spans = plain_spans(t)
        held[i] = {f"{k}:{t[a:b]}" for k, a, b in spans}
        terms[i] = {m.group() for m in WORD.finditer(t) if not any(a < m.end() and m.start() < b for _, a, b in spans)}
    words = {i: set(WORD.findall(t or "")) for i, t in data}
    text, total, told = dict(data), len(data), {}
    for e in set().union(*held.values()):
        has_e = [i for i in held if e in held[i]]
        if len({text[i] for i in has_e}) < 3:
            continue
        for w in set().union(*(terms[i] for i in has_e)):
            both = [i for i in has_e if w in terms[i]]
            if len({text[i] for i in both}) < 3:
                continue
            n_e, n_w = len(has_e), sum(w in words[i] for i in words)
            reveals = math.log2(len(both) * total / (n_e * n_w)) / math.log2(total / n_e)
            if reveals >= pii.REVEALS:
                told[w] = max(reveals, told.get(w, 0))
    assert len(told) >= 3
    for i, t in data:
        spans = plain_spans(t or "")
        want = sorted(f"term:{m.start()}:{m.end()}" for m in WORD.finditer(t or "") if m.group() in told and not any(a < m.end() and m.start() < b for _, a, b in spans))
        assert got[i] == (want or []) or (not want and got[i] == []), i


def test_many_addresses_in_one_text(spark):
    """Fifty thousand addresses in one text, in three texts: linear work, all of them replaced."""
    base = " ".join(f"u{i}@h{i}.example word{i}" for i in range(50_000))
    df = spark.createDataFrame([(1, base), (2, base + " end"), (3, "start " + base)], "doc_id long, text string")
    got = {r.doc_id: r.n_email for r in pii.personal_data(df).collect()}
    assert got == {1: 50_000, 2: 50_000, 3: 50_000}
    assert all("@" not in r.text for r in pii.sanitise(df).collect())


def test_mix(spark, docs):
    data = corpus.rows()
    got = mixing.mix_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((r[0], len(WORD.findall(r[1] or ""))) for r in data)
    sizes = collections.Counter()
    for r in data:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes), key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3 * sizes[s] if over else share[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken, seen = collections.Counter(), collections.defaultdict(set)
    by_size = {v: s for s, v in sizes.items()}
    for r in got:
        s = by_size[r.source_size]
        taken[s] += r.taken
        seen[s].add(r.target)
        assert 0 <= r.taken <= 3 * r.size
    for s in order:
        assert len(seen[s]) == 1 and math.isclose(seen[s].pop(), target[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= max(8, 0.002 * target[s])
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))


def test_mix_gives_small_sources_their_target(spark):
    """At the largest slots, beside a source of 200 million words."""
    rows = [(i, i, "big", 1_000_000) for i in range(200)]
    small = [1, 20, 300, 341, 342, 700, 1023, 1024, 1025, 1100, 2500, 5000]
    for k, words in enumerate(small):
        left = words
        while left:
            rows.append((len(rows), len(rows), f"s{k:02}", min(left, 90)))
            left -= rows[-1][3]
    docs, blocks = mixing.mix(mixing.durable(spark.createDataFrame(rows, "row_id long, doc_id long, source string, size long")))
    got, slots = docs.collect(), collections.Counter()
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(taken[r.source] == round(r.target) for r in got) and all(taken[f"s{k:02}"] == 3 * n for k, n in enumerate(small))
    each = collections.Counter()
    for r in blocks.filter("row_id >= 200").collect():
        slots[r.slot] += r.length
        each[r.row_id] += r.length
        assert 0 <= r.start < r.start + r.length <= rows[r.row_id][3]
    assert max(slots.values()) <= mixing.BLOCK_WORDS and each == {r.row_id: r.taken for r in got if r.row_id >= 200 and r.taken}


def test_mixed_rows(docs):
    """The stage's rows are the scheduled blocks, slot by slot, and each block holds the words that the schedule names."""
    taken = collections.Counter()
    for r in mixing.mix_documents(docs).collect():
        taken[r.doc_id] += r.taken
    texts = collections.defaultdict(list)
    for r in corpus.rows():
        texts[r[0]].append(WORD.findall(r[1] or ""))
    got, rows = collections.Counter(), mixing.scheduled_blocks(docs).collect()
    for r in rows:
        words = WORD.findall(r.text)
        got[r.doc_id] += len(words)
        assert len(words) == r._mix_length <= mixing.BLOCK_WORDS and any(words == t[r._mix_start : r._mix_start + r._mix_length] for t in texts[r.doc_id])
    assert {k: v for k, v in taken.items() if v} == dict(got)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    in_order = [(r.doc_id, r.text) for r in sorted(rows, key=lambda r: (r._mix_slot, r._mix_place))]
    assert [(r.doc_id, r.text) for r in out.collect()] == in_order
    # After any number of slots each source has about its share of the words.
    share, total, seen = collections.Counter(), 0, collections.Counter()
    for r in rows:
        share[r.source] += r._mix_length
    whole = sum(share.values())
    slots = collections.defaultdict(collections.Counter)
    for r in rows:
        slots[r._mix_slot][r.source] += r._mix_length
    for k in sorted(slots):
        seen.update(slots[k])
        total += sum(slots[k].values())
        assert all(abs(seen[s] - total * share[s] / whole) <= 6 * max(sum(v.values()) for v in slots.values()) for s in share)


def test_pack(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs).collect()
    pieces = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want, total = collections.Counter(), 0
    for r in corpus.rows():
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            p = ids[s : first if k == 0 else s + 1024]
            want[r[0], k, s, len(p), zlib.crc32(p.tobytes())] += 1
    assert pieces == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) + 1


def test_pack_added_tokens(spark):
    """A text that spells out an added token has the ids that the vocabulary file gives by default."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one <|endoftext|> two", "<|endoftext|><|endoftext|>x", "don<|endoftext|>'t  <|endoftext|>  y<|endoftext", "<|endoftext|>"]
    # Parts of a text are encoded apart: long blank runs, white space of other scripts, marks and contractions at the edges.
    texts += [" " * 1_000_000, "\n" * 1_000_000, "a " + " " * 500_000 + " b", " lead trail ", "a\u00a0b c\u3000 d \u2003e", "x \u180e y \x1c z\x1f \x85 w", "'s 't I 'll don 't", "e \u0301e \u0301 n", "_ _ 1 2 ?! ?", "漢 字 😀 😀  😀"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab1 ._'|<>!?,\n\té\u0301\u3000漢😀 ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    rows = packing.pack_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    ids = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.piece):
        ids[r.doc_id] += r.ids
    assert ids == {i: [*plain.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_local_search_never_loses_and_helps():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(300, 700, 600), rng.integers(1, 1024, 300), np.full(50, 600), np.array([1023] * 5 + [1] * 5)):
        first = packing.best_fit(lengths, 1024)
        better = packing.improve([list(b) for b in first], lengths, 1024)
        fill = [int(lengths[b].sum()) for b in better]
        assert sorted(i for b in better for i in b) == list(range(len(lengths))) and max(fill) <= 1024 and len(better) <= len(first)
        assert sum(f * f for f in fill) >= sum(int(lengths[b].sum()) ** 2 for b in first)


def test_pack_ids_round_trip(spark):
    text = "Round trip: naïve café 漢字 😀\n" * 300
    rows = packing.pack_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_ids=True).orderBy("piece").collect()
    ids = [i for r in rows for i in r.ids]
    assert packing.encoder("byte_bpe_50k").tokenizer.decode(ids[:-1]) == text and ids[-1] == 2


def test_shards(docs):
    got = sharding.shard_documents(docs).collect()
    data = corpus.rows()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data)
    slots = collections.defaultdict(list)
    for r in got:
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_like_a_plain_descent(docs):
    """The tree walked in plain Python, hash by hash, gives the same shard with eight and with nine shards."""
    import xxhash

    def draw(key, node):
        h = 42
        for part in (key, node.name):
            h = xxhash.xxh64(part.encode(), seed=h).intdigest()
        unit = (h - 2**64 if h >= 2**63 else h) / 2**64 + 0.5
        return -math.log(max(unit, 2.0**-64)) / node.total

    def descend(key, node):
        while node.children:
            node = min(node.children, key=lambda c: draw(key, c)) if len(node.children) > 1 else node.children[0]
        return node.shard

    trees = sharding.planned_tree(8), sharding.planned_tree(9, 8)
    for r in sharding.shard_documents(docs).collect():
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == tuple(descend(key, t) for t in trees)


def test_write_shards(docs, tmp_path, spark):
    sharding.write_shards(docs, str(tmp_path / "out"), 8)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.doc_id, r.shard) for r in sharding.shard_documents(docs).collect()}
    assert got.count() == docs.count() and {(r.doc_id, r.shard) for r in got.select("doc_id", "shard").collect()} == want


def test_shards_spread_and_weights_confine(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.planned_tree(8)
    counts = [r["count"] for r in sharding.assign_shards(ids, "doc_id", tree).groupBy("shard").count().collect()]
    assert len(counts) == 8 and min(counts) > 2200 and max(counts) < 2800
    heavier = sharding.Node("root", children=(tree.children[0], sharding.Node(tree.children[1].name, children=(tree.children[1].children[0], sharding.Node(tree.children[1].children[1].name, children=tuple(sharding.Node(c.name, weight=2.0, shard=c.shard) for c in tree.children[1].children[1].children))))))
    both = sharding.assign_shards(sharding.assign_shards(ids, "doc_id", tree), "doc_id", heavier, "after").filter("shard != after")
    # What moves, moves into the region that became heavier, and inside it into the heavier rack.
    assert both.count() > 0 and both.filter("after < 4").count() == 0 and both.filter("shard >= 4 and after < 6").count() == 0


GOOD = "the quiet river runs past a mill and the miller counts sacks of grain before the rain begins to fall on hills".split()
RUDE = ["idiot", "moron", "worthless", "scumbag"]


def labelled_corpus(spark):
    import random

    rng = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(GOOD) for _ in range(rng.randint(20, 80))]
        toxic, bad = i % 5 == 0, i % 4 == 1
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(RUDE))
        if bad:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(900, None), (901, ""), (902, "what an idiiot you are"), (None, "the quiet river"), (3, docs[3][1]), (903, "rain " * 20000 + "moron")]
    labels += [(3, labels[3][1], labels[3][2]), (None, 1, 1), (7777, 1, 0), (901, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled_corpus(spark)
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[902].predicted == 1 and by[903].predicted == 1 and by[900].predicted == 0 and by[901].score == by[900].score


def test_subword_embeddings(spark):
    """The table has more than one direction, all of it trained, and misspellings that no label showed are found."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(300)]
    rude = ["idiot", "moron", "worthless", "scumbag", "pathetic"]
    texts, y = [], []
    for i in range(600):
        w = [words[k] for k in rng.integers(0, 300, rng.integers(5, 40))]
        if i % 4 == 0:
            w.insert(int(rng.integers(0, len(w))), rude[i // 4 % 5])
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    table, soft, _ = toxicity.train(texts, np.array(y))
    start = np.random.default_rng(7).uniform(-1 / toxicity.SIZE, 1 / toxicity.SIZE, table.shape).astype(np.float32)
    moved = np.flatnonzero((table != start).any(axis=1))
    s = np.linalg.svd(table[moved], compute_uv=False)
    assert len(moved) > 1000 and (s > 1e-2 * s[0]).sum() == toxicity.SIZE
    # The steps themselves do not all lie along one vector: the softmax is trained at the same time.
    assert np.linalg.svd((table - start)[moved], compute_uv=False)[1] > 1e-3 * np.linalg.svd((table - start)[moved], compute_uv=False)[0]
    import pyarrow as pa

    model = toxicity.fit(texts, np.array(y))
    scores = model.scores(pa.array(["you idiiot there", "what a mooron", "wortthless stuff", "scumbagg", "patheticc", "abc fgh", "hgf cab de", None]))
    assert (scores[:5] >= 0.3).sum() >= 4 and (scores[5:] < 0.3).all()


def test_quality(spark):
    docs, labels = labelled_corpus(spark)
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 4 != 1) for r in held) >= 0.97 * len(held)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted == 1}


def test_classifiers_without_two_classes(spark):
    docs, labels = labelled_corpus(spark)
    for one in (labels.filter("toxic = 0 and quality = 1"), labels.limit(0)):
        assert len({r.score for r in toxicity.score_toxicity(docs, one).collect()}) == 1
        assert len({r.score for r in quality.score_quality(docs, one).collect()}) == 1


def test_empty_tables(spark):
    none = corpus.empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (minhash.near_duplicates, minhash.drop_near_duplicates, substrings.remove_repeated, pii.personal_data, pii.sanitise, mixing.mix_documents, mixing.mixed_documents, packing.pack_documents, sharding.shard_documents):
        assert f(none).count() == 0, f.__name__
    assert toxicity.score_toxicity(none, labels).count() == 0 and quality.score_quality(none, labels).count() == 0


NAMES = ["_th", "th", "row", "whole", "key", "_pii_cuts", "_pii_th", "cuts", "_mix_row", "_mix_words", "_mix_slot", "words", "part", "slot", "new", "id", "node", "gone", "pieces", "place", "kept"]


def test_columns_of_any_name_come_back_as_they_were(spark):
    """Every name that an operator uses, or used, inside, as a column of the user's."""
    from pyspark.sql import functions as F

    docs = corpus.frame(spark).select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    for stage in (minhash.drop_near_duplicates, pii.sanitise, mixing.mixed_documents, mixing.scheduled_blocks):
        out = stage(docs)
        assert out.columns[: len(docs.columns)] == docs.columns
        rows = out.collect()
        assert len(rows) > 30 and all(r[n] == (None if r.doc_id is None else f"{n} of {r.doc_id}") for r in rows for n in NAMES)


@pytest.mark.parametrize("turned", [False, True])
def test_near_duplicates_of_repeated_ids(spark, turned):
    """One doc_id with different texts: each text is a document, and no link of either is lost."""
    rng = random.Random(8)
    a, b, c = (corpus.words(rng, 90) for _ in range(3))
    near = lambda w, k: [*w[:k], "changed", *w[k + 1 :]]
    texts = [(1, a), (1, b), (2, near(a, 40)), (3, near(b, 50)), (4, c), (0, near(c, 10)), (4, a), (5, near(near(b, 50), 20)), (6, corpus.words(rng, 50)), (6, corpus.words(rng, 50))]
    data = [(i, " ".join(w), "en", "s", 1, "r", "c", "u", "z") for i, w in texts]
    docs = corpus.frame(spark, data[::-1] if turned else data)
    sets = {k: shingles(" ".join(w), 4) for k, (_, w) in enumerate(texts)}
    want = collections.Counter()
    smallest = components_of(sets)
    groups = collections.defaultdict(list)
    for k, root in smallest.items():
        groups[root].append(texts[k][0])
    for k, (i, _) in enumerate(texts):
        want[(i, min(groups[smallest[k]]))] += 1
    assert collections.Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, k=4).collect()) == want
    kept = minhash.drop_near_duplicates(docs, k=4).collect()
    of_text = {" ".join(w): smallest[k] for k, (_, w) in enumerate(texts)}
    assert sorted(of_text[r.text] for r in kept) == sorted(groups)
    assert all(r.doc_id == min(groups[of_text[r.text]]) for r in kept)


def test_the_mix_of_repeated_ids_is_the_same_in_any_order(spark):
    rng = random.Random(3)
    data = [(7 if k % 2 else k, " ".join(corpus.words(rng, rng.randint(1, 60))), "en", f"s{k % 3}", 1, "r", "c", "u", "z") for k in range(118)]
    got = [collections.Counter(map(tuple, mixing.mix_documents(corpus.frame(spark, rows).repartition(n)).collect())) for rows, n in ((data, 3), (data[::-1], 5))]
    assert got[0] == got[1]
