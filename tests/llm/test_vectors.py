"""Operators on vectors against brute force."""

import collections
import math

import numpy as np

from bandloom.llm import near_vectors, topk

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, size string, score string"


def vectors():
    rng = np.random.default_rng(11)
    rows, at = [], 0
    for label in (0, 1, 2):
        centre = rng.normal(size=64)
        for k in range(60):
            v = centre + rng.normal(size=64) * (0.05 + 0.004 * k) if k < 30 else rng.normal(size=64)
            rows.append((at, [float(np.float32(x)) for x in v], label))
            at += 1
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (250, rows[0][1], 1), (300, rows[1][1], None), (301, None, 0), (302, [0.0] * 64, 0), (303, [math.nan] + [1.0] * 63, 0), (304, [math.inf] + [1.0] * 63, 0), (305, [None] + [1.0] * 63, 0), (306, [], 0), (307, rows[0][1][:32], 0), (308, rows[0][1][:32], 0), (None, rows[0][1], 0), (400, [x * 3 for x in rows[5][1]], 0), (350, [0.5] * 64, 2)]
    return [(i, v, y, "r", "s", "t") for i, v, y in rows]


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def test_near_duplicate_vectors(spark):
    data = vectors()
    got = {r.vec_id: r for r in near_vectors.near_duplicate_vectors(spark.createDataFrame(data, SCHEMA)).collect() if r.vec_id is not None}
    ok = [(i, np.array(v, float), y) for i, v, y, *_ in data if i is not None and y is not None and good(v) and any(v)]
    links, root = collections.Counter(), {i: i for i, *_ in data}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a, y) in enumerate(ok):
        for j, b, z in ok[x + 1 :]:
            if y == z and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert sum(links.values()) > 100
    for i, *_ in data:
        if i is not None:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], find(i), find(i) == i), i


def test_repeated_ids_and_small_dimensions(spark):
    """A vec_id under two labels or with two vectors has the links of each; negative zeros equal zeros; any dimension."""
    rng = np.random.default_rng(4)
    for d in (1, 2, 3, 10):
        data = [(int(rng.integers(0, 150)), [float(x) for x in np.round(rng.normal(size=d), 1)], int(rng.integers(0, 2))) for _ in range(200)]
        data += [(7, [0.0] * (d - 1) + [1.0], 0), (8, [-0.0] * (d - 1) + [1.0], 0), (7, [0.0] * (d - 1) + [1.0], 1), (7, [1.0] * d, 0)]
        got = collections.Counter(map(tuple, near_vectors.near_duplicate_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()))
        root = list(range(len(data)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        v = [np.array(x, np.float32).astype(float) for _, x, _ in data]
        links = [0] * len(data)
        for i in range(len(data)):
            for j in range(i):
                if data[i][2] == data[j][2] and any(v[i]) and any(v[j]) and v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= 0.98 - 1e-12:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        least = {}
        for i, (k, *_) in enumerate(data):
            least[find(i)] = min(k, least.get(find(i), k))
        assert got == collections.Counter((k, links[i], least[find(i)], k == least[find(i)]) for i, (k, *_) in enumerate(data)), d


def test_large_cells(spark, monkeypatch):
    """A cell over the block size is worked on block by block, and counts each pair once."""
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=32)
    data = [(i, [float(x) for x in centre + rng.normal(size=32) * (0.05 if i < 90 else 0.3)], 0) for i in range(150)]
    got = {r.vec_id: r.n_links for r in near_vectors.near_duplicate_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}
    v = np.array([np.array(x, np.float32) for _, x, _ in data], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert got == dict(enumerate((v @ v.T >= 0.98).sum(axis=1) - 1)) and max(got.values()) > 50


def test_pairs_at_the_threshold_share_a_cell():
    rng = np.random.default_rng(2)
    for d, per in ((64, 12), (8, 6)):
        a = rng.normal(size=(20_000, d))
        a /= np.linalg.norm(a, axis=1)[:, None]
        o = rng.normal(size=a.shape)
        o -= (o * a).sum(1)[:, None] * a
        o /= np.linalg.norm(o, axis=1)[:, None]
        x, y = near_vectors.cells_of(a, per, 0.98), near_vectors.cells_of(0.98 * a + math.sqrt(1 - 0.98**2) * o, per, 0.98)
        z = near_vectors.cells_of(o, per, 0.98)
        assert (x == y).any(axis=1).mean() >= 0.9998 and (x == z).mean() < 0.02


def test_calibration_finds_pairs_at_the_threshold():
    """Of pairs exactly at the cosine, the count keeps nearly all; of unrelated ones, it keeps few."""
    rng = np.random.default_rng(0)
    d = near_vectors.directions(64)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * o
    h = near_vectors.WIDTH * math.sqrt(0.04) / 8
    hits = lambda x, y: (np.abs(x @ d - y @ d) <= h).sum(1) >= near_vectors.least_count(64)
    assert hits(a, b).mean() >= 0.999 and hits(a, o).mean() <= 0.02


def test_top_inner_products(spark):
    data = vectors()
    got = collections.defaultdict(list)
    for r in topk.top_inner_products(spark.createDataFrame(data, SCHEMA), every=50, k=5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in data if i is not None and good(v)]
    want = {}
    for i, a in ok:
        if i % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in ok if j != i and len(a) == len(b))[:5]
            want[i] = [(k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert {q: sorted(v) for q, v in got.items()} == want and len(want) == 9


def test_repeated_query_rows(spark):
    """Rows that repeat a query count once; a query's own id is never among its answers."""
    data = [(0, [1.0, 0.5], 0), (0, [1.0, 0.5], 0), (0, [0.5, 1.0], 1), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 2.0], 0), (100, [1.0, 1.0], 0), (100, [1.0, 1.0], 0)]
    got = topk.top_inner_products(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), every=50, k=3).collect()
    best = {}
    for q, a, _ in data:
        for c, b, _ in data:
            if q % 50 == 0 and q != c:
                s = sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
                best[q, c] = max(s, best.get((q, c), s))
    want = set()
    for q in (0, 100):
        order = sorted((-s, c) for (x, c), s in best.items() if x == q)[:3]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(order)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_ties_and_few_rows(spark):
    data = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (50, [0.0, -1.0], 0)]
    got = topk.top_inner_products(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_vectors.near_duplicate_vectors(none).count() == 0 and topk.top_inner_products(none).count() == 0
