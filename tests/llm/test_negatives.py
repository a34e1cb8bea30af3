"""Hard negatives against brute force."""

import math
import random

import pytest

from bandloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, slot string, block int, score double"


def data(seed=4, n=500, width=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # A third of the rows are copies with one label; many scores tie.
        v = [0.5] * width if i % 3 == 0 else [rng.choice([0.1, 0.3, 0.5, -0.2]) + (0.0 if i % 2 else rng.random() / 50) for _ in range(width)]
        rows.append((i, v, 1 if i % 3 == 0 else rng.randrange(4)))
    rows[7] = (7, None, 1)
    rows[11] = (11, [None] * width, 1)
    rows[20] = (20, [math.nan] * width, 2)
    rows[40] = (40, [math.inf] * width, 2)
    rows[60] = (60, rows[61][1], None)
    rows += [rows[10], rows[12], (None, rows[1][1], 1), (10, rows[13][1], 2), (600, [], 1), (601, [], 1), (602, [], 2), (610, [1.0], 1), (611, [0.9], 1), (612, [0.5], 3)]
    return [(*r, "u", "s", 1, 2.0) for r in rows]


def brute(rows, every, positives, k, low, high):
    good = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in (r[:3] for r in rows) if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, y, v in good:
        if i % every:
            continue
        others = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in good if j != i and len(w) == len(v)]
        for s, j, _ in sorted(o for o in others if o[2] == y)[:positives]:
            fit = sorted(o for o in others if o[2] != y and -low * s <= -100 * o[0] <= -high * s)[:k]
            out += [(i, j, r, o[1], -s, -o[0]) for r, o in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("low, high", [(30, 90), (80, 100)])
def test_hard_negatives(spark, low, high):
    import numpy as np

    rows = [(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]], *r[2:]) for r in data()]
    want = brute(rows, 10, 5, 7, low, high)
    for some in (rows, rows[::-1]):
        got = negatives.hard_negatives(spark.createDataFrame(some, SCHEMA).repartition(5), every=10, k=7, low=low, high=high)
        assert sorted(map(tuple, got.collect())) == want
    assert len({r[:2] for r in want}) > 100


def test_many_blocks_and_long_sums(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 9)
    monkeypatch.setattr(negatives, "SCORE_BYTES", 200)
    rows = [(i, [float(x) * 2**18 for x in v], y) for i, v, y in ((r[0], r[1], r[2]) for r in data(n=200)[12:200]) if v and None not in v and y is not None and all(map(math.isfinite, v))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, negatives.hard_negatives(df, every=10).collect())) == brute(rows, 10, 5, 10, 30, 90)


def test_nothing_and_too_much(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ArithmeticError):
        negatives.hard_negatives(spark.createDataFrame([(100, [1e30], 1)], "vec_id long, embedding array<double>, label int"))


def test_slots_are_merged_by_few_rows(spark, sf):
    from bandloom.llm import queries

    assert queries.op13_slot_selection(spark, sf).groupBy("anchor_id", "positive_id").count().filter("count > 10").count() == 0
