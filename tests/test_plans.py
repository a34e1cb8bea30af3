"""Registered queries against DuckDB, and plans."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from bandloom.operators import matrices
from bandloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(rows):
    out = []
    for r in rows:
        out.append(tuple("null" if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert plain(got.select(*cols).collect()) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.count() > 0 and "session_no" in got.columns


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(registry.QUERIES["telemetry_asof"](spark, sf))
    assert "PushedFilters" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_windows_are_partitioned(spark, sf):
    # Curves and grids are broadcast; what has an order is cut by key.
    for name in ("curve_lookup", "freq_align", "telemetry_rederived", "track_coverage", "prominent_peaks", "telemetry_asof", "zoom_times", "session_split", "session_split_bucketed", "uid_carry", "telemetry_lerp", "islands"):
        plan = plan_of(registry.QUERIES[name](spark, sf))
        assert "SinglePartition" not in plan.split("BroadcastExchange")[0], name


def test_dimensions_are_broadcast(spark, sf):
    assert "BroadcastHashJoin" in plan_of(registry.QUERIES["gain_predict"](spark, sf))


def test_closure_shuffles_a_row_a_key(spark, sf):
    plan = plan_of(registry.QUERIES["matrix_closure"](spark, sf))
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan and "partial_max" in plan


def test_closure_of_columns_and_of_tables(spark):
    rows = [(k, a, b, 1.0 + k + a * b, 0.5 * a - b) for k in range(5) for a in range(4) for b in range(4) if (k, a, b) != (1, 2, 3)]
    m = spark.createDataFrame(rows, "k int, a int, b int, re double, im double")
    beside = lambda f: (F.col("re") * f, F.col("im") * (f + F.col("a") * 0.125))
    apart = lambda f: m.select("k", "a", "b", beside(f)[0].alias("re"), beside(f)[1].alias("im"))
    want = {k: max(abs(complex(re * -0.25, im * (a * 0.25 - 0.25))) for q, a, _, re, im in rows if q == k) / max(abs(complex(re, im)) for q, _, _, re, im in rows if q == k) for k in range(5)}
    for parts in ([beside(0.25), beside(0.5)], [apart(0.25), apart(0.5)], [beside(0.25), apart(0.5)]):
        got = matrices.closure(parts, m, ["k"])
        assert {r.k: r.closure for r in got.collect()} == pytest.approx(want)
    assert plan_of(matrices.closure([apart(0.25), apart(0.5)], m, ["k"])).count("Exchange hashpartitioning") == 1
