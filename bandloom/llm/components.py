"""Connected components of an edge table by alternating stars.

A large star hangs a node's greater neighbours on its least neighbour, a small star its lesser ones; edges only ever get
re-hung inside their component, and after a few rounds each component is one star around its least id. Nothing leaves
the cluster but a count and a checksum per round; rounds of many edges broadcast nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, forget, unsent


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id that its links reach."""
    now = durable(edges.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = _state(now)
    while state[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(unsent(least, state[0]), "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(unsent(least, state[0]), "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi != lo")
        after = durable(small.union(least.select("hi", F.col("m").alias("lo"))).distinct())
        before, state = state, _state(after)
        forget(now)
        now = after
        if before == state:
            break
    own = now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(own)
