"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards has a weight at each shard; an inner node weighs what its shards weigh together. A
row descends from the root: at each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and
the child's own identity, and the smallest draw wins. A child's draw depends on nothing but the key, the child and its
weight, so a changed weight moves rows only into or out of the subtree that holds it.

Shards beyond those of the planned tree are added each as a region of its own: no existing node's weight changes, so
one more shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import durable, running, spread


@dataclass(frozen=True)
class Node:
    """A region, a rack or a shard; ``shard`` is set at leaves only. ``name`` is unique in the tree and never reused."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple[Node, ...] = ()

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def planned_tree(shards: int, planned: int = 8, racks: int = 2, per_rack: int = 2) -> Node:
    """Shards 0 to ``planned`` - 1 fill regions of ``racks`` x ``per_rack``; each later one gets a region of its own."""
    regions: dict[str, dict[str, list[Node]]] = {}
    for s in range(shards):
        region = f"region-{s // (racks * per_rack)}" if s < planned else f"region-of-{s}"
        rack = f"{region}/rack-{s // per_rack % racks if s < planned else 0}"
        regions.setdefault(region, {}).setdefault(rack, []).append(Node(f"{rack}/shard-{s}", shard=s))
    return Node(
        "root",
        children=tuple(Node(r, children=tuple(Node(k, children=tuple(leaves)) for k, leaves in racks_.items())) for r, racks_ in regions.items()),
    )


def draw(key: Column, node: Node) -> Column:
    """The node's draw for ``key``: exponential with the rate ``node.total``; smaller is better, no weight never wins."""
    unit = F.xxhash64(key, F.lit(node.name)).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return -F.log(F.greatest(unit, F.lit(2.0**-64))) / F.lit(float(node.total)) if node.total > 0 else F.lit(float("inf"))


def place(key: Column, tree: Node) -> Column:
    """The shard of ``key``: the tree descended level by level as one expression."""
    if not tree.children:
        return F.lit(tree.shard)
    if len(tree.children) == 1:
        return place(key, tree.children[0])
    best = F.least(*[draw(key, c) for c in tree.children])
    out = place(key, tree.children[-1])
    for child in reversed(tree.children[:-1]):
        out = F.when(draw(key, child) == best, place(key, child)).otherwise(out)
    return out


def assign_shards(df: DataFrame, key: str, tree: Node, out: str = "shard") -> DataFrame:
    """Add the shard of each row's ``key``. A null key counts as a key of its own; equal keys go to one shard."""
    return df.withColumn(out, place(F.coalesce(F.col(key).cast("string"), F.lit("null")), tree).cast("int"))


def number_slots(df: DataFrame, key: str, tie: list[str], rows: int, out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap, in the order of the key's hash.

    ``rows`` is the count of ``df``; it sets the hash ranges, about 20,000 rows each, that are numbered apart. Rows that
    repeat a key are ordered by ``tie``.
    """
    buckets = max(1, rows // 20_000)
    h = F.xxhash64(F.col(key))
    ranked = running(
        df.withColumn("_h", h).withColumn("_bucket", spread(F.col("_h"), buckets)),
        ["shard"], "_bucket", ["_h", key, *tie], F.lit(1), out,
    )
    return ranked.withColumn(out, F.col(out).cast("long")).drop("_h", "_bucket")


def shard_documents(docs: DataFrame, shards: int = 8, planned: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``. A null text has size 1 and the checksum of no bytes; rows that repeat a doc_id share its shard;
    an empty table gives no rows; columns other than doc_id and text are ignored.
    """
    planned = planned or shards
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = durable(assign_shards(assign_shards(sized, "doc_id", planned_tree(shards, planned)), "doc_id", planned_tree(shards + 1, planned), "grown_shard"))
    out = number_slots(placed, "doc_id", ["text_crc32", "size"], placed.count())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write ``docs`` as one folder of Parquet files per shard; a large shard is written by many tasks."""
    assign_shards(docs, "doc_id", planned_tree(shards, shards)).write.partitionBy("shard").parquet(path)
