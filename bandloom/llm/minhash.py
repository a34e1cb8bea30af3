"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on full shingle sets.

1. Every text becomes its set of word shingles, a sketch and band keys (one pass over the texts).
2. Texts with equal sets, told by a cryptographic digest of the whole sorted set, form a class, which has a number of its
   own: rows that bear one doc_id with different texts are in different classes. Only a row with the class's smallest
   doc_id goes on.
3. Each band bucket with several classes compares all its members with one hub, its smallest number: as many pairs as
   members. Pairs are verified on full sets and linked pairs give components.
4. Where a bucket's other members still lie in several components, links among them may be missing. Buckets that share
   such members form clusters; a cluster is cut into blocks of bounded size and each pair of blocks is compared in one
   task: sketches first, then full sets, and only between components. It emits a spanning set of links, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import durable, forget, in_batches, unsent
from .sketches import bands, sketch
from .words import Words, mixed, ragged, shingle_sets, slices

#: Coordinates of a sketch and of a band: a pair at similarity 0.8 shares no band with a probability below 1e-7.
COORDINATES, BAND = 128, 4
#: Blocks compare sketches first; a pair at the threshold has an estimate this far below it with a probability of 1e-5.
MARGIN = 4.2
#: Documents of a block of a cluster, on average, and rows up to which ids or classes (at most 48 bytes each) are broadcast.
#: The driver holds some 150 bytes a row of these, whatever the size of the table.
BLOCK, BROADCAST_IDS = 256, 1 << 16


def _put(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join with texts or sets, which are not sorted for it: few ``rows`` are broadcast, others are hashed apart."""
    return F.broadcast(df) if rows < BROADCAST_IDS else df.hint("shuffle_hash")


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.sha256(s.tobytes()).digest() for s in sets], pa.binary())


def _sketched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(Words(part.column("text"), lower=True), k)
            keys = bands(sketch(sets, COORDINATES), BAND)
            keys = mixed(keys ^ np.arange(1, keys.shape[1] + 1, dtype=np.uint64)[None, :])
            full = [len(s) > 0 for s in sets]
            keyed = [row if f else row[:0] for row, f in zip(keys, full, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), _digests(sets), ragged(keyed)], names=["doc_id", "th", "n_shingles", "whole", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(Words(part.column("text"), lower=True), k)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _digests(sets), ragged(sets)], names=["doc_id", "whole", "shingles"])


def _compare_blocks(table: pa.Table, percent: int) -> pa.Table:
    """Links between the documents of two blocks (or within one) that join different components."""
    side = table.column("side").to_numpy()
    ids, comp = table.column("node").to_numpy(), table.column("component").to_numpy()
    lists = table.column("shingles").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    size = np.diff(ends)
    sk = sketch(sets, COORDINATES)
    least = percent / 100 - MARGIN * np.sqrt(percent / 100 * (1 - percent / 100) / COORDINATES)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    found = []
    for i in left:
        js = right[(100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i])) & (comp[right] != comp[i])]
        js = js[(sk[js] == sk[i]).mean(axis=1) >= least] if len(js) else js
        js = np.array([j for j in js if find(int(comp[j])) != find(int(comp[i]))], dtype=np.int64)
        if not len(js):
            continue
        others = np.concatenate([sets[j] for j in js])
        at = np.searchsorted(sets[i], others)
        hit = sets[i][np.minimum(at, size[i] - 1)] == others
        common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[js])[:-1]]), dtype=np.int64)
        for j in js[100 * common >= percent * (size[js] + size[i] - common)]:
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((ids[i], ids[j]))
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def _rest(buckets: DataFrame, first: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Links that step 3 may have missed, as (a, b). ``n``: the members of all buckets."""
    member = buckets.filter("node != hub").join(unsent(first.withColumnRenamed("id", "node"), n), "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = durable(member.select("key", "node", "component"))
    mixed_ = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("a")).filter("lo != hi")
    open_ = durable(member.join(unsent(mixed_.select("key", "a"), n), "key").select("a", F.col("node").alias("b"), "component"))
    clusters = components(open_.select("a", "b")).withColumnRenamed("component", "cluster")
    docs = durable(open_.select(F.col("b").alias("id"), "component").distinct().join(unsent(clusters, n), "id"))
    counts = durable(docs.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("n")).filter("n > 1"))
    # Clusters of several blocks are few; a large one must not meet in a task.
    dealt = docs.join(_put(counts, counts.count()), "cluster", "left").fillna(1, "n").withColumn("block", F.pmod(F.hash("id"), F.col("n")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select(
        F.col("id").alias("node"), "component", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )

    def compare(table: pa.Table) -> pa.Table:
        return _compare_blocks(table, percent)

    # The rows of a cluster here are its blocks times its members, which no estimate from files tells.
    return unsent(dealt).join(sets, "node").groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def _classified(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_shingles, group, component_id, kept of each row of ``docs``. Groups that share a
    repeated doc_id may have the same component_id; ``group`` tells them apart and is null without shingles."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    base = durable(in_batches(docs, partial(_sketched, k=k), "doc_id long, th long, n_shingles long, whole binary, bands array<long>"))
    named = base.filter("doc_id is not null and n_shingles > 0")
    classes = durable(named.groupBy("n_shingles", "whole").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()))
    reps = named.join(unsent(classes.withColumnRenamed("rep", "doc_id")), ["n_shingles", "whole", "doc_id"])
    keyed = reps.select("node", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub != last").select("key", "hub")
    buckets = durable(keyed.join(unsent(hubs), "key"))
    pairs = durable(buckets.filter("node != hub").select("hub", "node").distinct())
    ids = pairs.select("node").union(pairs.select("hub")).distinct()
    ids = durable(ids.join(unsent(classes.select("node", F.col("rep").alias("doc_id"), "whole")), "node"))
    n = ids.count()
    sets = in_batches(docs.select("doc_id", "text").join(_put(ids.select("doc_id").distinct(), n), "doc_id", "left_semi"), partial(_sets, k=k), "doc_id long, whole binary, shingles array<long>")
    sets = sets.join(_put(ids, n), ["doc_id", "whole"]).select("node", "shingles")
    # Rows that repeat an id and a set have it once.
    sets = durable(sets.dropDuplicates(["node"]) if base.count() != base.select("doc_id").distinct().count() else sets)
    both = _put(pairs, 32 * n).join(sets.withColumnRenamed("shingles", "x"), "node").join(unsent(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("y")), n), "hub")
    both = both.filter(100 * F.least(F.size("x"), F.size("y")) >= percent * F.greatest(F.size("x"), F.size("y")))
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    links = durable(both.filter(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select(F.col("hub").alias("a"), F.col("node").alias("b")))
    first = durable(components(links))
    rest = durable(_rest(buckets, first, sets, percent, n))
    stars = first.select(F.col("component").alias("a"), F.col("id").alias("b"))
    last = components(stars.union(rest)) if not rest.isEmpty() else first
    last = durable(last.withColumnRenamed("id", "node").join(unsent(classes.select("node", "rep")), "node"))
    for done in (buckets, pairs, ids, sets, links, rest):
        forget(done)
    least = last.groupBy("component").agg(F.min("rep").alias("least"))
    of_class = classes.join(unsent(last.join(unsent(least, n), "component").select("node", "component", "least"), n), "node", "left")
    of_class = of_class.select("n_shingles", "whole", F.coalesce("component", "node").alias("group"), F.coalesce("least", "rep").alias("component_id"))
    out = base.drop("bands").join(unsent(of_class), ["n_shingles", "whole"], "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "th", "n_shingles", "group", alone.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (the document is its component's smallest id).

    Documents are linked if their sets of ``k``-word shingles, A-Z lower-cased, have 100 * intersection >= percent *
    union. Null, empty and blank texts have no shingles and no links; fewer than k words make one shingle; texts are
    compared whole, however long; repeated rows are copies of each other and share the answer; rows that bear one doc_id with
    different texts are documents of their own, each with the smallest id that its own text reaches; a row with a null doc_id
    takes part in nothing and gets a null component; other columns are ignored; an empty table gives no rows.
    """
    return _classified(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, and all documents that are in none.

    Rows that repeat a doc_id and a text count as one document and stay once; of rows that bear a kept doc_id with different
    texts of one group one stays; rows without a doc_id all stay, and so do null, empty and blank texts; a long text is
    compared whole; all columns are kept, whatever their names; an empty table gives no rows.
    """
    told = durable(_classified(docs, k, percent).filter("doc_id is not null"))
    first = told.filter("kept and n_shingles > 0").groupBy("group").agg(F.min("th").alias("first"))
    gone = told.filter("n_shingles > 0").join(unsent(first), "group", "left").filter(~F.col("kept") | (F.col("th") != F.col("first")))
    gone = durable(gone.select("doc_id", "th").distinct())
    # The user's columns travel in one, so no name of theirs can meet one of ours.
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("th"))
    out = rows.join(_put(gone, gone.count()), ["doc_id", "th"], "left_anti")
    n, d = told.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n != d:
        out = out.filter("doc_id is not null").dropDuplicates(["doc_id", "th"]).unionByName(out.filter("doc_id is null"))
    return out.select("row.*")
