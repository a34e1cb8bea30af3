"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

The mix is a sequence of slots of about equally many words. Slot k takes the golden-ratio point frac((k + 1) * 0.618...)
and maps it through the sources' cumulative target shares, so after any number of slots each source is within a few slots
of its share. A source that is drawn too seldom for its target has further slots at the end. A source's slots are ranked
and share its target, in whole words, equally: rank r takes the r-th part of the source's documents, laid end to end in
hashed order and, behind the last, from the first again. So each source gives its target, however small it is. The mix is
these blocks, slot after slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, durable, running, small, spread

GOLDEN = 0.6180339887498949
#: The mix has at least so many slots, but a slot has room for at least LEAST_WORDS and never for more than BLOCK_WORDS.
LEAST_SLOTS, LEAST_WORDS, BLOCK_WORDS = 1 << 12, 64, 1024
#: Documents of one range of a source's hashed order, about, that is laid out in one task.
BUCKET_ROWS = 2000
#: Cells into which the unit interval is cut to find a point's source by an equi join.
CELLS = 4096
#: No document is taken more often than this.
MOST_PASSES = 3


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST_PASSES) -> DataFrame:
    """source, source_no, source_size, target: the words each source should give.

    Sources in code-point order, null last, weigh ``weights`` in turn and share all words. A target above ``most`` times
    its source's size stops there and the excess is shared by weight again, until none is above: the fixed point is
    least(most * size, level * weight), and the level follows from running sums in the order of size / weight. This
    works on one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("source_no", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    by = by.withColumn("w", weight.cast("double")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = [F.col("cap") / F.col("w"), F.col("source_no")]
    full, before = Window.partitionBy(F.lit(0)), Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    by = (
        by.withColumn("all_words", F.sum("source_size").over(full).cast("double"))
        .withColumn("all_w", F.sum("w").over(full))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all_words") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    )
    # The first source in order whose cap is not below the level it would see sets the level for all after it.
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(*[c.alias(n) for c, n in zip(order, "ab", strict=True)], "level"))).over(full)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return by.select("source", "source_no", F.col("source_size").cast("long"), target.alias("target"))


def golden_point(k: Column) -> Column:
    """frac((k + 1) * GOLDEN), exact to about 1e-9 for k up to 2**40."""
    high, low = F.floor((k + 1) / F.lit(1 << 20)), (k + 1) % F.lit(1 << 20)
    coarse = (1 << 20) * GOLDEN % 1.0
    x = low * F.lit(GOLDEN) + (high * F.lit(coarse)) % F.lit(1.0)
    return x - F.floor(x)


def schedule(targets: DataFrame, slots: int, n_sources: int) -> DataFrame:
    """slot, source_no, rank: the source of each of ``slots`` slots and its number among that source's slots."""
    spark = targets.sparkSession
    to = Window.orderBy("source_no")
    ends = targets.withColumn("hi", F.sum("target").over(to) / F.sum("target").over(Window.partitionBy(F.lit(0))))
    ends = ends.withColumn("lo", F.coalesce(F.lag("hi").over(to), F.lit(0.0))).filter("target > 0")
    last = F.col("hi") == F.max("hi").over(Window.partitionBy(F.lit(0)))
    ends = ends.withColumn("hi", F.when(last, F.lit(2.0)).otherwise(F.col("hi")))
    cell = lambda c: F.least(F.lit(CELLS - 1), F.floor(c * CELLS)).cast("int")
    # At most CELLS rows more than there are sources.
    ends = ends.select("source_no", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u")).withColumn("cell", cell(F.col("u")))
    drawn = points.join(small(ends, n_sources), "cell").filter("u >= lo and u < hi")
    drawn = drawn.select("slot", "source_no", F.floor(F.col("slot") / 20_000).cast("int").alias("chunk"))
    return running(drawn, ["source_no"], "chunk", ["slot"], F.lit(1), "rank").drop("chunk")


def mix(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST_PASSES) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks) for ``sizes``: a stored table with row_id, doc_id, source, size.

    documents: row_id, doc_id, source, size, source_size, target, taken. blocks: row_id, slot, rank, pass, at, start, length:
    slot by slot, which words of which document (which begins at word ``at`` of its source) the mix takes. An empty table gives empty results; documents without
    words are never taken; all orders are hashed from doc_id, so reruns agree.
    """
    rows, words = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_sources = sizes.select("source").distinct().count()
    block = max(LEAST_WORDS, min(BLOCK_WORDS, words // LEAST_SLOTS))
    slots = -(-words // block)
    targets = durable(source_targets(sizes, weights, most))
    about = small(targets, n_sources)
    docs = sizes.join(about, sizes["source"].eqNullSafe(about["source"])).drop(about["source"])
    docs = docs.withColumn("h", F.xxhash64(F.lit("mix"), "doc_id"))
    docs = docs.withColumn("bucket", spread(F.col("h"), max(1, rows // BUCKET_ROWS)))
    laid = running(docs, ["source_no"], "bucket", ["h", "doc_id", "size", "row_id"], F.col("size"), "at").drop("bucket", "h")
    drawn = durable(schedule(targets, slots, n_sources))
    # A slot never exceeds ``block`` words, so a source needs so many.
    due = targets.withColumn("total", F.round("target").cast("long")).filter("total > 0").join(drawn.groupBy("source_no").agg(F.count("*").alias("n_drawn")), "source_no", "left")
    due = due.withColumn("n_drawn", F.coalesce("n_drawn", F.lit(0)))
    due = durable(due.select("source_no", "source_size", "total", "n_drawn", F.greatest("n_drawn", F.ceil(F.col("total") / F.lit(block))).cast("long").alias("n_slots")))
    late = due.withColumn("n_late", F.sum(F.col("n_slots") - F.col("n_drawn")).over(Window.orderBy("source_no"))).filter("n_slots > n_drawn")
    late = late.select("source_no", "n_slots", "n_late", F.explode(F.sequence("n_drawn", F.col("n_slots") - 1)).alias("rank"))
    late = late.select((F.lit(slots) + F.col("n_late") - F.col("n_slots") + F.col("rank")).alias("slot"), "source_no", "rank")
    filled = drawn.select("slot", "source_no", F.col("rank").cast("long").alias("rank")).unionByName(late).join(small(due, n_sources), "source_no")
    edge = lambda r: f"({r} * (total div n_slots) + ({r} * (total % n_slots)) div n_slots)"
    filled = filled.withColumn("lo", F.expr(edge("rank"))).withColumn("hi", F.expr(edge("(rank + 1)"))).filter("hi > lo")
    filled = filled.withColumn("pass", F.explode(F.expr("sequence(lo div source_size, (hi - 1) div source_size)")))
    base = F.col("pass") * F.col("source_size")
    filled = filled.select("slot", "source_no", "rank", "pass", (F.greatest("lo", base) - base).alias("lo"), (F.least("hi", base + F.col("source_size")) - base).alias("hi"))
    # Slots and documents meet in stretches of ``block`` words of the source.
    taken = filled.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    cut = laid.filter("size > 0").select(
        "row_id", "source_no", "at", "size",
        F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("stretch"),
    )
    start = F.greatest(F.col("stretch") * block, "at", "lo")
    end = F.least((F.col("stretch") + 1) * block, F.col("at") + F.col("size"), "hi")
    parts = cut.join(taken, ["source_no", "stretch"]).select("row_id", "slot", "rank", "pass", "at", (start - F.col("at")).alias("start"), (end - start).alias("length")).filter("length > 0")
    blocks = parts.groupBy("row_id", "slot", "rank", "pass", "at").agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    words_of = parts.groupBy("row_id").agg(F.sum("length").alias("taken"))
    out = laid.join(words_of, "row_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select("row_id", "doc_id", "source", "size", "source_size", "target", "taken"), blocks


def sizes_of(docs: DataFrame) -> DataFrame:
    """The stored table that ``mix`` works on; texts are read and counted once."""
    return durable(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", word_count(F.col("text")).alias("size")))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted, at most 3 times its size).

    Null texts have size 0; a null source is a source, ordered last; repeated rows are documents of their own; extra
    columns are ignored.
    """
    return mix(sizes_of(docs), weights)[0].select("doc_id", "size", "source_size", "target", "taken")


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it no column of ``docs``; case does not tell names apart."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _taken_parts(docs: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """row (the columns of ``docs``, the text being what the slot takes), slot, place, start, length."""
    # The user's columns travel in one, so no name of theirs can meet one of ours.
    numbered = durable(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_id")))
    sizes = durable(numbered.select("row_id", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), word_count(F.col("row.text")).alias("size")))
    blocks = mix(sizes, weights)[1]
    part = F.struct(F.col("slot"), F.struct("pass", "at").alias("place"), F.col("start"), F.col("length"))
    parts = blocks.groupBy("row_id").agg(F.collect_list(part).alias("parts"))
    # A generator keeps the words from being found again for each part.
    words = F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))
    rows = numbered.join(parts, "row_id").withColumn("words", F.explode(F.array(words)))
    cut = lambda p: F.struct(
        p["slot"].alias("slot"), p["place"].alias("place"), p["start"].alias("start"), p["length"].alias("length"),
        F.when(p["length"] < F.size("words"), F.array_join(F.slice("words", (p["start"] + 1).cast("int"), p["length"].cast("int")), " ")).alias("text"),
    )
    rows = rows.withColumn("part", F.explode(F.transform("parts", cut)))
    new, row = F.col("part")["text"], F.col("row")
    put = {"text": F.coalesce(new, row["text"])}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(new.isNotNull(), F.length(new)).otherwise(row["n_chars"]).cast(docs.schema["n_chars"].dataType)
    made = F.struct(*[put.get(c, row[c]).alias(c) for c in docs.columns])
    return rows.select(made.alias("row"), *[F.col("part")[c].alias(c) for c in ("slot", "place", "start", "length")])


def scheduled_blocks(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The mix itself: the columns of ``docs``, and _mix_slot, _mix_place (order inside a slot), _mix_start, _mix_length, with
    further underscores behind such a name if ``docs`` has it.

    A row is the words that one slot takes of one document; its text is the document's where it takes all of it, else these
    words with one space between them. n_chars, if there, is counted anew for such parts.
    """
    own = {c: _free(docs, f"_mix_{c}") for c in ("slot", "place", "start", "length")}
    return _taken_parts(docs, weights).select("row.*", *[F.col(c).alias(n) for c, n in own.items()])


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The blocks of ``scheduled_blocks`` as rows of ``docs``, in the order of their slots.

    Documents that no slot takes are left out, so those without words are; null ids and sources stay; repeated rows are
    documents of their own; a long text is taken block by block; other columns are kept, whatever their names; an empty table
    gives no rows.
    """
    rows = _taken_parts(docs, weights)
    return rows.repartitionByRange("slot").sortWithinPartitions("slot", "place").select("row.*")
