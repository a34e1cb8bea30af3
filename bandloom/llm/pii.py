"""Personal data: pattern spans, and terms that reveal protected values; DataFrame operations only.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers with their places. The values that occur in
at least SUPPORT different texts are protected entities. Every term of a text with such a value, however far from it, is
measured on the whole corpus: of the information -log2 p(entity), how much does the term give away,
PMI(entity; term) / -log2 p(entity)? That is 1 if the term occurs with the entity only. All occurrences of the terms from
REVEALS on, in all texts, become spans of kind ``term``: they are generalised, or removed where they reveal all but nothing
less than REMOVES. Counts are of documents; rare co-occurrence and mere copies prove nothing, so a pair counts from SUPPORT
different texts on. Words that share a character with a pattern span are no terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, forget

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns (Java). Each finds what the plain pattern finds leftmost and non-overlapping, without its backtracking:
#: a match can only begin where a run of its first characters begins or where the previous match ended, and card keeps
#: only runs that have 16 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
IP_OK = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
#: Texts that a pair needs, and shares of the entity's information.
SUPPORT, REVEALS, REMOVES = 3, 0.9, 0.98
#: Characters that separate words, and one that hides those of spans; a word that holds it itself is no term.
BLANK, MASK = r"[\x20\x09-\x0D]", "\uffff"
#: Code points of a piece in which a text is cut to be put together anew.
PIECE = 256
#: Hashes of texts or terms (8 bytes each) up to which their table is broadcast.
BROADCAST_KEYS = 1 << 20


def _luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    d = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        (kind == "email")
        | ((kind == "ip") & value.rlike(IP_OK))
        | ((kind == "card") & digits.between(16, 19) & _luhn(value))
        | ((kind == "phone") & digits.between(8, 15))
    )


def _hits(text: Column) -> Column:
    """Of each kind that matches: kind, the text between its matches (one part more than there are matches), the matches."""
    parts = []
    for k in KINDS:
        p = PATTERNS[k]
        has = (F.contains(text, F.lit(NEEDS[k])) & text.rlike(p)) if NEEDS[k] else text.rlike(p)
        parts.append(F.when(has, F.struct(F.lit(k).alias("kind"), F.split(text, p, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("values"))))
    return F.array_compact(F.array(*parts))


def _matches(hit: Column) -> Column:
    """kind, i, before (characters since the last match of the kind), value of each match."""
    rows = F.zip_with(F.slice(hit["gaps"], 1, F.size(hit["values"])), hit["values"], lambda g, v: F.struct(F.length(g).alias("before"), v.alias("value")))
    return F.transform(rows, lambda x, i: F.struct(hit["kind"].alias("kind"), i.alias("i"), x["before"].alias("before"), x["value"].alias("value")))


def _masked_words(hit: Column) -> Column:
    """The words of the text, those that share a character with a span of the kind with a MASK in them. All kinds cut the
    text into the same words."""
    hide = lambda v: F.when(_valid(hit["kind"], v), F.regexp_replace(v, r"[^\x20\x09-\x0D]", MASK)).otherwise(v)
    text = F.array_join(F.zip_with(hit["gaps"], F.transform(hit["values"], hide), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    return F.split(text, f"{BLANK}+", -1)


def _clear_words(hits: Column) -> Column:
    """The distinct words that share no character with a span."""
    either = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(F.contains(x, F.lit(MASK)), x).otherwise(y))
    first = _masked_words(F.element_at(hits, 1))
    words = F.aggregate(F.slice(hits, 2, F.size(hits)), first, lambda a, h: either(a, _masked_words(h)))
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~F.contains(w, F.lit(MASK))))


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, rows), both stored. spans: uid (of a row of ``docs``), doc_id, th (xxhash64 of the text), kind, start, end
    (code points, end exclusive), value. rows: uid, th and the distinct clear words of the texts with a match."""
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    # Generators keep what they make from being computed again by each column that uses it.
    hit = numbered.select("uid", "doc_id", "th", F.explode(F.filter(F.array(_hits(F.col("text"))), lambda x: F.size(x) > 0)).alias("hits"))
    raw = durable(hit.select("uid", "doc_id", "th", F.flatten(F.transform("hits", _matches)).alias("matches"), _clear_words(F.col("hits")).alias("words")))
    each = raw.select("uid", "doc_id", "th", F.explode("matches").alias("x")).select("uid", "doc_id", "th", "x.*")
    to = Window.partitionBy("uid", "kind").orderBy("i")
    start = F.sum("before").over(to) + F.coalesce(F.sum(F.length("value")).over(to.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.withColumn("start", start.cast("long")).withColumn("end", F.col("start") + F.length("value"))
    return durable(placed.filter(_valid(F.col("kind"), F.col("value")))), raw.select("uid", "th", "words")


def _few(df: DataFrame) -> DataFrame:
    """A stored table of keys and counts, broadcast if its rows are at most BROADCAST_KEYS."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _only(terms: DataFrame, wanted: DataFrame, *more: str) -> DataFrame:
    """Those of ``terms`` whose term is in the stored table ``wanted``, with its columns ``more``. A short table comes as
    hashes, and nothing is shuffled."""
    if wanted.count() > BROADCAST_KEYS:
        return terms.join(wanted.select("term", *more), "term")
    hashes = wanted.select(F.xxhash64("term").alias("_hash"), *more).dropDuplicates(["_hash"])
    return terms.join(F.broadcast(hashes), F.xxhash64("term") == F.col("_hash")).drop("_hash")


def _classes(rows: DataFrame, name: str, *same: str) -> DataFrame:
    """``name``, rep: of the names that stand in exactly the same texts (th) and agree in ``same``, the least. They have
    the same counts with everything, so one of them is counted for all: lists that are copied do not multiply."""
    marks = rows.groupBy(name, *same).agg(F.expr("bit_xor(xxhash64(th))").alias("_a"), F.expr("bit_xor(xxhash64('b', th))").alias("_b"), F.count("*").alias("n_texts"))
    marks = durable(marks.filter(F.col("n_texts") >= SUPPORT))
    return durable(marks.join(marks.groupBy("_a", "_b", "n_texts", *same).agg(F.min(name).alias("rep")), ["_a", "_b", "n_texts", *same]).select(name, "rep"))


def told_terms(docs: DataFrame, spans: DataFrame, rows: DataFrame) -> DataFrame:
    """The stored table of disclosing terms: term, reveals (the greatest share of a protected value's information)."""
    entity = F.concat_ws(":", "kind", "value")
    per_text = durable(spans.select("uid", "th", entity.alias("entity")).distinct().groupBy("entity", "th").agg(F.count("*").alias("c")))
    known = durable(per_text.groupBy("entity").agg(F.count("*").alias("n_texts"), F.sum("c").alias("n_entity")).filter(F.col("n_texts") >= SUPPORT).drop("n_texts"))
    total = F.lit(float(max(2, docs.count())))
    held = durable(per_text.select("entity", "th").join(_few(known), "entity"))
    # Equal texts have equal spans and terms: one of them is looked at, and counts as often as it is there.
    copies = rows.groupBy("th").agg(F.min("uid").alias("uid"), F.count("*").alias("copies"))
    texts = durable(held.groupBy("th").agg(F.max("n_entity").alias("top")).join(copies, "th"))
    words = rows.drop("th").join(_few(texts), "uid").select("th", "copies", "top", F.explode("words").alias("term"))
    wanted = durable(words.groupBy("term").agg(F.count("*").alias("n_texts")).filter(F.col("n_texts") >= SUPPORT).select("term"))
    all_words = docs.select(F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), f"{BLANK}+", -1))).alias("term"))
    n_term = _only(all_words, wanted).groupBy("term").agg(F.count("*").alias("n_term"))
    # n_pair is at most n_entity, so a term in more documents than this reveals less than REVEALS.
    most = lambda n: total * F.pow(n / total, F.lit(REVEALS)) * (1 + 1e-9)
    top = known.agg(F.coalesce(F.max("n_entity"), F.lit(0))).first()[0]
    rare = durable(n_term.filter(F.col("n_term") <= most(F.lit(float(top)))).join(wanted, "term", "left_semi"))
    clear = durable(_only(words, rare, "n_term").filter(F.col("n_term") <= most(F.col("top"))).select("th", "copies", "term", "n_term"))
    of_term, of_entity = _classes(clear, "term", "n_term"), _classes(held, "entity", "n_entity")
    one_term = clear.join(of_term.filter("term = rep").select("term"), "term")
    one_entity = held.join(of_entity.filter("entity = rep").select("entity"), "entity")
    both = one_term.join(one_entity, "th").filter(F.col("n_term") <= most(F.col("n_entity")))
    pairs = both.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_texts"), F.sum("copies").alias("n_pair")).filter(F.col("n_texts") >= SUPPORT)
    info = F.log2(total / F.col("n_entity"))
    pmi = F.log2(F.col("n_pair") * total / (F.col("n_entity") * F.greatest("n_term", "n_pair")))
    told = pairs.withColumn("reveals", F.when(info > 0, pmi / info).otherwise(0.0)).filter(F.col("reveals") >= REVEALS)
    told = told.groupBy(F.col("term").alias("rep")).agg(F.max("reveals").alias("reveals"))
    told = durable(of_term.join(told, "rep").select("term", "reveals"))
    for done in (rows, per_text, known, held, texts, wanted, rare, clear, of_term, of_entity):
        forget(done)
    return told


def occurrences(docs: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, th, term, reveals, start, end: every word of ``docs`` that is a term of ``told``.

    Row by row and without a shuffle: a text's words go in runs of about 32 or more, each with its place, so that a word's
    place takes the lengths of its run alone.
    """
    made = lambda c, *keep: docs_.select("doc_id", "th", *keep, F.explode(F.array(c)).alias("x"))
    docs_ = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    docs_ = made(F.split("text", BLANK, -1)).withColumnRenamed("x", "w")
    n, run = F.size("w"), F.greatest(F.lit(32), F.ceil(F.sqrt(F.size("w")) / 2)).cast("int")
    runs = F.sequence(F.lit(0), F.floor((n - 1) / run).cast("int"))
    part = lambda j: F.slice("w", j * run + 1, run)
    docs_ = made(F.struct("w", F.transform(runs, lambda j: F.length(F.array_join(part(j), " "))).alias("sizes"))).select("doc_id", "th", "x.*")
    base = lambda j: F.aggregate(F.slice("sizes", F.lit(1), j), F.lit(0).cast("long"), lambda a, x: a + x + 1)
    docs_ = docs_.select("doc_id", "th", F.explode(F.transform(runs, lambda j: F.struct(part(j).alias("words"), base(j).alias("base")))).alias("x")).select("doc_id", "th", "x.*")
    each = docs_.select("doc_id", "th", "words", "base", F.posexplode("words").alias("i", "term"))
    start = F.col("base") + F.when(F.col("i") > 0, F.length(F.array_join(F.slice("words", F.lit(1), F.col("i")), " ")) + 1).otherwise(0)
    placed = lambda d, *more: d.select("doc_id", "th", "term", start.alias("start"), *more)
    # Places are worked out for the words that are found; if those must be shuffled to be found, before that, without runs.
    found = placed(_only(each, told, "reveals"), "reveals") if told.count() <= BROADCAST_KEYS else _only(placed(each), told, "reveals")
    return found.withColumn("end", F.col("start") + F.length("term")).join(told.select("term"), "term", "left_semi").distinct()


def disclosing_terms(docs: DataFrame, spans: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, th, kind (``term``), start, end, value, reveals: all occurrences of the words that disclose protected values
    and share no character with a span."""
    told = told_terms(docs, spans, rows)
    if told.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, th long, kind string, start long, end long, value string, reveals double")
    words = durable(occurrences(docs, told))
    # A word meets a span if, of the spans that begin before its end, the farthest ends after its start.
    none = lambda kind: F.lit(None).cast(kind)
    both = words.select("doc_id", "th", "term", "reveals", "start", "end", F.col("end").alias("at"), F.lit(0).alias("side"), none("long").alias("upto")).unionByName(
        spans.select("doc_id", "th", none("string").alias("term"), none("double").alias("reveals"), "start", "end", F.col("start").alias("at"), F.lit(1).alias("side"), F.col("end").alias("upto"))
    )
    order = Window.partitionBy("doc_id", "th").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clear = both.withColumn("upto", F.max("upto").over(order)).filter((F.col("side") == 0) & F.coalesce(F.col("upto") <= F.col("start"), F.lit(True)))
    return clear.select("doc_id", "th", F.lit("term").alias("kind"), "start", "end", F.col("term").alias("value"), "reveals")


def all_spans(docs: DataFrame) -> DataFrame:
    """Pattern spans and disclosing terms: doc_id, th, kind, start, end, value, reveals (null for patterns); once for the
    rows of ``docs`` that repeat doc_id and text."""
    every, rows = find_spans(docs)
    first = every.groupBy("doc_id", "th").agg(F.min("uid").alias("uid")).select("uid")
    base = every.join(first, "uid").select("doc_id", "th", "kind", "start", "end", "value", F.lit(None).cast("double").alias("reveals"))
    return base.unionByName(disclosing_terms(docs, every, rows))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null texts count as empty ones; repeated rows get the same answer each; null ids stay; other columns are ignored; an
    empty table gives no rows. Spans of different kinds may overlap, those of one kind do not.
    """
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, "term")) for x in (k, i)]), F.col("kind"))
    spans = all_spans(docs).withColumn("span", F.struct(order.alias("o"), "start", "end", "kind"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    found = spans.groupBy("doc_id", "th").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS], F.array_sort(F.collect_list("span")).alias("all"))
    found = found.withColumn("base", text(F.filter("all", lambda x: x["kind"] != "term"))).withColumn("spans", text(F.col("all"))).drop("all")
    found = found.withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th")
    on = F.col("th").eqNullSafe(F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    out = docs.select("doc_id", F.xxhash64("text").alias("th")).join(found, on, "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _between(pieces: Column, a: Column, b: Column) -> Column:
    """The code points ``a`` to ``b``, exclusive, of the text that ``pieces`` of PIECE each make up."""
    first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    at, to = (a % PIECE).cast("int"), (b % PIECE).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    inner = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first == last, F.substring(piece(first), at + 1, to - at)).otherwise(F.concat(F.substring(piece(first), at + 1, F.lit(PIECE)), inner, F.substring(piece(last), F.lit(1), to)))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced: patterns by their kind in brackets, terms by their shape or, where they reveal at
    least REMOVES of the entity, by nothing. Overlapping spans are replaced as one. n_chars, if there, is counted anew.

    Null, empty and blank texts and texts without spans stay as they are; null ids and repeated rows stay, each sanitised
    alike; other columns are kept, whatever their names; an empty table gives no rows; a text is worked through in time
    proportional to its length and spans.
    """
    spans = all_spans(docs)
    shape = F.when(F.col("value").rlike("[0-9]"), "[NUMBER]").when(F.col("value").rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
    put = F.when(F.col("kind") != "term", F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).when(F.col("reveals") >= REMOVES, "").otherwise(shape)
    order = Window.partitionBy("doc_id", "th").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(F.col("start") >= reach, F.lit(True))).cast("int")).over(order)
    merged = spans.withColumn("put", put).withColumn("island", island).groupBy("doc_id", "th", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("put").alias("put"))
    found = merged.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end", "put"))).alias("cuts"))
    # Texts without a span need no shuffle; where the keys of the others are few, they tell the texts apart.
    found = durable(found)
    # The user's columns travel in one, so no name of theirs can meet one of ours.
    hashed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("th"))
    few = found.count() <= BROADCAST_KEYS
    keys = F.broadcast(found.select("th").distinct())
    hit = hashed.join(keys, "th", "left_semi") if few else hashed
    right = found.select(F.col("doc_id").alias("id"), F.col("th").alias("key"), "cuts")
    out = hit.join(right, F.col("th").eqNullSafe(F.col("key")) & F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    row, text, cuts = F.col("row"), F.col("row.text"), F.col("cuts")
    # Pieces of equal length make the part between two places cost what it holds, wherever in the text it lies.
    out = out.withColumn("pieces", F.explode(F.array(F.when(cuts.isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))))
    ends = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("put"))), cuts)
    stops = F.concat(F.transform(cuts, lambda x: x["start"]), F.array(F.length(text).cast("long")))
    parts = F.zip_with(ends, stops, lambda x, stop: F.concat(x["put"], _between(F.col("pieces"), x["end"], stop)))
    out = out.select("row", "cuts", F.when(cuts.isNotNull(), F.array_join(parts, "")).otherwise(text).alias("new"))
    put = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(cuts.isNotNull(), F.length("new")).otherwise(row["n_chars"]).cast(docs.schema["n_chars"].dataType)
    out = out.select(*[put.get(c, row[c]).alias(c) for c in docs.columns])
    return out.unionByName(hashed.join(keys, "th", "left_anti").select("row.*")) if few else out
