"""Queries of the corpus operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, credentials, minhash, mixing, near_vectors, negatives, packing, pii, quality, sharding, substrings, topk, toxicity
from .shared import documents, embeddings, labels


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicate_vectors(embeddings(spark, sf_dir), cosine=0.98)


def op2_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_golden_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op4_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(embeddings(spark, sf_dir), every=50, k=5)


def op5_zstd_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_swap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op7_information_theoretic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op8_fast_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), k=4, percent=80)


def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), shards=8)


def op10_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(documents(spark, sf_dir), n=35)


def op11_multipart_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secret_spans(documents(spark, sf_dir))


def op12_identity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(documents(spark, sf_dir), "byte_bpe_50k.json", "piece_bpe_32k.model")


def op13_slot_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, sevenths = embeddings(spark, sf_dir), F.col("vec_id") % 7 == 0
    moved = e.withColumn("label", F.when(sevenths, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(moved, every=100, positives=5, k=10, low=30, high=90)


QUERIES = {f.__name__: f for f in (op1_collision_counting, op2_subword_softmax, op3_golden_schedule, op4_pivot_table, op5_zstd_dictionaries, op6_swap_search, op7_information_theoretic, op8_fast_similarity, op9_hash_tree, op10_level_doubling, op11_multipart_linking, op12_identity_map, op13_slot_selection)}
#: Components of ``links`` (a, b) over ``nodes`` (id): the smallest id that each reaches.
_COMPONENTS = """
edges as (select a, b from links union select b, a from links),
reach(id, other) as (select id, id from nodes union select r.id, e.b from reach r join edges e on r.other = e.a),
component as (select id, min(other) component_id from reach group by id)
"""

#: The operators that SQL expresses; the others' hashes, models, tokens or schedules have no SQL form.
ORACLE_SQL: dict[str, str] = {
    "op1_collision_counting": f"""
with recursive nodes as (select vec_id id, label, [x::double for x in embedding] v from embeddings),
good as (select *, sqrt(list_inner_product(v, v)) norm from nodes where label is not null and v is not null and len([x for x in v if x is null or not isfinite(x)]) = 0 and len([x for x in v if x != 0]) > 0),
links as (select p.id a, q.id b from good p join good q on p.label = q.label and p.id < q.id and len(p.v) = len(q.v) where list_inner_product(p.v, q.v) / (p.norm * q.norm) >= 0.98),
{_COMPONENTS}
select id vec_id, (select count(*) from edges where a = n.id)::bigint n_links, component_id, n.id = component_id kept from nodes n join component using (id)""",
    "op4_pivot_table": """
with v as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] v from embeddings where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product([x::double for x in q.v], [x::double for x in c.v])::bigint score from v q join v c on q.vec_id != c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
    "op8_fast_similarity": f"""
with recursive words as (select doc_id id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
nodes as (select id, coalesce(w, []) w from words),
shingles as (select distinct id, unnest(case when len(w) >= 4 then [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from nodes),
sizes as (select id, count(*) n from shingles group by id),
common as (select p.id a, q.id b, count(*) n from shingles p join shingles q on p.s = q.s and p.id < q.id group by all),
links as (select a, b from common c join sizes x on x.id = a join sizes y on y.id = b where 100 * c.n >= 80 * (x.n + y.n - c.n)),
{_COMPONENTS}
select n.id doc_id, coalesce(z.n, 0)::bigint n_shingles, component_id, n.id = component_id kept from nodes n join component using (id) left join sizes z on z.id = n.id""",
    "op10_level_doubling": """
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) w from documents),
starts as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35)),
hit as (select doc_id, i from (select *, count(*) over (partition by h) c from starts) where c > 1),
word as (select doc_id, unnest(w) x, generate_subscripts(w, 1) j from d),
seen as (select word.*, max(hit.i) over (partition by word.doc_id order by j rows between 34 preceding and current row) is not null gone from word left join hit on hit.doc_id = word.doc_id and hit.i = j),
kept as (select doc_id, count(*) filter (gone) n_removed, string_agg(x, ' ' order by j) filter (not gone) t from seen group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id)""",
    "op13_slot_selection": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double)::bigint for x in embedding] v from embeddings where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id anchor_id, q.label = c.label as same, c.vec_id, list_inner_product([x::double for x in q.v], [x::double for x in c.v])::bigint score from v q join v c on q.vec_id != c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id negative_id, s.score negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10""",
}
