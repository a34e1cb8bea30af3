"""The pipeline's stages one after the other, each against a plain reading of its decision."""

import collections

import corpus_pipeline
from bandloom.llm import queries

from . import corpus
from .test_documents import WORD, plain_spans


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], sf).cache()
        assert name == "best_fit_packing" or out.columns == columns
        seen.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] == ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids[1] for i in clean) >= 0.95 * len(clean)
    assert all(not plain_spans(r.text) for r in seen[3].collect())
    before = {r.doc_id: len(WORD.findall(r.text)) for r in seen[3].collect()}
    after = collections.Counter()
    for r in seen[4].collect():
        after[r.doc_id] += len(WORD.findall(r.text))
    assert all(n <= 3 * before[i] for i, n in after.items())
    fills = collections.Counter()
    for r in seen[5].collect():
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 1024


def test_stages_take_awkward_rows(spark, sf):
    """Nulls, blanks, repeated rows, very long texts and clashing columns pass through every stage, and so does no row."""
    rows = [*corpus.rows(), (800, " " * 1_000_000, "en", "s1", 1, "r", "c", "u", "z"), (801, "mail a@b.example <|endoftext|> " * 3, None, None, None, None, None, None, None)]
    for docs in (corpus.frame(spark, rows), corpus.empty(spark)):
        some = docs.count() > 0
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf).cache()
            assert name == "best_fit_packing" or out.columns == docs.columns
            assert (out.count() > 0) == some, name
            docs = out if name != "quality_classifier" else docs


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
