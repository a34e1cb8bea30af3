"""The corpus pipeline: reject bad documents, keep one of each group of near duplicates, sanitise personal data, mix the
sources to target weights, and pack what is left into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.

Every stage works on any ``docs``: null ids, texts and sources, empty and very long texts, ties, repeated rows, an empty
table, and further columns, whatever their names, have the result that its operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandloom.llm import minhash, mixing, packing, pii, quality
from bandloom.llm.shared import documents, durable, labels


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    return quality.keep_good(docs, labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity from 0.8 on."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms replaced."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The scheduled mix: documents as often as their source's target takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, each with its sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", drop_copies),
    ("pii", sanitise),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: Classifier, sketches and tokenizer have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
