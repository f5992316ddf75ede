"""The corpus pipeline: documents without toxic ones, near copies and benchmark passages, redacted and encoded.

Each stage takes (spark, docs, sf_dir) and gives a table, which is written and read again as the next one's ``docs``.
All but the last give the columns of their input; the last gives the ids of each text. A stage takes any input with the
columns of documents, empty tables, null values, repeated rows and further columns included, as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import decontaminate, near_dup, pieces, pii, toxicity
from scanloom.llm.common import stage, table, use_own_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, learned from the labels, rejects."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of a benchmark item occurs."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, and ``n_chars`` that of the text that is left."""
    redacted = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    kind = dict(docs.dtypes)["n_chars"]
    return redacted.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether they decode to the text."""
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", encode_pieces),
]

#: The stages can't be expressed in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    use_own_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


PIPELINE = {"pipeline": run}
PIPELINE_SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
