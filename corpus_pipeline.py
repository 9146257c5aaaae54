"""A training corpus from documents: each stage reads what the one before kept.

Toxic documents go, of equal texts and of near copies one stays, documents with benchmark passages
go, and the rest is encoded.  Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.llm import decontaminate, exact_dedup, ngram_join, sentencepiece_lattice, toxicity
from seismark.llm.queries import model_path
from seismark.llm.shared import outside, scratch, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this stage's own input, scores under 0.3."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, up to white space, the document with the smallest id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 80 percent of five-word shingles, the document with the smallest id."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, their number, and whether they decode to it."""
    coded = sentencepiece_lattice.encode(docs.select("doc_id", "text"), model_path(), check_col="round_trip")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: No SQL states the scores of a trained classifier; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's rows are written as Parquet and read again, and its own tables are removed."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            with outside():
                docs = written(kept)
    return docs
