"""From documents to packed training sequences: five stages, each written and read again as the next one's input.

Toxic documents are rejected, of each group of near-duplicates one document stays, secrets are replaced by a
mark, the sources are mixed to their target weights, and the mix is packed. SQL cannot express the learned and
hashed stages; tests compare them with brute force.

All stages but the last return the columns of their input, clashing and extra ones included, and an empty table for
an empty table. A null text counts as empty; no stage needs ids that are unique or not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veltra.llm import mixing, neardup, packing, secrets, toxicity
from veltra.llm.common import default_tokenizer, staged

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the chain calls toxic; it learns from the labels of this stage's input.

    Rows are judged one by one, so repeated ones stay or go together. Null and empty texts stay, as do rows with a null
    id. Without a toxic and a clean label to learn from, all rows stay. Long texts are judged whole.
    """
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    others = F.struct(*(c for c in docs.columns if c != "text")).alias("__row")  # apart, so that no name clashes
    kept = toxicity.scored(docs.select("text", others), model).where("predicted = 0")
    return kept.select(*(F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Null and empty texts are equal to one another: one of them stays. Rows with one id are versions of one document, of
    which the least text stays; rows with a null id all stay. Long texts are compared whole.
    """
    return neardup.without_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret gives way to a mark; n_chars follows the text, if there is such a column. No row goes.

    A null text stays null; repeated rows are redacted alike; texts of any length are scanned whole.
    """
    out = secrets.redacted(docs)
    if "n_chars" not in docs.columns:
        return out
    length = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents; a document taken again is a row for each time.

    Null and empty texts hold no words and go; null sources are one source; repeated rows and ids are documents of their
    own, in the order of doc_id and size.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every row in the packed sequences: doc_id, piece, start, length, ids_crc32,
    sequence_id and offset.

    A null or empty text is one piece, the end id; rows with equal or null ids are packed each for itself; longer texts
    than a sequence are cut.
    """
    return packing.packed(docs, default_tokenizer())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table of a folder, each to all that the one before it kept, and returns the
    last one's rows. Every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
