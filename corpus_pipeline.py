"""The corpus pipeline: documents through toxicity, near-dedup, decontamination, secret scan and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's result as Parquet in the shared checkpoint folder and reads it back as the next one's
documents, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.arrowtext import saved
from feedlake.llm.decontaminate import decontaminate
from feedlake.llm.near_dedup import drop_near_duplicates
from feedlake.llm.packing import pack
from feedlake.llm.queries import vocabulary
from feedlake.llm.secret_scan import redact
from feedlake.llm.secret_scan import train as train_secrets
from feedlake.llm.toxicity import reject_toxic
from feedlake.llm.toxicity import train as train_toxicity
from feedlake.session import apply_defaults
from feedlake.sources.tables import read_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the network learns from the labelled ones."""
    return reject_toxic(docs, train_toxicity(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark."""
    return redact(docs, net=train_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 1024 tokens."""
    return pack(docs, vocabulary(), tokens=1024).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: the networks have no SQL form; tests/llm checks the pipeline against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn, each to all its predecessor kept."""
    apply_defaults(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
