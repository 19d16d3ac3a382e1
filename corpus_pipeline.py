"""The corpus pipeline: each stage reads what its predecessor kept, and all but the last return the columns of documents.

All stages take null and empty texts (clean, one empty line, linked with nothing, not contaminated, one token), empty
tables (no rows) and further columns (left out).  Rows without an id pass the filters, but toxicity judges them too.
Rows that share an id are one document: near-duplicates and decontamination judge its greatest text and keep or drop
all its rows; toxicity and packing take each row by itself, line dedup each row's own lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, remove, scratch, table
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.toxicity import fit_toxicity
from tidemark.llm.toxicity import toxicity as score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; it learns from the same labels as the operator's query."""
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 4) != 2)
    return docs.where(score(F.col("text"), fit_toxicity(docs, labels)) < 0.3).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text that stays."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.8 or more the one with the least id stays.

    Words and similarity are those that the contract fixes for stages without one of their own; looser copies stay.
    """
    copies = near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of training sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: Scores learned from labels, and tokens, are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread; what a stage has read is removed after it."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if old:
            remove(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
