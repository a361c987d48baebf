"""A pipeline from raw documents to encoded training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import op2_lines, op3_decontam, op5_jaccard, op7_language, op8_bpe
from kgloom.llm.common import documents, stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: undetermined and ambiguous ones go."""
    found = op7_language.predict(docs, op7_language.fit(docs))
    return found.where((F.col("lang_pred") != op7_language.UNKNOWN) & ~F.col("ambiguous")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs that start earlier too; those that lose all their lines go."""
    found = op2_lines.dedup(docs).where("n_removed = 0 or n_removed < n_lines")
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each component of linked ones."""
    return op5_jaccard.join(docs, keep_text=True).where("is_first").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = op3_decontam.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hit_items") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, with their digests; only ids and texts pass through Python, and no decoded text comes back."""
    return op8_bpe.encode(docs.select("doc_id", "text"), op8_bpe.vocabulary(), decoded=False).drop("text")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]

#: Trained and iterative stages have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
