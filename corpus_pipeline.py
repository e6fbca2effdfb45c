"""Five stages that turn documents into packed training sequences; each calls one of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, lines, minhash, mixing, packing, quality


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the quality rules nor their host's verdict reject."""
    return quality.keep_good(spark, docs)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in one; n_chars follows the text."""
    out = lines.drop_shared_lines(spark, docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(spark, docs, k=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole."""
    return mixing.mixed_documents(spark, docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence of 2048 tokens."""
    return packing.pack(spark, docs, length=2048, end_id=0)


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", without_shared_lines),
    ("near_dedup", without_near_duplicates),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: No SQL: near duplicates are found by signatures and pieces are made by a tokenizer. tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared folder and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = common.Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
