"""Corpus pipeline: documents to token ids, each stage written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readtrail.llm import mixing, neardup, pieces, quality, repeats
from readtrail.llm.common import staged
from readtrail.llm.queries import PIECE_MODEL
from readtrail.session import scratch_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fit on the labels of the rows that are there, does not reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.good_documents(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, likeness 0.8)."""
    groups = neardup.near_groups(docs, shingle=5)
    # ids of which no row is kept: far fewer than the others, so the texts are moved later or not at all
    gone = groups.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("kept").alias("kept")).where("NOT kept").select("_gone")
    gone = staged(gone, "gone")  # its size is known then, before a shuffle of the texts begins
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def fresh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that an earlier document, or place, has too."""
    return repeats.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left, and the text decoded from them."""
    return pieces.encode_documents(docs, PIECE_MODEL, tuple(c for c in docs.columns if c != "text"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good), ("near-dedup", distinct), ("repeats", fresh), ("mixing", mixed), ("sentencepiece", tokens),
]
ORACLE_SQL = None  # learned weights, signatures and byte matches have no SQL twin; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
