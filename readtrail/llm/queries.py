"""Registered queries of the operators, over their whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from readtrail.llm import (
    dialogues,
    fingerprints,
    mixing,
    neardup,
    parity,
    periodic,
    pieces,
    quality,
    repeats,
    shards,
    templates,
    token_files,
    topk,
)
from readtrail.session import scratch_folder

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(_table(spark, sf_dir, "pages"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, WORD_MODEL)
    return token_files.read_token_files(spark, path)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(_table(spark, sf_dir, "documents"))
    return taken.selectExpr("doc_id", "size", "source_size", "target", "size * n_copies AS taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select(
        "doc_id", (quality.fold() == 0).alias("held_out"), "score", "predicted"
    )


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digests(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "shards")
    sharded = shards.assign_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    shards.write_shards(sharded.select("doc_id", "text", "shard"), path)
    return shards.read_shards(spark, path).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(_table(spark, sf_dir, "documents"))


def op11_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.repair_digests(_table(spark, sf_dir, "conversations"))


def op12_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.join_groups(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": topk.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op9_sharding": shards.oracle_sql()}
