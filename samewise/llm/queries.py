"""One query per corpus operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences, oracle, packing, piece_table, quality_model, quality_rules, secrets, sharding, simhash, suffix_dedup, vector_forest
from .common import table


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table.digests(piece_table.encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept", "failed")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    out = quality_model.scored(docs, model)
    return out.select("doc_id", (quality_model.third() == 1).alias("held_out"), "score", "predicted")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scanned(table(spark, sf_dir, "documents")))


def op5_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), [1.0] * 16)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(licences.licences(table(spark, sf_dir, "documents")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_quality_rules, op3_quality_model, op4_secrets, op5_vector_forest, op6_simhash, op7_packing, op8_sharding, op9_licences, op10_suffix_dedup)}
ORACLE: dict[str, str] = {"op2_quality_rules": oracle.QUALITY_RULES, "op8_sharding": oracle.SHARDING}
