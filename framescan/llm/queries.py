"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat_repair, embed_dedup, lm, mixing, packing, pii, quality_knn, quality_rules, sharding, simhash, whitening
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op2_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_chats(read_table(spark, sf_dir, "conversations"))


def op3_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read_table(spark, sf_dir, "documents"))


def op4_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_groups(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(read_table(spark, sf_dir, "documents"))


def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(read_table(spark, sf_dir, "documents"))


def op9_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read_table(spark, sf_dir, "documents"))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_measures(read_table(spark, sf_dir, "documents"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_chat_repair, op3_mix_to_weights, op4_embedding_groups, op5_lm_scores, op6_quality_votes, op7_simhash_groups, op8_pii_spans, op9_hash_shards, op10_pack_sequences, op11_token_alignment, op12_bpe_round_trip, op13_whitened_embeddings)
}

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality_rules.sql(), "op9_hash_shards": sharding.sql()}
