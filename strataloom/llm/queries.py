"""One query for each operator of this folder over the driver's tables, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import mixing, quality, repeats, resample, turns, vectors
from strataloom.llm.decontaminate import contaminated
from strataloom.llm.lm import lm_scores
from strataloom.llm.neardup import near_duplicates
from strataloom.llm.packing import pack_documents
from strataloom.llm.repeats import remove_repeats
from strataloom.llm.sanitise import sanitise, span_count, spans_text
from strataloom.llm.sharding import shard_documents
from strataloom.llm.tokens import token_table
from strataloom.llm.vectors import near_vectors
from strataloom.plans.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_mixing", mixing.SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents")).drop("source")


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.train(docs, labels.where(~quality.held_out()))
    scored = quality.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op3_decontamination")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op4_sharding")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    out = shard_documents(table(spark, sf, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_token_ids")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return token_table(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_embedding_near_dedup", vectors.SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))


@query("op7_substring_dedup", repeats.SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    out = remove_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query("op8_lm_scoring")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return lm_scores(table(spark, sf, "documents"), learn)


@query("op9_minhash_near_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


@query("op10_pii_sanitisation")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    out = sanitise(table(spark, sf, "documents"))
    counts = [span_count(F.col("base"), kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


@query("op11_target_resample", resample.SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return resample.target_resample(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("n_words")


@query("op12_conversation_trie", turns.SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return turns.conversation_nodes(table(spark, sf, "conversations"))


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
