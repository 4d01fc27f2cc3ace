"""The operators applied to their whole tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowassay.llm import bit_sliced, boosted, budget, cap_filters, chat, context_mixing, golay, iceberg, importance, packing, reshard, token_counts, toxicity
from rowassay.llm.common import table

TOXIC_FROM = 0.7
TOKEN_LIMIT = 4096
GOOD_FROM = 0.3
OLD_SHARDS, SHARDS = 12, 16
CONTROL_CASE = "\\### Assistant: </turn> ok"


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs.filter(~out), table(spark, folder, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op2_cap_filters(spark: SparkSession, folder: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, folder, "embeddings"), 0.98)


def op3_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = toxicity.held_out(F.col("doc_id"), 7, 2)
    scored = context_mixing.score(table(spark, folder, "documents"), ~out)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op4_bit_sliced(spark: SparkSession, folder: str) -> DataFrame:
    return bit_sliced.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10, 1024)


def op5_budget_mix(spark: SparkSession, folder: str) -> DataFrame:
    return budget.mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_golay_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = golay.near_duplicates(table(spark, folder, "documents"), 3, 2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_chat_parts(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CASE).alias("text"))
    turns = turns.unionByName(case)
    return chat.digests(chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))))


def op8_flow_reshard(spark: SparkSession, folder: str) -> DataFrame:
    placed = reshard.place(table(spark, folder, "documents"), OLD_SHARDS)
    moved = reshard.reshard(placed, SHARDS, OLD_SHARDS)
    return moved.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op9_conflict_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.documents_to_pack(table(spark, folder, "documents")))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_boosted_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = boosted.held_out(F.col("doc_id"))
    model = boosted.fit(docs.filter(~out), table(spark, folder, "labels"))
    scored = boosted.score(docs, model, GOOD_FROM)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op13_iceberg_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return iceberg.divergence(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_cap_filters, op3_context_mixing, op4_bit_sliced, op5_budget_mix, op6_golay_simhash, op7_chat_parts, op8_flow_reshard, op9_conflict_packing, op10_token_counts, op11_importance_resampling, op12_boosted_quality, op13_iceberg_divergence)
}


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES["pipeline"] = pipeline
