"""One query per operator over its whole table, with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import (
    bpe,
    checks,
    codes,
    decision_list,
    main_text,
    mixing,
    neighbours,
    packed_ids,
    repeats,
    sharding,
    simhash,
    spelling,
    token_counts,
    tool_calls,
)

SHARDS = 40
SHARD_WEIGHTS = [1.0] * SHARDS
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
PLAIN_RANK_FILE = "byte_bpe_50k.tiktoken"
JSON_FILE = "byte_bpe_50k.json"
#: The id that the plain rank file leaves free, used as end of document in flat files.
FLAT_END_ID = 50_256
PACKED_END_ID = 0
NEIGHBOURS = 10
QUERY_STEP = 100
#: Target weights of the mix: blocks a period; other sources bring the weight of the rest.
TARGET_WEIGHTS = {"src0": 5, "src1": 3, "src2": 3, "src3": 2}
OTHER_WEIGHT = 1
#: One in so many runs of letters loses a letter in the spelling query.
MISSPELT_EVERY = 199

#: Argument schemas of the tools that the conversations' user turns are taken to call.
TOOL_SCHEMAS = {
    "search": {
        "type": "object",
        "required": ["query", "limit"],
        "additionalProperties": False,
        "properties": {
            "query": {"type": "string", "minLength": 1},
            "limit": {"type": "integer", "minimum": 1, "maximum": 100},
        },
    },
    "summarise": {
        "type": "object",
        "required": ["text"],
        "properties": {
            "text": {"type": "string", "minLength": 20},
            "style": {"type": "string", "enum": ["short", "long"]},
        },
    },
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    describe = {
        "size": (F.octet_length(text) + 16).cast("bigint"),
        "text_crc32": F.crc32(F.encode(text, "UTF-8")),
    }
    placed = sharding.shard_slots(table(spark, folder, "documents"), "doc_id", SHARD_WEIGHTS, describe)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
        sharding.shard_of(F.col("doc_id"), [*SHARD_WEIGHTS, 1.0]).alias("grown_shard"),
    )


def op2_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(
        table(spark, folder, "documents"), "doc_id", "text", public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    )


def op3_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), "doc_id", "text")
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.document_token_counts(
        table(spark, folder, "documents"), "doc_id", "text", public_tokenizers.path(PLAIN_RANK_FILE), public_tokenizers.PATTERN, FLAT_END_ID
    )


def conversation_messages(turns: DataFrame) -> DataFrame:
    """Calls and results read from conversations: a user turn calls a tool, the assistant turn that
    follows it is the result, and a call follows the user turn two turns before."""
    conversation = F.col("conv_id").cast("string")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    words = F.size(F.split(F.trim("text"), r"\s+"))
    arguments = F.when(
        F.col("turn") % 4 == 0,
        F.to_json(F.struct(F.col("text").alias("query"), words.alias("limit"))),
    ).otherwise(
        F.to_json(F.struct(F.col("text"), F.when(words > 30, "short").otherwise("long").alias("style")))
    )
    return turns.select(
        conversation.alias("conversation"), "turn", "role",
        F.when(user, "call").when(assistant, "result").otherwise("text").alias("kind"),
        F.when(user, F.concat_ws("-", conversation, F.col("turn").cast("string")))
        .when(assistant, F.concat_ws("-", conversation, (F.col("turn") - 1).cast("string"))).alias("call_id"),
        F.when(user & (F.col("turn") >= 2), F.concat_ws("-", conversation, (F.col("turn") - 2).cast("string"))).alias("after"),
        F.when(user, F.when(F.col("turn") % 4 == 0, "search").otherwise("summarise")).alias("tool"),
        F.when(user, arguments).alias("arguments"),
        F.when(~user, F.col("text")).alias("content"),
    )


def op5_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    linked = tool_calls.link_calls(conversation_messages(table(spark, folder, "conversations")), TOOL_SCHEMAS)
    return linked.withColumn("conv_id", F.col("conversation").cast("bigint")).drop("conversation")


def op6_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(
        table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % QUERY_STEP == 0, NEIGHBOURS
    )


def op7_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    placed = mixing.mixed(table(spark, folder, "documents"), "doc_id", "source", TARGET_WEIGHTS, OTHER_WEIGHT)
    return placed


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return main_text.extract(pages, "html").select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars")
    )


def op9_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    return packed_ids.packed_round_trip(
        table(spark, folder, "documents"), "doc_id", "text", public_tokenizers.path(JSON_FILE), PACKED_END_ID
    )


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = decision_list.judged(documents, table(spark, folder, "labels"), "doc_id", "text")
    return found.select(
        "doc_id", "_statistics.*", F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept")
    )


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows, codebooks = codes.compressed(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")
    digits = F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0")))
    return rows.select(
        "vec_id", F.array_join(digits, "").alias("code"), F.col("error").cast("bigint").alias("error"),
        F.col("label_error").cast("bigint").alias("label_error"),
        F.lit(codes.codebooks_digest(codebooks)).alias("codebooks_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.misspelt_words(table(spark, folder, "documents"), "doc_id", "text", MISSPELT_EVERY)
    return spelling.variants(words.where(F.col("n") >= spelling.MIN_COUNT))


def op13_without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    kept = repeats.without_repeats(table(spark, folder, "documents"), "doc_id", "text")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_shards, op2_bpe_round_trip, op3_simhash_near_duplicates, op4_token_counts, op5_tool_calls,
        op6_nearest_vectors, op7_mixed_sources, op8_main_text, op9_packed_ids, op10_quality_rules,
        op11_vector_codes, op12_spelling_variants, op13_without_repeats,
    )
}

ORACLE: dict[str, str] = {
    "op1_shards": checks.OP1,
    "op6_nearest_vectors": checks.OP6,
    "op7_mixed_sources": checks.op7(TARGET_WEIGHTS, OTHER_WEIGHT, mixing.BLOCK_ROWS),
    "op11_vector_codes": checks.op11(codes.PARTS, codes.ENTRIES, codes.ROUNDS, codes.SCALE),
    "op12_spelling_variants": checks.op12(MISSPELT_EVERY, spelling.MIN_LETTERS, spelling.MIN_COUNT, spelling.RATIO),
    "op13_without_repeats": checks.op13(repeats.WINDOW_WORDS),
}
