"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.byte_bpe import round_trip_digests
from turnwise.llm.chunk_dedup import repeated_spans
from turnwise.llm.conversation_repair import audit_conversations, audit_sql, damaged
from turnwise.llm.jump_shards import shard_documents, shard_sql
from turnwise.llm.maxscore import maxscore_search
from turnwise.llm.ngram_jaccard import ngram_jaccard_join
from turnwise.llm.packing import pack
from turnwise.llm.prefix_forest import prefix_forest_search
from turnwise.llm.source_divergence import source_divergence, source_divergence_sql
from turnwise.llm.suffix_tree_lm import score_texts
from turnwise.llm.tool_calls import SCHEMAS, conversation_calls, format_tool_calls
from turnwise.llm.toxicity import toxicity
from turnwise.llm.url_filter import filter_urls, url_filter_sql
from turnwise.llm.written import prepared

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    """Register a query under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepared(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).drop("set_key", "class_key")


@query
def op2_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return maxscore_search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE["op2_maxscore_search"] = """
    WITH whole AS (
        SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
        FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5"""


@query
def op3_prefix_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return prefix_forest_search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("row_key")


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE["op5_url_filter"] = url_filter_sql()


@query
def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, needs = conversation_calls(table(spark, sf_dir, "conversations"))
    return format_tool_calls(messages, needs, SCHEMAS)


@query
def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return audit_conversations(conversations, damaged(conversations))


ORACLE["op11_conversation_repair"] = audit_sql()


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE["op12_source_divergence"] = source_divergence_sql()


@query
def op13_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


ORACLE["op13_jump_shards"] = shard_sql()
