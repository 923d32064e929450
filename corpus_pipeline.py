"""From documents to training sequences: toxicity, near duplicates, repeated passages, packing.

Each stage works on all rows its predecessor kept. ``run`` writes every result as Parquet to the shared folder
and reads it again as the documents of the next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.chunk_dedup import remove_spans, repeated_spans
from turnwise.llm.ngram_jaccard import ngram_jaccard_join, with_set_key
from turnwise.llm.packing import pack
from turnwise.llm.toxicity import fit_toxicity, score_toxicity
from turnwise.llm.written import FEW_ROWS, prepared, written

#: A list of at most so many ids (16 bytes each) is broadcast; a longer one is joined by a shuffle.
FEW_IDS = 1 << 20


def _checked(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def _fresh(docs: DataFrame, name: str) -> str:
    """A name for a column of a stage's own, whatever columns ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The model is learned from the labels of the documents here, as in ``op10``."""
    prepared(spark, FEW_ROWS)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _fresh(docs, "score")
    return score_toxicity(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the least ``doc_id`` stays; of its rows that repeat, one.

    Rows are told apart by id and set of shingles, so an id that stands with several texts loses only those that others stand
    for. Rows without words stay, once per id and text. Rows without an id cannot be named by others and stay.
    """
    prepared(spark, FEW_ROWS)
    found = ngram_jaccard_join(docs).where("doc_id IS NOT NULL")
    groups = written(found.select("doc_id", "set_key", "class_key", "component_id"), "groups")
    repeats = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
    ids = written(repeats.where("n > 1 OR component_id <> doc_id"), "ids")
    kept = docs.join(_checked(ids.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    again = ids.where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    again = _checked(again)
    own, key, size = (_fresh(docs, name) for name in ("group", "set_key", "set_size"))
    rows = with_set_key(docs.join(again, "doc_id", "left_semi").select(*docs.columns), key, size)
    least = groups.join(again, "doc_id", "left_semi").where("doc_id = component_id")
    least = least.select("doc_id", F.col("set_key").alias(key), F.col("class_key").alias(own)).distinct()
    first = F.min(F.struct(*docs.columns)).alias("row")
    text = F.when(F.col(size) == 0, F.col("text"))
    once = rows.join(least, ["doc_id", key]).groupBy("doc_id", own, text.alias("words")).agg(first)
    return kept.unionByName(once.select("row.*"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur in an earlier document are cut out; every document stays, ``n_chars`` is counted again."""
    prepared(spark, FEW_ROWS)
    return remove_spans(docs, written(repeated_spans(docs), "spans"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, as in ``op8``."""
    prepared(spark, FEW_ROWS)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: No SQL states the learned scores, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``."""
    docs = prepared(spark, FEW_ROWS).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
