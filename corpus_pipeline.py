"""From raw documents to packed training sequences, in five stages.

In every stage a null text is an empty one and stays (of several empty texts all do), a null doc_id stays, rows that repeat
each other are treated alike, texts are taken whole, an empty table gives no rows, and the columns that the stage doesn't
name in its docstring, whatever they are called, go through as they are; packing gives its own columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, mixing, near_dedup, packing, suffix_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, rejects go; where the labels don't tell two kinds apart none
    does."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id stays, with all its rows; texts without words are in no
    class."""
    gone = near_dedup.near_duplicates(docs).where("doc_id != class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what documents with smaller ids hold already, and ``n_chars``, where there is one, follows; a null doc_id counts as
    the greatest."""
    return suffix_dedup.without_repeats(docs, count_col="n_chars" if "n_chars" in docs.columns else None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as the mix takes them, those without words as often as the whole part of their source's rate says.
    A null source is a source."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; an empty text is the end token alone."""
    return packing.pack(docs, public_tokenizers.path(packing.MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can't express the stages; tests/llm/test_brute_force.py holds them against plain versions on a fixture, toxicity by accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's result is written and read again."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return docs
