"""A pipeline over ``documents``: each stage works on what its predecessor kept.

Quality rules, line deduplication, near-duplicate removal, removal of repeated
long strings, and packing. All stages but the last return the columns of
``documents``; the last returns a row for each packed piece.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import common, lines, near, packing, quality, suffixes


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject, by a classifier fitted on ``labels``.

    Null, empty and short texts are rejected. Repeated rows share their verdict;
    rows without a doc_id are judged alike; an empty table gives an empty one.
    All columns stay, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.fit(docs, labels))


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``docs`` with the lengths of their new texts, where ``like`` has such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)) if "n_chars" in like.columns else docs


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes blocks of lines that an earlier document holds in the same order.

    All rows stay. Null texts and doc_ids, empty texts and empty tables pass as
    they are; equal rows lose the same lines; further columns stay, whatever
    their names, but ``n_chars`` is counted again.
    """
    return _counted(lines.texts(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: a row of its least doc_id.

    Texts without words are one class. Rows without a doc_id stay; of repeated
    rows one stays; an empty table gives an empty one. All columns stay, whatever
    their names.
    """
    return near.keep(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 200 bytes that start at two places or more.

    All rows stay, also those whose text is then empty; null texts stay null;
    characters stay whole. Empty tables give empty ones; further columns stay,
    whatever their names, but ``n_chars`` is counted again.
    """
    return _counted(suffixes.texts(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens.

    Null and empty texts are one token; rows without a doc_id and repeated rows
    are packed each; an empty table gives no rows. Columns beyond doc_id and text
    are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: Tokenisation and the classifier are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again.

    A stage's intermediate tables and its input are deleted when its result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with common.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
