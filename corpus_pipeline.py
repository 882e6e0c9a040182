"""Corpus pipeline: quality rules, line dedup, near-dedup, packing, each stage on all that the one before kept.

``run`` writes each stage's result as Parquet to the folder that the cluster's executors share and reads it again.
All stages but the last return the columns of ``documents``; their decisions are in the rows and texts themselves.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise, read
from lodestrata.llm.line_dedup import line_dedup
from lodestrata.llm.near_dedup import near_dedup
from lodestrata.llm.packing import packing
from lodestrata.llm.quality_rules import fit, judge

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects."""
    return judge(docs.select(*COLUMNS), fit(docs, read(spark, sf_dir, "labels"))).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated long lines that a larger doc_id holds; n_chars follows the text."""
    out = line_dedup(docs.select(*COLUMNS))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return near_dedup(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that stayed, dealt to sequences."""
    return packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("packing", packing_stage)]

#: None: the first stage's verdict is learned, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = materialise(stage(spark, out, sf_dir), name)
    return out
