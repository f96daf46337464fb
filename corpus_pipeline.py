"""The corpus pipeline: from raw documents to token shards in training order.

Each stage takes (spark, docs, sf_dir) with ``docs`` the rows that the stage
before it kept, and returns a DataFrame; all but the last return the columns of
documents. Stages are written as Parquet and read again, so each starts from
stored rows.

Cases: NULL columns, empty and long texts, repeated rows and extra columns take
the results that the operators' docstrings give. Documents without id are reduced
like others; a group without any id keeps one of its documents. An
empty table passes through every stage as an empty table.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import materialise
from lodestar.llm.decontam import contaminated, flag_contamination
from lodestar.llm.minhash import near_duplicates, text_key
from lodestar.llm.mixing import mix
from lodestar.llm.quality import judged
from lodestar.llm.tokens import sequences, shard_folder, write_training_order
from lodestar.operators.joins import maybe_broadcast
from lodestar.session import apply_session_conf
from lodestar.sources.tables import read_table

SHINGLE = 5  # words
SIMILARITY = 80  # percent


def _rows(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def _stage(fn):
    """A stage under the library's session settings."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apply_session_conf(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their kind."""
    return _rows(judged(docs).where("kept"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (NULL last) of each group of near
    duplicates. Rows are told apart by id and text, so different texts under one id
    stay; of rows that repeat both, one stays, by a hash of the row."""
    found = near_duplicates(docs, shingle=SHINGLE, percent=SIMILARITY).where("chosen")
    names = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).agg(F.count(F.lit(1)).alias("__n"))
    names = materialise(names, "pipeline-kept")
    key = text_key(F.col("text"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & key.eqNullSafe(F.col("__text"))
    once = docs.join(maybe_broadcast(names.where("__n = 1")), on, "left_semi")
    again = docs.join(maybe_broadcast(names.where("__n > 1")), on, "left_semi").select("doc_id", key.alias("__text"), F.struct("*").alias("row"))
    first = again.groupBy("doc_id", "__text").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.unionByName(_rows(first))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is in benchmark windows."""
    benchmark = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return _rows(flag_contamination(docs, benchmark).where(~contaminated()))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")
    return _rows(mix(docs).where("copies > 0").select("row", copies))


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride token records in training order, as read from their shards."""
    return write_training_order(sequences(docs), shard_folder(spark))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token output", token_output),
]
# Centre and scatter, signatures and multipliers are found by iteration.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
