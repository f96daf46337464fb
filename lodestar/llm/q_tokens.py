"""op6: all documents as token ids in training order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.registry import query
from lodestar.llm.tokens import sequences, shard_folder, write_training_order
from lodestar.sources.tables import read_table


@query("op6_feistel_training_order")
def op6_feistel_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return write_training_order(sequences(docs), shard_folder(spark)).select(
        "slot", "shard", "doc_id", "chunk", "n_tokens", "tokens"
    )
