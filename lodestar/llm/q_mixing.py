"""op5: the mix of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import materialise
from lodestar.llm.mixing import plan_mix, rank_hash, with_copies, word_count
from lodestar.llm.registry import query
from lodestar.sources.tables import read_table


@query("op5_entropy_balanced_mix")
def op5_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), rank_hash(docs).alias("hash"))
    rows = materialise(sized, "mix-documents")
    return with_copies(rows, plan_mix(rows)).select("doc_id", "size", "source_size", "target", "taken", "copies")
