"""op9: bytes covered by 100-byte strings that start earlier, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.registry import query
from lodestar.llm.suffix import remove_repeats
from lodestar.sources.tables import read_table


@query("op9_induced_sorting_repeats")
def op9_induced_sorting_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
