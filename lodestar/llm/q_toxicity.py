"""op2: toxicity of all documents, learned from the labels outside the fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.registry import query
from lodestar.llm.toxicity import fit_on_labels, is_held_out, score
from lodestar.sources.tables import read_table


@query("op2_factorization_toxicity")
def op2_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = fit_on_labels(docs, read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    scored = score(docs, model, carry=["doc_id"])
    return scored.select(
        "row.doc_id",
        is_held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
