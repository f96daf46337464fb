"""op7: base rules and robust outliers over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.quality import judged
from lodestar.llm.registry import query
from lodestar.sources.tables import read_table


@query("op7_mcd_quality")
def op7_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return judged(docs, carry=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )
