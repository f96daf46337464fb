"""op8: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.html import extract
from lodestar.llm.registry import query
from lodestar.sources.tables import read_table


@query("op8_tag_path_text")
def op8_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return extract(pages, carry=["page_id", "url"]).select("row.page_id", "row.url", "text", "n_chars")
