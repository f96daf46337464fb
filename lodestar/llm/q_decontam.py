"""op10: benchmark windows in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.decontam import WINDOW, contaminated, flag_contamination
from lodestar.llm.registry import query
from lodestar.sources.tables import read_table

# Every document window of every length that items have, hashed by its words.
ORACLE = f"""
WITH low AS (
  SELECT doc_id, row_number() OVER () AS k,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT id, least(len(w), {WINDOW}) AS n, w[s:s + least(len(w), {WINDOW}) - 1] AS win
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
places AS (
  SELECT k, s, n, w[s:s + n - 1] AS win
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM low, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT p.k, p.s, p.n, id FROM places p JOIN wins w ON p.n = w.n AND p.win = w.win),
covered AS (
  SELECT k, count(DISTINCT i) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS i FROM hits) GROUP BY k),
found AS (
  SELECT k, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN covered USING (k) LEFT JOIN found USING (k)
"""


@query("op10_prefix_filtered_decontamination", ORACLE)
def op10_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = flag_contamination(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]), carry=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
