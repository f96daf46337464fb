"""op11: all documents in fill-in-middle form, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.fim import restore, transform
from lodestar.llm.registry import query
from lodestar.sources.tables import read_table

ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
e AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM d),
f AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
         WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(list_slice(u, 1, least(a, b)), '') AS p,
    array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') AS m,
    array_to_string(list_slice(u, greatest(a, b) + 1, n), '') AS s FROM e)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""


@query("op11_piece_table_fill_in_middle", ORACLE)
def op11_piece_table_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    made = transform(docs, carry=["doc_id"])
    columns = ["n_units", "form", "prefix_chars", "middle_chars", "output_sha256"]
    back = restore(made, carry=["row", *columns])
    return back.selectExpr(
        "row.row.doc_id",
        "row.n_units AS n",
        "row.form",
        "row.prefix_chars",
        "row.middle_chars",
        "row.output_sha256",
        "restored_sha256",
    )
