"""op1: every document in one of 16 shards, and where it goes with a 17th."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.registry import query
from lodestar.llm.sharding import DRAW_HEX, SLOT_HEX, Node, Tree, assign, with_slots
from lodestar.sources.tables import read_table

TREE = Tree.regular(2, 2, 4)


def _sql_pick(nodes: tuple[Node, ...]) -> str:
    """The descent as SQL: the smallest draw of the children, then its subtree."""
    if len(nodes) == 1:
        return str(nodes[0].holds) if isinstance(nodes[0].holds, int) else _sql_pick(nodes[0].holds)
    draws = [
        f"-ln((('0x' || substr(md5(k || ':{n.name}:tree'), 1, {DRAW_HEX}))::BIGINT + 1) / {float(16**DRAW_HEX)}::DOUBLE) / {n.weight}"
        for n in nodes
    ]
    won = f"list_position([{', '.join(draws)}], list_min([{', '.join(draws)}]))"
    cases = " ".join(
        f"WHEN {i + 1} THEN {n.holds if isinstance(n.holds, int) else _sql_pick(n.holds)}" for i, n in enumerate(nodes)
    )
    return f"CASE {won} {cases} END"


# CRC-32 byte by byte: eight shift steps make the table, one lookup a byte.
ORACLE = f"""
WITH RECURSIVE step(b, i, v) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT b, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE i < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM step WHERE i = 8),
d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS x FROM documents),
c AS (
  SELECT doc_id, k, octet_length(encode(x)) + 1 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]))) AS crc
  FROM d, tab),
s AS (
  SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law,
    ({_sql_pick(TREE.regions)})::INTEGER AS shard, ({_sql_pick(TREE.grown().regions)})::INTEGER AS grown_shard,
    md5(k || '|' || crc || '|' || size) AS h FROM c)
SELECT doc_id, size, text_crc32, law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, grown_shard
FROM s
"""


@query("op1_hash_tree_shards", ORACLE)
def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `key`: the tree of 2 regions x 2 racks x 4 shards, and that tree grown by one."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = digest.withColumn("shard", assign(F.col("doc_id"), TREE)).withColumn(
        "grown_shard", assign(F.col("doc_id"), TREE.grown())
    )
    return with_slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


assert SLOT_HEX < DRAW_HEX
