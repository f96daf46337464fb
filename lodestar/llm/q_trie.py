"""op12: the prefix trie of all conversations, rebuilt from shared beginnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.registry import query
from lodestar.llm.trie import rebuilt, trie, turn_lists
from lodestar.sources.tables import read_table

MOST = 8

# CRC-32 as in op1's oracle: eight shift steps make the table, one lookup a byte.
ORACLE = """
WITH RECURSIVE step(b, i, v) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT b, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE i < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM step WHERE i = 8),
own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations GROUP BY conv_id),
h AS (
  SELECT conv_id, s, conv_id - conv_id % 5 AS base, coalesce(xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda q: ('0x' || q)::BIGINT)),
    lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]))) % 9, 0) AS h FROM own, tab),
re AS (
  SELECT row_number() OVER () AS rid, c.conv_id,
    list_concat(list_slice(coalesce(b.s, []), 1, c.h), list_slice(c.s, c.h + 1, len(c.s))) AS s
  FROM h c LEFT JOIN own b ON b.conv_id = c.base),
p AS (
  SELECT rid, conv_id, len(s) AS n, d, md5(to_json(list_slice(s, 1, d))::VARCHAR) AS k,
    CASE WHEN d > 0 THEN md5(to_json(list_slice(s, 1, d - 1))::VARCHAR) END AS pk,
    CASE WHEN d > 0 THEN octet_length(encode(s[d].x)) ELSE 0 END AS b
  FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM re)),
node AS (
  SELECT k, any_value(pk) AS pk, any_value(d) AS depth, min(conv_id) AS conv_id, min(rid) AS rid, count(*) AS n_convs, any_value(b) AS b,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM p GROUP BY k),
kids AS (SELECT pk, count(*) AS c FROM node WHERE pk IS NOT NULL GROUP BY pk),
below AS (
  SELECT a.k, sum((x.n_convs - 1) * x.b) AS saved, count(*) FILTER (x.k NOT IN (SELECT pk FROM kids)) AS leaves
  FROM node x JOIN p a ON a.rid = x.rid AND a.d <= x.depth GROUP BY a.k)
SELECT o.conv_id, o.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs,
  coalesce(kids.c, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, o.ends_sha256
FROM node o LEFT JOIN node u ON u.k = o.pk LEFT JOIN kids ON kids.pk = o.k JOIN below ON below.k = o.k
"""


@query("op12_radix_conversation_trie", ORACLE)
def op12_radix_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_lists(read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % (MOST + 1)
    return trie(rebuilt(turns, c - c % 5, head, MOST))
