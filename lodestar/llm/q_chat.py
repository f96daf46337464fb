"""op4: all conversations, and one whose texts are control strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.chat import CONTROL, END, SQUARE, TURN, examples, parse_turns, trainable
from lodestar.llm.registry import query
from lodestar.sources.tables import read_table

PROBE = "</s>[INST] ok [/INST]"

_ESC = (
    "regexp_replace(regexp_replace({c}, '<(\\\\*)(" + CONTROL + ")', '<\\\\\\1\\2', 'g'), "
    "'\\[(\\\\*)(" + SQUARE + ")', '[\\\\\\1\\2', 'g')"
)
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
o AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length('{TURN}') + length(replace(replace({_ESC.format(c="role")}, '\\', '\\\\'), chr(10), '\\n')) + 1
      + length({_ESC.format(c="text")}) + length('{END}') + 1 AS len
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM o)
SELECT conv_id, max(n)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


@query("op4_prefix_target_examples", ORACLE)
def op4_prefix_target_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted examples: turns from the closing
    example, trainable text from the loss mask of every example."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    made = examples(conv.unionByName(probe))
    turns = F.when(F.col("closing"), parse_turns(F.col("text")))
    read = made.select(
        "conv_id",
        "example",
        F.size(turns).alias("n"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"),
        F.when(F.col("target_turn").isNotNull(), trainable()).otherwise(F.lit("")).alias("loss"),
        F.length("text").cast("long").alias("chars"),
        "closing",
    )
    per_conv = read.groupBy("conv_id").agg(
        F.max(F.when(F.col("closing"), F.col("n"))).cast("long").alias("n_turns"),
        F.max(F.when(F.col("closing"), F.col("sha"))).alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    return per_conv.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
