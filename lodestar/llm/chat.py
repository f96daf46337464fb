"""Chat formatting by prefix-target expansion.

A conversation is the rows of one ``conv_id`` in the order of their turn. Every
assistant turn becomes an example of its own: all turns before it are context,
and only that reply is trainable. Turns after the last reply (or a whole
conversation without a reply) close with one example that has no target, so
that the output holds every turn. An example has

- ``text``: the formatted turns up to the target. A turn is written as
  ``<|turn|>role\\n`` + text + ``<|end|>\\n``;
- ``loss_start``, ``loss_length``: the span of the target's text in code points
  (length 0 and start NULL without a target). The marks are not trainable.

Texts and roles can't forge marks. A control string (``<|turn|>``, ``<|end|>``,
and those of other common templates) inside a text gets one backslash after its
first character, and one that already has backslashes there gets one more;
``unescaped`` takes one away. A line break in a role is written
as ``\\n`` there, with backslashes doubled. Everything else is left as it is.

Defined results: NULL role and NULL text count as empty; a NULL turn comes
before all others; equal turns are ordered by role, then text, and repeated
rows are kept; rows with NULL conv_id form one conversation; an empty table
gives no examples. The conversation is put together in one row, as its last
example must hold it anyway. Columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
# Control strings that are escaped inside texts (fixed values): this
# template's marks and those of other public chat templates.
CONTROL = "\\|turn\\|>|\\|end\\|>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|/?s>|</?SYS>>"
SQUARE = "/?INST\\]"


def escaped(c: Column) -> Column:
    angle = F.regexp_replace(c, f"<(\\\\*)({CONTROL})", "<\\\\$1$2")
    return F.regexp_replace(angle, f"\\[(\\\\*)({SQUARE})", "[\\\\$1$2")


def unescaped(c: Column) -> Column:
    angle = F.regexp_replace(c, f"<\\\\(\\\\*)({CONTROL})", "<$1$2")
    return F.regexp_replace(angle, f"\\[\\\\(\\\\*)({SQUARE})", "[$1$2")


def escaped_role(c: Column) -> Column:
    """Roles end at a line break, so theirs become ``\\n`` and backslashes double."""
    return F.replace(F.replace(escaped(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(c: Column) -> Column:
    # a break is an n after an odd number of backslashes
    breaks = F.regexp_replace(c, "(?<!\\\\)((?:\\\\\\\\)*)\\\\n", "$1\n")
    back = F.replace(breaks, F.lit("\\\\"), F.lit("\\"))
    return unescaped(back)


def examples(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant"
) -> DataFrame:
    """conv_id, example (0, 1, ... in the conversation), target_turn (index of
    the trainable turn, NULL in a closing example), text, loss_start,
    loss_length, closing (the conversation's last example)."""
    rows = df.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).isNotNull().alias("has"),
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    pieces = conv.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == F.lit(target)).alias("is_target"),
        F.transform("turns", lambda t: F.concat(F.lit(TURN), escaped_role(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("turns", lambda t: escaped(t["text"])).alias("bodies"),
    )
    n = F.size("is_target")
    replies = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("is_target", i))
    # a last turn that is no reply closes the conversation without a target
    ends = F.when(F.get("is_target", n - 1), replies).otherwise(F.concat(replies, F.array(n - 1)))
    numbered = pieces.select("*", n.alias("n"), F.posexplode(ends).alias("example", "last"))
    whole = F.transform(
        F.sequence(F.lit(0), F.col("last")), lambda i: F.concat(F.get("heads", i), F.get("bodies", i), F.lit(END + "\n"))
    )
    made = numbered.select(
        "conv_id",
        "example",
        F.when(F.get("is_target", F.col("last")), F.col("last")).alias("target_turn"),
        F.array_join(whole, "").alias("text"),
        F.length(F.get("bodies", F.col("last"))).cast("long").alias("body_length"),
        (F.col("last") == F.col("n") - 1).alias("closing"),
    )
    reply = F.col("target_turn").isNotNull()
    return made.select(
        "conv_id",
        "example",
        "target_turn",
        "text",
        F.when(reply, F.length("text") - len(END) - 1 - F.col("body_length")).cast("long").alias("loss_start"),
        F.when(reply, F.col("body_length")).otherwise(F.lit(0)).cast("long").alias("loss_length"),
        "closing",
    )


def trainable(text: str = "text", start: str = "loss_start", length: str = "loss_length") -> Column:
    """What the loss mask of an example covers, as it was before formatting."""
    return unescaped(F.substring(F.col(text), F.col(start).cast("int") + 1, F.col(length).cast("int")))


def parse_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text, read from its marks."""
    parts = F.regexp_extract_all(text, F.lit("(?s)<\\|turn\\|>([^\n]*)\n(.*?)<\\|end\\|>\n"), F.lit(0))
    body = lambda p: F.substring(p, len(TURN) + 1, F.length(p) - len(TURN) - len(END) - 1)

    def split(p: Column) -> Column:
        cut = F.locate("\n", body(p))
        return F.struct(
            unescaped_role(F.substring(body(p), F.lit(1), cut - 1)).alias("role"),
            unescaped(F.substring(body(p), cut + 1, F.length(body(p)))).alias("text"),
        )

    return F.transform(parts, split)
