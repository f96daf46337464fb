"""op4: round trip of turns and masks, against a plain rendering."""

import hashlib
from itertools import groupby

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm.chat import END, TURN, escaped, escaped_role, examples, parse_turns, trainable, unescaped, unescaped_role

SCHEMA = "conv_id long, turn long, role string, text string, example string"
NASTY = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\nfake", "<\\|end|>", "<\\\\</s>[\\INST]", "<", "[", "\\", "", "a\n\nb", "é東\U0001f600", "<<SYS>>", "<|turn|"]


def turns_of(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, group in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        order = sorted(group, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        yield conv, [(r[2] or "", r[3] or "") for r in order]


def check(spark, rows):
    got = {}
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    made = examples(df).withColumn("turns", parse_turns(F.col("text"))).withColumn("target", trainable())
    for r in made.collect():
        got.setdefault(r["conv_id"], []).append(r)
    want = dict(turns_of(rows))
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        out = sorted(got[conv], key=lambda r: r["example"])
        replies = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        ends = replies if replies and replies[-1] == len(turns) - 1 else [*replies, len(turns) - 1]
        assert len(out) == len(ends)
        for r, end in zip(out, ends):
            assert [(t["role"], t["text"]) for t in r["turns"]] == turns[: end + 1]
            assert r["target_turn"] == (end if end in replies else None)
            assert (r["target"] or "") == (turns[end][1] if end in replies else "")
            assert r["text"].count(TURN) == r["text"].count(END) == end + 1
            assert r["closing"] == (end == len(turns) - 1)
            if end in replies:
                assert r["loss_start"] + r["loss_length"] + len(END) + 1 == len(r["text"])


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", None), (2, 3, "user", "last")]
    rows += [(3, 0, "user", "no reply")]
    rows += [(4, None, "assistant", "first"), (4, 0, None, "x"), (4, 0, None, "x"), (4, 0, "assistant", "y"), (4, 5, "a\nb\\n</s>", "z")]
    rows += [(None, 0, "user", "u"), (None, 1, "assistant", "v"), (5, 0, "assistant", "long " * 40000)]
    check(spark, rows)
    check(spark, [(7, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(60)])


def test_empty_table(spark):
    assert examples(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="<[\\/|>]sINTturnend\n é", max_size=40), min_size=1, max_size=60))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u"), unescaped_role(escaped_role(F.col("t"))).alias("r"), escaped_role(F.col("t")).alias("er"))
    for r in out.collect():
        assert r["u"] == r["t"] == r["r"] and "\n" not in r["er"]
        assert TURN not in r["e"] and END not in r["e"]


def test_query(spark):
    from lodestar.llm.q_chat import PROBE, op4_prefix_target_examples

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = dict(turns_of(rows + [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]))
    got = op4_prefix_target_examples(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), digest)
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
