"""op6: one-to-one order, round trip of texts, fixed stride and resumable reads."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import corpus, documents

from lodestar.llm.tokens import END_ID, PATTERN, VOCABULARY, permute, read_from, sequences, write_training_order


@pytest.mark.parametrize("total", [0, 1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_one_to_one(total):
    x = permute(np.arange(total), total)
    assert sorted(x.tolist()) == list(range(total))
    if total >= 1000:
        assert x.tolist() != permute(np.arange(total), total, key=1).tolist()
        assert abs(np.corrcoef(np.arange(total), x)[0, 1]) < 0.15
        # one slot at a time gives the same order
        assert [int(permute(np.array([i]), total)[0]) for i in range(50)] == x[:50].tolist()


def test_round_trip_and_shards(spark, tmp_path):
    import tiktoken

    texts = corpus(n=10) + ["<|endoftext|> is text", "x" * 5000]
    ids = [None, *range(1, len(texts))]
    docs = documents(spark, texts, ids=ids).withColumn("tokens", F.lit("clash")).withColumn("slot", F.lit("clash"))
    path = str(tmp_path / "shards")
    out = write_training_order(sequences(docs.repartition(3), seq_len=64), path, per_shard=50)
    rows = out.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(r["shard"] == r["slot"] // 50 and len(r["tokens"]) == 128 for r in rows)
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {}
    for r in sorted(rows, key=lambda r: r["chunk"]):
        tokens = np.frombuffer(r["tokens"], "<u2").tolist()
        assert tokens[r["n_tokens"] :] == [END_ID] * (64 - r["n_tokens"])
        got.setdefault(r["doc_id"], []).extend(tokens[: r["n_tokens"]])
    for i, t in zip(ids, texts):
        assert got[i][-1] == END_ID and END_ID not in got[i][:-1]
        assert enc.decode(got[i][:-1]) == (t or "")
    part = [r["slot"] for r in read_from(spark, path, 47, 10, per_shard=50).collect()]
    assert part == list(range(47, 57))
    for shard in range(-(-len(rows) // 50)):
        assert len(list((tmp_path / "shards" / f"shard={shard}").glob("*.parquet"))) == 1


def test_empty_table(spark, tmp_path):
    assert write_training_order(sequences(documents(spark, [])), str(tmp_path / "none")).collect() == []
