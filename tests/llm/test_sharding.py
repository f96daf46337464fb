"""op1: the tree's laws and the awkward cases."""

import zlib
from collections import Counter

from pyspark.sql import functions as F
from tests.llm.helpers import corpus, documents

from lodestar.llm.q_sharding import TREE
from lodestar.llm.sharding import Tree, assign, shard_documents, write_shards


def placed(spark, tree, n=4000):
    return {r["id"]: r["s"] for r in spark.range(n).select("id", assign(F.col("id"), tree).alias("s")).collect()}


def test_growth_takes_rows_only_into_the_new_shard(spark):
    tree = TREE
    before = placed(spark, tree)
    for _ in range(3):
        grown = tree.grown()
        after = placed(spark, grown)
        new = max(grown.shards())
        moved = {k for k in before if before[k] != after[k]}
        assert moved and all(after[k] == new for k in moved)
        assert abs(len(moved) - 4000 / len(grown.shards())) < 100
        tree, before = grown, after


def test_movement_is_confined_to_the_subtree(spark):
    before = placed(spark, TREE)
    after = placed(spark, TREE.reweighted("1/0/2", 3.0))  # one shard of region 1, rack 0
    rack = {8, 9, 10, 11}
    for k, s in before.items():
        if s != after[k]:
            assert after[k] == 10 and s in rack
    after = placed(spark, TREE.reweighted("0/1", 1.0))  # a rack of region 0 loses weight
    for k, s in before.items():
        if s != after[k]:
            assert s in {4, 5, 6, 7} and after[k] in {0, 1, 2, 3}


def test_shares_follow_weights(spark):
    share = Counter(placed(spark, TREE.reweighted("1", 24.0)).values())
    top = sum(n for s, n in share.items() if s >= 8)
    assert 0.72 < top / 4000 < 0.78
    assert placed(spark, Tree.regular(1, 1, 1), 5) == dict.fromkeys(range(5), 0)
    assert 0 not in placed(spark, TREE.reweighted("0/0/0", 0.0)).values()


def test_slots_are_gapless_with_nulls_and_repeated_rows(spark, tmp_path):
    texts = corpus()
    ids = [None, None, *range(2, len(texts) - 2), 5, 5]
    docs = documents(spark, texts, ids=ids).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit("clash"))
    out = shard_documents(docs, TREE)
    rows = out.collect()
    assert len(rows) == len(texts)
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(texts)


def test_empty_table_and_query(spark):
    assert shard_documents(documents(spark, []), TREE).collect() == []
    from lodestar.llm.q_sharding import op1_hash_tree_shards

    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_hash_tree_shards(spark, sf).collect():
        b = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 1, zlib.crc32(b), "key")
        assert r["grown_shard"] in (r["shard"], 16)
