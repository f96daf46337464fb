"""op10: the indexed and the shuffled join against brute force."""

import random

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import corpus, documents, prose

from lodestar.llm.decontam import flag_contamination, merge_spans, words_of


def brute(texts, items, window=13):
    out = {}
    for d, t in enumerate(texts):
        w = words_of(t)
        hit, found = set(), set()
        for item, it in items:
            iw = words_of(it)
            for s in range(max(1, len(iw) - window + 1)) if iw else ():
                x = iw[s : s + window]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit.update(range(p, p + len(x)))
                        found.add("null" if item is None else str(item))
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("bound", [1 << 20, 1])
def test_against_brute_force(spark, bound):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(1, 40), 60)) for i in range(12)]
    items += [(12, "only"), (13, "W1, w2. w3"), (14, None), (None, prose(rng, 15)), (15, "..."), (2, items[2][1]), (16, "a a a a")]
    texts = corpus(n=20)
    for i, t in items:
        if t:
            texts.append(prose(rng, 10, 60) + " " + t.upper().replace(" ", "; ") + " " + prose(rng, 10, 60))
            texts.append(t)
    texts += ["a " * 50, "only only", "é" * 3, " w1 w2 w3"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts).withColumn("n_hit", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("spans", F.lit(1))
    found = flag_contamination(docs.repartition(3), bench, max_index_bytes=bound).collect()
    want = brute(texts, items)
    assert len(found) == len(texts)
    for r in found:
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == want[r["row"]["doc_id"]], r["row"]["doc_id"]
        assert sum(s["length"] for s in r["spans"]) == r["n_hit"]
        assert r["row"]["text"] == texts[r["row"]["doc_id"]]


@pytest.mark.parametrize("bound", [1 << 20, -1])
def test_empty_tables(spark, bound):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in flag_contamination(documents(spark, ["a b", None]), bench, max_index_bytes=bound).collect()] == [0, 0]
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert flag_contamination(documents(spark, []), one, max_index_bytes=bound).collect() == []


def test_merge_spans():
    assert merge_spans([(5, 3), (0, 2), (2, 1), (6, 1)]) == [(0, 3), (5, 3)]
