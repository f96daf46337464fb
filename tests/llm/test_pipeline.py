"""Pipeline stages on planted cases, and the whole run on the smallest tables."""

import random

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F
from tests.llm.helpers import corpus, documents, prose

from lodestar.llm.tokens import SEQ_LEN
from lodestar.session import checkpoint_dir


def planted(spark):
    """Clean prose, junk, copies, near copies, and benchmark passages."""
    rng = random.Random(21)
    clean = [prose(rng, rng.randrange(60, 200)) for _ in range(60)]
    near = clean[3].split()
    near[10] = "changed"
    long = prose(rng, 300).split()
    item = prose(rng, 40)
    texts = {
        "clean": clean + [" ".join(long)],
        "copy": [clean[0], clean[1].upper(), " ".join(near[:]), clean[0]],
        "junk": ["a b c d e f g h " * 20, "short text", None, "", " ".join(w + "%%%" for w in prose(rng, 60).split())],
        "bench": [prose(rng, 30) + " " + item + " " + prose(rng, 30), item],
        "touch": [prose(rng, 400) + " " + " ".join(item.split()[:13])],
    }
    kinds = [(k, t) for k, ts in texts.items() for t in ts]
    docs = documents(spark, [t for _, t in kinds]).withColumn("extra", F.lit("kept"))
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    sf = f"{checkpoint_dir(spark)}/planted-{rng.randrange(10**9)}"
    bench.write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
    return docs, sf, {i: k for i, (k, _) in enumerate(kinds)}


def test_stages_on_planted_cases(spark):
    docs, sf, kind = planted(spark)
    kept = {}
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        kept[name] = [r["doc_id"] for r in out.collect()]
        docs = spark.createDataFrame(out.collect(), docs.schema)
    ids = lambda k: {i for i, x in kind.items() if x == k}
    q = set(kept["quality rules"])
    assert q == set(kind) - ids("junk")
    d = set(kept["near dedup"])
    assert len(kept["near dedup"]) == len(d) and d == q - ids("copy")
    c = set(kept["decontamination"])
    assert c == d - ids("bench")
    times = {i: kept["mixing"].count(i) for i in c}
    assert set(kept["mixing"]) <= c and max(times.values()) <= 3


def test_token_stage_holds_every_copy(spark):
    docs, sf, _ = planted(spark)
    rows = P.token_output(spark, docs.unionByName(docs.limit(3)), sf).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(len(np.frombuffer(r["tokens"], "<u2")) == SEQ_LEN for r in rows)
    assert len([r for r in rows if r["chunk"] == 0]) == docs.count() + 3


def test_awkward_rows_and_empty_tables(spark):
    _, sf, _ = planted(spark)
    texts = corpus(n=20)
    ids = [None, None, *range(2, len(texts) - 2), 4, 4]
    docs = documents(spark, texts, lang=None, source=None, ids=ids)
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.collect()
    empty = documents(spark, [])
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).collect() == []


def test_dedup_keeps_one_of_repeated_rows(spark):
    rng = random.Random(2)
    a, b = prose(rng, 50), prose(rng, 50)
    docs = documents(spark, [a, a, a, b, None, None, b], ids=[5, 5, 7, None, 1, 1, None])
    out = P.near_dedup(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == sorted([(5, a), (1, None), (None, b)], key=repr)


def test_dedup_keeps_different_texts_under_one_id(spark):
    rng = random.Random(12)
    texts = [prose(rng, 60) for _ in range(40)]
    near = texts[0].split()
    near[5] = "changed"
    docs = documents(spark, [*texts, " ".join(near), texts[1]], ids=[*[i // 2 for i in range(40)], 0, None])
    outs = [sorted((r["doc_id"], r["text"]) for r in P.near_dedup(spark, docs.repartition(n), "").collect()) for n in (2, 5)]
    assert outs[0] == outs[1] and len(outs[0]) == 40
    assert {t for _, t in outs[0]} - {texts[0], " ".join(near)} == set(texts[1:])


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    rows = P.run(spark, sf).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert rows and {r["doc_id"] for r in rows} <= ids
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
