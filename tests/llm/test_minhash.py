"""op3 and the dedup stage against all pairs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import corpus, documents, prose

from lodestar.llm import minhash
from lodestar.llm.minhash import near_duplicates


def sets_of(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        width = min(k, len(w))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if w else set())
    return out


def brute(texts, k, percent=80, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    sets = sets_of(texts, k)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(j)] = find(i)
    best = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            best[find(i)] = min(best.get(find(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), best.get(find(i))) for i in range(len(texts))]


def check(spark, texts, k, ids=None):
    docs = documents(spark, texts, ids=ids).withColumn("component_id", F.lit("clash")).withColumn("n", F.lit("clash")).withColumn("seq", F.lit(1))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs.repartition(4), shingle=k).collect()), key=repr)
    assert got == sorted(brute(texts, k, ids=ids), key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_corpus(spark, k):
    check(spark, corpus(), k)


def test_chains_and_hubs(spark):
    """A hub with many copies that differ from each other, and a chain."""
    rng = random.Random(2)
    hub = prose(rng, 120).split()
    texts = [" ".join(hub)]
    for _ in range(40):
        w = list(hub)
        for _ in range(rng.randrange(1, 10)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    link = prose(rng, 100).split()
    for i in range(12):
        link = list(link)
        for j in range(4):
            link[(i * 8 + j * 2) % 100] = f"y{i}{j}"
        texts.append(" ".join(link))
    rng.shuffle(texts)
    check(spark, texts, 2)


def test_null_and_repeated_ids(spark):
    rng = random.Random(4)
    a, b = prose(rng, 50), prose(rng, 50)
    check(spark, [a, a, b, None, "", a], 2, ids=[None, 7, None, None, 3, 9])


def test_many_near_copies_without_ids(spark):
    """One text a class is fetched, however many rows share an id or have none."""
    rng = random.Random(6)
    base = prose(rng, 60).split()
    texts = [" ".join([*base[:i], f"z{i}", *base[i + 1 :]]) for i in range(60)] * 2
    check(spark, texts, 2, ids=[None] * 120)
    check(spark, texts, 2, ids=[4] * 120)


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a, b = minhash.permutation_constants(200)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    other = np.concatenate([base[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        s = minhash.min_max([np.unique(base), np.unique(other)], a, b)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08
    with np.errstate(over="ignore"):
        long = np.unique(rng.integers(0, 2**63, 3 * minhash._CHUNK, dtype=np.uint64))
        x = (long >> np.uint64(32)).astype(np.uint32)
        s = minhash.min_max([long], a[:3], b[:3])[0]
        want = [(x * a[p] + b[p]) for p in range(3)]
    assert s.tolist() == [w.min() for w in want] + [w.max() for w in want]
