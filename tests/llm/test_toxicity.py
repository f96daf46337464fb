"""op2: held-out accuracy, a pair effect that no linear weights give, cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS, documents, prose

from lodestar.llm import toxicity
from lodestar.llm.toxicity import Scorer, fit, fit_on_labels, is_held_out, score, text_terms


def test_held_out_labels(spark):
    rng = random.Random(1)
    insults, rows, marks = ["clown", "loweiisch", "trash"], [], []
    for i in range(700):
        toxic = i % 5 == 1
        words = prose(rng, rng.randrange(10, 120)).replace("w", "v").split()
        words = [f"{'abcdefghij'[int(w[1]) if w[1:].isdigit() else 0]}{chr(97 + len(w))}{rng.choice('klmno')}{rng.choice('pqrst')}" for w in words]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(insults) + rng.choice(["", ".", "!"]))
        rows.append((i, " ".join(words), None, None, None))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame(marks + [(3, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    out = score(docs, fit_on_labels(docs, labels)).select("row.doc_id", "score", is_held_out(F.col("row.doc_id")).alias("h")).collect()
    assert len(out) == 700
    held = [r for r in out if r["h"]]
    assert len(held) > 100
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 5 == 1) for r in held)


def test_pairs_are_learned():
    """Either word alone is harmless; together they are not."""
    rng = np.random.default_rng(0)
    a, b = 11, 22
    terms, label = [], []
    for i in range(3000):
        t = {int(x) for x in rng.integers(100, 130, 6)}
        kind = i % 4
        t |= {a} if kind in (1, 3) else set()
        t |= {b} if kind in (2, 3) else set()
        terms.append(np.array(sorted(t)))
        label.append(float(kind == 3))
    model = fit(terms, np.array(label), np.ones(3000))
    place = {int(k): i for i, k in enumerate(model["key"])}

    def logit(*keys):
        i = [place[k] for k in keys if k in place]
        w, v = model["w"][i], model["v"][i]
        return model["bias"][0] + w.sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())

    assert logit(a, b) > 0 > max(logit(a), logit(b), logit())
    pair = model["v"][place[a]] @ model["v"][place[b]]
    assert pair > 0.5  # the interaction itself, beyond the linear weights


def test_pair_with_a_neutral_word():
    """As many rows with the word as without it have the label; beside another word it decides."""
    rng = np.random.default_rng(4)
    a, b = 11, 22
    terms, label = [], []
    for i in range(3000):
        t = {int(x) for x in rng.integers(100, 130, 6)}
        kind = i % 4
        t |= {a} if kind in (1, 3) else set()
        t |= {b} if kind in (2, 3) else set()
        terms.append(np.array(sorted(t)))
        label.append(float(kind == 3 or (kind < 2 and i // 4 % 2 == 0)))
    model = fit(terms, np.array(label), np.ones(3000))
    place = {int(k): i for i, k in enumerate(model["key"])}

    def logit(*keys):
        i = [place[k] for k in keys if k in place]
        w, v = model["w"][i], model["v"][i]
        return model["bias"][0] + w.sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())

    assert b in place and not any(k in place for k in range(100, 130))
    assert logit(a, b) > logit(a) + 1 and logit(b) < logit() - 1


def test_cases(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents(spark, [None, "", "word", "word " * 50000], ids=[None, 1, 2, 2])
    assert {r["score"] for r in score(docs, fit_on_labels(docs, none)).collect()} == {0.5}
    same = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(r["score"] < 0.5 for r in score(docs, fit_on_labels(docs, same)).collect())
    assert score(documents(spark, []), fit_on_labels(documents(spark, []), none)).collect() == []


def test_terms_and_scorer_agree():
    memo: dict = {}
    assert len(text_terms("Idiot, idiot IDIOT", memo)) == 1 + 2
    model = {"bias": np.array([-1.0]), "key": text_terms("clown", {}), "w": np.ones(3, np.float32), "v": np.zeros((3, toxicity.FACTORS), np.float32)}
    assert abs(Scorer(model).score("a CLOWN.") - 1 / (1 + np.exp(-2))) < 1e-9


@pytest.mark.parametrize("rows", [2, 3, 10, 50])
def test_few_labels_give_defined_scores(rows):
    terms = [text_terms("you idiot" if i % 2 else "a kind word", {}) for i in range(rows)]
    model = fit(terms, np.arange(rows) % 2 * 1.0, np.ones(rows))
    for text in ("you idiot", "a kind word", "", None):
        assert 0 < Scorer(model).score(text) < 1


def test_labels_without_strong_terms():
    rng = random.Random(5)
    texts = [prose(rng, 30) for _ in range(600)] + ["", "   "] * 200
    label = np.array([float(rng.random() < 0.3) for _ in texts])
    model = fit([text_terms(t, {}) for t in texts], label, np.ones(len(texts)))
    got = [Scorer(model).score(t) for t in texts[:50] + [""]]
    assert all(0 < s < 0.95 for s in got) and abs(got[-1] - 0.3) < 0.15
    # label 1 where exactly one of two words stands: neutral alone, no crash
    texts = [("red " if i & 1 else "") + ("blue " if i & 2 else "") + prose(rng, 5) for i in range(2000)]
    label = np.array([float(bool(i & 1) != bool(i & 2)) for i in range(2000)])
    model = fit([text_terms(t, {}) for t in texts], label, np.ones(2000))
    assert 0 < Scorer(model).score("red blue") < 1


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    words = ["alpha", "be", "gamma", "delta", "omega"]
    keys = np.unique(np.concatenate([text_terms(w, {}) for w in words]))
    model = {"bias": np.array([-0.7]), "key": keys, "w": rng.normal(0, 1, len(keys)).astype(np.float32), "v": rng.normal(0, 0.5, (len(keys), 4)).astype(np.float32)}
    for text in ("alpha be", "Gamma, delta! omega", "unknown words", "alpha beta gamma delta epsilon omega be"):
        held = [int(np.searchsorted(keys, t)) for t in text_terms(text, {}) if t in keys]
        logit = -0.7 + sum(float(model["w"][i]) for i in held)
        for n, i in enumerate(held):
            for j in held[n + 1 :]:
                logit += float(model["v"][i].astype(float) @ model["v"][j].astype(float))
        assert abs(Scorer(model).score(text) - 1 / (1 + np.exp(-logit))) < 1e-9
