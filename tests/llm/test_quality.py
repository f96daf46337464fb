"""op7: base statistics against brute force, scatter against numpy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import corpus, documents, prose

from lodestar.llm import quality
from lodestar.llm.quality import FEATURES, FLOORS, SUPPORT, chi_square_cut, consistency, judged, minimum_covariance


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_base_statistics(spark):
    rng = random.Random(1)
    texts = corpus() + ["a b c d e f g h " * 4, "x " * 30, "\n\na\na\n \n \na", "#*$%&|<> é&", prose(rng, 40, 3), "   word", "\U0001f600 " * 25]
    texts += [prose(rng, 30, 6) + "\n" + prose(rng, 30, 6) for _ in range(20)]
    docs = documents(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("x0", F.lit("clash"))
    for r in judged(docs.repartition(3)).collect():
        want = base(texts[r["row"]["doc_id"]])
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == want, r["row"]["doc_id"]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def plain_mcd(x):
    """Concentration steps on one group, as the module's docstring has them."""
    d = x.shape[1]
    floor = np.diag(np.array(FLOORS) ** 2)
    least = lambda c: c + np.diag(np.maximum(np.diag(floor) - np.diag(c), 0))
    lower = lambda v: np.sort(v, axis=0)[int(np.ceil(len(v) / 2)) - 1]
    m = lower(x)
    c = least(np.diag((1.4826 * lower(np.abs(x - m))) ** 2))
    old = None
    for _ in range(quality.STEPS):
        dist = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        near = x[dist <= np.sort(dist)[int(np.ceil(SUPPORT * len(x))) - 1]]
        m, c = near.mean(0), least(np.cov(near.T, bias=True) * consistency(SUPPORT, d))
        now = np.linalg.slogdet(c)[1]
        if old is not None and abs(now - old) <= quality.SETTLED:
            break
        old = now
    return m, c


def test_scatter_against_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {("en", "a"): 300, ("en", None): 120, ("de", "a"): 80, ("de", "few"): 5}
    rows, data = [], {}
    for key, n in groups.items():
        x = rng.multivariate_normal([1.6, 0.1, 0.2, 0.3], np.diag([0.02, 0.01, 0.1, 0.09]) + 0.004, n)
        x[: n // 5] += rng.normal(3, 1, (n // 5, 4))  # junk
        data[key] = x
        rows += [(*key, *map(float, r)) for r in x]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{f} double" for f in FEATURES))
    found = {(r["lang"], r["source"]): r for r in minimum_covariance(df, ["lang", "source"]).collect()}
    assert set(found) == {k for k, n in groups.items() if n >= quality.MIN_GROUP}
    for key, r in found.items():
        m, c = plain_mcd(data[key])
        assert [r[f"m{i}"] for i in range(4)] == pytest.approx(m.tolist(), abs=1e-6)
        inv = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        assert inv.T @ inv == pytest.approx(np.linalg.inv(c), rel=1e-5)


def test_outliers_go_and_prose_stays(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(25, 400)) for _ in range(150)]
    junk = [" ".join(w + "###" for w in prose(rng, 60).split()) for _ in range(20)]
    verdict = {r["row"]["doc_id"]: r["kept"] for r in judged(documents(spark, texts + junk)).collect()}
    assert all(verdict[i] for i in range(150)) and not any(verdict[i] for i in range(150, 170))


@pytest.mark.parametrize("share", [30, 45])
def test_junk_heavy_source(spark, share):
    """Junk below half of a source goes, and its prose stays."""
    rng = random.Random(share)
    texts = [prose(rng, rng.randrange(25, 120)) for _ in range(200)]
    for i in range(2 * share):
        texts[i] = " ".join(w + "#" * rng.randrange(1, 3) for w in texts[i].split())
    verdict = {r["row"]["doc_id"]: r["kept"] for r in judged(documents(spark, texts)).collect()}
    assert [verdict[i] for i in range(200)] == [False] * (2 * share) + [True] * (200 - 2 * share)


def test_chi_square():
    assert chi_square_cut(0.05, 2) == pytest.approx(5.9915, abs=1e-3)
    assert chi_square_cut(0.05, 4) == pytest.approx(9.4877, abs=1e-3)
    assert consistency(0.75, 4) == pytest.approx(1.49, abs=0.01)


def test_small_groups_and_empty(spark):
    assert judged(documents(spark, [])).collect() == []
    out = judged(documents(spark, ["w " * 3, None] + [" ".join(f"v{i}" for i in range(25))], lang=None, source=None)).collect()
    assert sorted((r["row"]["doc_id"], r["kept"], r["distance"]) for r in out) == [(0, False, None), (1, False, None), (2, True, None)]
