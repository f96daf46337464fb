"""Posting-list top-N against scoring every pair, and what it leaves unscored."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import sparse
from lodestar.operators.sparse import Lists, sparse_top_n

DIM = 12


def make(rng, players, games, signed=False):
    """Few distinct item vectors, one of them held by a third of all games."""
    draw = (lambda k: np.round(rng.normal(0, 1, k), 2)) if signed else (lambda k: np.round(rng.random(k) + 0.01, 2))
    kinds = []
    for _ in range(30):
        t = np.sort(rng.choice(DIM, rng.integers(1, 5), replace=False))
        kinds.append((t, draw(len(t))))
    of = np.where(rng.random(games) < 0.34, 0, rng.integers(0, len(kinds), games))
    items = {int(g) * 3: kinds[k] for g, k in enumerate(of)}
    users = {}
    for p in range(players):
        t = np.sort(rng.choice(DIM, rng.integers(1, DIM), replace=False))
        users[p] = (t, draw(len(t)))
    owned = {(int(rng.integers(players)), int(rng.integers(games)) * 3) for _ in range(players * 12)}
    hot = {(0, g) for g in list(items)[: games - 4]}  # one player owns nearly all
    return users, items, owned | hot


def frames(spark, users, items, owned, genre=lambda g: g % 5):
    rows = lambda side: [(k, [int(x) for x in t], [float(x) for x in w]) for k, (t, w) in side.items()]
    u = spark.createDataFrame(rows(users), "player_id long, idx array<int>, w array<double>")
    i = spark.createDataFrame([(*r, genre(r[0])) for r in rows(items)], "game_id long, idx array<int>, w array<double>, genre long")
    return u, i, spark.createDataFrame(sorted(owned), "player_id long, game_id long")


def brute(users, items, owned, n, cosine=False, floor=-np.inf, at_least=-np.inf, per=None, genre=lambda g: g % 5):
    out = {}
    for p, (ut, uw) in users.items():
        u = np.zeros(DIM)
        u[ut] = uw
        if cosine:
            u /= np.linalg.norm(u)
        scored = []
        for g, (t, w) in items.items():
            s = round(float(u[t] @ w), 9)
            if (p, g) not in owned and s > floor and s >= at_least:
                scored.append((-s, g))
        scored.sort()
        if per:
            seen, kept = {}, []
            for s, g in scored:
                seen[genre(g)] = seen.get(genre(g), 0) + 1
                if seen[genre(g)] <= per:
                    kept.append((s, g))
            scored = kept
        out[p] = [(g, i + 1, pytest.approx(-s, abs=2e-9)) for i, (s, g) in enumerate(scored[:n])]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("player_id", "rank").collect():
        out.setdefault(r["player_id"], []).append((r["game_id"], r["rank"], r["score"]))
    return out


@pytest.mark.parametrize("case", range(5))
def test_equals_scoring_all_pairs(spark, monkeypatch, case):
    monkeypatch.setattr(sparse, "LIST", 3)
    rng = np.random.default_rng(case)
    users, items, owned = make(rng, 40, 150, signed=case == 4)
    u, i, o = frames(spark, users, items, owned)
    kw, want = [
        ({}, {}),
        ({"cosine": True, "positive_only": True}, {"cosine": True, "floor": 0.0}),
        ({"cosine": True, "positive_only": True, "min_score": 0.55, "block_entries": 150}, {"cosine": True, "at_least": 0.55, "floor": 0.0}),
        ({"group": "genre", "per_group": 2, "block_entries": 200}, {"per": 2}),
        ({"block_entries": 100}, {}),
    ][case]
    expected = {p: x for p, x in brute(users, items, owned, 7, **want).items() if x}
    assert lists(sparse_top_n(u, i, o, DIM, 7, **kw)) == expected


def test_parts_are_the_score(spark):
    rng = np.random.default_rng(9)
    users, items, owned = make(rng, 20, 80)
    u, i, o = frames(spark, users, items, owned)
    rows = sparse_top_n(u, i, o, DIM, 5, cosine=True, positive_only=True, parts=True).collect()
    assert rows
    for r in rows:
        assert sum(r["shares"]) == pytest.approx(r["score"], abs=2e-9)
        assert set(r["terms"]) == set(users[r["player_id"]][0].tolist()) & set(items[r["game_id"]][0].tolist())


def test_lists_are_skipped_and_classes_not_expanded():
    """A list whose bound is below the threshold is never scored; a class of all
    items is one candidate."""
    rng = np.random.default_rng(1)
    idx, w = [], []
    for k in range(4000):
        t = np.sort(rng.choice(40, 3, replace=False))
        idx.append(t)
        w.append(rng.random(3) + 0.1)
    idx.append(np.array([1, 2]))
    w.append(np.array([0.5, 0.5]))
    entries = np.r_[0, np.cumsum([len(t) for t in idx])]
    begin = np.r_[np.arange(4001), 7000]  # the last class has 3,000 items
    found = Lists(entries, np.concatenate(idx), np.concatenate(w), begin, rng.permutation(7000), 40)
    assert found.size.max() == 3000 and found.size.sum() == 7000 and sorted(found.members) == list(range(7000))
    u = np.zeros((5, 40))
    u[np.arange(5), np.arange(5) * 3] = 1.0
    scored = []
    real = found.lists

    class Seen(list):
        def __getitem__(self, k):
            scored.append(k)
            return real[k]

    found.lists = Seen(real)
    row, _, _, _ = found.best_classes(u, 10, np.empty(0, np.int64), 0.0)
    assert set(row.tolist()) == set(range(5)) and len(row) < 100
    assert len(set(scored)) < 0.7 * len(real)


def test_empty_sides(spark):
    rng = np.random.default_rng(2)
    users, items, owned = make(rng, 3, 10)
    u, i, o = frames(spark, users, items, owned)
    assert sparse_top_n(u.limit(0), i, o, DIM).collect() == []
    assert sparse_top_n(u, i.where(F.lit(False)), o, DIM).collect() == []
    assert sparse_top_n(u, i, None, DIM, 3).count() == 9
