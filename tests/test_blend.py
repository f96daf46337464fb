"""The four-model blend and the network over all games, against numpy."""

import numpy as np
import pytest

from lodestar.operators import models as M
from lodestar.operators.scoring import dense_blend_top_n
from lodestar.plans.models import hybrid
from lodestar.session import cut_lineage
from lodestar.sources import fixtures as fx

SF_SMALL = "/root/testdata/sf0.001"


def _matrix(df, key):
    rows = df.collect()
    return {r[key]: np.array(r["vec"], float) for r in rows}


def test_four_models_equal_numpy_with_any_item_blocks(spark):
    inter = cut_lineage(fx.interactions(spark, SF_SMALL))
    got, models, (au, ai, mlp) = hybrid(inter, fx.games(spark, SF_SMALL), n=10, max_iter=3)
    one = {(r["player_id"], r["rank"]): (r["game_id"], r["score"]) for r in got.collect()}
    blocks = dense_blend_top_n(models, inter, n=10, max_bytes=60_000)
    assert {(r["player_id"], r["rank"]): (r["game_id"], pytest.approx(r["score"], abs=1e-8)) for r in blocks.collect()} == one

    owned = {}
    for r in inter.select("player_id", "game_id").collect():
        owned.setdefault(r["player_id"], set()).add(r["game_id"])
    sides = {k: (_matrix(m["users"], "player_id"), _matrix(m["items"], "game_id")) for k, m in models.items() if k != "neural"}
    fu, fi = _matrix(au, "player_id"), _matrix(ai, "game_id")
    layers = M.network_layers(mlp)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for p in sorted(owned)[:25]:
        total, any_score = {}, set()
        for name, m in models.items():
            if name == "neural":
                x = {}
                for g, v in fi.items():
                    h = np.concatenate([fu[p], v])
                    for k, (w, b) in enumerate(layers):
                        h = (h if k == 0 else sigmoid(h)) @ w + b
                    x[g] = np.exp(h[1]) / np.exp(h).sum()
            else:
                u, items = sides[name]
                if p not in u:
                    continue
                v = u[p] / np.linalg.norm(u[p]) if m.get("cosine") else u[p]
                x = {g: float(v @ i) for g, i in items.items()}
            x = {g: round(s, 9) for g, s in x.items() if g not in owned[p] and (s > 5e-10 or not m.get("positive_only"))}
            lo, hi = min(x.values()), max(x.values())
            for g, s in x.items():
                total[g] = total.get(g, 0.0) + m["weight"] * (1.0 if hi == lo else (s - lo) / (hi - lo))
        best = sorted(total.items(), key=lambda t: -t[1])
        for k in range(10):
            game, score = one[(p, k + 1)]
            assert score == pytest.approx(best[k][1], abs=1e-6) and total[game] == pytest.approx(score, abs=1e-6)


def test_network_equals_sparks_own_transform(spark):
    inter = cut_lineage(fx.interactions(spark, SF_SMALL).where("player_id < 20"))
    users, items = (cut_lineage(x) for x in M.factors(M.als_fit(inter, rank=4, max_iter=2)))
    mlp = M.neural_fit(inter, users, items, hidden=(6, 3), max_iter=3)
    full = M.neural_recommend(mlp, users, items, inter, n=10**6)
    pairs = full.select("player_id", "game_id")
    every = users.count() * items.count() - inter.select("player_id", "game_id").distinct().count()
    assert full.count() == every
    same = M.neural_rerank(pairs, mlp, users, items, n=10**6).withColumnRenamed("score", "s").drop("rank")
    worst = full.join(same, ["player_id", "game_id"]).selectExpr("max(abs(score - s)) AS e", "count(*) AS n").first()
    assert worst["n"] == every and worst["e"] < 1e-8
