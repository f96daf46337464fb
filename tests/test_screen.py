"""Screened block scoring against scoring all pairs, and what a class must keep."""

import numpy as np
import pyarrow as pa
import pytest

from lodestar.operators import screen
from lodestar.operators.sparse import Lists, first_members


def sides(users, items, owned):
    """users, items: a list of {id: vector}, one a model."""
    u = [(k, i, list(map(float, v))) for k, m in enumerate(users) for i, v in m.items()]
    v = [(k, i, list(map(float, x))) for k, m in enumerate(items) for i, x in m.items()]
    who, what = [p for p, _ in owned], [g for _, g in owned]
    vecs = pa.list_(pa.float64())
    left = pa.table({
        "model": pa.array([r[0] for r in u] + [None], pa.int32()), "player_id": pa.array([r[1] for r in u] + [0], pa.int64()),
        "vec": pa.array([r[2] for r in u] + [None], vecs), "owners": pa.array([None] * len(u) + [who], pa.list_(pa.int64())),
        "games": pa.array([None] * len(u) + [what], pa.list_(pa.int64()))})
    right = pa.table({"model": pa.array([r[0] for r in v], pa.int32()), "game_id": pa.array([r[1] for r in v], pa.int64()),
                      "vec": pa.array([r[2] for r in v], vecs)})
    return left, right


def spec(weight=1.0, positive=False, rest=None):
    return {"cosine": False, "rest": rest, "weight": weight, "positive": positive}


@pytest.mark.parametrize("kind", ["signed", "positive", "equal", "network"])
def test_top_and_ends_equal_all_pairs(kind, monkeypatch):
    monkeypatch.setattr(screen, "HEAD", 8)
    monkeypatch.setattr(screen, "ROWS", 7)
    rng = np.random.default_rng(5)
    dim, n_items, rest = 6, 400, None
    u, v = rng.normal(size=(20, dim)), rng.normal(size=(n_items, dim))
    if kind == "positive":
        u, v = np.abs(u), np.where(rng.random(v.shape) < 0.3, np.abs(v), 0)
    if kind == "equal":  # few distinct vectors, a player that scores all alike
        v = v[rng.integers(0, 9, n_items)]
        u[3] = 0
    if kind == "network":
        rest = [(rng.normal(size=(dim, 5)), rng.normal(size=5)), (rng.normal(size=(5, 2)), rng.normal(size=2))]
    owned = {(int(rng.integers(20)), int(rng.integers(n_items))) for _ in range(900)} | {(1, g) for g in range(n_items - 3)}
    left, right = sides([dict(enumerate(u))], [dict(enumerate(v))], sorted(owned))
    s = spec(positive=kind == "positive", rest=rest)
    if rest is None:
        scores = np.round(u @ v.T, 9)
    else:
        sig = lambda x: 1 / (1 + np.exp(-x))
        h = sig(u[:, None] + v[None]) @ rest[0][0] + rest[0][1]
        z = sig(h) @ rest[1][0] + rest[1][1]
        scores = np.round(sig(z[..., 1] - z[..., 0]), 9)
    out = screen.top_block([s], 10, False)(left, right).to_pandas()
    ends = screen.ends_block([s])(left, right).to_pandas().set_index("player_id")
    for p in range(20):
        free = [g for g in range(n_items) if (p, g) not in owned and (scores[p, g] > 0 or not s["positive"])]
        want = sorted(free, key=lambda g: (-scores[p, g], g))[:10]
        got = out[out.player_id == p].sort_values("rank")
        assert [scores[p, g] for g in got.game_id] == pytest.approx([scores[p, g] for g in want], abs=2e-9)
        assert got.score.tolist() == pytest.approx([scores[p, g] for g in want], abs=2e-9)
        if kind != "network":
            assert got.game_id.tolist() == want
        assert ends.loc[p, "lo"] == pytest.approx(min(scores[p, free]), abs=2e-9)
        assert ends.loc[p, "hi"] == pytest.approx(max(scores[p, free]), abs=2e-9)


def test_a_null_player_does_not_unmask_owned_games():
    """Its id used to break the order in which owned pairs are looked up."""
    left, right = sides([{1: [1.0], 2: [1.0]}], [{7: [3.0], 8: [2.0]}], [(1, 7), (2, 8)])
    extra = left.slice(0, 1).set_column(1, "player_id", pa.array([None], pa.int64()))
    out = screen.top_block([spec()], 2, False)(pa.concat_tables([extra, left]), right).to_pandas()
    assert sorted(zip(out.player_id, out.game_id))[-2:] == [(1, 8), (2, 7)]


def test_a_class_keeps_what_a_player_can_need(spark):
    """A class's part grows with N and what one player owns of it, not with its games."""
    items = spark.createDataFrame([(g, [0], [1.0], 0, 5) for g in range(500)] + [(900, [1], [1.0], 0, 6)],
                                  "game_id long, idx array<int>, w array<double>, grp long, key long")
    owned = spark.createDataFrame([(1, g) for g in range(4)] + [(2, 0), (2, 499)], "player_id long, game_id long")
    assert sorted(r["game_id"] for r in first_members(items, owned, 3).collect()) == [*range(7), 900]


def test_rows_without_any_class_over_the_limit():
    """A list's bound may reach the floor although none of its classes does."""
    lists = Lists(np.array([0, 2, 3]), np.array([0, 1, 0]), np.array([0.5, 0.5, 0.9]), np.array([0, 1, 2]), np.array([4, 5]), 2)
    got = lists.best_classes(np.array([[0.6, 0.6]]), 1, np.empty(0, np.int64), 0.65)
    assert [len(x) for x in got] == [0, 0, 0, 0]


@pytest.mark.parametrize("scale", [0.1, 0.5, 3.0])
def test_a_networks_expansion_bounds_its_error(scale):
    """Of what is left out, and of rounding; smooth networks pass few pairs."""
    rng = np.random.default_rng(8)
    sig = lambda x: 1 / (1 + np.exp(-x))
    halves = rng.normal(size=(4, 20))  # games lie in four dimensions
    u, v = rng.normal(size=(30, 20)), scale * rng.normal(size=(700, 4)) @ halves
    rest = [(rng.normal(size=(20, 9)), rng.normal(size=9)), (rng.normal(size=(9, 2)), rng.normal(size=2))]
    net = screen.Net(u, v, spec(rest=rest))
    z, off, rounding = net.near(np.arange(30))(np.arange(700))
    h = sig(sig(u[:, None] + v[None]) @ rest[0][0] + rest[0][1]) @ rest[1][0] + rest[1][1]
    assert (np.abs(z - (h[..., 1] - h[..., 0])) <= off + rounding[:, None]).all()


def test_a_smooth_network_runs_few_pairs(monkeypatch):
    """It used to run all of them."""
    rng = np.random.default_rng(9)
    u, v = 0.3 * rng.normal(size=(40, 16)), 0.2 * rng.normal(size=(3000, 16))
    rest = [(0.3 * rng.normal(size=(16, 8)), rng.normal(size=8)), (rng.normal(size=(8, 2)), rng.normal(size=2))]
    run, quick = [], screen.Net._quick
    monkeypatch.setattr(screen.Net, "_quick", lambda self, like, n, sides: run.append(n) or quick(self, like, n, sides))
    left, right = sides([dict(enumerate(u))], [dict(enumerate(v))], [(0, 0)])
    screen.top_block([spec(rest=rest)], 10, False)(left, right)
    screen.ends_block([spec(rest=rest)])(left, right)
    assert run and sum(run) < 0.5 * 2 * 40 * 3000
