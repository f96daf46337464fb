"""op12: radix tree, ranges of any number and the whole query against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import trie as T
from lodestar.llm.q_trie import op12_radix_conversation_trie
from lodestar.llm.trie import RadixTree, prefixes, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def test_layouts_grow_and_paths_split():
    rng = random.Random(1)
    tree, keys = RadixTree(), set()
    for n in (3, 10, 40, 200):
        for b in rng.sample(range(256), n):
            keys.add(bytes([b, 7, 7]) + rng.randbytes(2))
    keys |= {b"", b"\x05", b"\x05\x07", rng.randbytes(400)}
    order = sorted(keys)
    rng.shuffle(order)
    for k in order:
        tree.insert(k, k)
    seen, rooms, stack = [], set(), [(tree.root, b"")]
    while stack:
        node, at = stack.pop()
        path = at + node.path
        if node.value is not None:
            assert node.value == path
            seen.append(path)
        if node.children is not None:
            rooms.add(type(node.children).__name__)
            below = list(node.items())
            assert [b for b, _ in below] == sorted(b for b, _ in below)
            assert len(below) <= node.children.room
            assert len(below) > 1 or node.value is not None  # a path without forks is compressed
            stack += [(c, path + bytes([b])) for b, c in below]
    assert sorted(seen) == sorted(keys) and len(seen) == len(keys)
    for n, kind in ((4, "Few"), (5, "Few"), (17, "Indexed"), (49, "Direct"), (256, "Direct")):
        node = T.Node(b"")
        for b in range(n):
            node.put(b, b)
        assert type(node.children).__name__ == kind and node.children.room >= n
        assert [b for b, _ in node.items()] == list(range(n)) and node.child(n - 1) == n - 1


def brute(convs):
    """Node table of {conv_id: [(role, text), ...]}."""
    at = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            at.setdefault(tuple(turns[:d]), []).append((c, len(turns)))
    out = []
    ids = lambda members: [c for c, _ in members if c is not None]
    for node, members in at.items():
        tree = [x for x in at if x[: len(node)] == node]
        children = [x for x in tree if len(x) == len(node) + 1]
        ends = ",".join(map(str, sorted(c for c, n in members if n == len(node) and c is not None)))
        up = min(ids(at[node[:-1]]), default=None) if node else None
        saved = sum((len(at[x]) - 1) * len(x[-1][1].encode()) for x in tree if x)
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in tree) for x in tree)
        out.append((min(ids(members), default=None), len(node), up, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuild(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append(((turn is not None, turn or 0, role or "", text or "")))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}
    out = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        base = [] if c is None else own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])
        out[c] = base[:h] + turns[h:]
    return out


def got(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def conversations(rng, n):
    rows = []
    for c in range(n):
        if rng.random() < 0.3:  # copies
            rows += [(c, i, "user", f"copy {i} é") for i in range(6)]
            continue
        lead = rng.choice([["sys"], ["sys", "a"], []])
        turns = lead + [f"t{rng.randrange(4)}" for _ in range(rng.randrange(0, 9))]
        rows += [(c, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("ranges", [1, 2, 5, 40])
def test_any_number_of_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = conversations(rng, 80)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    lists = T.turn_lists(df)
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(c, []).append((role, text))
    assert got(trie(lists, ranges=ranges)) == brute(want)


def test_query_on_awkward_rows(spark, tmp_path):
    rows = conversations(random.Random(9), 40) + [
        (None, 0, "user", "no id"),
        (None, 1, None, None),
        (100, None, "user", "first"),
        (100, None, "user", "first"),
        (100, 0, None, "x"),
        (101, 3, "b", "tie"),
        (101, 3, "a", "tie"),
        (102, 0, "us", "erx"),
        (103, 0, "user", "x"),
        (-3, 0, "user", "negative"),
        (-5, 0, "user", "its base"),
        (200, 0, "user", "long " * 20_000),
    ] + [(205 + k, i, "user", f"deep {min(i, 700 + k)}") for k in range(3) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("head", F.lit("clash")).withColumn("base", F.lit(1))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    result = op12_radix_conversation_trie(spark, str(tmp_path))
    found, want = got(result), brute_deep(rebuild(rows))
    assert found == want


def brute_deep(convs):
    """As ``brute`` by one pass over sorted sequences (deep conversations)."""
    at, kids = {}, {}
    for c, turns in convs.items():
        h = hashlib.md5()
        prev = None
        for d in range(len(turns) + 1):
            if d:
                h.update(repr(turns[d - 1]).encode())
            k = (d, h.hexdigest())
            node = at.setdefault(k, {"ids": [], "n": 0, "ends": [], "up": prev, "b": len(turns[d - 1][1].encode()) if d else 0})
            node["n"] += 1
            node["ids"] += [c] if c is not None else []
            node["ends"] += [c] if c is not None and d == len(turns) else []
            if prev is not None:
                kids.setdefault(prev, set()).add(k)
            prev = k
    saved, leaves = {}, {}
    for k in sorted(at, reverse=True):
        n = at[k]
        below = kids.get(k, ())
        saved[k] = (n["n"] - 1) * n["b"] + sum(saved[x] for x in below)
        leaves[k] = sum(leaves[x] for x in below) or 1
    out = []
    for k, n in at.items():
        up = min(at[n["up"]]["ids"], default=None) if n["up"] else None
        ends = ",".join(map(str, sorted(n["ends"])))
        out.append((min(n["ids"], default=None), k[0], up, n["n"], len(kids.get(k, ())), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_ids_beyond_a_run_and_ranges_inside_one_prefix(spark, monkeypatch):
    monkeypatch.setattr(T, "ID_RUN", 7)
    rows = [(c, i, "user", f"same {i}") for c in range(300) for i in range(3)]
    rows += [(1000 + c, i, "user", f"same {i}" if i < 3 else f"own {c % 50}") for c in range(300) for i in range(5)]
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(c, []).append((role, text))
    lists = T.turn_lists(spark.createDataFrame(rows, SCHEMA))
    assert got(trie(lists, ranges=16)) == brute(want)


def test_turnless_and_empty(spark):
    rows = [(1, 0, "user", "a")]  # conversation 1 loses its only turn and has no base
    out = rebuild(rows)
    lists = T.turn_lists(spark.createDataFrame(rows, SCHEMA))
    c = F.col("conv_id")
    made = T.rebuilt(lists, c - c % 5, F.lit(3), 8)
    assert got(trie(made)) == brute({1: []}) and out[1] in ([], [("user", "a")])
    assert got(trie(T.turn_lists(spark.createDataFrame([], SCHEMA)))) == []
    assert prefixes([(b"", [], 4, 2, "x")], -1, -1)[0].children == 0
