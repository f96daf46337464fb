"""Training of the neural model (M6) on all labelled pairs.

Pairs, player vectors and game vectors are cut into (player block, game block) pairs,
as for scoring: a vector travels once a block, not once a pair, and a pair is two
places in its block. The blocks are stored once, in pieces; every evaluation of the
loss is a pass over them in numpy (single precision in batches, sums in double), and
tasks send back one row of sums. The driver holds the weights alone and runs L-BFGS
with the line search and the stopping rule of Spark's own optimiser. Spark's
``MultilayerPerceptronClassifier`` gives the first weights and takes the last ones, so
the model is one of Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.scoring import _met, owned_rows
from lodestar.session import cut_lineage

try:  # ship this module's task code by value: executors need no installed package
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

PAIRS_PER_BLOCK = 1_000_000
PIECE = 1 << 15  # rows of a stored piece
BATCH = 1024  # pairs that a task works on at once
CORRECTIONS = 10
USERS, ITEMS, NEGATIVE, POSITIVE = range(4)  # kinds of pieces, in the order of a block

PIECES = "kind int, n int, data binary"
SUMS = "part int, n long, loss double, gradient binary"


def layers_of(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights [in, out], bias) of each layer, as views of the flat weights."""
    at, out = 0, []
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def _matrix(column) -> np.ndarray:
    c = column.combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(c), -1)


def _packed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block in pieces: its players' and games' vectors, then its pairs as their places."""
    has = pc.is_valid(left["vec"])
    users, pairs = left.filter(has), left.filter(pc.invert(has))
    schema = pa.schema([("kind", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
    if not users.num_rows or not right.num_rows or not pairs.num_rows:
        return schema.empty_table()
    sides, found = [], []
    for table, key in ((users, "player_id"), (right, "game_id")):
        ids = table[key].to_numpy()
        order = np.argsort(ids, kind="stable")
        sides.append((ids[order], _matrix(table["vec"])[order]))
    labels = pairs["label"].to_numpy()
    for kind, label in ((NEGATIVE, 0.0), (POSITIVE, 1.0)):
        rows = pairs.filter(pa.array(labels == label))
        places, ok = [], True
        for (ids, _), name in zip(sides, ("owners", "games")):
            wanted = rows[name].combine_chunks()
            wanted = (pa.concat_arrays(wanted.chunks) if isinstance(wanted, pa.ChunkedArray) else wanted).flatten().to_numpy()
            at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
            ok = ok & (ids[at] == wanted)
            places.append(at)
        both = np.stack(places, 1)[ok].astype(np.int32)
        # the tables come in any order, the sums should not
        found.append((kind, both[np.lexsort((both[:, 1], both[:, 0]))]))
    out = []
    for kind, rows in [(USERS, sides[0][1]), (ITEMS, sides[1][1]), *found]:
        for s in range(0, len(rows), PIECE):
            part = np.ascontiguousarray(rows[s : s + PIECE])
            out.append(pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=schema))
    return pa.Table.from_batches(out, schema)


def training_blocks(pos: DataFrame, neg: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """All labelled pairs with their vectors, in blocks of about ``PAIRS_PER_BLOCK`` pairs
    and at least a few a core. A stored partition holds whole blocks, piece by piece."""
    sc = pos.sparkSession.sparkContext
    n = pos.count() + neg.count()
    blocks = max(-(-n // PAIRS_PER_BLOCK), min(4 * sc.defaultParallelism, -(-n // PIECE)), 1)
    user_blocks = max(1, round(blocks**0.5))
    item_blocks = -(-blocks // user_blocks)
    ub = F.pmod(F.xxhash64(F.col("player_id").cast("long")), F.lit(user_blocks)).cast("int").alias("ub")
    ib = F.pmod(F.xxhash64(F.col("game_id").cast("long")), F.lit(item_blocks)).cast("int").alias("ib")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    vec = F.col("vec").cast("array<float>").alias("vec")
    left = users.select(F.col("player_id").cast("long"), vec, ub, every(item_blocks).alias("ib"))
    right = items.select(F.col("game_id").cast("long"), vec, ib, every(user_blocks).alias("ub"))
    for pairs, label in ((neg, 0.0), (pos, 1.0)):
        known = pairs.where(F.col("player_id").isNotNull() & F.col("game_id").isNotNull())
        left = left.unionByName(owned_rows(known, ub, ib).withColumn("label", F.lit(label)), allowMissingColumns=True)
    return cut_lineage(_met(left, right, user_blocks * item_blocks, _packed, PIECES))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60.0, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Sums:
    """Loss and gradient of some pairs, added up batch by batch."""

    def __init__(self, flat: np.ndarray, sizes: list[int]) -> None:
        self.layers = layers_of(flat.astype(np.float32), sizes)
        self.gradient = np.zeros(len(flat))
        self.parts = layers_of(self.gradient, sizes)
        self.loss, self.n = 0.0, 0

    def add(self, x: np.ndarray, label: int) -> None:
        held = [x]
        for k, (w, b) in enumerate(self.layers):
            z = held[-1] @ w
            z += b
            held.append(z if k == len(self.layers) - 1 else _sigmoid(z))
        d = held.pop()
        d -= d.max(1, keepdims=True)
        picked = d[:, label].astype(np.float64)
        np.exp(d, out=d)
        total = d.sum(1, keepdims=True)
        self.loss += float((np.log(total[:, 0].astype(np.float64)) - picked).sum())
        self.n += len(x)
        d /= total
        d[:, label] -= 1
        for k in range(len(self.layers) - 1, -1, -1):
            w, (gw, gb), h = self.layers[k][0], self.parts[k], held[k]
            gw += h.T @ d
            gb += d.sum(0)
            if k:
                d = d @ w.T
                d *= h
                d *= 1 - h


def evaluated(blocks: DataFrame, flat: np.ndarray, sizes: list[int]) -> tuple[float, np.ndarray, int]:
    """Mean loss, its gradient and the number of pairs: one pass over all blocks."""
    sent = blocks.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, vecs, before = Sums(sent.value, sizes), {}, POSITIVE
        dim = sizes[0] // 2
        for batch in batches:
            for kind, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = data.as_buffer()
                if kind < NEGATIVE:
                    if before >= NEGATIVE:  # a new block
                        vecs = {USERS: [], ITEMS: []}
                    vecs[kind].append(np.frombuffer(data, "<f4").reshape(n, dim).copy())
                else:
                    if before < NEGATIVE:
                        users, items = (np.concatenate(vecs[side]) for side in (USERS, ITEMS))
                    at = np.frombuffer(data, "<i4").reshape(n, 2)
                    for s in range(0, n, BATCH):
                        part = at[s : s + BATCH]
                        sums.add(np.hstack([users.take(part[:, 0], 0), items.take(part[:, 1], 0)]), kind - NEGATIVE)
                before = kind
        if sums.n:
            part = TaskContext.get().partitionId()
            cols = [pa.array([part], pa.int32()), pa.array([sums.n], pa.int64()), pa.array([sums.loss]), pa.array([sums.gradient.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "n", "loss", "gradient"])

    found = blocks.mapInArrow(run, SUMS)
    loss, gradient, n = 0.0, np.zeros(len(flat)), 0
    for r in sorted(found.collect(), key=lambda r: r["part"]):  # a row a task, none larger than the weights
        loss, gradient, n = loss + r["loss"], gradient + np.frombuffer(r["gradient"]), n + r["n"]
    sent.destroy()
    return loss / max(n, 1), gradient / max(n, 1), n


def _between(low: tuple, high: tuple) -> float:
    """Minimum of the cubic through two points (step, value, slope), not near either."""
    (a, fa, da), (b, fb, db) = sorted((low, high))
    d1 = da + db - 3 * (fa - fb) / (a - b)
    d2 = max(d1 * d1 - da * db, 0.0) ** 0.5
    t = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2 or 1.0)
    return float(min(max(t, a + 0.1 * (b - a)), a + 0.9 * (b - a)))


def _wolfe(phi: Callable[[float], tuple], start: tuple, t: float, c1: float = 1e-4, c2: float = 0.9, most: int = 10) -> float | None:
    """A step that meets the strong Wolfe conditions, or None."""
    _, value, slope = low = start

    def zoom(low: tuple, high: tuple) -> float | None:
        for _ in range(most):
            c = phi(_between(low, high))
            if c[1] > value + c1 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= c2 * abs(slope):
                return c[0]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        return None

    for i in range(most):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + c1 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= c2 * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    return None


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float = 1e-6) -> np.ndarray:
    """Minimises ``f`` (value, gradient) from ``x`` in at most ``max_iter`` steps."""
    if not max_iter:
        return x
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.linalg.norm(g) <= tol * max(abs(value), 1e-12):
            break
        d, put = -g, []
        for s, y in reversed(steps):
            a = s @ d / (s @ y)
            d = d - a * y
            put.append(a)
        if steps:
            s, y = steps[-1]
            d = d * (s @ y / (y @ y))
        for (s, y), a in zip(steps, reversed(put)):
            d = d + (a - y @ d / (s @ y)) * s
        if g @ d >= 0:
            steps, d = [], -g
        seen: dict[float, tuple[float, np.ndarray]] = {}

        def phi(t: float) -> tuple[float, float, float]:
            seen[t] = f(x + t * d)
            return t, seen[t][0], float(seen[t][1] @ d)

        t = _wolfe(phi, (0.0, value, float(g @ d)), 1.0 if steps else 1 / np.linalg.norm(d))
        if t is None:
            if not steps:
                break
            steps = []  # once more along the gradient
            continue
        before, (new, ng) = value, seen[t]
        s, y = t * d, ng - g
        if s @ y > 0:
            steps = [*steps, (s, y)][-CORRECTIONS:]
        x, value, g = x + s, new, ng
        if abs(before - value) <= tol * max(abs(value), abs(before), 1e-6):
            break
    return x


def sparks_model(spark: SparkSession, sizes: list[int], seed: int, flat: np.ndarray | None = None):
    """Spark's classifier with given weights, or with those that the seed gives."""
    one = spark.createDataFrame([(Vectors.dense([0.0] * sizes[0]), 0.0)], ["features", "label"])
    mlp = MultilayerPerceptronClassifier(layers=sizes, maxIter=0, seed=seed, featuresCol="features", labelCol="label")
    if flat is not None:
        mlp = mlp.setInitialWeights(Vectors.dense(flat))
    return mlp.fit(one)


def fit(blocks: DataFrame, sizes: list[int], max_iter: int, seed: int):
    """The classifier fitted to all pairs of the blocks."""
    spark = blocks.sparkSession
    # few tasks over small blocks: their partitions one after the other, each whole
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-blocks.agg(F.sum("n")).first()[0] // PAIRS_PER_BLOCK) if blocks.head(1) else 1)
    blocks = blocks.coalesce(tasks)
    start = sparks_model(spark, sizes, seed).weights.toArray()
    best = lbfgs(lambda w: evaluated(blocks, w, sizes)[:2], start, max_iter)
    return sparks_model(spark, sizes, seed, best)
