"""Exact top-N scoring of every player against every item by dot product.

Scoring all (player, item) pairs is what content, factor and graph models
need for "top N unseen items". The pairs are never materialised as rows:
players and items are cut into blocks, and a task multiplies one player block
with one item block in numpy (``cogroup``), masks owned items and emits only
the top N of each player - the blocked product ALS itself uses. Both sides
travel through the shuffle; neither passes the driver. The per-block lists of
a player are merged with a group-limited top N (exact).

Block pairs are screened in 32 bits (``screen``); what can matter is scored in 64.

Scores are quantised to ``SCORE_DIGITS`` decimals before ranking so float
summation order cannot reorder ties; ties go to the smaller item id.
``positive_only`` keeps positive scores alone (cosine content scores, where 0
means nothing in common); other models rank whatever the score's sign.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import screen
from lodestar.operators.ranking import top_n

try:  # ship this module's task code by value: executors need no installed package
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

SCORE_DIGITS = 9
MAX_ITEM_BLOCK_BYTES = 64 * 1024 * 1024
USERS_PER_BLOCK = 100_000
USER_BATCH = 1024
BLOCK_BYTES = 64 * 1024 * 1024

OUT_SCHEMA = "player_id long, game_id long, score double, rank int"


def _ranked_rows(s: np.ndarray, n: int):
    """(row, column, score) of the top ``n`` finite scores of each row, in
    order: score descending, then column ascending."""
    m = s.shape[1]
    if m > n:
        kth = np.partition(s, m - n, axis=1)[:, m - n]
        keep = (s >= kth[:, None]) & np.isfinite(s)
    else:
        keep = np.isfinite(s)
    r, c = np.nonzero(keep)
    if r.size == 0:
        return r, c, np.zeros(0), r
    sc = s[r, c]
    order = np.lexsort((c, -sc, r))  # row, then score desc, then item asc
    r, c, sc = r[order], c[order], sc[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    rank = np.arange(r.size) - np.repeat(starts, np.diff(np.r_[starts, r.size]))
    sel = rank < n
    return r[sel], c[sel], sc[sel], rank[sel] + 1


def _grouped_rows(s: np.ndarray, n: int, groups: np.ndarray, per_group: int):
    """As ``_ranked_rows`` with at most ``per_group`` items of a group."""
    best = np.full_like(s, -np.inf)
    for g in np.unique(groups):
        at = np.flatnonzero(groups == g)
        r, c, sc, _ = _ranked_rows(s[:, at], per_group)
        best[r, at[c]] = sc
    return _ranked_rows(best, n)


PAIRS_PER_ROW = 50_000


def owned_rows(owned: DataFrame, ub, ib) -> DataFrame:
    """(ub, ib, owners, games): the pairs of each block in rows of about
    PAIRS_PER_ROW, as a row a pair costs more to hand to Python than to score.
    A player's pairs are spread over the rows, so none grows with a player."""
    pairs = owned.select(F.col("player_id").cast("long"), F.col("game_id").cast("long"), *[c for c in owned.columns if c == "ib"])
    n = pairs.count()
    part = F.pmod(F.xxhash64("player_id", "game_id"), F.lit(max(1, -(-n // PAIRS_PER_ROW))))
    put = pairs.groupBy(ub, ib, part.alias("part")).agg(F.collect_list(F.struct("player_id", "game_id")).alias("p"))
    # an id of 0 keeps pandas' column of ids whole numbers
    return put.select("ub", "ib", F.lit(0).cast("long").alias("player_id"), F.transform("p", lambda x: x["player_id"]).alias("owners"),
                      F.transform("p", lambda x: x["game_id"]).alias("games"))


def _pairs_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Owners and games of all pairs of a block."""
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate([np.asarray(x, np.int64) for x in rows[c]]) for c in ("owners", "games"))


def _score_block(n: int, cosine: bool, positive_only: bool, per_group: int | None):
    """Top ``n`` of one player block against one item block. The left side
    holds the players' vectors and the block's owned pairs."""

    def run(left: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        has = left["vec"].notna()
        users = left[has].sort_values("player_id", kind="stable")
        items = items.sort_values("game_id", kind="stable")
        if not len(users) or not len(items):
            return pd.DataFrame({"player_id": [], "game_id": [], "score": [], "rank": [], **({"grp": []} if per_group else {})})
        ids, mat = items["game_id"].to_numpy(dtype=np.int64), np.stack(items["vec"].to_numpy()).astype(np.float64)
        groups = items["grp"].to_numpy(dtype=np.int64) if per_group else None
        uid = users["player_id"].to_numpy(dtype=np.int64)
        who, what = _pairs_of(left[~has])
        row, col = np.searchsorted(uid, who), np.searchsorted(ids, what)
        ok = (row < len(uid)) & (col < len(ids))
        ok[ok] = (uid[row[ok]] == who[ok]) & (ids[col[ok]] == what[ok])
        order = np.argsort(row[ok], kind="stable")
        row, col = row[ok][order], col[ok][order]
        # keep one score block near BLOCK_BYTES whatever the catalogue size
        step = max(1, min(USER_BATCH, BLOCK_BYTES // max(1, 8 * len(ids))))
        parts = []
        for start in range(0, len(uid), step):
            u = np.stack(users["vec"].iloc[start:start + step].to_numpy()).astype(np.float64)
            if cosine:
                norms = np.linalg.norm(u, axis=1, keepdims=True)
                u = np.divide(u, norms, out=np.zeros_like(u), where=norms > 0)
            s = np.round(u @ mat.T, SCORE_DIGITS)
            mine = slice(*np.searchsorted(row, (start, start + step)))
            s[row[mine] - start, col[mine]] = -np.inf
            if positive_only:
                s[~(s > 0)] = -np.inf
            r, c, sc, rank = _ranked_rows(s, n) if groups is None else _grouped_rows(s, n, groups, per_group)
            out = {"player_id": uid[start + r], "game_id": ids[c], "score": sc, "rank": rank.astype(np.int32)}
            if per_group:
                out["grp"] = items["grp"].to_numpy(dtype=np.int64)[c]
            parts.append(pd.DataFrame(out))
        return pd.concat(parts, ignore_index=True)

    return run


LIST_ROW_BYTES = 24  # of a row of a block's list in a shuffle


def _grid(spark, n_users: int, user_bytes: int, item_bytes: int, max_bytes: int, n: int) -> tuple[int, int]:
    """(player blocks, item blocks). Every player goes to all item blocks and comes back
    with N rows, every item to all player blocks; of the grids with enough tasks the one
    that sends least, within the blocks' bounds. More tasks than a few a core would only
    send more."""
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tasks = max(tasks, spark.sparkContext.defaultParallelism)
    sent = max(user_bytes + n_users * n * LIST_ROW_BYTES, 1)
    least = max(1, -(-item_bytes // max_bytes))
    item_blocks = max(least, min(tasks, round((tasks * item_bytes / sent) ** 0.5)))
    user_blocks = max(-(-tasks // item_blocks), -(-n_users // USERS_PER_BLOCK), -(-user_bytes // max_bytes))
    return user_blocks, item_blocks


def _met(left: DataFrame, right: DataFrame, pairs: int, block, schema: str) -> DataFrame:
    """``block`` over each pair of blocks. The pairs cost alike however few bytes they
    have, so they are dealt here: adaptive execution would join small partitions."""
    parts = max(2 * pairs, 1)
    left, right = (x.repartition(parts, "ub", "ib").groupBy("ub", "ib") for x in (left, right))
    return left.cogroup(right).applyInArrow(block, schema)


def _blocked(users: DataFrame, items: DataFrame, owned: DataFrame | None, dim: int, max_bytes: int):
    """Both sides keyed by (player block, item block). An item goes to every
    player block, a player to every item block, an owned pair to its own."""
    spark = users.sparkSession
    n_items = items.count()
    item_blocks = max(1, -(-n_items * 8 * max(dim, 1) // max_bytes))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    user_blocks = max(-(-tasks // item_blocks), -(-users.count() // USERS_PER_BLOCK))
    ub = F.pmod(F.xxhash64(F.col("player_id").cast("long")), F.lit(user_blocks)).cast("int").alias("ub")
    ib = F.pmod(F.xxhash64(F.col("game_id").cast("long")), F.lit(item_blocks)).cast("int").alias("ib")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = users.select(F.col("player_id").cast("long"), F.col("vec").cast("array<double>"),
                        ub, every(item_blocks).alias("ib"))
    if owned is not None:
        left = left.unionByName(owned_rows(owned, ub, ib), allowMissingColumns=True)
    right = items.withColumn("ib", ib).withColumn("ub", every(user_blocks))
    return left, right, item_blocks


def dense_top_n(users: DataFrame, items: DataFrame, owned: DataFrame | None, n: int = 10,
                cosine: bool = False, max_bytes: int = MAX_ITEM_BLOCK_BYTES, dim: int | None = None,
                positive_only: bool = False, group: str | None = None, per_group: int | None = None) -> DataFrame:
    """Top ``n`` items per player by (quantised) dot product.

    users: (player_id, vec ARRAY<DOUBLE>); items: (game_id, vec ARRAY<DOUBLE>
    and the ``group`` column, if any), all vectors of length ``dim``; owned:
    (player_id, game_id) pairs to exclude. Item vectors are used as given
    (normalise them for cosine); with ``cosine`` the player vectors are
    L2-normalised. ``per_group`` limits how many items of one group a
    player's list holds; the limit is applied to all unseen items, before the
    top ``n``.

    An item block holds about ``max_bytes`` of vectors, a player block up to
    USERS_PER_BLOCK players; there are at least as many block pairs as tasks."""
    from lodestar.session import cut_lineage

    spark = users.sparkSession
    items = items.select("game_id", "vec", (F.xxhash64(group) if group else F.lit(0).cast("long")).alias("grp"))
    if not per_group:
        model = {"users": users, "items": items, "weight": 1.0, "cosine": cosine, "positive_only": positive_only}
        return dense_blend_top_n({"only": model}, owned, n, scaled=False, max_bytes=max_bytes)
    # both sides are counted, then sent to their blocks: compute them once
    users, items = cut_lineage(users.select("player_id", "vec")), cut_lineage(items)
    if dim is None:
        first = items.select(F.size("vec").alias("d")).first()
        if first is None:
            return spark.createDataFrame([], OUT_SCHEMA)
        dim = int(first["d"])
    left, right, item_blocks = _blocked(users, items, owned, dim, max_bytes)
    schema = OUT_SCHEMA + (", grp long" if per_group else "")
    scored = left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib")).applyInPandas(
        _score_block(n, cosine, positive_only, per_group), schema)
    if item_blocks > 1:
        scored = scored.drop("rank")
        if per_group:  # the limit again, over the blocks' lists
            w = Window.partitionBy("player_id", "grp").orderBy(F.col("score").desc(), F.col("game_id").asc())
            scored = scored.withColumn("_g", F.row_number().over(w)).where(F.col("_g") <= per_group).drop("_g")
        scored = top_n(scored, n).withColumn("rank", F.col("rank").cast("int"))
    return scored.select("player_id", "game_id", "score", "rank")


def _width(side: DataFrame) -> int:
    """Bytes of a number of the vectors."""
    return 4 if side.schema["vec"].dataType.elementType.typeName() == "float" else 8


def network_sides(users: DataFrame, items: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]]):
    """A network's first layer, split into the players' part (with the bias) and the
    games' part, each computed once a row; returns both and the other layers.
    ``layers``: (weights [in, out], bias) of each layer, the first over the player's
    and the game's vector one after the other."""
    (first, bias), rest = layers[0], layers[1:]

    def part(weights: np.ndarray, add: np.ndarray, key: str):
        def run(batches):
            for b in batches:
                x = np.stack(b["vec"].to_numpy()) @ weights + add if len(b) else np.empty((0, len(add)))
                yield pd.DataFrame({key: b[key].to_numpy(), "vec": list(x)})

        return run

    dim = int((users.select(F.size("vec").alias("d")).first() or {"d": 0})["d"])
    cast = lambda df, key: df.select(F.col(key).cast("long"), F.col("vec").cast("array<double>"))
    u = cast(users, "player_id").mapInPandas(part(first[:dim], bias, "player_id"), "player_id long, vec array<double>")
    i = cast(items, "game_id").mapInPandas(part(first[dim:], np.zeros(len(bias)), "game_id"), "game_id long, vec array<double>")
    return u, i, rest


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60.0, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _model_scores(u: np.ndarray, i: np.ndarray, spec: dict) -> np.ndarray:
    """One model's scores of some players for all items of a block."""
    if spec["rest"] is None:
        if spec["cosine"]:
            norms = np.linalg.norm(u, axis=1, keepdims=True)
            u = np.divide(u, norms, out=np.zeros_like(u), where=norms > 0)
        return np.round(u @ i.T, SCORE_DIGITS)
    h = (u[:, None, :] + i[None, :, :]).reshape(-1, u.shape[1])
    for weights, bias in spec["rest"]:
        h = _sigmoid(h) @ weights + bias
    return np.round(_sigmoid(h[:, 1] - h[:, 0]), SCORE_DIGITS).reshape(len(u), len(i))


def _blend_block(specs: list[dict], step_of: str, n: int = 0, dense_weight: float | None = None):
    """One player block against one item block. Step "bounds": the smallest and
    largest score of each player and model; "totals": those of each player's blend
    (as model -1); "top": the ``n`` best of the blend. Scores are scaled by the bounds
    that come with the players' vectors (lo, hi). With ``dense_weight`` the blend is
    scaled by its own bounds (tlo, thi) and listed scores are added."""
    wanted = {"player_id": [], "game_id": [], "score": [], "rank": []} if step_of == "top" else {"player_id": [], "model": [], "lo": [], "hi": []}

    def bounds_of(x: np.ndarray, has: np.ndarray, block: np.ndarray, k: int) -> pd.DataFrame:
        lo, hi, some = np.where(has, x, np.inf).min(1), np.where(has, x, -np.inf).max(1), has.any(1)
        return pd.DataFrame({"player_id": block[some], "model": np.int32(k), "lo": lo[some], "hi": hi[some]})

    def run(left: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        has_vec = left["vec"].notna()
        vecs = left[has_vec].sort_values("player_id", kind="stable")
        others = left[~has_vec]
        listed = others[others["adds"].notna()] if dense_weight is not None else others[:0]
        l_who, l_what = _pairs_of(listed)
        ids = np.union1d(items["game_id"].to_numpy(dtype=np.int64), l_what)
        uid = np.union1d(vecs["player_id"].to_numpy(dtype=np.int64), l_who)
        if not len(uid) or not len(ids):
            return pd.DataFrame(wanted)
        l_row, l_col = np.searchsorted(uid, l_who), np.searchsorted(ids, l_what)
        l_add = np.concatenate([np.asarray(x, float) for x in listed["adds"]]) if len(listed) else np.empty(0)
        who, what = _pairs_of(others[others["adds"].isna()] if dense_weight is not None else others)
        row, col = np.searchsorted(uid, who), np.searchsorted(ids, what)
        ok = (row < len(uid)) & (col < len(ids))
        ok[ok] = (uid[row[ok]] == who[ok]) & (ids[col[ok]] == what[ok])
        order = np.argsort(row[ok], kind="stable")
        row, col = row[ok][order], col[ok][order]
        sides, widest = [], 1
        for k, spec in enumerate(specs):
            u, i = vecs[vecs["model"] == k], items[items["model"] == k]
            if len(u) and len(i):
                at = np.searchsorted(ids, i["game_id"].to_numpy(dtype=np.int64))
                sides.append((k, spec, u, u["player_id"].to_numpy(dtype=np.int64), at, np.stack(i["vec"].to_numpy()).astype(np.float64)))
                widest = max(widest, 1 if spec["rest"] is None else sides[-1][-1].shape[1])
        step = max(1, min(USER_BATCH, BLOCK_BYTES // (8 * len(ids) * widest)))
        out = []
        for s in range(0, len(uid), step):
            block = uid[s : s + step]
            mine = slice(*np.searchsorted(row, (s, s + step)))
            total, scored = np.zeros((len(block), len(ids))), np.zeros((len(block), len(ids)), bool)
            for k, spec, u, owner, at, im in sides:
                part = slice(*np.searchsorted(owner, (block[0], block[-1] + 1)))
                if part.start == part.stop:
                    continue
                r = np.searchsorted(block, owner[part])
                x = np.full(total.shape, np.nan)
                x[np.ix_(r, at)] = _model_scores(np.stack(u["vec"].iloc[part].to_numpy()).astype(np.float64), im, spec)
                x[row[mine] - s, col[mine]] = np.nan
                if spec["positive"]:
                    x[~(x > 0)] = np.nan
                has = ~np.isnan(x)
                if step_of == "bounds":
                    out.append(bounds_of(x, has, block, k))
                    continue
                if spec["scaled"]:
                    lo, hi = np.full((2, len(block), 1), np.nan)
                    lo[r, 0], hi[r, 0] = u["lo"].iloc[part], u["hi"].iloc[part]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        x = np.where(hi == lo, 1.0, (x - lo) / (hi - lo))
                total += np.where(has, spec["weight"] * x, 0.0)
                scored |= has
            if step_of == "totals":
                out.append(bounds_of(np.round(total, SCORE_DIGITS), scored, block, -1))
            elif step_of == "top":
                if dense_weight is not None:
                    t = np.full((2, len(block), 1), np.nan)
                    first = vecs.drop_duplicates("player_id")
                    mine_too = first["player_id"].isin(block).to_numpy()
                    t[:, np.searchsorted(block, first["player_id"].to_numpy(dtype=np.int64)[mine_too]), 0] = first.loc[mine_too, ["tlo", "thi"]].to_numpy().T
                    with np.errstate(invalid="ignore", divide="ignore"):
                        one = np.where(t[1] == t[0], 1.0, (np.round(total, SCORE_DIGITS) - t[0]) / (t[1] - t[0]))
                    total = np.where(scored, dense_weight * one, 0.0)
                    here = (l_row >= s) & (l_row < s + step)
                    total[l_row[here] - s, l_col[here]] += l_add[here]
                    scored[l_row[here] - s, l_col[here]] = True
                    scored[row[mine] - s, col[mine]] = False
                r, c, sc, rank = _ranked_rows(np.where(scored, np.round(total, SCORE_DIGITS), -np.inf), n)
                out.append(pd.DataFrame({"player_id": block[r], "game_id": ids[c], "score": sc, "rank": rank.astype(np.int32)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(wanted)

    return run


def dense_blend_top_n(models: dict[str, dict], owned: DataFrame | None, n: int = 10, lists: dict[str, dict] | None = None,
                      dense_weight: float = 1.0, scaled: bool = True, max_bytes: int = MAX_ITEM_BLOCK_BYTES) -> DataFrame:
    """Top ``n`` of a weighted blend over full score lists.

    ``models``: name -> {users, items, weight, cosine, positive_only, rest}, users
    and items as in ``dense_top_n`` (dimensions may differ between models); with
    ``rest`` the sides are a network's halves (``network_sides``). Every model scores
    every unseen item; its scores are scaled per player from their minimum and
    maximum over all of these (unless ``scaled`` is off), weighted and summed (an item
    without a score of a model adds 0).

    Two passes over the same pairs of player and item blocks: the first gives each
    block's minimum and maximum per (player, model), which merge by aggregation, the
    second scores with these bounds and keeps N a block. Item blocks hold about
    ``max_bytes`` of vectors, so no task holds the catalogue.

    ``lists``: name -> {scores (player_id, game_id, score), weight} of models that
    score some items only. The models' sum is then scaled per player over all unseen
    items as well (a pass of its own) and weighs ``dense_weight``; a list is scaled
    over itself; all items are ranked once, by the sum."""
    from lodestar.session import cut_lineage

    users = items = None
    specs = []
    # vectors of single precision travel as they are; tasks work on them in double
    width = max(_width(m[side]) for m in models.values() for side in ("users", "items"))
    array = "array<float>" if width == 4 else "array<double>"
    for k, (name, m) in enumerate(models.items()):
        u = m["users"].select(F.lit(k).alias("model"), F.col("player_id").cast("long"), F.col("vec").cast(array))
        i = m["items"].select(F.lit(k).alias("model"), F.col("game_id").cast("long"), F.col("vec").cast(array))
        users, items = (u, i) if users is None else (users.unionByName(u), items.unionByName(i))
        specs.append({"name": name, "weight": float(m["weight"]), "cosine": bool(m.get("cosine")), "rest": m.get("rest"),
                      "positive": bool(m.get("positive_only")), "scaled": scaled})
    users, items = cut_lineage(users), cut_lineage(items)
    spark = users.sparkSession
    size = lambda side: side.agg(F.sum(F.size("vec") * width + 16)).first()[0] or 0
    user_blocks, item_blocks = _grid(spark, users.select("player_id").distinct().count(), size(users), size(items), max_bytes, n)
    ub = F.pmod(F.xxhash64(F.col("player_id").cast("long")), F.lit(user_blocks)).cast("int").alias("ub")
    ib = F.pmod(F.xxhash64(F.col("game_id").cast("long")), F.lit(item_blocks)).cast("int").alias("ib")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    right = items.withColumn("ib", ib).withColumn("ub", every(user_blocks))
    none = spark.createDataFrame([], "player_id long, game_id long")
    pairs = cut_lineage(owned_rows(owned if owned is not None else none, ub, ib))

    def met(side: DataFrame, block, schema: str, arrow: bool = True) -> DataFrame:
        left = side.withColumn("ub", ub).withColumn("ib", every(item_blocks)).unionByName(pairs, allowMissingColumns=True)
        if arrow:
            return _met(left, right, user_blocks * item_blocks, block, schema)
        return left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib")).applyInPandas(block, schema)

    kind = "player_id long, model int, lo double, hi double"
    merged = lambda found: found.groupBy("player_id", "model").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    if scaled:
        users = users.join(merged(met(users, screen.ends_block(specs), kind)), ["player_id", "model"], "left")
    if lists:
        users = cut_lineage(users)
        whole = merged(met(users, _blend_block(specs, "totals"), kind, arrow=False))
        users = users.join(whole.select("player_id", F.col("lo").alias("tlo"), F.col("hi").alias("thi")), "player_id", "left")
        pairs = pairs.unionByName(_listed_rows(lists, owned, ub, ib), allowMissingColumns=True)
        out = met(users, _blend_block(specs, "top", n, dense_weight), OUT_SCHEMA, arrow=False)
    else:
        out = met(users, screen.top_block(specs, n, scaled), OUT_SCHEMA)
    if item_blocks > 1:
        out = top_n(out.drop("rank"), n).withColumn("rank", F.col("rank").cast("int"))
    return out


def _listed_rows(lists: dict[str, dict], owned: DataFrame, ub, ib) -> DataFrame:
    """(ub, ib, owners, games, adds): each list's unowned scores, scaled over the
    list and weighted, summed per pair."""
    parts = None
    for name, m in lists.items():
        x = m["scores"].select(F.lit(name).alias("name"), F.col("player_id").cast("long"), F.col("game_id").cast("long"),
                               F.col("score").cast("double"), F.lit(float(m["weight"])).alias("weight"))
        parts = x if parts is None else parts.unionByName(x)
    parts = parts.join(owned.select("player_id", "game_id"), ["player_id", "game_id"], "left_anti")
    ends = parts.groupBy("player_id", "name").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    j = parts.join(ends, ["player_id", "name"])
    one = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    added = j.groupBy("player_id", "game_id").agg(F.sum(F.col("weight") * one).alias("add"))
    part = F.pmod(F.xxhash64("player_id", "game_id"), F.lit(max(1, -(-added.count() // PAIRS_PER_ROW))))
    put = added.groupBy(ub, ib, part.alias("part")).agg(F.collect_list(F.struct("player_id", "game_id", "add")).alias("p"))
    return put.select("ub", "ib", F.lit(0).cast("long").alias("player_id"), F.col("p.player_id").alias("owners"),
                      F.col("p.game_id").alias("games"), F.col("p.add").alias("adds"))
