"""Exact top-N over sparse item vectors by posting lists with upper bounds.

Item vectors of terms (content, popularity) have few entries, and many items
share a vector. A block of items is therefore kept as

- classes: the distinct vectors, each with its items in order of their ids;
- posting lists: the classes under their heaviest term, in the order of their other
  terms, cut into lists of up to ``LIST`` classes; of each list the largest and
  smallest weight of every term it holds.

For a batch of players the maxima bound every list's scores at once. The lists
with the best bounds give N scores and so a threshold; only lists whose
bound reaches it are scored, only classes that reach it are kept. Classes are taken
by score until they hold N unseen items, together with all that tie with the
last, and only then expanded to items: of a class no more than N + (owned in it)
are needed. So a class keeps its N + (most that a player owns of it) smallest ids, and
lies in one block as a whole: blocks grow with the distinct vectors, not with the items.
Players and items meet in block pairs (``cogroup``) as in ``scoring.dense_top_n``;
neither side passes the driver.

Scores are quantised to ``SCORE_DIGITS``; ties go to the smaller item id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.joins import maybe_broadcast
from lodestar.operators.ranking import top_n
from lodestar.operators.scoring import OUT_SCHEMA, SCORE_DIGITS, USERS_PER_BLOCK, owned_rows
from lodestar.session import cut_lineage

try:  # ship this module's task code by value: executors need no installed package
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

LIST = 128
BATCH = 2048  # players scored at once
LEADS = 3  # lists that give the threshold
ITEM_BLOCK_ENTRIES = 1_000_000  # vector entries and ids of an item block
SLACK = 10.0 ** (1 - SCORE_DIGITS)


class Lists:
    """Classes, their members and posting lists of one block of items (of one
    group). Class c has the entries ``entries[c]:entries[c + 1]`` of (terms,
    weights) and the items ``begin[c]:begin[c + 1]`` of ``ids``, in order."""

    def __init__(self, entries: np.ndarray, terms: np.ndarray, weights: np.ndarray, begin: np.ndarray, ids: np.ndarray, dim: int) -> None:
        count = np.diff(entries)
        classes = len(count)
        owner = np.repeat(np.arange(classes), count)
        # heaviest term first, then the other terms; equal terms by weight
        by = np.lexsort((terms, -weights, owner))
        place = np.arange(len(terms)) - np.repeat(entries[:-1], count)
        width = int(count.max(initial=0))
        key_t, key_w = np.full((classes, width), -1, np.int64), np.zeros((classes, width))
        key_t[owner, place], key_w[owner, place] = terms[by], -weights[by]
        keys = [k[:, j] for j in range(width - 1, -1, -1) for k in (key_w, key_t)] or [np.zeros(classes)]
        # all terms before all weights
        order = np.lexsort(keys[0::2] + keys[1::2])
        self.vectors = [(terms[entries[c] : entries[c + 1]], weights[entries[c] : entries[c + 1]]) for c in order]
        self.size = np.diff(begin)[order]
        self.first = np.cumsum(self.size) - self.size
        self.members = ids[np.repeat(begin[:-1][order] - self.first, self.size) + np.arange(len(ids))]
        back = np.argsort(self.members, kind="stable")
        self.ids, self.of_item = self.members[back], np.repeat(np.arange(classes), self.size)[back]
        lead = key_t[order, 0] if width else np.full(classes, -1)
        edges = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1], True]) if classes else np.zeros(1, int)
        starts = [(c, min(c + LIST, e)) for s, e in zip(edges[:-1], edges[1:]) for c in range(s, e, LIST)]
        self.lists = []
        self.most, self.least = np.zeros((len(starts), dim)), np.zeros((len(starts), dim))
        for k, (a, b) in enumerate(starts):
            t = np.concatenate([t for t, _ in self.vectors[a:b]])
            held = np.unique(t)
            x = np.zeros((b - a, len(held)))
            x[np.repeat(np.arange(b - a), [len(t) for t, _ in self.vectors[a:b]]), np.searchsorted(held, t)] = np.concatenate(
                [w for _, w in self.vectors[a:b]])
            self.lists.append((a, b, held, np.ascontiguousarray(x.T)))
            if len(held):
                self.most[k, held], self.least[k, held] = x.max(0), x.min(0)

    def bounds(self, u: np.ndarray) -> np.ndarray:
        return np.maximum(u, 0) @ self.most.T + np.minimum(u, 0) @ self.least.T

    def best_classes(self, u: np.ndarray, n: int, owned: np.ndarray, floor: float):
        """(row, class, score, unseen items) of all classes that can hold one of a
        row's ``n`` best unseen items. ``owned``: sorted codes row * classes + class,
        one for each owned item; ``floor``: scores must exceed it."""
        classes = len(self.vectors)
        code, count = np.unique(owned, return_counts=True)
        gone = code[count >= self.size[code % classes]]  # classes a row owns whole
        gone_row, gone_class = gone // classes, gone % classes

        def scores(k: int, rows: np.ndarray) -> np.ndarray:
            a, b, terms, x = self.lists[k]
            s = np.round(u[np.ix_(rows, terms)] @ x, SCORE_DIGITS)
            s[~(s > floor)] = -np.inf
            lo = (gone_class >= a) & (gone_class < b)
            if lo.any():
                at = np.searchsorted(rows, gone_row[lo])
                ok = (at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)] == gone_row[lo])
                s[at[ok], gone_class[lo][ok] - a] = -np.inf
            return s

        bound = self.bounds(u)
        tops = min(LEADS, bound.shape[1])
        lead = np.argpartition(-bound, tops - 1, axis=1)[:, :tops]
        best = np.full((len(u), n), -np.inf)
        for k in np.unique(lead):
            rows = np.flatnonzero((lead == k).any(axis=1))
            s = np.hstack([best[rows], scores(k, rows)])
            best[rows] = -np.partition(-s, n - 1, axis=1)[:, :n]
        limit = np.maximum(best.min(axis=1), floor)
        out_row, out_class, out_score = [], [], []
        for k in range(len(self.lists)):
            rows = np.flatnonzero(bound[:, k] + SLACK >= limit)
            if len(rows):
                s = scores(k, rows)
                r, c = np.nonzero((s >= limit[rows, None]) & np.isfinite(s))
                out_row.append(rows[r])
                out_class.append(c + self.lists[k][0])
                out_score.append(s[r, c])
        if not out_row:
            return np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, int)
        row, cls, score = np.concatenate(out_row), np.concatenate(out_class), np.concatenate(out_score)
        if not len(row):  # bounds reached the limit, no class did
            return row, cls, score, np.empty(0, int)
        order = np.lexsort((-score, row))
        row, cls, score = row[order], cls[order], score[order]
        at = np.searchsorted(code, row * classes + cls)
        held = np.zeros(len(row), np.int64)
        ok = at < len(code)
        ok[ok] = code[at[ok]] == (row * classes + cls)[ok]
        held[ok] = count[at[ok]]
        unseen = self.size[cls] - held
        # up to the class that completes n unseen items, and all that tie with it
        total = np.cumsum(unseen)
        new = np.r_[True, row[1:] != row[:-1]]
        begin = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        before = total - unseen - (total - unseen)[begin][of]  # unseen in better classes of the row
        full = before < n
        last = np.full(len(begin), np.inf)
        np.minimum.at(last, of[full], score[full])
        keep = score >= last[of]
        return row[keep], cls[keep], score[keep], held[keep]


def _rank_rows(row, item, score, n, *more):
    order = np.lexsort((item, -score, row))
    row, item, score = row[order], item[order], score[order]
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, int)
    rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)]))
    keep = rank < n
    return row[keep], item[keep], score[keep], rank[keep] + 1, *[m[order][keep] for m in more]


def _list_column(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of an array column without NULLs."""
    c = table[name].combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    offsets = c.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], c.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(kind)


def _rows_of(offsets: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and places of the entries when rows are taken in ``order``."""
    size = np.diff(offsets)[order]
    out = np.r_[0, np.cumsum(size)]
    return out, np.repeat(offsets[:-1][order] - out[:-1], size) + np.arange(out[-1])


def _posting_block(n: int, dim: int, cosine: bool, floor: float, per_group: int | None, parts: bool):
    """Top ``n`` of one player block against one item block."""
    kinds = [("player_id", pa.int64()), ("game_id", pa.int64()), ("score", pa.float64()), ("rank", pa.int32())]
    kinds += [("grp", pa.int64())] if per_group else []
    kinds += [("terms", pa.list_(pa.int32())), ("shares", pa.list_(pa.float64()))] if parts else []
    schema = pa.schema(kinds)

    def run(left: pa.Table, items: pa.Table) -> pa.Table:
        is_user = pc.is_valid(left["idx"])
        users, mine = left.filter(is_user), left.filter(pc.invert(is_user))
        if not users.num_rows or not items.num_rows:
            return schema.empty_table()
        entries, terms = _list_column(items, "idx", np.int64)
        weights = _list_column(items, "w", np.float64)[1]
        begin, members = _list_column(items, "ids", np.int64)
        ids = np.sort(members)
        group = items["grp"].to_numpy()
        groups = []  # (group, its lists)
        for g in np.unique(group) if per_group else [0]:
            at = np.flatnonzero(group == g) if per_group else np.arange(len(group))
            e, pick = _rows_of(entries, at)
            m, who = _rows_of(begin, at)
            groups.append((g, Lists(e, terms[pick], weights[pick], m, members[who], dim)))
        by_id = np.argsort(users["player_id"].to_numpy(), kind="stable")
        uid = users["player_id"].to_numpy()[by_id]
        offsets, u_term = _list_column(users, "idx", np.int64)
        u_begin, pick = _rows_of(offsets, by_id)
        u_term, u_weight = u_term[pick], _list_column(users, "w", np.float64)[1][pick]
        who, what = (_list_column(mine, c, np.int64)[1] if mine.num_rows else np.empty(0, np.int64) for c in ("owners", "games"))
        row, col = np.searchsorted(uid, who), np.searchsorted(ids, what)
        ok = (row < len(uid)) & (col < len(ids))
        ok[ok] = (uid[row[ok]] == who[ok]) & (ids[col[ok]] == what[ok])
        owned = np.unique(row[ok] * len(ids) + col[ok])
        row, col = owned // len(ids), owned % len(ids)
        want = per_group or n
        out = []
        for s in range(0, len(uid), BATCH):
            e = min(s + BATCH, len(uid))
            u, has = np.zeros((e - s, dim)), np.zeros((e - s, dim), bool)
            r = np.repeat(np.arange(e - s), np.diff(u_begin[s : e + 1]))
            t, w = u_term[u_begin[s] : u_begin[e]], u_weight[u_begin[s] : u_begin[e]]
            ok = t < dim
            u[r[ok], t[ok]], has[r[ok], t[ok]] = w[ok], True
            if cosine:
                norms = np.linalg.norm(u, axis=1, keepdims=True)
                u = np.divide(u, norms, out=np.zeros_like(u), where=norms > 0)
            a, b = np.searchsorted(row, (s, e))
            mine_row, mine_id = row[a:b] - s, ids[col[a:b]]
            known_codes = mine_row * len(ids) + col[a:b]
            batch = []
            for g, lists in groups:
                p = np.searchsorted(lists.ids, mine_id)
                held_here = p < len(lists.ids)
                held_here[held_here] = lists.ids[p[held_here]] == mine_id[held_here]
                codes = np.sort(mine_row[held_here] * len(lists.vectors) + lists.of_item[p[held_here]])
                br, bc, bs, held = lists.best_classes(u, want, codes, floor)
                take = np.minimum(lists.size[bc], want + held)
                er, ec = np.repeat(br, take), np.repeat(bc, take)
                step = np.arange(len(er)) - np.repeat(np.cumsum(take) - take, take)
                game = lists.members[lists.first[ec] + step]
                new = ~np.isin(er * len(ids) + np.searchsorted(ids, game), known_codes)
                x = _rank_rows(er[new], game[new], np.repeat(bs, take)[new], want, ec[new])
                batch.append((x[0], x[1], x[2], np.full(len(x[0]), g), x[4]))
            br, game, score, grp, cls = (np.concatenate(c) for c in zip(*batch))
            br, game, score, rank, grp, cls = _rank_rows(br, game, score, n, grp, cls)
            part = [uid[s + br], game, score, rank.astype(np.int32)] + ([grp] if per_group else [])
            if parts:
                by_group = dict(groups)
                shared, shares = [], []
                for i, c, g in zip(br, cls, grp):
                    t, w = by_group[g].vectors[c]
                    t, w = t[has[i, t]], w[has[i, t]]
                    shared.append(t.astype(np.int32))
                    shares.append(u[i, t] * w)
                part += [shared, shares]
            out.append(pa.table([pa.array(c, f.type) for c, f in zip(part, schema)], schema=schema))
        return pa.concat_tables(out)

    return run


def packed(vecs: DataFrame, key: str) -> DataFrame:
    """(key, idx ARRAY<INT>, w ARRAY<DOUBLE>) in order of idx from the long form."""
    e = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("i"), F.col("weight").cast("double").alias("w"))))
    return vecs.groupBy(key).agg(e.alias("e")).select(
        key, F.transform("e", lambda x: x["i"]).alias("idx"), F.transform("e", lambda x: x["w"]).alias("w"))


SALTS = 16  # parts in which a class's ids are ranked first


def first_members(items: DataFrame, owned: DataFrame | None, n: int) -> DataFrame:
    """The items that can be among a player's ``n`` first unseen ones of their class
    (``key``, grp, idx, w): its smallest ids, ``n`` and as many as one player owns of it."""
    most = F.lit(0)
    if owned is not None:
        mine = owned.select("player_id", F.col("game_id").cast("long")).join(maybe_broadcast(items.select("game_id", "key")), "game_id")
        held = mine.groupBy("player_id", "key").agg(F.count(F.lit(1)).alias("_m")).groupBy("key").agg(F.max("_m").alias("_m"))
        items, most = items.join(maybe_broadcast(held), "key", "left"), F.coalesce("_m", F.lit(0))
    of = ["key", "grp", "idx", "w"]
    items = items.where(F.col("game_id").isNotNull()).withColumn("_s", F.pmod(F.xxhash64("game_id"), F.lit(SALTS)))
    for by in (of + ["_s"], of):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("game_id"))
        items = items.withColumn("_r", place).where(F.col("_r") <= F.lit(n) + most)
    return items.select("game_id", *of)


def sparse_top_n(users: DataFrame, items: DataFrame, owned: DataFrame | None, dim: int, n: int = 10, cosine: bool = False,
                 positive_only: bool = False, min_score: float | None = None, group: str | None = None,
                 per_group: int | None = None, parts: bool = False, block_entries: int = ITEM_BLOCK_ENTRIES) -> DataFrame:
    """Top ``n`` unseen items per player by (quantised) dot product.

    users: (player_id, idx, w), items: (game_id, idx, w and the ``group`` column, if
    any) as ``packed`` makes them, idx below ``dim``; owned: (player_id, game_id)
    pairs to exclude. ``per_group`` limits the items of a group in a list, over all
    unseen items. ``min_score`` is a floor. With ``parts`` the terms that player and
    item share come along, with their parts of the score (terms, shares)."""
    spark = users.sparkSession
    users = cut_lineage(users.select(F.col("player_id").cast("long"), "idx", "w"))
    items = cut_lineage(items.select(F.col("game_id").cast("long"), "idx", "w", (
        F.xxhash64(group) if group else F.lit(0).cast("long")).alias("grp")).withColumn("key", F.xxhash64("grp", "idx", "w")))
    items = cut_lineage(first_members(items, owned, per_group or n))
    size = items.groupBy("key").agg(F.max(F.size("idx")).alias("t"), F.count("game_id").alias("n")).agg(F.sum(F.col("t") + F.col("n"))).first()
    item_blocks = max(1, -(-(size[0] or 0) // block_entries))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    user_blocks = max(-(-tasks // item_blocks), -(-users.count() // USERS_PER_BLOCK))
    ub = F.pmod(F.xxhash64("player_id"), F.lit(user_blocks)).cast("int").alias("ub")
    ib = F.pmod(F.col("key"), F.lit(item_blocks)).cast("int").alias("ib")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = users.select("player_id", "idx", "w", ub, every(item_blocks).alias("ib"))
    if owned is not None:
        met = owned.select(F.col("player_id").cast("long"), F.col("game_id").cast("long")).join(
            maybe_broadcast(items.select("game_id", ib).distinct()), "game_id")
        left = left.unionByName(owned_rows(cut_lineage(met), ub, F.col("ib")), allowMissingColumns=True)
    classes = items.groupBy(ib, "grp", "idx", "w").agg(F.array_sort(F.collect_list("game_id")).alias("ids"))
    right = classes.withColumn("ub", every(user_blocks))
    # scores are multiples of 10^-SCORE_DIGITS, so the step below a floor excludes nothing
    floor = max(0.0 if positive_only else -np.inf, -np.inf if min_score is None else min_score - SLACK / 20)
    schema = OUT_SCHEMA + (", grp long" if per_group else "") + (", terms array<int>, shares array<double>" if parts else "")
    scored = left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib")).applyInArrow(
        _posting_block(n, dim, cosine, floor, per_group, parts), schema)
    if item_blocks > 1:
        scored = scored.drop("rank")
        if per_group:  # the limit again, over the blocks' lists
            w = Window.partitionBy("player_id", "grp").orderBy(F.col("score").desc(), F.col("game_id").asc())
            scored = scored.withColumn("_g", F.row_number().over(w)).where(F.col("_g") <= per_group).drop("_g")
        scored = top_n(scored, n).withColumn("rank", F.col("rank").cast("int"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= F.lit(min_score))
    return scored.drop("grp")
