"""Top-N and bounds of one player block against one item block, screened in single
precision.

A block pair has far more scores than it keeps. They are computed in 32 bits,
a batch of players and a chunk of items at once, and compared with what a player's
N-th best (or smallest, largest) score is so far, less a bound of the rounding
error. Only pairs that reach it are scored in 64 bits and ranked, so the result is
that of scoring all pairs in 64 bits; memory is one chunk. Items come by size, so
that thresholds rise early.

A network is the costliest model: in a blend it is asked only for pairs whose other
models' sum could reach the threshold with its full weight. Its first layer, split
into halves, needs no exponential a pair: sigmoid(u + i) = 1 / (1 + exp(-u) exp(-i)).

A network of two hidden layers is screened before it is run (``Near``): its second-order
expansion about the items' mean is one product a pair, and what the expansion leaves out
has a bound an item, for all players of a batch. Only pairs whose bound reaches the
threshold are run. The bound holds for any weights; the smoother the network, the fewer
pairs pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:  # ship this module's task code by value: executors need no installed package
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

DIGITS = 9
ROWS, COLUMNS = 256, 4096  # players and items scored at once
NET_ROWS = 512  # pairs that a network takes at once
HEAD = 256  # items scored in full first, for a threshold
PAIRS = 1 << 16
EPS = 2.0**-23
SLACK = 2.0 * 10.0**-DIGITS
NET_HEAD = 64
NEAR_ROWS = 256
NEAR_RANK = 32  # items that span more dimensions are not expanded
WIDE = 40.0  # beyond it exp(-u) exp(-i) could overflow


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60.0, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _ids(column) -> np.ndarray:
    return pc.fill_null(column, -(2**63)).to_numpy().astype(np.int64)


def _matrix(table: pa.Table) -> np.ndarray:
    c = table["vec"].combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


class Side:
    """Rows of one side: ids in order, and each model's vectors in rows ``at``."""

    def __init__(self, table: pa.Table, key: str, models: int) -> None:
        model, ids = table["model"].to_numpy(), _ids(table[key])
        self.ids = np.unique(ids)
        self.mats, self.at, self.rows = [], [], []
        self.pattern = np.zeros(len(self.ids), np.int64)
        for k in range(models):
            rows = np.flatnonzero(model == k)
            rows = rows[np.argsort(ids[rows], kind="stable")]
            place = np.full(len(self.ids), -1)
            where = np.searchsorted(self.ids, ids[rows])
            place[where] = np.arange(len(rows))
            self.pattern[where] |= 1 << k
            self.at.append(place)
            self.rows.append(rows)
            self.mats.append(_matrix(table.take(rows)) if len(rows) else np.zeros((0, 1)))


class Dot:
    """A model whose score is the product of two vectors."""

    def __init__(self, u: np.ndarray, v: np.ndarray, spec: dict) -> None:
        if spec["cosine"]:
            norms = np.linalg.norm(u, axis=1, keepdims=True)
            u = np.divide(u, norms, out=np.zeros_like(u), where=norms > 0)
        self.u, self.v = u, v
        self.u32, self.v32 = u.astype(np.float32), np.ascontiguousarray(v.astype(np.float32))
        self.length = np.linalg.norm(v, axis=1)
        self.most = np.linalg.norm(u, axis=1) * self.length.max(initial=0)  # of a player's scores
        self.error = self.most * (u.shape[1] + 8) * EPS
        self.signed = (u < 0).any() or (v < 0).any()

    def block(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.round(self.u[r] @ self.v[c].T, DIGITS)

    def pairs(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.round(np.einsum("ij,ij->i", self.u[r], self.v[c]), DIGITS)

    def fast(self, r: np.ndarray, c: slice) -> np.ndarray:
        return self.u32[r] @ self.v32[c].T

    def arrange(self, order: np.ndarray) -> None:
        self.v, self.v32 = self.v[order], self.v32[order]


def _logit(s: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(s <= 0, -np.inf, np.where(s >= 1, np.inf, np.log(s) - np.log1p(-s)))


class Near:
    """A network of two hidden layers, z(u, c + t) = add + a . sigmoid(W' sigmoid(u + c + t) + b),
    expanded to second order in t. Sigmoid's third derivative is at most 1/8, so with
    the first layer's and the second layer's inputs each expanded, what is left out is

    - the first layer's third order, |t|^3 / 48 a unit, seen through z's gradient;
    - the second order of the second layer's inputs beyond their linear part;
    - the second layer's third order, |change of its input|^3 / 48 a unit.

    Ranges of a batch's players bound all three by item."""

    def __init__(self, v: np.ndarray, rest: list) -> None:
        (self.w, self.b), (last, add) = rest
        self.a, self.add = last[:, 1] - last[:, 0], add[1] - add[0]
        self.center = v.mean(0)
        parts = [slice(s, s + COLUMNS) for s in range(0, len(v), COLUMNS)]
        gram = sum((v[s] - self.center).T @ (v[s] - self.center) for s in parts)
        size, axes = np.linalg.eigh(gram)
        self.axes = axes[:, size > max(size.max(), 0) * 1e-12]
        self.usable = self.axes.shape[1] <= NEAR_RANK
        if not self.usable:
            return
        self.d = np.concatenate([(v[s] - self.center) @ self.axes for s in parts])
        lost = max(np.abs(v[s] - self.center - self.d[s] @ self.axes.T).max() for s in parts)
        self.lost = lost * (np.abs(self.w) @ np.abs(self.a)).sum() / 16 * 1.01
        self.one, self.two = np.triu_indices(self.axes.shape[1])
        self.twice = np.where(self.one == self.two, 1.0, 2.0)

    def batch(self, u: np.ndarray):
        """Of some players: a function of items' places that gives z by player and item, a bound
        of its error by item and one of its rounding by player."""
        f, q, w = np.float32, self.axes, self.w
        p = u + self.center
        h = _sigmoid(p.copy())
        slope = h * (1 - h)
        bend = slope * (1 - 2 * h) / 2
        g = _sigmoid(h @ w + self.b)
        g1 = g * (1 - g)
        g2 = g1 * (1 - 2 * g) / 2
        seen = (g1 * self.a) @ w.T  # z's gradient by the first layer's outputs
        linear = (seen * slope) @ q
        second = (seen * bend) @ (q[:, self.one] * q[:, self.two])
        inner = np.matmul(slope[:, None, :] * q.T, w)  # the second layer's gradients
        both = np.matmul(inner * (g2 * self.a)[:, None, :], inner.transpose(0, 2, 1))
        second += both[:, self.one, self.two]
        factor = np.hstack([linear, second * self.twice])
        start = g @ self.a + self.add
        size, f32 = np.linalg.norm(factor, axis=1), factor.astype(f)
        middle = lambda x: ((x.max(0) + x.min(0)) / 2, (x.max(0) - x.min(0)) / 2)
        (s_mid, s_off), (b_mid, b_off) = middle(slope), middle(bend)
        wide = np.abs(w)
        w1, w2, w3 = ((m[:, None] * x).astype(f) for m, x in ((s_mid, w), (s_off, wide), (b_mid, w)))
        w4, w5 = np.vstack([b_off[:, None] * wide, wide / 48]).astype(f), (np.abs(seen).max(0) / 48).astype(f)
        a2, a3 = (np.abs(self.a) * np.abs(g2).max(0)).astype(f), (np.abs(self.a) / 48).astype(f)
        axes = q.T.astype(f)

        def near(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            d = self.d[at]
            terms = np.hstack([d, d[:, self.one] * d[:, self.two]])
            long = np.linalg.norm(terms, axis=1).max(initial=0)
            z = f32 @ terms.astype(f).T
            z += start.astype(f)[:, None]
            t = d.astype(f) @ axes
            wt, t2 = np.abs(t), t * t
            t3 = t2 * wt
            more = np.abs(t @ w1) + wt @ w2
            off = np.abs(t2 @ w3) + np.hstack([t2, t3]) @ w4
            error = t3 @ w5 + (off * (2 * more + off)) @ a2 + (more + off) ** 3 @ a3
            rounding = (terms.shape[1] + 16) * EPS * (size * long + np.abs(start)) + 4 * EPS * float(error.max(initial=0))
            return z, error * f(1.001) + f(self.lost + 1e-9), rounding

        return near


class Net:
    """A network on the halves of its first layer; its score is the second class's
    probability."""

    signed = False

    def __init__(self, u: np.ndarray, v: np.ndarray, spec: dict) -> None:
        self.u, self.v, self.rest = u, v, spec["rest"]
        # with the sign of exp(-x); of the last layer only the difference counts
        last, add = self.rest[-1]
        layers = [*self.rest[:-1], (last[:, 1:2] - last[:, :1], add[1:2] - add[:1])]
        self.rest32 = [((-w).astype(np.float32), (-b).astype(np.float32)) for w, b in layers]
        high = max(np.abs(u).max(initial=0), np.abs(v).max(initial=0))
        self.wide = not high < WIDE
        e = (lambda x: x) if self.wide else (lambda x: np.exp(-x))
        self.u32, self.v32 = e(u).astype(np.float32), np.ascontiguousarray(e(v).astype(np.float32))
        # what 32 bits can be off by, layer by layer: sigmoids are at most 1/4 steep
        off = np.full(u.shape[1], 0.25 * (high if self.wide else 1.5) * EPS + EPS)
        for w, b in layers:
            off = np.abs(w).T @ (off + (len(w) + 4) * EPS / 2) + np.abs(b) * EPS
            off = 0.25 * off + EPS
        self.error = np.full(len(u), 2 * off.max())
        self.expanded = None
        finite = np.isfinite(u).all() and np.isfinite(v).all() and all(np.isfinite(x).all() for layer in self.rest for x in layer)
        if len(self.rest) == 2 and len(v) > min(HEAD, NET_HEAD) and finite:
            self.expanded = Near(v, self.rest)
            if not self.expanded.usable:
                self.expanded = None

    def near(self, r: np.ndarray):
        """The expansion for some players, or None."""
        return None if self.expanded is None else self.expanded.batch(self.u[r])

    def usual(self) -> np.ndarray:
        """Scores of the players' mean."""
        u = self.u.mean(0)
        return np.concatenate([self._scores(u + self.v[s : s + NET_ROWS]) for s in range(0, len(self.v), NET_ROWS)] or [np.empty(0)])

    def _scores(self, h: np.ndarray) -> np.ndarray:
        for weights, bias in self.rest:
            h = _sigmoid(h) @ weights + bias
        return np.round(_sigmoid(h[:, 1] - h[:, 0]), DIGITS)

    def block(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty((len(r), len(c)))
        for i, row in enumerate(r):
            out[i] = self._scores(self.u[row] + self.v[c])
        return out

    def pairs(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([self._scores(self.u[r[s : s + NET_ROWS]] + self.v[c[s : s + NET_ROWS]]) for s in range(0, len(r), NET_ROWS)] or [np.empty(0)])

    def row(self, r: int, c: np.ndarray | slice) -> np.ndarray:
        """32-bit scores of one player."""
        v = self.v32[c]
        return self._quick(self.u32[r], len(v), lambda s: (v[s], self.u32[r]))

    def some(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """32-bit scores of pairs."""
        return self._quick(self.u32[0], len(r), lambda s: (self.v32.take(c[s], 0), self.u32.take(r[s], 0)))

    def _quick(self, like: np.ndarray, n: int, sides) -> np.ndarray:
        out = np.empty(n, np.float32)
        hold = [np.empty((NET_ROWS, len(b)), np.float32) for b in (like, *[b for _, b in self.rest32])]
        with np.errstate(over="ignore"):  # exp of a large number: the sigmoid is 0
            for s in range(0, n, NET_ROWS):
                x, u = sides(slice(s, s + NET_ROWS))
                h = hold[0][: len(x)]
                if self.wide:
                    np.add(x, u, out=h)
                    np.exp(np.negative(h, out=h), out=h)
                else:
                    np.multiply(x, u, out=h)
                h += 1
                np.reciprocal(h, out=h)
                for (weights, bias), to in zip(self.rest32, hold[1:]):
                    h = np.matmul(h, weights, out=to[: len(x)])
                    h += bias
                    np.exp(h, out=h)
                    h += 1
                    np.reciprocal(h, out=h)
                out[s : s + NET_ROWS] = h[:, 0]
        return out

    def fast(self, r: np.ndarray, c: slice) -> np.ndarray:
        return np.stack([self.row(i, c) for i in r])

    def arrange(self, order: np.ndarray) -> None:
        self.v, self.v32 = self.v[order], self.v32[order]
        if self.expanded is not None:
            self.expanded.d = self.expanded.d[order]


class Owned:
    """Owned pairs as sorted codes."""

    def __init__(self, users: Side, items: Side, who: np.ndarray, what: np.ndarray) -> None:
        self.width = max(len(items.ids), 1)
        row, col = np.searchsorted(users.ids, who), np.searchsorted(items.ids, what)
        ok = (row < len(users.ids)) & (col < len(items.ids))
        ok[ok] = (users.ids[row[ok]] == who[ok]) & (items.ids[col[ok]] == what[ok])
        self.codes = np.unique(row[ok] * self.width + col[ok])

    def holds(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        code = row * self.width + col
        at = np.searchsorted(self.codes, code)
        found = at < len(self.codes)
        found[found] = self.codes[at[found]] == code[found]
        return found

    def whole(self, of: np.ndarray, size: np.ndarray) -> Owned:
        """The classes that a player owns whole; item i is in class ``of[i]``, if not -1."""
        row, col = np.divmod(self.codes, self.width)
        ok = of[col] >= 0
        code, held = np.unique(row[ok] * len(size) + of[col[ok]], return_counts=True)
        out = Owned.__new__(Owned)
        out.width, out.codes = len(size), code[held >= size[code % len(size)]]
        return out

    def block(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return self.holds(np.repeat(rows, len(cols)), np.tile(cols, len(rows))).reshape(len(rows), len(cols))


def _groups(pattern: np.ndarray):
    for p in np.unique(pattern):
        yield int(p), np.flatnonzero(pattern == p)


def _models(users: Side, items: Side, specs: list[dict]) -> list:
    kinds = [Net if s["rest"] is not None else Dot for s in specs]
    return [kind(u, v, s) if len(u) and len(v) else None for kind, u, v, s in zip(kinds, users.mats, items.mats, specs)]


def _by_size(models: list, items: Side, cols: np.ndarray, used: list[int]) -> np.ndarray:
    """The items with the largest vectors first, and with the best scores of a network."""
    size = np.zeros(len(cols))
    for k in used:
        if isinstance(models[k], Net) and models[k].expanded is not None:
            score = models[k].usual()[items.at[k][cols]]
            size += (score - score.min(initial=1)) / ((score.max(initial=0) - score.min(initial=1)) or 1.0)
        if isinstance(models[k], Dot):
            norms = models[k].length[items.at[k][cols]]
            size += norms / (norms.max(initial=0) or 1.0)
    return cols[np.argsort(-size, kind="stable")]


def best_rows(row: np.ndarray, item: np.ndarray, score: np.ndarray, n: int):
    """The ``n`` best of each row: score descending, then item ascending, with ranks."""
    order = np.lexsort((item, -score, row))
    row, item, score = row[order], item[order], score[order]
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, int)
    rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)]))
    keep = rank < n
    return row[keep], item[keep], score[keep], rank[keep] + 1


class _Blend:
    """The models' weighted sum for some rows and some columns that all have the same models."""

    def __init__(self, models: list, specs: list[dict], users: Side, items: Side, used: list[int], ends, owned: Owned, cols: np.ndarray) -> None:
        self.models, self.specs, self.users, self.items, self.used, self.owned = models, specs, users, items, used, owned
        self.ends = ends  # each model's smallest and largest score by row, or None
        self.order = _by_size(models, items, cols, used)
        self.v32 = {k: np.ascontiguousarray(models[k].v32[items.at[k][self.order]]) for k in used if isinstance(models[k], Dot)}

    def _added(self, total: np.ndarray, scored: np.ndarray, k: int, x: np.ndarray, ends) -> None:
        spec = self.specs[k]
        has = ~np.isnan(x)
        if spec["positive"]:
            has &= x > 0
        if ends is not None:
            lo, hi = ends
            with np.errstate(invalid="ignore", divide="ignore"):
                x = np.where(hi == lo, 1.0, (x - lo) / (hi - lo))
        total += np.where(has, spec["weight"] * x, 0.0)
        scored |= has

    def exact(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Blend of all rows and columns; -inf where it has no score or is owned."""
        total, scored = np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)), bool)
        for k in self.used:
            r = self.users.at[k][rows]
            ends = None if self.ends is None else [e[:, None] for e in self.ends[k][:, rows]]
            self._added(total, scored, k, self.models[k].block(r, self.items.at[k][cols]), ends)
        return np.where(scored & ~self.owned.block(rows, cols), np.round(total, DIGITS), -np.inf)

    def exact_pairs(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        total, scored = np.zeros(len(rows)), np.zeros(len(rows), bool)
        for k in self.used:
            ends = None if self.ends is None else self.ends[k][:, rows]
            self._added(total, scored, k, self.models[k].pairs(self.users.at[k][rows], self.items.at[k][cols]), ends)
        return np.where(scored, np.round(total, DIGITS), -np.inf)

    def factors(self, rows: np.ndarray):
        """Each model's factor and addend by row: blend = sum of factor * score + addend."""
        out = {}
        for k in self.used:
            w = self.specs[k]["weight"]
            if self.ends is None:
                out[k] = np.full(len(rows), w), np.zeros(len(rows))
                continue
            lo, hi = self.ends[k][:, rows]
            with np.errstate(invalid="ignore", divide="ignore"):
                one = w / (hi - lo)
                out[k] = np.where(hi > lo, one, 0.0), np.where(hi > lo, -one * lo, np.where(hi == lo, w, 0.0))
        return out

    def best(self, rows: np.ndarray, n: int, limit: np.ndarray, pool: list) -> None:
        """Puts into ``pool`` all (place, column, blend) that can be among the ``n`` best of
        the rows; ``limit``: the n-th best so far, raised here."""
        order = self.order
        nets = [k for k in self.used if isinstance(self.models[k], Net)]
        head = order[: max(min(HEAD, NET_HEAD) if nets else HEAD, 2 * n)]
        s = self.exact(rows, head)
        r, c = np.nonzero(np.isfinite(s) & (s >= limit[:, None]))
        pool.append((r, head[c], s[r, c]))
        self._raise(pool, limit, n)
        factors = self.factors(rows)
        linear = [k for k in self.used if isinstance(self.models[k], Dot) and not self.specs[k]["positive"]]
        positive = [k for k in self.used if isinstance(self.models[k], Dot) and self.specs[k]["positive"]]
        near = {k: self.models[k].near(self.users.at[k][rows]) for k in nets}
        error = np.full(len(rows), SLACK)
        base = sum((factors[k][1] for k in linear), np.zeros(len(rows)))
        for k in self.used:
            a, b = factors[k]
            m, at = self.models[k], self.users.at[k][rows]
            size = m.most[at] if isinstance(m, Dot) else 1.0
            error += np.abs(a) * m.error[at] + (np.abs(a) * size + np.abs(b)) * 8 * EPS
        scaled = {k: (self.models[k].u[self.users.at[k][rows]] * factors[k][0][:, None]).astype(np.float32) for k in linear + positive}
        # a network's part is at most its weight if it is scaled, or a probability
        most = sum(max(self.specs[k]["weight"], 0.0) for k in nets)
        end = len(head)
        while end < len(order):
            # as many as were seen: about N of them pass, then the threshold is raised
            a, end = end, end + min(COLUMNS, end)
            cols = order[a:end]
            x = None
            for k in linear + positive:
                y = scaled[k] @ self.v32[k][a:end].T
                if k in positive:
                    y += factors[k][1].astype(np.float32)[:, None]
                    np.maximum(y, 0, out=y)
                x = y if x is None else np.add(x, y, out=x)
            need = np.nextafter((limit - base - error - most).astype(np.float32), np.float32(-np.inf))
            if nets and all(near.values()):
                hit = np.flatnonzero(self._near(nets, near, factors, cols, x, limit - base - error))
                r, c = hit // len(cols), hit % len(cols)
                got = np.zeros(len(r), np.float32) if x is None else x[r, c]
                for k in nets if len(r) else []:
                    a, b = (y[r].astype(np.float32) for y in factors[k])
                    got += a * self.models[k].some(self.users.at[k][rows[r]], self.items.at[k][cols[c]]) + b
                ok = got >= (limit - base - error)[r]
                r, c = r[ok], c[ok]
            elif x is None:
                r, c = np.nonzero(np.broadcast_to((need <= 0)[:, None], (len(rows), len(cols))))
                x = np.zeros((1, 1), np.float32)
            else:
                hit = np.flatnonzero(x >= need[:, None])
                r, c = hit // len(cols), hit % len(cols)
            if len(r) and nets and not all(near.values()):
                r, c = self._net_screened(nets, factors, rows, cols, r, c, x, limit - base - error)
            for s in range(0, len(r), PAIRS):
                self._take(rows, r[s : s + PAIRS], cols[c[s : s + PAIRS]], limit, pool)
            if len(pool) > 1 and sum(len(p[0]) for p in pool[1:]) > len(rows):
                self._raise(pool, limit, n)
        self._raise(pool, limit, n)

    def _near(self, nets, near, factors, cols, x, need) -> np.ndarray:
        """Whether a pair's bound reaches ``need``, with the networks expanded."""
        if x is None and len(nets) == 1 and (factors[nets[0]][0] > 0).all():
            a, b = factors[nets[0]]
            z, off, rounding = near[nets[0]](self.items.at[nets[0]][cols])
            z += off
            least = _logit((need - b) / a) - rounding
            return z >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]
        total = np.zeros((len(need), len(cols)), np.float32) if x is None else x.copy()
        slack = np.zeros(len(need))
        for k in nets:
            a, b = factors[k]
            z, off, rounding = near[k](self.items.at[k][cols])
            z = _sigmoid(z)
            z *= a.astype(np.float32)[:, None]
            total += z
            # sigmoids are at most 1/4 steep
            total += np.abs(a).astype(np.float32)[:, None] * (off * np.float32(0.25))
            slack += np.abs(a) * (rounding / 4 + 16 * EPS) - b
        return total >= np.nextafter((need - slack - 16 * EPS * np.abs(need)).astype(np.float32), np.float32(-np.inf))[:, None]

    def _net_screened(self, nets, factors, rows, cols, r, c, x, need):
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        kept_r, kept_c = [], []
        for i, j in zip(first, np.r_[first[1:], len(r)]):
            row, mine = r[i], c[i:j]
            whole = 2 * len(mine) > len(cols)
            got = np.zeros(len(cols) if whole else len(mine), np.float32)
            for k in nets:
                at = self.items.at[k][cols if whole else cols[mine]]
                a, b = factors[k][0][row], factors[k][1][row]
                got += np.float32(a) * self.models[k].row(self.users.at[k][rows[row]], at) + np.float32(b)
            got = got[mine] if whole else got
            ok = got + (x[row, mine] if x.size > 1 else 0) >= need[row]
            kept_r.append(r[i:j][ok])
            kept_c.append(mine[ok])
        return np.concatenate(kept_r), np.concatenate(kept_c)

    def _take(self, rows, r, cols, limit, pool) -> None:
        new = ~self.owned.holds(rows[r], cols)
        r, cols = r[new], cols[new]
        s = self.exact_pairs(rows[r], cols)
        ok = np.isfinite(s) & (s >= limit[r])
        pool.append((r[ok], cols[ok], s[ok]))

    @staticmethod
    def _raise(pool: list, limit: np.ndarray, n: int) -> None:
        row, col, score, rank = best_rows(*(np.concatenate(x) for x in zip(*pool)), n)
        pool[:] = [(row, col, score)]
        last = rank == n
        limit[row[last]] = np.maximum(limit[row[last]], score[last])


def _alike(vecs: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the rows in groups of at most ``size``, halved along the longest axis."""
    todo, out = [np.arange(len(vecs))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        x = vecs[at] - vecs[at].mean(0)
        order = at[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
        half = size * -(-(len(at) // 2) // size)
        todo += [order[half:], order[:half]]
    return out


def _batches(models: list | dict, users: Side, members: np.ndarray, used: set[int]) -> list[np.ndarray]:
    """The players in batches; alike ones together if a network is expanded, as the bounds
    cover a batch."""
    net = next((k for k in sorted(used) if isinstance(models[k], Net) and models[k].expanded is not None), None)
    if net is None:
        return [members[s : s + ROWS] for s in range(0, len(members), ROWS)]
    return [members[at] for at in _alike(models[net].u[users.at[net][members]], NEAR_ROWS)]


OUT = pa.schema([("player_id", pa.int64()), ("game_id", pa.int64()), ("score", pa.float64()), ("rank", pa.int32())])
ENDS = pa.schema([("player_id", pa.int64()), ("model", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())])


def _sides(left: pa.Table, right: pa.Table, specs: list[dict]):
    has = pc.is_valid(left["vec"])
    vecs, pairs = left.filter(has), left.filter(pc.invert(has))
    users, items = Side(vecs, "player_id", len(specs)), Side(right, "game_id", len(specs))
    lists = [np.concatenate([np.asarray(x.values, np.int64) for x in pairs[c]]) if pairs.num_rows else np.empty(0, np.int64) for c in ("owners", "games")]
    return vecs, users, items, Owned(users, items, *lists)


def top_block(specs: list[dict], n: int, scaled: bool):
    """The ``n`` best of the blend of all models."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        vecs, users, items, owned = _sides(left, right, specs)
        models = _models(users, items, specs)
        ends = None
        if scaled:
            ends = []
            for k in range(len(specs)):
                e = np.full((2, len(users.ids)), np.nan)
                held = users.at[k] >= 0
                for i, name in enumerate(("lo", "hi")):
                    e[i, held] = vecs[name].to_numpy()[users.rows[k]][users.at[k][held]]
                ends.append(e)
        out = []
        item_groups = list(_groups(items.pattern))
        for up, members in _groups(users.pattern):
            parts = []
            for ip, cols in item_groups:
                used = [k for k in range(len(specs)) if up >> k & 1 and ip >> k & 1]
                if used:
                    parts.append(_Blend(models, specs, users, items, used, ends, owned, cols))
            together = {k for blend in parts for k in blend.used}
            for rows in _batches(models, users, members, together) if parts else []:
                pool = []
                limit = np.full(len(rows), -np.inf)
                for blend in parts:
                    blend.best(rows, n, limit, pool)
                r, c, score, rank = best_rows(*pool[0], n)
                out.append(pa.table([users.ids[rows[r]], items.ids[c], score, rank.astype(np.int32)], schema=OUT))
        return pa.concat_tables(out) if out else OUT.empty_table()

    return run


def ends_block(specs: list[dict]):
    """Each player's and model's smallest and largest score."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, users, items, owned = _sides(left, right, specs)
        out = []
        for k, model in enumerate(_models(users, items, specs)):
            if model is None:
                continue
            # equal vectors score alike: one of them stands for all that are not owned
            vecs = np.ascontiguousarray(model.v)
            _, one, of = np.unique(vecs.view(np.dtype((np.void, vecs.itemsize * vecs.shape[1]))).ravel(), return_index=True, return_inverse=True)
            gone = owned.whole(np.where(items.at[k] >= 0, of[items.at[k]], -1), np.bincount(of))
            if isinstance(model, Dot):
                first = -model.length[one]
            elif model.expanded is None:
                first = np.arange(len(one))
            else:  # the lowest and the highest scores
                usual = model.usual()[one]
                first = -np.abs(usual - np.median(usual))
            cols = np.argsort(first, kind="stable")
            model.arrange(one[cols])  # place i holds the vector of class cols[i]
            every = np.flatnonzero(users.at[k] >= 0)
            for rows in _batches({k: model}, users, every, {k}):
                lo, hi = _ends(model, specs[k]["positive"], rows, users.at[k][rows], cols, gone)
                some = np.isfinite(lo)
                out.append(pa.table([users.ids[rows[some]], np.full(some.sum(), k, np.int32), lo[some], hi[some]], schema=ENDS))
        return pa.concat_tables(out) if out else ENDS.empty_table()

    return run


def _ends(model, positive: bool, rows, at, cols, owned: Owned):
    error = model.error[at] + SLACK
    near = None if positive or isinstance(model, Dot) else model.near(at)
    head = HEAD if near is None else min(HEAD, NET_HEAD)
    x = model.block(at, np.arange(len(cols[:head])))
    has = ~owned.block(rows, cols[:head]) & ~np.isnan(x)
    if positive:
        has &= x > 0
    lo, hi = np.where(has, x, np.inf).min(1, initial=np.inf), np.where(has, x, -np.inf).max(1, initial=-np.inf)
    if near is not None:
        return _net_ends(model, near, rows, at, cols, owned, lo, hi, error, head)
    for a in range(HEAD, len(cols), COLUMNS):
        part = cols[a : a + COLUMNS]
        x = model.fast(at, slice(a, a + len(part)))
        top, low = hi - error, lo + error
        # positive scores of vectors without a minus sign are positive in 32 bits, too
        floor = None if not positive else np.zeros(len(rows)) if not model.signed else -error
        with np.errstate(invalid="ignore"):
            if floor is None:
                least = x.min(1)
            elif not model.signed:
                least = (x.view(np.uint32) - np.uint32(1)).min(1).astype(np.uint32)
                least = np.where(least < 0x7F800000, (least + np.uint32(1)).view(np.float32), np.inf)
            else:
                least = np.where(x > floor[:, None], x, np.inf).min(1)
        greatest = x.max(1)
        seen = np.flatnonzero((greatest >= top) | (least <= low) | np.isnan(greatest))
        if not len(seen):
            continue
        y = x[seen]
        want = (y >= top[seen, None]) | (y <= low[seen, None])
        if floor is not None:
            want &= y > floor[seen, None]
        hit = np.flatnonzero(want)
        for b in range(0, len(hit), PAIRS):
            i, c = np.divmod(hit[b : b + PAIRS], len(part))
            i = seen[i]
            new = ~owned.holds(rows[i], part[c])
            i, c = i[new], c[new]
            s = model.pairs(at[i], a + c)
            ok = ~np.isnan(s) & ((s > 0) | (not positive))
            np.minimum.at(lo, i[ok], s[ok])
            np.maximum.at(hi, i[ok], s[ok])
    return lo, hi


def _net_ends(model: Net, near, rows, at, cols, owned: Owned, lo, hi, error, head: int):
    """The rest of ``_ends`` for an expanded network: pairs that the expansion leaves are
    run in 32 bits, then in 64."""
    for a in range(head, len(cols), COLUMNS):
        part = cols[a : a + COLUMNS]
        z, off, rounding = near(np.arange(a, a + len(part)))
        down, up = np.float32(-np.inf), np.float32(np.inf)
        top = np.nextafter((_logit(hi - error) - rounding).astype(np.float32), down)
        low = np.nextafter((_logit(lo + error) + rounding).astype(np.float32), up)
        hit = np.flatnonzero((z + off >= top[:, None]) | (z - off <= low[:, None]))
        i, c = np.divmod(hit, len(part))
        x = model.some(at[i], a + c)
        kept = ~((x < (hi - error)[i]) & (x > (lo + error)[i]))
        i, c = i[kept], c[kept]
        for b in range(0, len(i), PAIRS):
            r, g = i[b : b + PAIRS], c[b : b + PAIRS]
            new = ~owned.holds(rows[r], part[g])
            r, g = r[new], g[new]
            s = model.pairs(at[r], a + g)
            ok = ~np.isnan(s)
            np.minimum.at(lo, r[ok], s[ok])
            np.maximum.at(hi, r[ok], s[ok])
    return lo, hi
