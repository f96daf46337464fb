"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its distinct words (runs of letters, lower case) and the
words' beginnings of ``PREFIXES`` letters, so that inflected and compounded forms
share evidence. Terms are hashed to 32 bits; no vocabulary is kept. With x_j = 1
for the terms of a text, the machine's logit is

    b + sum_j w_j + 1/2 sum_f [(sum_j v_jf)^2 - sum_j v_jf^2]

The last part holds an interaction for every pair of terms (an insult together
with a group that is mentioned) at the cost of the terms alone. w has an L1
penalty, v an L2 penalty, so the many neutral terms of a long text add nothing.

Fitting: at most about ``MAX_POSITIVE`` + ``MAX_NEGATIVE`` labelled rows take
part (chosen by a hash of the id if there are more; rows weigh as many as they
stand for). Their terms are made in parallel; one task keeps the terms whose
share of label 1 in the sample is off by ``MIN_Z`` standard deviations (with
thousands of rare terms, weaker ones are chance) and fits them with AdaGrad.
Terms that are neutral by themselves, but beside one of these go with a label
that this fit doesn't explain (``partners``), join them for a second fit. It
returns the terms with weight, which bounds the model by the sample. A pair of
which both terms are neutral by themselves isn't looked for. Scoring reads every
whole text once.

Defined results: NULL and empty texts score the intercept; labels that are NULL
are left out, of repeated labels the largest counts; rows with NULL id are
scored and never learned from; repeated rows are scored alike; without labels of
both kinds every score is the share of label 1 (0.5 without any), and near that
share if no term passes the screen, as with a few labels; an empty
table gives an empty result. Columns of other names are not read.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.joins import maybe_broadcast

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_POSITIVE = 6_000
MAX_NEGATIVE = 12_000
PREFIXES = (4, 5, 6)
FACTORS = 4
EPOCHS = 40
BATCH = 256
MIN_ROWS = 3  # rows of the sample that must hold a term
MIN_Z = 4.0  # association of a term with the label, in standard deviations
RATE = 0.2
L1, L2 = 1e-6, 1e-2
_WORDS = re.compile(r"[^\W\d_]+")
_MEMO = 1 << 18


def word_terms(word: str) -> list[int]:
    return [xxhash.xxh32_intdigest(word)] + [
        xxhash.xxh32_intdigest(word[:n], seed=n) for n in PREFIXES if len(word) >= n
    ]


def text_terms(text: str | None, memo: dict[str, list[int]]) -> np.ndarray:
    """Sorted distinct hashed terms of a whole text."""
    out: set[int] = set()
    for w in set(_WORDS.findall((text or "").lower())):
        t = memo.get(w)
        if t is None:
            if len(memo) >= _MEMO:
                memo.clear()
            t = memo[w] = word_terms(w)
        out.update(t)
    return np.array(sorted(out), np.int64)


def partners(flat: np.ndarray, sizes: np.ndarray, label: np.ndarray, chance: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Terms that, beside some anchor, go with a label the anchors don't explain:
    rows with label 1 among those that hold both, against what ``chance`` (label
    1 by the anchors' machine) expects, differ beyond chance for as many pairs."""
    found = np.zeros(len(anchor), bool)
    cut = max(MIN_Z**2, 2 * math.log(max(anchor.sum() * len(anchor), 1)))
    ends = np.cumsum(sizes)
    held = np.flatnonzero(anchor[flat])
    held = held[np.argsort(flat[held], kind="stable")]
    owner = np.searchsorted(ends, held, "right")
    for own in np.split(owner, np.flatnonzero(np.diff(flat[held])) + 1) if len(held) else []:
        near = np.concatenate([flat[ends[i] - sizes[i] : ends[i]] for i in own])
        rows = np.bincount(near, minlength=len(anchor))
        at = np.flatnonzero(rows >= MIN_ROWS)
        rows = rows[at]
        ones = np.bincount(near, np.repeat(label[own], sizes[own]), len(anchor))[at]
        expected = np.bincount(near, np.repeat(chance[own], sizes[own]), len(anchor))[at]
        deviance = np.zeros(len(at))
        for seen, due in ((ones, expected), (rows - ones, rows - expected)):
            deviance += 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, due, 1))
        found[at[deviance >= cut]] = True
    return found


def fit(terms: list[np.ndarray], label: np.ndarray, weight: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """bias, and key / w / v of the terms with weight."""
    total = weight.sum()
    share = float((weight * label).sum() / total) if total else 0.5
    empty = {"bias": np.array([_logit(share)]), "key": np.empty(0, np.int64), "w": np.empty(0, np.float32), "v": np.empty((0, FACTORS), np.float32)}
    if not len(label) or label.min() == label.max():
        return empty
    keys, at, rows = np.unique(np.concatenate(terms), return_inverse=True, return_counts=True)
    hits = np.bincount(at, np.repeat(label, [len(t) for t in terms]), len(keys))
    rate = label.mean()
    z = (hits - rows * rate) / np.sqrt(np.maximum(rows * rate * (1 - rate) * (1 - rows / (len(label) + 1)), 1e-9))
    anchor = (rows >= MIN_ROWS) & (np.abs(z) >= MIN_Z)
    model = _descend(keys[anchor], terms, label, weight, share, seed)
    logit = _logits(model, terms)
    # rows of a label weigh alike; the sample's odds are the population's by the weights' ratio
    logit += math.log(weight[label == 0].mean() / weight[label > 0].mean())
    sizes = np.array([len(t) for t in terms])
    beside = partners(at, sizes, label, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), anchor) & ~anchor
    return _descend(keys[anchor | beside], terms, label, weight, share, seed) if beside.any() else model


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by place; zeros where there is nothing (``bincount`` of
    nothing gives integers)."""
    return np.bincount(at, values, n).astype(float)


def _places(keys: np.ndarray, terms: list[np.ndarray]) -> list[np.ndarray]:
    """The places in ``keys`` of each row's terms."""
    index = [np.searchsorted(keys, t) for t in terms]
    return [i[(i < len(keys)) & (keys[np.minimum(i, max(len(keys) - 1, 0))] == t)] if len(keys) else i[:0] for i, t in zip(index, terms)]


def _logits(model: dict[str, np.ndarray], terms: list[np.ndarray]) -> np.ndarray:
    w, v = model["w"].astype(float), model["v"].astype(float)
    pairs = [0.5 * ((v[i].sum(0) ** 2).sum() - (v[i] ** 2).sum()) + w[i].sum() for i in _places(model["key"], terms)]
    return model["bias"][0] + np.array(pairs)


def _descend(keys: np.ndarray, terms: list[np.ndarray], label: np.ndarray, weight: np.ndarray, share: float, seed: int) -> dict[str, np.ndarray]:
    """AdaGrad over the rows' terms that are in ``keys``; rows without any, and no
    keys at all, move the bias alone."""
    index = _places(keys, terms)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(keys)), rng.normal(0, 0.01, (len(keys), FACTORS))
    gw, gv, gb = np.full(len(keys), 1e-6), np.full((len(keys), FACTORS), 1e-6), 1e-6
    bias, scale = _logit(share), weight / weight.mean()
    for _ in range(EPOCHS):
        order = rng.permutation(len(index))
        for s in range(0, len(order), BATCH):
            batch = order[s : s + BATCH]
            sizes = np.array([len(index[i]) for i in batch])
            flat = np.concatenate([index[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            vs = v[flat]
            total_v = np.stack([_sums(owner, vs[:, f], len(batch)) for f in range(FACTORS)], 1)
            logit = bias + _sums(owner, w[flat], len(batch))
            logit += 0.5 * ((total_v**2).sum(1) - _sums(owner, (vs**2).sum(1), len(batch)))
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[batch]) * scale[batch] / len(batch)
            g = err[owner]
            touched = np.flatnonzero(np.bincount(flat, minlength=len(keys)))
            dw = _sums(flat, g, len(keys))[touched]
            dv = np.stack([_sums(flat, g * (total_v[owner, f] - vs[:, f]), len(keys))[touched] for f in range(FACTORS)], 1)
            dv += L2 * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            step = RATE / np.sqrt(gw[touched])
            moved = w[touched] - step * dw
            w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * L1, 0)
            v[touched] -= RATE * 0.3 / np.sqrt(gv[touched]) * dv
            gb += err.sum() ** 2
            bias -= RATE * err.sum() / math.sqrt(gb)
    used = (np.abs(w) > 1e-4) | (np.abs(v).max(1) > 0.02)
    return {"bias": np.array([bias]), "key": keys[used], "w": w[used].astype(np.float32), "v": v[used].astype(np.float32)}


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


class Scorer:
    def __init__(self, model: dict[str, np.ndarray]) -> None:
        self.bias, self.w, self.v = float(model["bias"][0]), model["w"].astype(float), model["v"].astype(float)
        self.place = {int(k): i for i, k in enumerate(model["key"])}
        self.memo: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        memo, place = self.memo, self.place
        for w in set(_WORDS.findall((text or "").lower())):
            t = memo.get(w)
            if t is None:
                if len(memo) >= _MEMO:
                    memo.clear()
                t = memo[w] = tuple(place[x] for x in word_terms(w) if x in place)
            if t:
                found.update(t)
        if not found:
            logit = self.bias
        else:
            i = np.fromiter(sorted(found), np.int64, len(found))
            vs = self.v[i]
            logit = self.bias + self.w[i].sum() + 0.5 * ((vs.sum(0) ** 2).sum() - (vs**2).sum())
        return 1 / (1 + math.exp(-min(max(logit, -30.0), 30.0)))


def train(labelled: DataFrame, doc_id: str, text: str, label: str, max_positive: int, max_negative: int) -> dict[str, np.ndarray]:
    """Fit on a bounded sample of ``labelled`` (one row a document)."""
    sizes = {bool(r[label]): r["n"] for r in labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    take = {k: min(1.0, bound / max(sizes.get(k, 0), 1)) for k, bound in ((True, max_positive), (False, max_negative))}
    u = F.pmod(F.xxhash64(F.lit("toxicity"), F.col(doc_id)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    positive = F.col(label).cast("boolean")
    sample = labelled.where(u < F.when(positive, take[True]).otherwise(take[False]))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        for batch in batches:
            terms = [text_terms(t.as_py(), memo).astype("<u4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.binary())], ["id", "label", "terms"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, y, t) for b in batches for i, y, t in zip(*[c.to_pylist() for c in b.columns])]
        rows.sort(key=lambda r: r[:2])
        y = np.array([float(r[1]) for r in rows])
        weight = np.where(y > 0, 1 / take[True], 1 / take[False])
        model = fit([np.frombuffer(r[2], "<u4").astype(np.int64) for r in rows], y, weight)
        data = [model["bias"].tobytes(), model["key"].tobytes(), model["w"].tobytes(), model["v"].tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in data], ["bias", "key", "w", "v"])

    slim = sample.select(F.col(doc_id).cast("long").alias("id"), positive.cast("int").alias("label"), F.col(text).alias("t"))
    made = slim.mapInArrow(make, "id long, label int, terms binary")
    # the bounded sample, as hashed terms, in one task; the model is bounded by it
    r = made.repartition(1).mapInArrow(learn, "bias binary, key binary, w binary, v binary").first()
    if r is None:
        return fit([], np.empty(0), np.empty(0))
    return {
        "bias": np.frombuffer(r["bias"]),
        "key": np.frombuffer(r["key"], np.int64),
        "w": np.frombuffer(r["w"], np.float32),
        "v": np.frombuffer(r["v"], np.float32).reshape(-1, FACTORS),
    }


def score(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns, all by default) and score."""
    carry = docs.columns if carry is None else carry
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([slim.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    return slim.mapInArrow(run, schema)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def fit_on_labels(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_positive: int = MAX_POSITIVE,
    max_negative: int = MAX_NEGATIVE,
) -> dict[str, np.ndarray]:
    """The model from the rows that are not held out."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~is_held_out(F.col(doc_id)))
    marks = marks.groupBy(F.col(doc_id).alias("__id")).agg((F.max(label) > 0).alias("__label"))
    rows = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text"))
    joined = rows.join(maybe_broadcast(marks), F.col("__doc") == F.col("__id")).drop("__id")
    return train(joined, "__doc", "__text", "__label", max_positive, max_negative)
