"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def documents(spark, texts, lang="en", source="s", ids=None, schema=DOCS):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, schema)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed: int = 3, n: int = 60) -> list:
    """Prose, copies, near copies, shared passages, NULL, empty and long texts."""
    rng = random.Random(seed)
    out = [None, "", "   \n\t", "one", "one two", "One TWO", "é ÉÉ ß 東京 x"]
    base = [prose(rng, rng.randrange(20, 200)) for _ in range(n)]
    out += base
    out += [base[0], base[0], base[1].upper()]
    for b in base[2:12]:
        words = b.split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    passage = prose(rng, 60)
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(8)]
    out += ["ab" * 400, "a" * 700, "line one is here\n" * 30, prose(rng, 6000)]
    return out


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}
