"""Benchmark decontamination by a prefix-filtered set join.

Words are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
in lower case. An item is cut into windows of ``window`` consecutive words; an
item of fewer words, but not none, is one window. A window occurs in a document
if all its words do, at consecutive places.

The join asks for full containment, so of a window's words, ordered by how
rare they are in the corpus, the shortest necessary prefix is one word: a
document without the rarest word can't hold the window. Documents therefore
meet a window only at places of its rarest word. The place of that word in the
window gives the one start that is possible there; starts before the text or
with too few words left are dropped (positional and length bound), and the
rest are verified word for word.

Rarity is counted over all documents. Up to ``MAX_INDEX_BYTES`` of benchmark
text the windows are sent to every task, which scans whole documents with
bounded memory. A larger benchmark is joined with a shuffle on the rarest word
(``shuffled_hits``); both ways give the same rows.

Defined results: a NULL or wordless text has 0 words and no hit; a NULL or
wordless item has no window; a NULL item id counts as the id "null"; repeated
items count once by id; an empty benchmark hits nothing; repeated documents
each give a row. Columns of the input come back inside ``row``, so their names
can't clash with the added ones.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
# Benchmark text up to this size is indexed in every task (about 43 times the
# bytes in memory, 13 times when sent); beyond it windows and documents meet in a shuffle.
MAX_INDEX_BYTES = 2 * 1024 * 1024

# Bytes outside words become spaces, A-Z become a-z.
_KEEP = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256)
)
WORD_PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


def windows_of(words: list, window: int) -> list[list]:
    if not words:
        return []
    return [words[i : i + window] for i in range(max(1, len(words) - window + 1))]


def build_index(items: list[tuple[str, str | None]], counts: dict[bytes, int], window: int) -> dict:
    """rarest word -> (its place, window length) -> window -> numbers of items."""
    index: dict = {}
    for number, (_, text) in enumerate(items):
        for w in windows_of(words_of(text), window):
            _, _, place = min((counts.get(x, 0), x, i) for i, x in enumerate(w))
            table = index.setdefault(w[place], {}).setdefault((place, len(w)), {})
            held = table.setdefault(b" ".join(w), [])
            if not held or held[-1] != number:
                held.append(number)
    return index


def find_hits(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[int]]:
    """Spans (start, length) of windows in a document, and their items."""
    n, spans, found = len(words), [], set()
    for i in [i for i, w in enumerate(words) if w in index]:
        for (place, length), table in index[words[i]].items():
            s = i - place
            if s < 0 or s + length > n:
                continue
            held = table.get(b" ".join(words[s : s + length]))
            if held:
                spans.append((s, length))
                found.update(held)
    return spans, found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, length in sorted(spans):
        if out and s <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s + length - out[-1][0]))
        else:
            out.append((s, length))
    return out


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])


def _result_schema(row: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("row", row),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("item_ids", T.ArrayType(T.StringType())),
            T.StructField("spans", T.ArrayType(SPAN)),
        ]
    )


def word_counts(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Occurrences of the benchmark's words in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for t in batch.column(0):
                for w in words_of(t.as_py()):
                    if w in total:
                        total[w] += 1
        seen = [(w, n) for w, n in total.items() if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in seen], pa.binary()), pa.array([n for _, n in seen], pa.int64())], ["word", "n"]
        )

    parts = docs.select(F.col(text).alias("t")).mapInArrow(count, "word binary, n long")
    # as many rows as the benchmark has words, whose bytes are bounded
    return {bytes(r["word"]): r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def flag_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    carry: list[str] | None = None,
    max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """Per document: ``row`` (its ``carry`` columns, all by default), n_words,
    n_hit, item_ids (of the items that occur, sorted) and spans (merged runs
    of hit words: first word and length)."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("id")), F.lit(0))).first()[0]
    carry = list(dict.fromkeys(docs.columns if carry is None else carry))
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text).alias("t"))
    if size > max_index_bytes:
        return shuffled_hits(slim, items, window)

    rows = [(r["id"], r["t"]) for r in items.collect()]
    vocabulary = frozenset(w for _, t in rows for w in words_of(t))
    counts = word_counts(docs, text, vocabulary) if vocabulary else {}
    ids = [i for i, _ in rows]
    shared = docs.sparkSession.sparkContext.broadcast((ids, build_index(rows, counts, window)))
    schema = _result_schema(slim.schema["row"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, index = shared.value
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            n_words, n_hit, item_ids, spans = [], [], [], []
            for t in batch.column(1):
                words = words_of(t.as_py())
                raw, found = find_hits(words, index) if index else ([], set())
                merged = merge_spans(raw)
                n_words.append(len(words))
                n_hit.append(sum(length for _, length in merged))
                item_ids.append(sorted({ids[k] for k in found}))
                spans.append([{"start": s, "length": length} for s, length in merged])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(item_ids, pa.list_(pa.string())),
                    pa.array(spans, span_type),
                ],
                ["row", "n_words", "n_hit", "item_ids", "spans"],
            )

    return slim.mapInArrow(scan, schema)


def _words_column(c):
    from lodestar.llm.common import ascii_lower

    return F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD_PATTERN})"), F.lit(1))


def shuffled_hits(slim: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """The same join for a benchmark of any size, with DataFrame operations.
    Only places of a word that is some window's rarest carry their context."""
    keyed = materialise(slim.withColumn("__k", F.monotonically_increasing_id()).withColumn("__w", _words_column(F.col("t"))), "decontam")
    corpus = keyed.select(F.explode("__w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    cut = items.select("id", _words_column(F.col("t")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    win = cut.select("id", F.explode(F.transform(starts, lambda s: F.slice("ws", s, window))).alias("win"))
    win = win.groupBy("win").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    ranked = win.select("win", F.posexplode("win").alias("place", "w")).join(corpus, "w", "left")
    rarest = ranked.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w", "place")).alias("m"))
    table = win.join(rarest, "win").select(F.col("m.w").alias("w"), F.col("m.place").alias("place"), "win", "ids")
    at = keyed.select("__k", F.size("__w").alias("n"), "__w", F.posexplode("__w").alias("i", "w"))
    lo = F.greatest(F.col("i") - (window - 1), F.lit(0))
    # AQE splits the partition of a word that very many places share
    near = at.select("__k", "n", "i", "w", lo.alias("lo"), F.slice("__w", lo + 1, 2 * window - 1).alias("ctx"))
    met = near.join(table, "w").withColumn("s", F.col("i") - F.col("place"))
    hit = met.where(
        (F.col("s") >= 0)
        & (F.col("s") + F.size("win") <= F.col("n"))
        & (F.slice("ctx", F.col("s") - F.col("lo") + 1, F.size("win")) == F.col("win"))
    )
    per_doc = hit.groupBy("__k").agg(
        F.collect_set(F.struct(F.col("s").alias("start"), F.size("win").alias("length"))).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"),
    )

    @F.pandas_udf(T.ArrayType(SPAN))
    def merged(raw):
        return raw.map(
            lambda r: None if r is None else [{"start": s, "length": n} for s, n in merge_spans([(int(x["start"]), int(x["length"])) for x in r])]
        )

    out = keyed.join(per_doc, "__k", "left").withColumn("spans", F.coalesce(merged("raw"), F.array().cast(T.ArrayType(SPAN))))
    return out.select(
        "row",
        F.size("__w").cast("long").alias("n_words"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        "spans",
    )


def contaminated(n_hit="n_hit", n_words="n_words"):
    """The contract's rule: a twentieth of the words or more are hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


