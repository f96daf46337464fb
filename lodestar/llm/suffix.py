"""Removal of byte strings of ``LENGTH`` bytes that also start earlier.

The classes of equal ``LENGTH``-byte suffix prefixes are found by sampling and
induction, with sorted runs on disk in place of a suffix array in memory:

1. Sample. Of the 44-byte grams in a window of 100 bytes the one with the
   smallest hash is the window's anchor, a choice that depends on the window's
   bytes only, so equal windows have equal anchors at equal places. An anchor
   owns a run of window starts; about one position in 29 is an anchor. The
   name of an anchor is a hash of all bytes its windows cover and of its place in
   them; names are compared only where the grams' hashes agree.
2. Names. Blocks of documents sort their anchors by name; the sorted runs go
   through Spark's shuffle (on disk, merged by key range), where anchors with the
   same gram meet. If an equal name starts earlier, all windows of the anchor
   do: their common prefix is known from the name, and they are induced without
   being looked at.
3. Recursion. Only first anchors of their name, whose gram also has another
   name, are left: their windows agree around the gram but not throughout. Each
   of their windows is named by itself (96-bit hash of its 100 bytes) and sorted
   the same way; all but the earliest window of a name are covered.

Every key is first reduced within its block to the earliest occurrence, so a
name shared by a third of all documents sends one row a block. Blocks hold a
bounded number of bytes, parts of the shuffle grow in number with the input, and
documents meet their intervals in a stream sorted by part, so no task holds more
than one block or part.

Defined results: NULL and empty texts have no bytes; rows equal in id and text
are the same document and get the same result; rows with one id but different
texts are ordered by a digest of the text; NULL ids come after all others; texts
of fewer than ``LENGTH`` bytes lose nothing; an empty table gives an empty
result. Columns of other names are not read.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 100
GRAM = 44
SEGMENT = 1 << 18  # window starts handled at a time
BLOCK_BYTES = 8 << 20  # text sorted at a time
PART_BYTES = 24 << 20  # text whose anchors make one part of the shuffle
NO_ID = np.iinfo(np.int64).max

NAMES, MARKS, WINDOWS, COVERED, OPEN = range(5)  # kinds of packed rows
ANCHOR = [("g", "<u4"), ("name", "<u8"), ("id", "<i8"), ("dig", "<u4"), ("lo", "<u4"), ("len", "<u1")]
MARK = [("g", "<u4")]
WINDOW = [("h1", "<u8"), ("h2", "<u4"), ("id", "<i8"), ("dig", "<u4"), ("lo", "<u4")]
SPAN = [("id", "<i8"), ("dig", "<u4"), ("lo", "<u4"), ("hi", "<u4")]
COLUMNS = {NAMES: ANCHOR, MARKS: MARK, WINDOWS: WINDOW, COVERED: SPAN, OPEN: SPAN}
STEPPED = {"id", "lo"}  # stored as differences, which shrink well
PACKED = "part int, kind int, payload binary"


def pack(kind: int, cols: dict[str, np.ndarray], rows) -> bytes:
    """The chosen rows, column after column, compressed (sorted ids shrink well)."""
    chosen = {c: np.ascontiguousarray(cols[c][rows], t) for c, t in COLUMNS[kind]}
    for c in STEPPED & chosen.keys():
        chosen[c] = np.diff(chosen[c], prepend=chosen[c].dtype.type(0))
    raw = b"".join(chosen[c].tobytes() for c, _ in COLUMNS[kind])
    return struct.pack("<Q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def unpack(kind: int, payloads: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {c: [] for c, _ in COLUMNS[kind]}
    width = sum(np.dtype(t).itemsize for _, t in COLUMNS[kind])
    for p in payloads:
        size = struct.unpack("<Q", p[:8])[0]
        raw = pa.decompress(p[8:], size, "zstd", asbytes=True)
        n, at = size // width, 0
        for c, t in COLUMNS[kind]:
            x = np.frombuffer(raw, t, n, at)
            parts[c].append(np.cumsum(x, dtype=t) if c in STEPPED else x)
            at += n * np.dtype(t).itemsize
    return {c: np.concatenate(parts[c]) if parts[c] else np.empty(0, t) for c, t in COLUMNS[kind]}


def packed_by(kind: int, cols: dict[str, np.ndarray], part: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One packed row for each part that has rows."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    ends = np.flatnonzero(np.diff(part[order])) + 1
    for s, e in zip([0, *ends], [*ends, len(order)]):
        yield int(part[order[s]]), kind, pack(kind, cols, order[s:e])


def to_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    p, k, b = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(b, pa.binary())], ["part", "kind", "payload"])


def document_part(doc_id: int, parts: int) -> int:
    """As the JVM side computes it: crc32 of the id as text."""
    return zlib.crc32(b"null" if doc_id == NO_ID else str(doc_id).encode()) % parts


class Hasher:
    """Hashes of substrings as differences of running sums modulo 2^64."""

    def __init__(self, size: int) -> None:
        rng = np.random.default_rng(61)
        self.tables = [rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
        self.powers, self.inverses = [], []
        for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            for value, into in ((base, self.powers), (pow(base, -1, 2**64), self.inverses)):
                p = np.full(size + 1, np.uint64(value), np.uint64)
                p[0] = 1
                into.append(np.multiply.accumulate(p))

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.tables[which][data] * self.powers[which][: len(data)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
        return mixed((sums[hi] - sums[lo]) * self.inverses[which][lo])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, ends: np.ndarray, hasher: Hasher) -> dict[str, np.ndarray]:
    """Anchors of the documents laid end to end in ``data``: first and last
    owned window start (lo, hi), hash of the gram (g) and name."""
    found: list[tuple] = []
    span = LENGTH - GRAM + 1
    starts = len(data) - LENGTH + 1
    for s in range(0, max(starts, 0), SEGMENT):
        part = data[s : s + SEGMENT + LENGTH - 1]
        n = len(part) - LENGTH + 1
        if n <= 0:
            break
        valid = np.ones(n, bool)
        for e in ends[np.searchsorted(ends, s, "right") : np.searchsorted(ends, s + len(part), "right")]:
            valid[max(0, e - LENGTH + 1 - s) : max(0, min(e - s, n))] = False
        s1 = hasher.sums(part, 0)
        at = np.arange(len(part) - GRAM + 1)
        gram = mixed((s1[GRAM:] - s1[: len(s1) - GRAM]) * hasher.inverses[0][: len(at)])
        order = (mixed(gram) >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
        owner = (sliding_min(order, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        p = np.flatnonzero(valid)
        if not len(p):
            continue
        own = owner[p]
        new = np.ones(len(p), bool)
        new[1:] = (own[1:] != own[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(new)
        lo, hi, a = p[first], p[np.append(first[1:], len(p)) - 1], own[first]
        s2 = hasher.sums(part, 1)  # independent of the gram's hash
        place = ((a - lo) * 1000 + (hi - lo)).astype(np.uint64)
        name = mixed(hasher.between(s2, lo, hi + LENGTH, 1) + place * np.uint64(0xA24BAED4963EE407))
        found.append((lo + s, hi + s, gram[a], name))
    cols = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, t) for t in ("i8", "i8", "u8", "u8")]
    return dict(zip(("lo", "hi", "g", "name"), cols))


def window_names(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, hasher: Hasher) -> Iterator[tuple]:
    """(number of the anchor, window start, h1, h2) of all windows from lo to hi."""
    size = hi - lo + LENGTH
    upto = np.cumsum(size)
    first = 0
    while first < len(lo):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] - size[first] + SEGMENT, "right")))
        each = size[first:last]
        offset = np.cumsum(each) - each
        at = np.arange(int(each.sum())) - np.repeat(offset, each)
        text = data[np.repeat(lo[first:last], each) + at]
        keep = at < np.repeat(each - LENGTH + 1, each)  # window starts
        p = np.flatnonzero(keep)
        who = np.repeat(np.arange(first, last), each)[p]
        s1, s2 = hasher.sums(text, 0), hasher.sums(text, 1)
        h1 = hasher.between(s1, p, p + LENGTH, 0)
        h2 = (hasher.between(s2, p, p + LENGTH, 1) >> np.uint64(32)).astype(np.uint32)
        yield who, lo[who] + at[p], h1, h2
        first = last


def changes(*keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in some key."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals [lo, hi) of each document number."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    base = doc.astype(np.int64) << 33
    reach = np.maximum.accumulate(base + hi)
    new = np.ones(len(doc), bool)
    new[1:] = base[1:] + lo[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], reach[last] - base[last]


def later_windows(cols: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the earliest window of each name, and of the others. The same
    window of a repeated row is neither."""
    order = np.lexsort((cols["lo"], cols["dig"], cols["id"], cols["h2"], cols["h1"]))
    new = changes(cols["h1"][order], cols["h2"][order])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    other = (cols["id"][order] != cols["id"][lead]) | (cols["dig"][order] != cols["dig"][lead]) | (cols["lo"][order] != cols["lo"][lead])
    return order[new], order[other]


class Windows:
    """Windows gathered up to a bound, then reduced to the earliest of each name."""

    def __init__(self, parts: int) -> None:
        self.parts, self.held, self.rows = parts, [], 0

    def add(self, ids, digs, lo, h1, h2) -> None:
        self.held.append((h1, h2, ids, digs, lo))
        self.rows += len(lo)

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        if self.held:
            cols = dict(zip(("h1", "h2", "id", "dig", "lo"), (np.concatenate(x) for x in zip(*self.held))))
            first, other = later_windows(cols)
            kept = {c: v[np.sort(first)] for c, v in cols.items()}
            yield from packed_by(WINDOWS, kept, (kept["h1"] % np.uint64(self.parts)).astype(np.int64))
            yield from packed_spans(COVERED, cols["id"][other], cols["dig"][other], cols["lo"][other], cols["lo"][other].astype(np.int64) + LENGTH, self.parts)
        self.held, self.rows = [], 0


def packed_spans(kind: int, ids, digs, lo, hi, parts: int) -> Iterator[tuple[int, int, bytes]]:
    if not len(ids):
        return
    order = np.lexsort((digs, ids))
    new = changes(ids[order], digs[order])
    doc_ids, doc_digs = ids[order][new], digs[order][new]
    number = np.empty(len(ids), np.int64)
    number[order] = np.cumsum(new) - 1
    if kind == COVERED:
        number, lo, hi = merged(number, lo, hi)
    at = np.array([document_part(int(i), parts) for i in doc_ids], np.int64)
    yield from packed_by(kind, {"id": doc_ids[number], "dig": doc_digs[number], "lo": lo, "hi": hi}, at[number])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and UTF-8 texts of at most BLOCK_BYTES, or of one longer document."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1)):
            data = t.as_buffer()
            data = b"" if data is None else data.to_pybytes()
            if texts and size + len(data) > BLOCK_BYTES:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
            ids.append(NO_ID if i.as_py() is None else i.as_py())
            texts.append(data)
            size += len(data)
    if texts:
        yield np.array(ids, np.int64), texts


def block_names(ids: np.ndarray, texts: list[bytes], hasher: Hasher, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Steps 1 and 2 of one block: packed names, and what its own anchors decide."""
    digs = np.array([xxhash.xxh32_intdigest(t) for t in texts], np.uint32)
    order = np.lexsort((digs, ids))
    order = order[changes(ids[order], digs[order])]  # repeated rows once
    ids, digs, texts = ids[order], digs[order], [texts[i] for i in order]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - np.array([len(t) for t in texts])
    a = anchors(data, ends, hasher)
    if not len(a["lo"]):
        return
    doc = np.searchsorted(ends, a["lo"], "right")  # in the order of (id, digest)
    order = np.lexsort((a["lo"], a["name"], a["g"]))
    new = changes(a["g"][order], a["name"][order])
    covered = [(doc[order[~new]], a["lo"][order[~new]], a["hi"][order[~new]] + LENGTH)]
    first = order[new]
    g = a["g"][first]
    same = ~changes(g)
    many = same | np.append(same[1:], False)
    lone, open_ = np.sort(first[~many]), np.sort(first[many])
    cols = {
        "g": a["g"][lone] >> np.uint64(32),
        "name": a["name"][lone],
        "id": ids[doc[lone]],
        "dig": digs[doc[lone]],
        "lo": a["lo"][lone] - begins[doc[lone]],
        "len": a["hi"][lone] - a["lo"][lone],
    }
    yield from packed_by(NAMES, cols, (a["g"][lone] % np.uint64(parts)).astype(np.int64))
    marks = np.unique(g[many])
    yield from packed_by(MARKS, {"g": marks >> np.uint64(32)}, (marks % np.uint64(parts)).astype(np.int64))
    held = Windows(parts)
    for who, at, h1, h2 in window_names(data, a["lo"][open_], a["hi"][open_], hasher):
        d = doc[open_][who]
        held.add(ids[d], digs[d], (at - begins[d]).astype(np.uint32), h1, h2)
    yield from held.flush()
    d, lo, hi = (np.concatenate(x) for x in zip(*covered))
    yield from packed_spans(COVERED, ids[d], digs[d], lo - begins[d], hi - begins[d], parts)


def resolve_names(rows: dict[int, list[bytes]], parts: int) -> Iterator[tuple[int, int, bytes]]:
    """One part of the shuffle by gram: covered anchors, and those left open."""
    a, marks = unpack(NAMES, rows.get(NAMES, [])), np.unique(unpack(MARKS, rows.get(MARKS, []))["g"])
    if not len(a["g"]):
        return
    order = np.lexsort((a["lo"], a["dig"], a["id"], a["name"], a["g"]))
    a = {c: v[order] for c, v in a.items()}
    new_g = changes(a["g"])
    new = new_g | changes(a["name"])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    other = (a["id"] != a["id"][lead]) | (a["dig"] != a["dig"][lead]) | (a["lo"] != a["lo"][lead])
    hi = a["lo"].astype(np.int64) + a["len"]
    yield from packed_spans(COVERED, a["id"][other], a["dig"][other], a["lo"][other], hi[other] + LENGTH, parts)
    group = np.cumsum(new_g) - 1
    names = np.bincount(group, new)
    open_ = new & ((names[group] > 1) | np.isin(a["g"], marks))
    yield from packed_spans(OPEN, a["id"][open_], a["dig"][open_], a["lo"][open_], hi[open_], parts)


def by_document(cols: dict[str, np.ndarray]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    order = np.lexsort((cols["lo"], cols["dig"], cols["id"]))
    ends = np.append(np.flatnonzero(changes(cols["id"][order], cols["dig"][order]))[1:], len(order)) if len(order) else []
    out, s = {}, 0
    for e in ends:
        i = order[s:e]
        out[int(cols["id"][i[0]]), int(cols["dig"][i[0]])] = (cols["lo"][i].astype(np.int64), cols["hi"][i].astype(np.int64))
        s = e
    return out


def stream_with_spans(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[tuple[int | None, bytes, tuple | None]]:
    """Documents of a partition sorted by (part, kind), spans first: (id, text,
    the spans of the document or None, whether there was a text)."""
    part, payloads, spans = None, [], None
    for batch in batches:
        for p, k, b, i, t in zip(*[batch.column(c) for c in ("part", "kind", "payload", "id", "text")]):
            if p.as_py() != part:
                part, payloads, spans = p.as_py(), [], None
            if k.as_py() < 9:
                payloads.append(b.as_py())
                continue
            if spans is None:
                spans, payloads = by_document(unpack(kind, payloads)), []
            buf = t.as_buffer()
            data = b"" if buf is None else buf.to_pybytes()
            doc_id = i.as_py()
            found = spans.get((NO_ID if doc_id is None else doc_id, xxhash.xxh32_intdigest(data))) if spans else None
            yield doc_id, data, found


def _by_part(packed: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """Packed rows and documents of a part in one partition, packed rows first."""
    text = docs.select(
        F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("null")).cast("binary")), F.lit(parts)).cast("int").alias("part"),
        F.lit(9).alias("kind"),
        F.lit(None).cast("binary").alias("payload"),
        "id",
        "text",
    )
    rows = packed.select("part", "kind", "payload", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"))
    return rows.unionByName(text).repartition(parts, "part").sortWithinPartitions("part", "kind")


def _groups(packed: DataFrame, fn, parts: int) -> DataFrame:
    """Apply ``fn`` to the packed rows of each part in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, {}

        def done():
            with np.errstate(over="ignore"):
                return to_batch(list(fn(rows))) if rows else None

        for batch in batches:
            for p, k, b in zip(*[batch.column(c) for c in range(3)]):
                if p.as_py() != part:
                    if (out := done()) is not None:
                        yield out
                    part, rows = p.as_py(), {}
                rows.setdefault(k.as_py(), []).append(b.as_py())
        if (out := done()) is not None:
            yield out

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, PACKED)


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType()),
    ]
)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs, byte offsets) and kept (the
    remaining bytes; a run may cut a character, so they are not a string)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    bound = SEGMENT + 2 * LENGTH

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bound)
        with np.errstate(over="ignore"):
            for ids, texts in blocks(batches):
                yield to_batch(list(block_names(ids, texts, hasher, parts)))

    def names(rows: dict[int, list[bytes]]) -> Iterator[tuple[int, int, bytes]]:
        for kind in (WINDOWS, COVERED):  # of single blocks: passed on
            for b in rows.get(kind, []):
                yield row_part(kind, b), kind, b
        yield from resolve_names(rows, parts)

    def row_part(kind: int, payload: bytes) -> int:
        cols = unpack(kind, [payload])
        return int(cols["h1"][0] % np.uint64(parts)) if kind == WINDOWS else document_part(int(cols["id"][0]), parts)

    first = materialise(_groups(slim.mapInArrow(sample, PACKED), names, parts), "suffix-names")

    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = Hasher(bound), Windows(parts)
        with np.errstate(over="ignore"):
            for doc, data, found in stream_with_spans(batches, OPEN):
                if found is None:
                    continue
                ids, dig = np.int64(NO_ID if doc is None else doc), np.uint32(xxhash.xxh32_intdigest(data))
                for _, at, h1, h2 in window_names(np.frombuffer(data, np.uint8), found[0], found[1], hasher):
                    held.add(np.full(len(at), ids), np.full(len(at), dig), at.astype(np.uint32), h1, h2)
                if held.rows > 1 << 20:
                    yield to_batch(list(held.flush()))
            yield to_batch(list(held.flush()))

    left = first.where(F.col("kind") == OPEN)
    again = materialise(_by_part(left, slim, parts).mapInArrow(open_windows, PACKED), "suffix-windows")

    def windows(rows: dict[int, list[bytes]]) -> Iterator[tuple[int, int, bytes]]:
        cols = unpack(WINDOWS, rows.get(WINDOWS, []))
        _, other = later_windows(cols)
        lo = cols["lo"][other].astype(np.int64)
        yield from packed_spans(COVERED, cols["id"][other], cols["dig"][other], lo, lo + LENGTH, parts)

    named = first.where(F.col("kind") == WINDOWS).unionByName(again.where(F.col("kind") == WINDOWS))
    covered = (
        first.where(F.col("kind") == COVERED)
        .unionByName(again.where(F.col("kind") == COVERED))
        .unionByName(_groups(named, windows, parts))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=pa_schema)

        pa_schema = pa.schema(
            [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
        )
        for doc, data, found in stream_with_spans(batches, COVERED):
            spans, kept, at = [], [], 0
            if found is not None:
                _, lo, hi = merged(np.zeros(len(found[0]), np.int64), *found)
                for s, e in zip(lo.tolist(), hi.tolist()):
                    kept.append(data[at:s])
                    spans.append({"start": s, "end": e})
                    at = e
            kept.append(data[at:])
            rows.append({"doc_id": doc, "n_bytes": len(data), "spans": spans, "kept": b"".join(kept)})
            size += len(data)
            if size > 4 << 20:
                yield batch()
                rows, size = [], 0
        yield batch()

    return _by_part(covered, slim, parts).mapInArrow(cut, RESULT)


