"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct shingles of ``shingle`` words
(``[^\\x20\\x09-\\x0D]+``, A-Z in lower case); with fewer words the whole
sequence is one shingle. Each of ``permutations`` hash functions is evaluated
once per shingle and both its minimum and its maximum are kept, so the
signature has twice as many values as hash evaluations; each value agrees
between two sets with probability equal to their similarity. The values are cut
into bands of ``rows`` values. Documents that agree in a band are candidates,
and a candidate counts only if the full sets, rebuilt from the texts, reach the
threshold. With 126 permutations and bands of 6 there are 42 bands; a pair at
similarity 0.8 is missed with probability (1 - 0.8^6)^42 = 3e-6.

Copies (the same word sequence) are one class from the start; their smallest id
stands for them. Within a bucket no pairs of all members are made:

1. every member is compared with the bucket's hub, the member that meets most
   others over all bands (a star), and links are closed to components;
2. in buckets that then hold several components, the rest (members outside the
   hub's component) is compared with the bucket's members in other components.
   This goes by the hub's component, once for all its buckets and bands: its
   members are cut into blocks of a bounded number of shingles, and the rest
   passes each block as a stream. Set sizes of intersections come from the
   block's sorted shingles; only links leave the task.

Pairs inside a component need no comparison, as they can't change the result,
so the result equals that of comparing all pairs of each bucket, while a bucket
of thousands of near copies costs a comparison a member.

Texts are fetched by a digest of the text, one for each class, so ids may be
repeated or NULL without more work.

Defined results: NULL, empty and blank texts have an empty set and stand alone;
repeated rows are copies of each other; rows with a NULL id can link others but
take the smallest id of their component, NULL if it has none; an empty table
gives an empty result. Extra columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialise, release, task_count
from lodestar.operators.joins import maybe_broadcast

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PERMUTATIONS = 126
ROWS = 6
SEED = 20240117
BLOCK_SHINGLES = 1 << 20  # shingles of a block that the rest of a bucket meets
MAX_ID_BYTES = 8 * 1024 * 1024  # candidate ids up to this size are broadcast
_CHUNK = 1 << 14  # shingles hashed at a time
_MEMO = 1 << 18  # words whose hash a task remembers


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only and bytes.split() cuts at 09-0D and 20 only."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], k: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the document's shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        v = memo.get(w)
        if v is None:
            if len(memo) >= _MEMO:
                memo.clear()
            v = memo[w] = xxhash.xxh64_intdigest(w)
        h[i] = v
    width = min(k, len(words))
    n = len(words) - width + 1
    acc = np.full(n, np.uint64(width), np.uint64)
    for j in range(width):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(acc)


def permutation_constants(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32)


def min_max(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signature of each (non-empty) set: minima, then maxima, of every permutation."""
    m = len(a)
    out = np.empty((len(sets), 2 * m), np.uint32)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= _CHUNK):
            total += len(sets[last])
            last += 1
        group = sets[first:last]
        x = (np.concatenate(group) >> np.uint64(32)).astype(np.uint32)
        if len(group) == 1 and len(x) > _CHUNK:
            lo = np.full(m, 0xFFFFFFFF, np.uint32)
            hi = np.zeros(m, np.uint32)
            for s in range(0, len(x), _CHUNK):
                part = x[s : s + _CHUNK]
                for p in range(m):
                    v = part * a[p] + b[p]
                    lo[p] = min(lo[p], v.min())
                    hi[p] = max(hi[p], v.max())
            out[first, :m], out[first, m:] = lo, hi
        else:
            starts = np.cumsum([0] + [len(s) for s in group[:-1]])
            for p in range(m):
                v = x * a[p] + b[p]
                out[first:last, p] = np.minimum.reduceat(v, starts)
                out[first:last, m + p] = np.maximum.reduceat(v, starts)
        first = last
    return out


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band. Minimum and maximum of a permutation fall into
    different bands, as the minima come first."""
    n, width = signature.shape
    bands = width // rows
    acc = np.zeros((n, bands), np.uint64)
    cut = signature[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    for j in range(rows):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, j] + np.uint64(1))
    return acc.view(np.int64)


def sequence_digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def text_key(text: Column) -> Column:
    """16 bytes that name a text, NULL for none; ids need not be unique."""
    return F.unhex(F.md5(text))


def signatures(
    docs: DataFrame, doc_id: str, text: str, shingle: int, permutations: int, rows: int
) -> DataFrame:
    """doc_id, text_key, n_shingles, seq (digest of the word sequence, NULL if empty), bands."""
    a, b = permutation_constants(permutations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        with np.errstate(over="ignore"):
            for batch in batches:
                for s in range(0, batch.num_rows, 256):
                    ids, keys_, texts = (batch.column(c).slice(s, 256) for c in range(3))
                    sizes, seqs, sets = [], [], []
                    for t in texts:
                        words = words_of(t.as_py())
                        x = shingle_hashes(words, shingle, memo)
                        sizes.append(len(x))
                        seqs.append(sequence_digest(words) if words else None)
                        sets.append(x)
                    full = [x for x in sets if len(x)]
                    signature = min_max(full, a, b) if full else np.empty((0, 2 * len(a)), np.uint32)
                    keys = iter(band_hashes(signature, rows).tolist())
                    bands = [next(keys) if len(x) else None for x in sets]
                    yield pa.RecordBatch.from_arrays(
                        [ids, keys_, pa.array(sizes, pa.int64()), pa.array(seqs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                        ["doc_id", "text_key", "n_shingles", "seq", "bands"],
                    )

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("t"))
    return slim.mapInArrow(run, "doc_id long, text_key binary, n_shingles long, seq binary, bands array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, text: str, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of class representatives whose full sets reach the threshold.

    ``pairs`` has a, b (word-sequence digests) and a_key, b_key (``text_key`` of a
    text with that sequence). One text is fetched a key, however many rows hold it."""
    keys = pairs.select(F.explode(F.array("a_key", "b_key")).alias("__want")).distinct()
    slim = texts_of(docs, keys, text).dropDuplicates(["__key"])
    with_b = pairs.join(slim.withColumnRenamed("__t", "b_text"), F.col("b_key") == F.col("__key")).drop("__key")
    both = with_b.join(slim.withColumnRenamed("__t", "a_text"), F.col("a_key") == F.col("__key")).drop("__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a_set, a_ok = None, frozenset(), False

        def shingles(words: list[bytes]) -> set:
            width = min(shingle, len(words))
            return set(zip(*[words[j:] for j in range(width)]))

        for batch in batches:
            a_out, b_out = [], []
            for a, b, a_text, b_text in zip(*[batch.column(i) for i in range(4)]):
                a, b = a.as_py(), b.as_py()
                text_a = a_text.as_py()
                if (a, text_a) != last:
                    words = words_of(text_a)
                    a_ok, a_set, last = sequence_digest(words) == a, shingles(words), (a, text_a)
                if not a_ok:
                    continue
                words = words_of(b_text.as_py())
                if sequence_digest(words) != b:
                    continue
                b_set = shingles(words)
                common = len(a_set & b_set)
                if 100 * common >= percent * (len(a_set) + len(b_set) - common):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.binary()), pa.array(b_out, pa.binary())], ["a", "b"])

    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a binary, b binary").distinct()


def texts_of(docs: DataFrame, keys: DataFrame, text: str) -> DataFrame:
    """(__key, __t) of the documents with a text key in ``keys`` (__want): only these move on."""
    every = docs.select(F.col(text).alias("__t")).where(F.col("__t").isNotNull()).select(text_key(F.col("__t")).alias("__key"), "__t")
    return every.join(maybe_broadcast(keys, MAX_ID_BYTES), F.col("__key") == F.col("__want"), "left_semi")


def rest_links(open_: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, shingle: int, percent: int) -> DataFrame:
    """Pairs (rank, o_rank) of different components that share a band and whose
    hashed sets reach the threshold. ``open_``: members (rank, n, root) of
    buckets with several components, by the component of the bucket's hub."""
    blocks = open_.groupBy("lead_root").agg(F.ceil(F.sum(F.col("n") + 64) / BLOCK_SHINGLES).cast("int").alias("blocks"))
    rows = open_.join(blocks, "lead_root")
    block = F.pmod(F.xxhash64("rank.seq"), F.col("blocks")).cast("int")
    held = rows.select("lead_root", block.alias("block"), F.lit(0).alias("kind"), "rank", "root")
    # one of the rest meets every block of its hub's component
    rest = rows.where(F.col("root") != F.col("lead_root")).select(
        "lead_root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "rank", "root"
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        with np.errstate(over="ignore"):
            for batch in batches:
                words = [words_of(t.as_py()) for t in batch.column(0)]
                data = [[sequence_digest(w), shingle_hashes(w, shingle, memo).tobytes()] for w in words]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*data)] if data else [pa.array([], pa.binary())] * 2, ["seq", "set"])

    keys = open_.select(F.col("rank.key").alias("__want")).distinct()
    sets = texts_of(docs, keys, text).select("__t").mapInArrow(make, "seq binary, set binary").dropDuplicates(["seq"])
    full = sets.join(nodes.select("seq", "bands"), "seq")
    both = held.unionByName(rest).withColumn("seq", F.col("rank.seq")).join(full, "seq").select(
        "lead_root", "block", "kind", "seq", F.col("rank.key").alias("key"), F.col("root.seq").alias("root"), "bands", "set",
        F.col("lead_root.seq").alias("lead"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, index, found = None, [], None, set()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*found)) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], ["a", "a_key", "b", "b_key"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("lead", "block", "kind", "seq", "key", "root", "bands", "set")]
            for lead, block, kind, seq, key, root, bands, data in zip(*cols):
                if (lead, block) != at:
                    at, members, index = (lead, block), [], None
                hashes = np.frombuffer(data, np.uint64)
                if kind == 0:
                    members.append((seq, key, root, bands, hashes))
                    continue
                if not members:
                    continue
                if index is None:
                    every = np.concatenate([m[4] for m in members])
                    owner = np.repeat(np.arange(len(members)), [len(m[4]) for m in members])
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order], np.array([len(m[4]) for m in members]), np.array([m[3] for m in members])
                sorted_, owner_, sizes, all_bands = index
                lo, hi = np.searchsorted(sorted_, hashes, "left"), np.searchsorted(sorted_, hashes, "right")
                span = hi - lo
                hits = np.repeat(lo - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
                common = np.bincount(owner_[hits], minlength=len(members))
                near = 100 * common >= percent * (len(hashes) + sizes - common)
                near[near] = (all_bands[near] == np.array(bands)).any(axis=1)
                for j in np.flatnonzero(near):
                    other = members[j]
                    if other[2] != root:
                        found.add((seq, key, *other[:2]) if seq < other[0] else (*other[:2], seq, key))
            if len(found) > 10_000:
                yield flush()
                found = set()
        yield flush()

    dealt = both.repartition(task_count(docs.sparkSession), "lead_root", "block").sortWithinPartitions("lead_root", "block", "kind")
    out = dealt.drop("lead_root").mapInArrow(compare, "a binary, a_key binary, b binary, b_key binary")
    return out.select(F.struct(F.col("a_key").alias("key"), F.col("a").alias("seq")).alias("rank"), F.struct(F.col("b_key").alias("key"), F.col("b").alias("seq")).alias("o_rank"))


def _content(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal for equal sets."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


def components(nodes: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """(seq, root): each node's smallest reachable node, ordered by ``rank``.

    ``nodes`` has seq and rank (a struct that orders nodes); ``links`` a, b.
    Rounds of large-star / small-star: every node points to the smallest node
    it knows, halving the distance to the root, until no link changes. Only
    nodes with links take part; each step is aggregation by node."""
    order = nodes.select("seq", "rank")
    ea = links.join(order.withColumnRenamed("seq", "a").withColumnRenamed("rank", "ra"), "a")
    edges = ea.join(order.withColumnRenamed("seq", "b").withColumnRenamed("rank", "rb"), "b")
    # from here on nodes are their ranks, which carry the digest
    e = materialise(edges.select(F.greatest("ra", "rb").alias("u"), F.least("ra", "rb").alias("v")).distinct(), label)
    before = _content(e)
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node are tied to the node's smallest neighbour
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below it are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where(F.col("u") > F.col("v")).distinct()
        new = materialise(small, label)
        after = _content(new)
        release(e)
        e = new
        if after == before:
            break
        before = after
    roots = e.select(F.col("u.seq").alias("seq"), F.col("v").alias("root"))
    return order.join(roots, "seq", "left").select("seq", F.coalesce("root", "rank").alias("root"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    percent: int = 80,
    permutations: int = PERMUTATIONS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key, chosen: one row for each
    row of ``docs``. ``chosen`` marks the rows with the id and text that stand for
    their component (its smallest id, NULL last, then text key)."""
    sig = materialise(signatures(docs, doc_id, text, shingle, permutations, rows), "minhash-signatures")
    # one representative for each word sequence; partial minimum in each task
    nodes = sig.where(F.col("seq").isNotNull()).groupBy("seq").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))).alias("low"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
    )
    nodes = nodes.select("seq", "n", "bands", F.struct("low.none", "low.id", "seq", "low.key").alias("rank"))
    nodes = materialise(nodes, "minhash-classes")
    entries = nodes.select("rank", "n", F.posexplode("bands").alias("band", "key"))
    size = entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    # rows of buckets with two members or more
    member = materialise(entries.join(size, ["band", "key"]), "minhash-buckets")
    meets = member.groupBy("rank").agg(F.sum(F.col("members") - 1).alias("meets"))
    hub = (
        member.join(meets, "rank")
        .groupBy("band", "key")
        .agg(F.min(F.struct((-F.col("meets")).alias("order"), "rank", "n")).alias("hub"))
        .select("band", "key", F.col("hub.rank").alias("lead"), F.col("hub.n").alias("lead_n"))
    )
    member = materialise(member.join(hub, ["band", "key"]), "minhash-hubs")

    def close(n: str, m: str) -> Column:
        """Sets of such sizes can reach the threshold at all."""
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    def links(df: DataFrame, a: str, b: str) -> DataFrame:
        pairs = df.select(
            F.col(f"{a}.seq").alias("a"), F.col(f"{a}.key").alias("a_key"), F.col(f"{b}.seq").alias("b"), F.col(f"{b}.key").alias("b_key")
        )
        pairs = materialise(pairs.distinct(), "minhash-pairs")
        found = materialise(confirmed(pairs, docs, text, shingle, percent), "minhash-links")
        release(pairs)
        return found

    def closed(found: DataFrame) -> DataFrame:
        return materialise(components(nodes, found, "minhash-edges"), "minhash-components")

    def placed() -> DataFrame:
        """Members of buckets that hold several components, with their own."""
        root = comp.select(F.col("seq").alias("__seq"), "root")
        own = member.where(F.col("members") > 2).join(root, F.col("rank.seq") == F.col("__seq")).drop("__seq")
        several = own.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi"))
        return own.join(several.select("band", "key"), ["band", "key"], "left_semi").select("lead", "rank", "n", "root")

    star = member.where((F.col("rank") != F.col("lead")) & close("n", "lead_n"))
    found = links(star, "lead", "rank")
    comp = closed(found)
    lead_root = comp.select(F.col("seq").alias("__seq"), F.col("root").alias("lead_root"))
    open_ = placed().join(lead_root, F.col("lead.seq") == F.col("__seq"))
    open_ = materialise(open_.select("lead_root", "rank", "n", "root").distinct(), "minhash-open")
    more = links(rest_links(open_, nodes, docs, text, shingle, percent), "rank", "o_rank")
    release(open_, member)
    if not more.isEmpty():
        found = found.unionByName(more)
        comp = closed(found)
    roots = comp.select("seq", F.col("root.id").alias("__root"), F.col("root.key").alias("__root_key"))
    alone = F.col("seq").isNull()
    out = sig.select("doc_id", "text_key", "n_shingles", "seq").join(roots, "seq", "left").select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("__root")).alias("component_id"),
        "text_key",
        (alone | (F.col("doc_id").eqNullSafe(F.col("__root")) & (F.col("text_key") == F.col("__root_key")))).alias("chosen"),
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
