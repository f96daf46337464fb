"""Prefix trie of conversations from adaptive radix trees.

A turn is a fixed-width id of ``WIDTH`` bytes, the first bytes of a SHA-256 of
role and text, read big-endian; a conversation is its turns' ids in a row, so
byte order is the order of sequences. Every prefix of whole turns is a node of
the trie.

- Conversations with the same turns become one sequence first. Member ids are
  put together in runs of ``ID_RUN`` neighbouring ids by many tasks; one task
  then only streams a sequence's finished runs, in order, through the digest.
- The sequences are dealt into sorted ranges. A task fills an adaptive radix
  tree with its range: inner nodes grow from 4 to 16, 48 and 256 children, a
  path without forks is kept compressed in its node, and a path that a new key
  leaves midway is split there. Forks may stand at any byte; only depths at a
  whole turn give nodes of the trie, on compressed paths as well.
- A prefix that runs on in a neighbouring range is open. What has to be known of
  it adds up over ranges (members, children, leaves, bytes), if each node counts
  as a new one only in the first range that has it. For that a range needs no more
  than the length of the prefix shared with the range before and after it. Open
  prefixes, at most a path at either end of a range, are merged by a grouping.

So a first turn that a third of all conversations share is spread over ranges,
and a conversation with thousands of copies is one key.

Saved tokens, (n_convs - 1) * bytes summed over a subtree, is the sum of n_convs *
bytes, which adds up over ranges, less the bytes of each node once.

Defined results: NULL role and NULL text are empty; a NULL turn comes first; equal
turns are ordered by role, then text, and repeated rows are kept; rows with NULL
conv_id form one conversation, which counts as a member, is rebuilt from its own
turns alone and has no id to show in conv_id or ends_sha256; an empty table has no
nodes. A conversation is put together in one row. Columns of other names are
not read.
"""

from __future__ import annotations

import hashlib
import sys
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import materialise, release, task_count
from lodestar.operators.joins import maybe_broadcast

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 16
ID_RUN = 4096
RANGE_BYTES = 8 * 1024 * 1024  # of keys a range, beyond the session's number of tasks
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------ radix tree
class Few:
    """Up to ``room`` children (4 or 16): sorted bytes beside a list."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int = 4) -> None:
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, b: int):
        i = bisect_left(self.bytes, b)
        return self.nodes[i] if i < len(self.bytes) and self.bytes[i] == b else None

    def put(self, b: int, node) -> bool:
        """False if there is no room for another byte."""
        i = bisect_left(self.bytes, b)
        if i < len(self.bytes) and self.bytes[i] == b:
            self.nodes[i] = node
        elif len(self.bytes) == self.room:
            return False
        else:
            self.bytes.insert(i, b)
            self.nodes.insert(i, node)
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return zip(self.bytes, self.nodes)

    def grown(self):
        return _filled(Few(16) if self.room == 4 else Indexed(), self)


class Indexed:
    """Up to 48 children: a byte's place in the list, 255 for none."""

    __slots__ = ("place", "nodes")
    room = 48

    def __init__(self) -> None:
        self.place, self.nodes = bytearray(b"\xff" * 256), []

    def get(self, b: int):
        i = self.place[b]
        return None if i == 255 else self.nodes[i]

    def put(self, b: int, node) -> bool:
        i = self.place[b]
        if i != 255:
            self.nodes[i] = node
        elif len(self.nodes) == self.room:
            return False
        else:
            self.place[b] = len(self.nodes)
            self.nodes.append(node)
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return ((b, self.nodes[i]) for b, i in enumerate(self.place) if i != 255)

    def grown(self):
        return _filled(Direct(), self)


class Direct:
    """A place for each of 256 bytes."""

    __slots__ = ("nodes",)
    room = 256

    def __init__(self) -> None:
        self.nodes = [None] * 256

    def get(self, b: int):
        return self.nodes[b]

    def put(self, b: int, node) -> bool:
        self.nodes[b] = node
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


def _filled(layout, old):
    for b, node in old.items():
        layout.put(b, node)
    return layout


class Node:
    """A compressed path, the value of a key that ends with it, children."""

    __slots__ = ("path", "value", "children")

    def __init__(self, path: bytes, value=None) -> None:
        self.path, self.value, self.children = path, value, None

    def child(self, b: int):
        return None if self.children is None else self.children.get(b)

    def put(self, b: int, node: Node) -> None:
        if self.children is None:
            self.children = Few()
        if not self.children.put(b, node):
            self.children = self.children.grown()
            self.children.put(b, node)

    def items(self):
        return () if self.children is None else self.children.items()


def common_length(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] doesn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class RadixTree:
    def __init__(self) -> None:
        self.root: Node | None = None

    def insert(self, key: bytes, value) -> None:
        """``key`` must be new."""
        if self.root is None:
            self.root = Node(key, value)
            return
        node, above, byte, at = self.root, None, 0, 0
        while True:
            m = common_length(node.path, key[at : at + len(node.path)])
            if m < len(node.path):  # split the compressed path
                fork = Node(node.path[:m])
                fork.put(node.path[m], node)
                node.path = node.path[m + 1 :]
                if above is None:
                    self.root = fork
                else:
                    above.put(byte, fork)
                node = fork
            at += m
            if at == len(key):
                node.value = value
                return
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            above, byte, node = node, key[at], below
            at += 1


# --------------------------------------------------------- nodes of a range
class Prefix:
    """What a range knows of one prefix of whole turns."""

    __slots__ = ("depth", "n", "smallest", "children", "leaves", "weighted", "once", "ends", "parent", "key", "open")


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def prefixes(rows: list[tuple], before: int, after: int, width: int = WIDTH) -> list[Prefix]:
    """All prefixes of the sorted ``rows`` (key, bytes of each turn, members,
    smallest member, digest of the members' ids). ``before`` and ``after`` are the
    turns that the first key shares with the range before and the last key with
    the range after (-1: there is none)."""
    tree = RadixTree()
    for i, row in enumerate(rows):
        tree.insert(row[0], i)
    first, last = rows[0][0], rows[-1][0]
    made: list[Prefix] = []

    # post-order without recursion: (node, bytes above it, any key below, results of children)
    def any_key(node: Node) -> int:
        while node.value is None:
            node = next(iter(node.items()))[1]
        return node.value

    def close(node: Node, start: int, sample: int, results: list) -> tuple:
        """Prefixes on the node's path that end behind byte ``start``; what is
        left for the node above: topmost prefixes, sums."""
        end = start + len(node.path)
        key, sizes = rows[sample][0], rows[sample][1]
        n, smallest, leaves, weighted, once, tops, fresh = 0, None, 0, 0, 0, [], 0
        for r in results:
            n += r[0]
            smallest = _smaller(smallest, r[1])
            leaves += r[2]
            weighted += r[3]
            once += r[4]
            tops.extend(r[5])
            fresh += r[6]
        ends = None
        if node.value is not None:
            _, _, members, least, ends = rows[node.value]
            n += members
            smallest = _smaller(smallest, least)
        # byte ``start`` - 1 is the branch that leads here; depth 0 belongs to the root
        above = -1 if start == 0 else (start - 1) // width
        for depth in range(end // width, above, -1):
            cut = depth * width
            on_first = depth <= before and first[:cut] == key[:cut]
            on_last = depth <= after and last[:cut] == key[:cut]
            p = Prefix()
            p.depth, p.n, p.smallest, p.children = depth, n, smallest, fresh
            p.open = on_first or on_last
            size = sizes[depth - 1] if depth else 0
            weighted += n * size
            if not on_first:
                once += size
            goes_on = on_last and len(last) == cut
            if not tops and not goes_on and not on_first:
                leaves += 1
            p.leaves, p.weighted, p.once = leaves, weighted, once
            p.ends = ends if cut == end and node.value is not None else None
            p.parent, p.key = None, sample
            for child in tops:
                child.parent = p
            made.append(p)
            tops, fresh = [p], 0 if on_first else 1
        return n, smallest, leaves, weighted, once, tops, fresh

    stack = [[tree.root, 0, iter(tree.root.items()), []]]
    while True:
        node, start, children, results = stack[-1]
        step = next(children, None)
        if step is not None:
            stack.append([step[1], start + len(node.path) + 1, iter(step[1].items()), []])
            continue
        stack.pop()
        done = close(node, start, any_key(node), results)
        if not stack:
            return made
        stack[-1][3].append(done)


def path_digests(key: bytes, depth: int, width: int = WIDTH) -> list[bytes]:
    """Names of a key's prefixes of 0 to ``depth`` turns."""
    digest = hashlib.blake2b(digest_size=16)
    out = [digest.digest()]
    for i in range(depth):
        digest.update(key[i * width : (i + 1) * width])
        out.append(digest.copy().digest())
    return out


OUT = (
    "open boolean, name binary, parent_name binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, weighted long, once long, ends_sha256 string"
)
_KINDS = [
    pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
]


def _range_rows(rows: list[tuple], before: int, after: int) -> Iterator[tuple]:
    named: dict[int, list[bytes]] = {}

    def name(p: Prefix) -> bytes:
        held = named.get(p.key)
        if held is None:
            held = named[p.key] = path_digests(rows[p.key][0], max(before, after, 0))
        return held[p.depth]

    for p in prefixes(rows, before, after):
        up = p.parent
        named_up = name(up) if up is not None and up.open else None
        known = up.smallest if up is not None and not up.open else None
        yield (p.open, name(p) if p.open else None, named_up, p.smallest, p.depth, known, p.n, p.children, p.leaves, p.weighted, p.once, p.ends)


def _tree_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, key): a tree for each range."""
    names = [f.split()[0] for f in OUT.split(", ")]

    def emit(rows, before, after):
        part = []
        for r in _range_rows(rows, before, after):
            part.append(r)
            if len(part) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), _KINDS)], names)
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), _KINDS)], names)

    held, rows, ends = None, [], (-1, -1)
    for batch in batches:
        for r in zip(*[c.to_pylist() for c in batch.columns]):
            if r[0] != held:
                if rows:
                    yield from emit(rows, *ends)
                held, rows, ends = r[0], [], (r[1], r[2])
            rows.append(r[3:])
    if rows:
        yield from emit(rows, *ends)


def _shared_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*[c.to_pylist() for c in batch.columns]))
        before = [-1 if p is None else common_length(p, a) // WIDTH for _, p, a, _, _ in rows]
        after = [-1 if n is None else common_length(b, n) // WIDTH for _, _, _, b, n in rows]
        ranges = pa.array([r[0] for r in rows], pa.int32())
        yield pa.RecordBatch.from_arrays([ranges, pa.array(before, pa.int64()), pa.array(after, pa.int64())], ["range", "before", "after"])


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (name, run): one row a sequence, ids digested in order."""
    names = ["key", "sizes", "members", "smallest", "ends_sha256"]
    kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    held = None
    out: list[tuple] = []

    def done():
        name, digest, _, key, sizes, members, least = held
        out.append((key, sizes, members, least, digest.hexdigest()))

    for batch in batches:
        for name, _, ids, members, least, key, sizes in zip(*[c.to_pylist() for c in batch.columns]):
            if held is None or held[0] != name:
                if held is not None:
                    done()
                held = [name, hashlib.sha256(), False, key, sizes, 0, None]
            if ids:
                held[1].update(("," + ids if held[2] else ids).encode())
                held[2] = True
            held[5] += members
            held[6] = _smaller(held[6], least)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out = []
    if held is not None:
        done()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


# ------------------------------------------------------------- data frames
def turn_lists(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, turns: array of (id as hex, bytes of the text) in order."""
    rows = df.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).isNotNull().alias("has"),
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    named = F.sha2(F.concat(F.octet_length("t.role").cast("string"), F.lit(":"), F.col("t.role"), F.col("t.text")), 256)
    rows = rows.select(
        "conv_id",
        F.struct(
            "t.*",
            F.upper(F.substring(named, 1, 2 * WIDTH)).alias("id"),
            F.octet_length("t.text").cast("long").alias("size"),
        ).alias("t"),
    )
    sorted_turns = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(sorted_turns.alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns")
    )


def rebuilt(conversations: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """conv_id, turns: the first ``head`` turns of conversation ``base``, then the
    own turns after the first ``head``. No head exceeds ``most``."""
    own = conversations.withColumn("base", base).withColumn("head", F.coalesce(head, F.lit(0)).cast("int"))
    # a base is fetched from the rows of its group, so both sides share one shuffle
    lead = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, most))).over(Window.partitionBy("base"))
    none = F.array().cast(conversations.schema["turns"].dataType)
    given = own.withColumn("lead", F.coalesce(lead, none))
    rest = F.when(F.size("turns") > F.col("head"), F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return given.select("conv_id", F.concat(F.slice("lead", 1, F.col("head")), F.coalesce(rest, none)).alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """Distinct turn sequences: key, sizes (bytes of each turn's text), members,
    smallest (member id), ends_sha256 (ids in order, comma-joined)."""
    keyed = conversations.select(
        "conv_id",
        F.floor(F.col("conv_id") / ID_RUN).alias("run"),
        F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    ).withColumn("name", F.unhex(F.sha2("key", 256)))
    # a run holds at most ID_RUN ids of a sequence
    runs = keyed.groupBy("name", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"),
        F.count(F.lit(1)).alias("members"),
        F.min("conv_id").alias("least"),
        F.first("key").alias("key"),
        F.first("sizes").alias("sizes"),
    )
    ordered = runs.repartition("name").sortWithinPartitions("name", F.col("run").asc_nulls_first())
    streamed = ordered.select("name", "run", "ids", "members", "least", "key", "sizes")
    return streamed.mapInArrow(
        _digest_runs, "key binary, sizes array<long>, members long, smallest long, ends_sha256 string"
    )


def trie(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 of every node; ``conversations`` has conv_id
    and turns (see ``turn_lists``), one row a conversation."""
    spark = conversations.sparkSession
    distinct = materialise(sequences(conversations), "trie-distinct")
    if ranges is None:
        held = distinct.agg(F.sum(F.octet_length("key") + F.lit(64))).first()[0] or 0
        ranges = max(task_count(spark), held // RANGE_BYTES)
    dealt = distinct.repartitionByRange(ranges, "key")
    stored = materialise(dealt.withColumn("range", F.spark_partition_id()), "trie-sequences")
    ends = stored.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    # one row a range
    order = Window.orderBy("range")
    edges = ends.select("range", F.lag("high").over(order).alias("p"), "low", "high", F.lead("low").over(order).alias("n"))
    shared = edges.mapInArrow(_shared_turns, "range int, before long, after long")
    ready = stored.join(maybe_broadcast(shared), "range").select(
        "range", "before", "after", "key", "sizes", "members", "smallest", "ends_sha256"
    )
    ready = ready.repartition(ranges, "range").sortWithinPartitions("range", "key")
    found = materialise(ready.mapInArrow(_tree_task, OUT), "trie-prefixes")
    merged = found.where("open").groupBy("name").agg(
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.first("parent_name", True).alias("parent_name"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("weighted").alias("weighted"),
        F.sum("once").alias("once"),
        F.max("ends_sha256").alias("ends_sha256"),
    )
    merged = materialise(merged, "trie-open")
    up = maybe_broadcast(merged.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("up_id")))
    columns = ["parent_name", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "weighted", "once", "ends_sha256"]
    closed = found.where("not open").select(*columns, "parent_conv_id")
    below = merged.select(*columns, F.lit(None).cast("long").alias("parent_conv_id")).unionByName(closed)
    # only prefixes right under an open one, and open ones, look their parent up
    looked = below.where(F.col("parent_name").isNotNull()).join(up, "parent_name").withColumn("parent_conv_id", F.col("up_id"))
    done = looked.drop("up_id").unionByName(below.where(F.col("parent_name").isNull()))
    release(distinct, stored)
    return done.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("weighted") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
