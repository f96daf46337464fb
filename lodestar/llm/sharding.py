"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks in a region and shards in a rack, each with a
declared weight. A row descends region -> rack -> shard; at each node every
child draws ``-ln(u) / weight`` from a hash of (row key, child) and the
smallest draw wins, so a child wins with probability weight / sum of weights.
A draw depends on the key and on that child alone. Changing one child's weight
therefore moves rows only into or out of that child, and only within the node
that holds it: other subtrees keep all their rows.

New shards are added by ``grown``: one region with one rack and one shard of
unit weight, so one more shard takes rows only into itself and 1 / (n + 1) of
them in the mean, at whatever number of shards the tree stands.

Defined results: a NULL key draws as the text "null"; an empty table gives an
empty result; equal keys always share a shard; repeated rows are all kept and
get slots of their own. Columns of the input that clash with an added name
(``shard``, ``slot``) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DRAW_HEX = 13  # hex digits of a draw: 52 bits, exact in a DOUBLE
SLOT_HEX = 3  # 4096 slot buckets a shard


@dataclass(frozen=True)
class Node:
    """A child: its name in the draws, its weight, and what it holds: the
    children of a region or rack, or the number of a shard."""

    name: str
    weight: float
    holds: tuple["Node", ...] | int


@dataclass(frozen=True)
class Tree:
    regions: tuple[Node, ...]

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> "Tree":
        """Unit weight for each shard; racks and regions weigh what they hold."""
        top, n = [], 0
        for g in range(regions):
            inner = []
            for k in range(racks):
                leaves = tuple(Node(f"{g}/{k}/{s}", 1.0, n + s) for s in range(shards))
                inner.append(Node(f"{g}/{k}", float(shards), leaves))
                n += shards
            top.append(Node(f"{g}", float(racks * shards), tuple(inner)))
        return Tree(tuple(top))

    def shards(self) -> list[int]:
        out: list[int] = []

        def walk(nodes: tuple[Node, ...]) -> None:
            for n in nodes:
                if isinstance(n.holds, int):
                    out.append(n.holds)
                else:
                    walk(n.holds)

        walk(self.regions)
        return out

    def grown(self) -> "Tree":
        """One more shard in a region of its own."""
        g, n = len(self.regions), max(self.shards(), default=-1) + 1
        leaf = Node(f"{g}/0/0", 1.0, n)
        return Tree((*self.regions, Node(f"{g}", 1.0, (Node(f"{g}/0", 1.0, (leaf,)),))))

    def reweighted(self, name: str, weight: float) -> "Tree":
        """The same tree with another declared weight for one node."""

        def walk(nodes: tuple[Node, ...]) -> tuple[Node, ...]:
            return tuple(
                Node(n.name, weight if n.name == name else n.weight, n.holds if isinstance(n.holds, int) else walk(n.holds))
                for n in nodes
            )

        return Tree(walk(self.regions))


def _key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def _draw(key: Column, child: Node, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{child.name}:{seed}"))), 1, DRAW_HEX)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(1)) / F.lit(float(16**DRAW_HEX))
    return -F.log(u) / F.lit(child.weight)


def assign(key: Column, tree: Tree, seed: str = "tree") -> Column:
    """The shard of a key. Only the children on the way down are drawn."""

    def descend(nodes: tuple[Node, ...]) -> Column:
        live = [n for n in nodes if n.weight > 0]
        if not live:
            return F.lit(None).cast("int")
        inner = [F.lit(n.holds) if isinstance(n.holds, int) else descend(n.holds) for n in live]
        if len(live) == 1:
            return inner[0]
        won = F.least(*[F.struct(_draw(_key_text(key), n, seed).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(live)])["i"]
        if all(isinstance(n.holds, int) for n in live):
            return F.element_at(F.array(*inner), won + 1)
        pick = F.when(F.lit(False), F.lit(None).cast("int"))
        for i, sub in enumerate(inner):
            pick = pick.when(won == i, sub)
        return pick

    return descend(tree.regions).cast("int")


def with_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard, in the order of a hash of the
    ``order`` columns. A shard is numbered in 4096 hash buckets: bucket sizes
    are counted first (a partial count per task), their running sums are the
    buckets' first numbers, and rows are ranked within their bucket only, so
    no task orders a whole shard. Rows equal in all ``order`` columns are
    interchangeable."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order]
    rows = df.withColumn("__h", F.md5(F.concat_ws("|", *text))).withColumn("__b", F.substring("__h", 1, SLOT_HEX))
    counts = rows.groupBy(F.col(shard).alias("__s"), F.col("__b").alias("__b2")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__s").orderBy("__b2").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__s", "__b2", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    # ordered by the hash; its source columns follow, so equal hashes are equal rows
    within = Window.partitionBy(shard, "__b").orderBy("__h", *order)
    ranked = rows.withColumn("__r", F.row_number().over(within))
    joined = ranked.join(starts, (F.col(shard) == F.col("__s")) & (F.col("__b") == F.col("__b2")))
    return joined.withColumn(slot, (F.col("__first") + F.col("__r") - 1).cast("long")).drop(
        "__h", "__b", "__s", "__b2", "__first", "__r"
    )


def shard_documents(df: DataFrame, tree: Tree, key: str = "doc_id", order: list[str] | None = None) -> DataFrame:
    """All columns of ``df`` with its ``shard`` and its ``slot`` in the shard."""
    placed = df.drop("shard", "slot").withColumn("shard", assign(F.col(key), tree))
    return with_slots(placed, "shard", order or [key])


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard (``shard=k``), rows of a task sorted by slot."""
    df.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
