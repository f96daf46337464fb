"""Current document per player from a state store (ST1, V8).

``upsert_players_stream`` keeps the winning document of every player as keyed
state of the stream, in ``GROUPS`` hash groups of players, and hands on only the
players whose document changed; their buckets of the player store (IO4) are the only
ones that a batch rewrites.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lodestar.operators.validate import admit, id_is_hashable
from lodestar.sources.tables import read_store, store_bucket, store_buckets, write_store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_UNORDERED = -(2**63)  # rank of a document without an order field
_STATE = "documents string"  # players, ranks and documents of a group, as JSON
GROUPS = 4096  # of players; a call and a state a group, as a call a player costs far more than the player's work
_CHANGED = "player_id string, doc string"


def _newest_of_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the rows by (task, row) and keep one row a player of each Arrow batch,
    so a player with most of the rows ships one row a batch."""
    pos = TaskContext.get().partitionId() << 33
    for frame in frames:
        frame["pos"] = range(pos, pos + len(frame))
        pos += len(frame)
        yield frame.sort_values(["rank", "pos"]).drop_duplicates("player_id", keep="last")


class _CurrentDocuments(StatefulProcessor):
    """Of each player of a group the document with the greatest rank; a later batch wins
    a tie, in a batch the later row. A document equal to the current one is no change."""

    def init(self, handle) -> None:
        self.current = handle.getValueState("current", _STATE)

    def _held(self) -> dict:
        state = self.current.get()
        return {} if state is None else {p: (r, d) for p, r, d in zip(*json.loads(state[0]))}

    def _keep(self, held: dict) -> None:
        self.current.update((json.dumps([list(held), [r for r, _ in held.values()], [d for _, d in held.values()]]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for frame in rows:
            for player, rank, pos, doc in zip(*(frame[c].tolist() for c in ("player_id", "rank", "pos", "doc"))):
                player = player if isinstance(player, str) else None
                if player not in best or (rank, pos) > best[player][:2]:
                    best[player] = (rank, pos, doc)
        held, players, docs, won = self._held(), [], [], False
        for player, (rank, _, doc) in best.items():
            old = held.get(player)
            if old is not None and old[0] > rank:
                continue
            held[player], won = (rank, doc), True
            if old is None or old[1] != doc:
                players.append(player)
                docs.append(doc)
        if won:
            self._keep(held)
        if players:
            yield pd.DataFrame({"player_id": players, "doc": docs})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        held = self._held()
        for player, rank, doc in zip(*(initialState[c].tolist() for c in ("player_id", "rank", "doc"))):
            held[player if isinstance(player, str) else None] = (rank, doc)
        self._keep(held)

    def close(self) -> None:
        pass


def _rank(doc: str, order: str | None):
    seq = F.get_json_object(doc, order).try_cast("long") if order else F.lit(None).cast("long")
    return F.coalesce(seq, F.lit(_UNORDERED)).alias("rank")


def merge_documents(changed: DataFrame, store: str) -> list[int]:
    """Put changed documents (player_id, doc; one a player) into the player store; lists of
    recommendations stay. Reads and writes only the buckets of these players and returns
    them. Merging the same rows again changes nothing."""
    spark = changed.sparkSession
    n = store_buckets(spark, store)
    touched = sorted(r["b"] for r in changed.select(store_bucket(F.col("player_id"), n).alias("b")).distinct().collect())
    if touched:  # at most the number of buckets
        players, recs = read_store(spark, store, only=touched)
        old = players.select("player_id", "doc", F.lit(0).alias("new"))
        both = old.unionByName(changed.select("player_id", "doc", F.lit(1).alias("new")))
        now = both.groupBy("player_id").agg(F.max_by("doc", "new").alias("doc"))
        write_store(now, recs, store, only=touched)
    return touched


def upsert_players_stream(docs: DataFrame, store: str, checkpoint: str, raw_col: str = "value",
                          order: str | None = None) -> None:
    """ST1, V8: admitted documents (V3) update the player store (IO4), the last write a
    player wins.

    ``order`` is a JSON path of an integer field that orders documents (a document
    without it ranks lowest); ties, and everything by default, go by arrival: batch,
    then position in the batch. The state is in RocksDB under ``checkpoint``, so a
    restart goes on from it; a new checkpoint starts from what the store holds. A batch
    that runs again starts from the state before it, emits the same changes, and merging
    them again changes nothing. NULL is an id like any other; ids that are JSON arrays
    or objects are left out, as in P3."""
    spark = docs.sparkSession
    rows = admit(docs.select(F.col(raw_col).alias("raw")), "raw").where(id_is_hashable("raw"))
    rows = rows.select("player_id", F.col("raw").alias("doc"), _rank("raw", order))
    newest = rows.mapInPandas(_newest_of_batches, "player_id string, doc string, rank long, pos long")
    held = read_store(spark, store)[0].select("player_id", "doc", _rank("doc", order))
    group = store_bucket(F.col("player_id"), GROUPS).alias("grp")
    changed = newest.select(group, "*").groupBy("grp").transformWithStateInPandas(
        statefulProcessor=_CurrentDocuments(), outputStructType=_CHANGED, outputMode="Update", timeMode="None",
        initialState=held.select(group, "*").groupBy("grp"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # the batch is the state's output: read once, then used from the copy
        kept = batch.persist()
        try:
            merge_documents(kept, store)
        finally:
            kept.unpersist()

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        q = (changed.writeStream.foreachBatch(write_batch).outputMode("update")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(_PROVIDER, before)
    q.awaitTermination()
