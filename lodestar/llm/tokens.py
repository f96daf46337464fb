"""Token-ID output in training order.

Texts become token ids of a public byte-level vocabulary, each text closed by
the end id, and are cut into sequences of ``seq_len`` ids; a text's last
sequence is filled up with the end id. A sequence is one record of exactly
``2 * seq_len`` bytes (ids as unsigned 16-bit little-endian numbers).

Order: the stored sequences are numbered from 0 without gaps (running sums of
file sizes plus the row's place in its file, so no sort and no task with all
rows), and a keyed Feistel network permutes the numbers. Its domain is the next
power of four; a number that falls outside walks the cycle until it is inside,
which keeps the permutation one to one on exactly the sequences there are. A
sequence's image is its global slot: neighbours in training order come from
all over the corpus, and the order can be computed for any slot without a table.

Shards: ranges of ``per_shard`` slots. A range is one partition, sorted by slot
and written as one file of fixed-stride records, so a reader at slot k opens
shard k // per_shard and goes on in order; Spark's commit protocol makes the
write safe against lost tasks.

Defined results: NULL and empty texts are one sequence holding the end id only;
repeated rows are sequences of their own; a NULL id is carried as it is; an
empty table writes no shard. Columns of other names are not read.
"""

from __future__ import annotations

import base64
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import materialise
from lodestar.operators.joins import maybe_broadcast
from lodestar.session import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split pattern this vocabulary was made with (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50256
SEQ_LEN = 512
PER_SHARD = 1 << 16
KEY = 0x1F3A5C7E9B2D4F60
ROUNDS = 6


def _encoder(ranks_file: bytes):
    """The encoding, made once in a worker process."""
    import tiktoken

    held = getattr(tiktoken, "_lodestar_encoding", None)
    if held is None or held[0] != len(ranks_file):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        held = (len(ranks_file), tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
        tiktoken._lodestar_encoding = held
    return held[1]


def sequences(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN, end_id: int = END_ID
) -> DataFrame:
    """doc_id, chunk, n_tokens (with the end id, without filling), tokens."""
    with open(vocabulary, "rb") as f:  # the driver reads the vocabulary, of fixed size
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks.value).encode_ordinary
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                ids, chunks, sizes, records = [], [], [], []
                for i, t in zip(batch.column(0).slice(s, 512), batch.column(1).slice(s, 512)):
                    tokens = np.array(encode(t.as_py() or "") + [end_id], "<u2")
                    for c in range(0, len(tokens), seq_len):
                        part = tokens[c : c + seq_len]
                        ids.append(i.as_py())
                        chunks.append(c // seq_len)
                        sizes.append(len(part))
                        if len(part) < seq_len:
                            part = np.concatenate([part, np.full(seq_len - len(part), end_id, "<u2")])
                        records.append(part.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(chunks, pa.int32()), pa.array(sizes, pa.int32()), pa.array(records, pa.binary())],
                    ["doc_id", "chunk", "n_tokens", "tokens"],
                )

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return slim.mapInArrow(run, "doc_id long, chunk int, n_tokens int, tokens binary")


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, total: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0 .. total - 1."""
    x = np.asarray(index, np.uint64).copy()
    if total <= 1:
        return x.astype(np.int64)
    half = max(1, ((total - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    outside = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while outside.any():
            left, right = x[outside] >> shift, x[outside] & mask
            for r in range(rounds):
                left, right = right, left ^ (_scramble(right, (key + r * 0xD1B54A32D192ED03) % 2**64) & mask)
            x[outside] = (left << shift) | right
            outside = x >= np.uint64(total)
    return x.astype(np.int64)


def numbered(table: DataFrame) -> tuple[DataFrame, int]:
    """A stored table with ``index``, gapless from 0, and its number of rows."""
    placed = table.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file: as many as the writing job had tasks
    starts = materialise(files.select("__file", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first")), "tokens-files")
    total = starts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = placed.join(maybe_broadcast(starts.drop("n")), "__file")
    return out.withColumn("index", F.col("__first") + F.col("__row")).drop("__file", "__row", "__first"), total


def in_training_order(stored: DataFrame, key: int = KEY, per_shard: int = PER_SHARD) -> tuple[DataFrame, int]:
    """The sequences with their global slot and shard, and how many there are."""
    rows, total = numbered(stored)

    @F.pandas_udf("long")
    def slot_of(index):
        import pandas as pd

        return pd.Series(permute(index.to_numpy(), total, key))

    placed = rows.withColumn("slot", slot_of("index")).drop("index")
    return placed.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int")), total


def write_training_order(sequences: DataFrame, path: str, key: int = KEY, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards under ``path`` (``shard=k`` folders) and read them back."""
    spark = sequences.sparkSession
    stored = materialise(sequences, "tokens", "zstd")
    placed, total = in_training_order(stored, key, per_shard)
    shards = max(1, -(-total // per_shard))
    ranges = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
    ranges.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    schema = ranges.select("doc_id", "chunk", "n_tokens", "tokens", "slot", "shard").schema
    return spark.read.schema(schema).parquet(path)


def shard_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-shards-{uuid.uuid4().hex}"


def read_from(spark: SparkSession, path: str, slot: int, count: int, per_shard: int = PER_SHARD) -> DataFrame:
    """``count`` sequences in training order from ``slot`` on; only the shards
    that hold them are opened."""
    last = slot + count - 1
    shards = spark.read.parquet(path)
    return shards.where(
        F.col("shard").between(slot // per_shard, last // per_shard) & F.col("slot").between(slot, last)
    ).orderBy("slot")
