"""Scans and sinks (IO1-IO6).

Readers return lazy DataFrames so Catalyst prunes columns and pushes filters
into the Parquet scan; writers are plain DataFrameWriter calls, partitioned
where later reads filter by date.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """IO1: read one Parquet table; ``columns`` narrows the scan's ReadSchema."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_raw(spark: SparkSession, path: str, schema: T.StructType, corrupt_col: str = "_corrupt_record") -> DataFrame:
    """IO2: JSON Lines with an explicit schema; unparsable lines keep their text
    in ``corrupt_col`` (PERMISSIVE), so rejected input stays inspectable."""
    if corrupt_col not in schema.fieldNames():
        schema = T.StructType(schema.fields + [T.StructField(corrupt_col, T.StringType(), True)])
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt_col)
        .json(path)
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (hdfs, s3a, file)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


# Player store: one JSON line per player (id, raw document, recommendations) in hash
# buckets of the id. A write puts whole buckets beside the old ones under a folder of
# its own, ``data/write=W/bucket=B``; the newest manifest, ``_manifests/N``, names the
# folder of each bucket, so a write counts once its manifest is there and buckets that
# it does not touch stay where they are.
STORE_SCHEMA = T.StructType(
    [
        T.StructField("player_id", T.StringType(), True),
        T.StructField("doc", T.StringType(), True),
        T.StructField("recommendations", T.ArrayType(T.StringType()), True),
    ]
)


STORE_BUCKETS = 64


class _Folder:
    """Hadoop file system calls below a path (hdfs, s3a, file)."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> None:
        """Write beside and rename, so a reader sees all of the file or none."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.at(part), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(self.at(part), self.at(name)):
            self.fs.delete(self.at(part), False)
            raise RuntimeError(f"another write of {self.path} was committed first")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _manifests(folder: _Folder) -> list[int]:
    """Numbers of the committed manifests, oldest first."""
    return sorted(int(n) for n in folder.names("_manifests") if n.isdigit())


def _manifest(folder: _Folder, number: int | None = None) -> dict:
    """{"buckets": number of buckets, "folders": {bucket: folder}}; buckets without rows have no folder."""
    numbers = _manifests(folder)
    if not numbers:
        return {"buckets": None, "folders": {}}
    return json.loads(folder.read(f"_manifests/{number or numbers[-1]}"))


def store_bucket(player_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(player_id), F.lit(buckets)).cast("int")


def store_buckets(spark: SparkSession, path: str) -> int:
    """Number of buckets of a store, ``STORE_BUCKETS`` for a missing one."""
    return _manifest(_Folder(spark, path))["buckets"] or STORE_BUCKETS


def read_store(spark: SparkSession, path: str, only: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """IO3: (players(player_id, doc), recommendations(player_id, recommendations))
    as of the newest manifest, of all buckets or of those in ``only``. A missing
    store is an empty one."""
    held = _manifest(_Folder(spark, path))["folders"]
    folders = [f"{path.rstrip('/')}/{f}" for b, f in held.items() if only is None or int(b) in only]
    store = spark.read.schema(STORE_SCHEMA).json(folders) if folders else spark.createDataFrame([], STORE_SCHEMA)
    players = store.where(F.col("doc").isNotNull()).select("player_id", "doc")
    recs = store.where(F.col("recommendations").isNotNull()).select("player_id", "recommendations")
    return players, recs


def write_store(players: DataFrame, recs: DataFrame, path: str, keep: int = 2, only: list[int] | None = None,
                buckets: int | None = None) -> None:
    """IO4: replace the store, or the buckets in ``only`` (rows of another bucket then
    fail the write); Spark's JSON writer keeps non-ASCII text as UTF-8. ``buckets`` sets
    the number of buckets of a new or wholly replaced store; choose it so that a bucket
    is a few hundred MB. Files that were read stay in place until the new manifest is
    committed, so rows may come from the same store and a failed write loses nothing;
    the newest ``keep`` manifests and their folders remain. A store has one writer at a
    time; the second of two that meet fails. NULL is an id like any other (one row)."""
    spark = players.sparkSession
    folder = _Folder(spark, path)
    numbers, old = _manifests(folder), _manifest(folder)
    n = (buckets if only is None else None) or old["buckets"] or STORE_BUCKETS
    p = players.select(F.col("player_id").alias("_pid"), "doc")
    r = recs.select(F.col("player_id").alias("_rid"), "recommendations")
    joined = p.join(r, F.col("_pid").eqNullSafe(F.col("_rid")), "full_outer").select(
        F.coalesce("_pid", "_rid").alias("player_id"), "doc", "recommendations")
    bucket = store_bucket(F.col("player_id"), n)
    if only is not None:
        bucket = F.when(bucket.isin(*only), bucket).otherwise(F.raise_error(F.lit("a row outside the buckets of the write")).cast("int"))
    write = f"data/write={uuid.uuid4().hex}"
    rows = joined.withColumn("bucket", bucket).repartition(n if only is None else max(1, len(only)), "bucket")
    rows.write.option("encoding", "UTF-8").partitionBy("bucket").json(f"{folder.path}/{write}")
    new = {name.split("=")[1]: f"{write}/{name}" for name in folder.names(write) if name.startswith("bucket=")}
    kept = {} if only is None else {b: f for b, f in old["folders"].items() if int(b) not in only}
    number = (numbers[-1] if numbers else 0) + 1
    folder.commit(f"_manifests/{number}", json.dumps({"buckets": n, "folders": {**kept, **new}}))
    _forget(folder, [v for v in numbers if v <= number - keep])


def _forget(folder: _Folder, gone: list[int]) -> None:
    """Delete manifests and the folders that only they name."""
    if not gone:
        return
    live = {f for v in _manifests(folder) if v not in gone for f in _manifest(folder, v)["folders"].values()}
    dead = {f for v in gone for f in _manifest(folder, v)["folders"].values()} - live
    for v in gone:
        folder.delete(f"_manifests/{v}")
    for f in sorted(dead):
        folder.delete(f)


SESSION_COLUMNS = ["session_id", "player_id", "game_id", "start_time"]


def append_sessions(new_sessions: DataFrame, path: str) -> None:
    """IO5: append new sessions (4 columns; end_time and duration stay NULL),
    partitioned by start date so range reads prune partitions."""
    out = (
        new_sessions.select(*SESSION_COLUMNS)
        .withColumn("end_time", F.lit(None).cast("timestamp_ntz"))
        .withColumn("session_duration", F.lit(None).cast("double"))
        .withColumn("start_date", F.to_date("start_time"))
    )
    out.write.mode("append").partitionBy("start_date").parquet(path)


def write_dataset(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """IO6 sink: overwrite a Parquet dataset (dynamic partition overwrite)."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
