"""Spark session helpers.

Everything in the library takes a ``SparkSession`` from the caller; these
helpers only build one for tests, the bench and local runs, and make sure a
checkpoint directory exists for operators that cut lineage.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this library relies on. UTC keeps NTZ<->LTZ casts and
# date extraction stable; the local session-merge makes batch session windows
# pre-merge events map-side, so a very active player is reduced to a handful
# of sessions per input partition before the shuffle.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # batches that tasks exchange with Python: bounded by bytes, as texts can be long
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(
    app: str = "lodestar",
    cpus: int | str = "*",
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local session for tests and the bench (clusters bring their own)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(
        shuffle_partitions or (8 if cpus == "*" else max(int(cpus) * 2, 2))
    )
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_session_conf(spark)
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Apply the SQL settings above to an existing session (e.g. the driver's)."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            try:
                spark.conf.set(k, v)
            except Exception:  # static or locked conf on a managed cluster
                pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when nothing is configured and the master is local (tests, the
    bench) a scratch folder is created; on a cluster a machine-local folder
    would not survive executor loss, so the setting is required there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="lodestar-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_place(df: DataFrame) -> DataFrame:
    """``cut_lineage`` of rows that lie and are sorted by a key, which later joins on it
    know. An adaptive plan does not tell how its rows lie, so this one is not adaptive."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def drop_cut(*tables: DataFrame) -> None:
    """Removes the stored rows of tables made by ``cut_lineage`` that no later plan reads."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        file = t._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
