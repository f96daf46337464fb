"""Helpers shared by the operators: word rules, intermediate tables, columns."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import checkpoint_dir

# Task code travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# White space of the word rule [^\x20\x09-\x0D]+ as a Java pattern.
SPACES = "[\\x20\\x09-\\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for NULL or blank."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES, -1)
    return F.filter(parts, lambda w: w != F.lit(""))


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it
    back: later stages survive lost executors and start from the stored rows."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove intermediate tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path:
            spark: SparkSession = t.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            t._scratch_path = None


def task_count(spark: SparkSession) -> int:
    """Partitions for work that is heavy per row."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
