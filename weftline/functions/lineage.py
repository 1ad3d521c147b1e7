"""Cutting lineage through the folder that executors share, and indexing without a single-partition window."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weftline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """df computed once; what follows starts from the shared copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def indexed(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with ``name`` = 0, 1, 2, ... in the given order: a range sort, positions within partitions, and one offset for each partition."""
    placed = settle(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    offset, at = F.lit(0).cast("long"), 0
    starts = {}
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy("_p").count().collect()):
        starts[p], at = at, at + n
    if starts:
        offset = F.element_at(F.create_map(*(F.lit(v) for kv in starts.items() for v in kv)), F.col("_p")).cast("long")
    return placed.withColumn(name, F.col("_i") + offset).drop("_p", "_i")
