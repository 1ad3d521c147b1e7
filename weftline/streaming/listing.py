"""A source of file events: differences between listings of a tree, appended to a change log that a stream reads."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import files
from weftline.streaming import changelog

LISTED = "path string, modified timestamp, length long"


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, op, ts, dest_path) from two listings (path, modified, length): create, modify or delete.  A move is a deletion and a creation; equal listings give nothing."""
    a, b = old.select("path", F.col("modified").alias("m0"), F.col("length").alias("n0")), new.select("path", F.col("modified").alias("m1"), F.col("length").alias("n1"))
    both = a.join(b, "path", "full_outer")
    op = F.when(F.col("m0").isNull(), "create").when(F.col("m1").isNull(), "delete").when((F.col("m0") != F.col("m1")) | (F.col("n0") != F.col("n1")), "modify")
    return both.select("path", op.alias("op"), F.current_timestamp().alias("ts"), F.lit(None).cast("string").alias("dest_path")).where("op is not null")


class TreeLog:
    """The change log of a source tree in a folder that executors share; each poll lists the tree and appends what changed since the one before."""

    def __init__(self, spark: SparkSession, root: str, folder: str):
        self.spark, self.root, self.folder = spark, root, folder.rstrip("/")
        self.log = f"{self.folder}/log"
        spark.createDataFrame([], changelog.SCHEMA).write.mode("append").parquet(self.log)
        self._seen = self._list()

    def _list(self) -> DataFrame:
        """The tree as it is now, written down: a later look must not see later files."""
        path = f"{self.folder}/listing-{uuid.uuid4().hex}"
        files.listing(self.spark, self.root).select(F.col("relative").alias("path"), "modified", "length").write.parquet(path)
        return self.spark.read.schema(LISTED).parquet(path)

    def poll(self) -> int:
        """Appends the changes since the last poll; how many they are."""
        now = self._list()
        found = differences(self._seen, now)
        n = found.count()
        if n:
            found.coalesce(1).write.mode("append").parquet(self.log)
        self._seen = now
        return n

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(changelog.SCHEMA).parquet(self.log)


class Watcher:
    """Polls a tree and applies its changes until stopped: the poll runs in a thread of the driver, the changes in a streaming query."""

    def __init__(self, spark: SparkSession, root: str, folder: str, change: Callable[[list[str]], None], delete: Callable[[list[str]], None], every: float = 1.0):
        self.source, self.every = TreeLog(spark, root, folder), every
        self._change, self._delete, self._done = change, delete, threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self.query = None

    def _run(self) -> None:
        while not self._done.wait(self.every):
            try:
                self.source.poll()
            except Exception as e:  # the tree may change while it is listed; the next poll sees it
                print(f"not listed: {e}")

    def start(self) -> Watcher:
        self.query = changelog.start_latest(self.source.stream(), self._delete, self._change, f"{self.source.folder}/checkpoint")
        self._thread.start()
        return self

    def stop(self, wait: float = 2.0) -> None:
        self._done.set()
        self._thread.join(wait)
        if self.query is not None:
            self.query.stop()
