"""Where an operator may cut lineage or keep files that executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where the session names none, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            return kept
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weftline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: later steps neither repeat it nor depend on the executors that made it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """As settle, as Parquet in the shared folder, for wide rows of which later steps read some columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/weftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].paths.append(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it, plans that are run send at most n rows at once between the JVM and Python: whole texts make large buffers, which the JVM's native heap then keeps in pieces.  The session's own setting, if it is lower, stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= n:
        yield
        return
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_scopes: list[Scope] = []


class Scope:
    """Remembers the tables that are written within it, so that they can be removed once what was made of them is kept.  Tables that are written outside any scope stay for whoever reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        _scopes.append(self)
        return self

    def __exit__(self, *_) -> None:
        _scopes.remove(self)

    def keep_last(self) -> None:
        """Removes all remembered tables but the last."""
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in self.paths[:-1]:
            gone = make(path)
            gone.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
        self.paths = self.paths[-1:]


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are kept already; otherwise they stay until the driver happens to collect its garbage.  Native memory that the driver's threads have freed goes back to the system, where the JVM can do so."""
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        _diagnose(spark, "systemTrimNativeHeap")
    except Py4JJavaError:  # a JVM without this command keeps it
        pass


def _diagnose(spark: SparkSession, command: str) -> None:
    """Runs a diagnostic command of the driver's JVM."""
    jvm = spark.sparkContext._jvm

    def array(kind, *values):
        out = spark.sparkContext._gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    named = jvm.java.lang.Class.forName
    text, anything = jvm.java.lang.String, jvm.java.lang.Object
    kinds = array(jvm.java.lang.Class, named("javax.management.ObjectName"), named("java.lang.String"), named("[Ljava.lang.Object;"), named("[Ljava.lang.String;"))
    bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    given = array(anything, bean, command, array(anything, array(text)), array(text, "[Ljava.lang.String;"))
    named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
