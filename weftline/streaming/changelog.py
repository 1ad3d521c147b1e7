"""Incremental maintenance from a change log: filtered, debounced, last operation of a path, deletes first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.vocabulary import EXTENSIONS, SKIPPED_FOLDERS

SCHEMA = "path string, op string, ts timestamp, dest_path string"
DEBOUNCE = "300 milliseconds"


def watched(path: Column) -> Column:
    """Whether a path has a known extension (in lower case, as it stands) and lies in no skipped folder."""
    folders = F.split(path, "/")
    suffix = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    return suffix.isin(*EXTENSIONS) & ~F.arrays_overlap(folders, F.array(*(F.lit(x) for x in SKIPPED_FOLDERS)))


def events(log: DataFrame) -> DataFrame:
    """(path, op, ts) with op change or delete: creations and edits are changes, a move deletes one path and changes the other."""
    both = F.when(
        F.col("op") == "move",
        F.array(F.struct(F.col("path").alias("path"), F.lit("delete").alias("op")), F.struct(F.col("dest_path").alias("path"), F.lit("change").alias("op"))),
    ).otherwise(F.array(F.struct(F.col("path").alias("path"), F.when(F.col("op") == "delete", "delete").otherwise("change").alias("op"))))
    out = log.select("ts", F.explode(both).alias("e")).select("e.path", "e.op", "ts")
    return out.where(F.col("path").isNotNull() & watched(F.col("path")))


def debounced(changes: DataFrame, gap: str = DEBOUNCE, watermark: str | None = None) -> DataFrame:
    """(burst_start, burst_end, path, op): for each burst of events with pauses below the gap, the last operation of each path; burst_end is the last event's time and the gap.

    One timer serves all paths, so a burst is a session of the whole log: the names of files
    changed without a pause, which whoever applies the burst needs together.  Repeats of an
    event are held once; for logs of many independent trees add a tree column to the key.
    Of a table that is no stream, events are first put together by spans of the gap's length,
    and only spans are ordered.
    """
    if not changes.isStreaming:
        return _bursts(changes, gap)
    if watermark:
        changes = changes.withWatermark("ts", watermark)
    # Sessions of a stream need a key; a literal in the grouping itself would be folded away.
    session = changes.withColumn("k", F.lit("all")).groupBy("k", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_set(F.struct("path", "ts", "op"))).alias("e"))
    # Of the sorted events, the last of each path.
    last = F.filter("e", lambda x, i: F.coalesce(F.get(F.col("e"), i + 1)["path"] != x["path"], F.lit(True)))
    return session.select(F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), F.explode(last).alias("x")).select("burst_start", "burst_end", "x.path", "x.op")


def _bursts(changes: DataFrame, gap: str) -> DataFrame:
    """As debounced, of a whole table.  Events of one span of the gap's length are always of one burst, so bursts are told from the spans' first and last times (a row for each span that has events), and events meet them by span."""
    placed = changes.select("path", "op", "ts", F.window("ts", gap)["start"].alias("span"))
    spans = placed.groupBy("span").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    order = Window.orderBy("span")
    begins = F.coalesce(F.col("first") >= F.lag("last").over(order) + F.expr(f"interval {gap}"), F.lit(True))
    spans = spans.withColumn("begins", begins).withColumn("burst", F.sum(F.col("begins").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    bursts = spans.groupBy("burst").agg(F.min("first").alias("burst_start"), (F.max("last") + F.expr(f"interval {gap}")).alias("burst_end"))
    last = placed.groupBy("span", "path").agg(F.max(F.struct("ts", "op")).alias("m")).join(spans.select("span", "burst"), "span")
    last = last.groupBy("burst", "path").agg(F.max("m").alias("m"))
    return last.join(bursts, "burst").select("burst_start", "burst_end", "path", F.col("m.op").alias("op"))


def last_ops(changes: DataFrame) -> DataFrame:
    """The last operation of each path; of operations at one time, the one that sorts last."""
    return changes.groupBy("path").agg(F.max(F.struct("ts", "op")).alias("m")).select("path", F.col("m.op").alias("op"), F.col("m.ts").alias("ts"))


def sessions(changes: DataFrame, key: str, gap: str) -> DataFrame:
    """(key, start, end, n): bursts of each key."""
    return changes.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "n")


def _apply(ops: dict[str, str], delete: Callable, change: Callable, on_error: Callable) -> None:
    for op, act in (("delete", delete), ("change", change)):
        own = sorted(p for p, o in ops.items() if o == op)
        if own:
            try:
                act(own)
            except Exception as e:
                on_error(e)


def start_latest(log: DataFrame, delete: Callable[[list[str]], None], change: Callable[[list[str]], None], checkpoint: str, on_error: Callable[[Exception], None] = lambda e: print(f"change not applied: {e}"), trigger: dict | None = None):
    """As start, but each trigger's events are one burst: for a log that is itself written in bursts, such as the polls of a tree, no later event has to come before a burst is applied."""

    def apply(batch: DataFrame, _: int) -> None:
        _apply({r["path"]: r["op"] for r in last_ops(batch).collect()}, delete, change, on_error)

    writer = events(log).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"processingTime": "300 milliseconds"})).start()


def start(log: DataFrame, delete: Callable[[list[str]], None], change: Callable[[list[str]], None], checkpoint: str, gap: str = DEBOUNCE, watermark: str = "1 second", on_error: Callable[[Exception], None] = lambda e: print(f"change not applied: {e}"), trigger: dict | None = None):
    """A streaming query that applies bursts: deletes first, then changes; errors are reported and the stream goes on."""

    def apply(batch: DataFrame, _: int) -> None:
        rows = batch.orderBy("burst_end").collect()  # names of one trigger's changed files
        _apply({r["path"]: r["op"] for r in rows}, delete, change, on_error)

    writer = debounced(events(log), gap, watermark).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"processingTime": "300 milliseconds"})).start()
