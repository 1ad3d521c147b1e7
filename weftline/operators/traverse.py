"""Bounded breadth-first traversal with discovery order, tree paths and cycles.

The order in which a queue would discover nodes is the lexicographic order of the edge
positions along their tree paths.  So each reached node carries its path and that list of
positions, the tree parent is a partially aggregated minimum, and neither a window nor a
global row number is needed: a hop is one join, one anti-join and one aggregation.

A front that is measured to be small is sent to the edges, which then do not move.  With a
larger one the edges move once for the hop, and are not sorted while tasks can hold their
shares of the front.  Who only asks what is reached at which hop uses ``reach``, which carries
neither positions nor paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.lineage import settle

#: Edges met from their far end come after all others of the same node.
_FAR = 1 << 62
#: Rows of a front or of the reached set that may be broadcast (an id each, or an id, positions and path of a few hops).
FRONT_SENT = 50_000
#: Rows of those that tasks may hold in hash tables, all together; more are met by sorting.
FRONT_HASHED = 50_000_000


@dataclass
class Subgraph:
    """nodes (id, hop, ord, path) of all reached ids, edges (inspected, with hops, ord, current, neighbor, path) and cycles (cycle, hops, ord)."""

    root: str
    nodes: DataFrame
    edges: DataFrame
    cycles: DataFrame

    def ordered_edges(self) -> DataFrame:
        return self.edges.orderBy("hops", "ord")


def steps(edges: DataFrame, direction: str, min_confidence: float = 0.0, kinds: list[str] | None = None) -> DataFrame:
    """Edges as steps from ``cur`` to ``nb``, with their position ``o`` among the steps of cur."""
    if min_confidence > 0:
        edges = edges.where(F.col("confidence") >= min_confidence)
    if kinds:
        edges = edges.where(F.col("kind").isin(kinds))
    kept = ["edge_id", "src", "dst", "kind", "confidence"]
    forward = edges.select(F.col("src").alias("cur"), F.col("dst").alias("nb"), F.col("edge_id").alias("o"), *kept)
    backward = edges.select(F.col("dst").alias("cur"), F.col("src").alias("nb"), F.col("edge_id").alias("o"), *kept)
    if direction == "callees":
        return forward
    if direction == "callers":
        return backward
    return forward.unionByName(backward.where("src <> dst").withColumn("o", F.col("o") + _FAR))


def _lookup(rows: DataFrame, n: int) -> DataFrame:
    """The n rows in the form in which larger tables meet them."""
    return F.broadcast(rows) if n <= FRONT_SENT else rows.hint("shuffle_hash") if n <= FRONT_HASHED else rows


def _meet(step: DataFrame, front: DataFrame, n: int) -> DataFrame:
    """Steps from the n rows of a front (id, ...)."""
    return step.join(_lookup(front.withColumnRenamed("id", "cur"), n), "cur")


def _unseen(found: DataFrame, visited: DataFrame, n: int) -> DataFrame:
    """Rows of found (nb, ...) whose nb is none of the n visited."""
    return found.join(_lookup(visited.select(F.col("id").alias("nb")), n), "nb", "left_anti")


def reach(edges: DataFrame, root: str, direction: str = "both", max_hops: int = 3, min_confidence: float = 0.0, kinds: list[str] | None = None) -> DataFrame:
    """(id, hop) of everything within max_hops of the root, the root itself included."""
    spark = edges.sparkSession
    step = steps(edges, direction, min_confidence, kinds).select("cur", "nb")
    front = spark.range(1).select(F.lit(root).alias("id"), F.lit(0).alias("hop"))
    visited, n, total = front, 1, 1
    for hop in range(1, max_hops + 1):
        new = _unseen(_meet(step, front.select("id"), n).select("nb").distinct(), visited, total)
        front = settle(new.select(F.col("nb").alias("id"), F.lit(hop).alias("hop")))
        n = front.count()
        if not n:
            break
        visited, total = visited.unionByName(front), total + n
    return visited


def walk(spark: SparkSession, step: DataFrame, root: str, max_hops: int) -> tuple[DataFrame, DataFrame | None]:
    """(reached ids with hop, ord and path; inspected steps).  Stops early when nothing new is found."""
    front = spark.range(1).select(F.lit(root).alias("id"), F.lit(0).alias("hop"), F.expr("cast(array() as array<bigint>)").alias("ord"), F.array(F.lit(root)).alias("path"))
    visited, inspected, n, total = front, None, 1, 1
    for hop in range(1, max_hops + 1):
        seen = _meet(step, front.drop("hop"), n)
        seen = seen.select("edge_id", "src", "dst", "kind", "confidence", "cur", "nb", F.lit(hop).alias("hops"), F.concat("ord", F.array("o")).alias("ord"), "path")
        seen = settle(seen)
        inspected = seen if inspected is None else inspected.unionByName(seen)
        new = _unseen(seen.select("nb", "ord", "path"), visited, total).groupBy("nb").agg(F.min(F.struct("ord", "path")).alias("best"))
        front = settle(new.select(F.col("nb").alias("id"), F.lit(hop).alias("hop"), F.col("best.ord").alias("ord"), F.concat("best.path", F.array("nb")).alias("path")))
        n = front.count()
        if not n:
            break
        visited, total = visited.unionByName(front), total + n
    return visited, inspected


def discovered(edges: DataFrame, root: str, direction: str = "both", max_hops: int = 3) -> DataFrame:
    """(id, hop, ord) of everything within max_hops of the root: as ``walk``, without inspected steps and paths, so that only ends and positions move."""
    spark = edges.sparkSession
    step = steps(edges, direction).select("cur", "nb", "o")
    front = spark.range(1).select(F.lit(root).alias("id"), F.lit(0).alias("hop"), F.expr("cast(array() as array<bigint>)").alias("ord"))
    visited, n, total = front, 1, 1
    for hop in range(1, max_hops + 1):
        found = _meet(step, front.select("id", "ord"), n).select("nb", F.concat("ord", F.array("o")).alias("ord"))
        best = _unseen(found.groupBy("nb").agg(F.min("ord").alias("ord")), visited, total)
        front = settle(best.select(F.col("nb").alias("id"), F.lit(hop).alias("hop"), "ord"))
        n = front.count()
        if not n:
            break
        visited, total = visited.unionByName(front), total + n
    return visited


def subgraph(edges: DataFrame, root: str, direction: str = "both", max_hops: int = 3, min_confidence: float = 0.0, kinds: list[str] | None = None, strict_cycles: bool = False) -> Subgraph:
    """Everything within max_hops of the root; nodes at the last hop are not expanded, all kinds are followed, a root without edges or node is traversed too.

    A cycle closes when a step leads to a node on the tree path to the current one.  In
    direction ``both`` each tree edge is met again from its far end and so gives a cycle of
    two, as a plain queue reports it; ``strict_cycles`` leaves those out.
    """
    spark = edges.sparkSession
    reached, inspected = walk(spark, steps(edges, direction, min_confidence, kinds), root, max_hops)
    if inspected is None:
        inspected = edges.limit(0).select("edge_id", "src", "dst", "kind", "confidence", F.col("src").alias("cur"), F.col("dst").alias("nb"), F.lit(0).alias("hops"), F.expr("cast(array() as array<bigint>)").alias("ord"), F.expr("cast(array() as array<string>)").alias("path"))
    on_path = inspected.where(F.array_contains("path", F.col("nb")))
    if strict_cycles:
        on_path = on_path.where(F.expr("not (size(path) >= 2 and nb = element_at(path, -2))"))
    cycles = on_path.select(F.concat(F.expr("slice(path, cast(array_position(path, nb) as int), size(path))"), F.array("nb")).alias("cycle"), "hops", "ord")
    return Subgraph(root, reached, inspected, cycles)


def with_rows(found: Subgraph, nodes: DataFrame) -> DataFrame:
    """Reached ids that have a node row, with hops and discovery order; ids without one only conduct."""
    return found.nodes.select("id", F.col("hop").alias("hops"), "ord").join(nodes, "id")


def shortest_paths(found: Subgraph, max_hops: int | None = None) -> DataFrame:
    """(id, path) by undirected search over the subgraph's inspected edges, for every target at once; the adjacency is in inspection order, far ends first."""
    from weftline.functions.lineage import indexed

    spark = found.nodes.sparkSession
    listed = indexed(found.edges.select("src", "dst", "hops", "ord"), "ix", "hops", "ord")
    blank = [F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("confidence")]
    near = listed.select(F.col("dst").alias("cur"), F.col("src").alias("nb"), (F.col("ix") * 2).alias("o"), F.col("ix").alias("edge_id"), "src", "dst", *blank)
    far = listed.select(F.col("src").alias("cur"), F.col("dst").alias("nb"), (F.col("ix") * 2 + 1).alias("o"), F.col("ix").alias("edge_id"), "src", "dst", *blank)
    hops = max_hops if max_hops is not None else (found.nodes.agg(F.max("hop")).first()[0] or 0)
    reached, _ = walk(spark, near.unionByName(far), found.root, hops)
    return reached.select("id", "path")
