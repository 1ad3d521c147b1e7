"""Lookups, project overview and relational answers over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.schema import CALLABLE


def node(nodes: DataFrame, id_: str) -> DataFrame:
    return nodes.where(F.col("id") == id_)


def edges_of(edges: DataFrame, id_: str, direction: str = "both") -> DataFrame:
    """Edges out of, into or at a node; in ``both`` a loop comes once and edges met at their far end come last (column far)."""
    if direction == "out":
        return edges.where(F.col("src") == id_).withColumn("far", F.lit(0))
    if direction == "in":
        return edges.where(F.col("dst") == id_).withColumn("far", F.lit(0))
    return edges.where((F.col("src") == id_) | (F.col("dst") == id_)).withColumn("far", (F.col("src") != id_).cast("int"))


def nodes_of_kind(nodes: DataFrame, kinds: str = "") -> DataFrame:
    """Nodes of a comma-separated list of kinds; blanks are trimmed, and an empty list is all kinds."""
    wanted = [k.strip() for k in kinds.split(",") if k.strip()]
    return nodes.where(F.col("kind").isin(wanted)) if wanted else nodes


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("total_nodes")).join(edges.agg(F.count("*").alias("total_edges")))


def edge_breakdown(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def modules(nodes: DataFrame) -> DataFrame:
    """Each module with its first file, its functions (methods included) and classes; variables only make it exist."""
    return nodes.groupBy("module").agg(F.min_by("file", F.struct("file", "id")).alias("file"), F.count_if(F.col("kind").isin(*CALLABLE)).alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"))


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges into each node, of all kinds; zero where there are none."""
    counted = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return nodes.select("id", "kind", "file").join(counted, "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))


def hot_symbols(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    return in_degree(nodes, edges).orderBy(F.desc("in_degree"), "id").limit(n)


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods that nothing calls."""
    called = edges.where("kind = 'calls'").select(F.col("dst").alias("id"))
    return nodes.where(F.col("kind").isin(*CALLABLE)).join(called, "id", "left_anti")


def covered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Public functions and methods on which something asserts."""
    asserted = edges.where("kind = 'asserts_on'").select(F.col("dst").alias("id"))
    return nodes.where(F.col("kind").isin(*CALLABLE) & (F.col("is_public") == 1)).join(asserted, "id", "left_semi")


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """total_public, covered and coverage_pct (one decimal, half to even; 0 without public callables)."""
    total = nodes.agg(F.count_if(F.col("kind").isin(*CALLABLE) & (F.col("is_public") == 1)).alias("total_public"))
    out = total.join(covered(nodes, edges).agg(F.count("*").alias("covered")))
    return out.withColumn("coverage_pct", F.when(F.col("total_public") > 0, F.bround(100.0 * F.col("covered") / F.col("total_public"), 1)).otherwise(0.0))


def mutations(nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """Who writes a field: a row for each mutating edge; a writer without a node has file '' and line 0."""
    writes = edges.where((F.col("kind") == "mutates") & (F.col("dst") == target)).select("edge_id", F.col("src").alias("id"), "confidence")
    found = writes.join(nodes.select("id", "file", "line_start"), "id", "left")
    return found.select(F.col("id").alias("symbol"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line_start", F.lit(0)).alias("line_start"), "confidence", "edge_id")


def symbol(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    """A node with its edges out and in as arrays of structs, in edge order; no row if there is no such node."""
    out = edges.where(F.col("src") == id_).agg(F.array_sort(F.collect_list(F.struct("edge_id", "dst", "kind", "confidence"))).alias("edges_out"))
    into = edges.where(F.col("dst") == id_).agg(F.array_sort(F.collect_list(F.struct("edge_id", "src", "kind", "confidence"))).alias("edges_in"))
    return node(nodes, id_).join(out).join(into)


def overrides(methods: DataFrame, bases: DataFrame) -> DataFrame:
    """(src, dst) of methods that a class shares by name with a direct base of the same file; methods (file, class_name, name, id), bases (file, class_name, base)."""
    child = methods.join(bases, ["file", "class_name"])
    parent = methods.select("file", F.col("class_name").alias("base"), "name", F.col("id").alias("dst"))
    return child.join(parent, ["file", "base", "name"]).select(F.col("id").alias("src"), "dst")


def resolve_targets(calls: DataFrame, scope: DataFrame, imports: DataFrame) -> DataFrame:
    """dst and confidence of calls (file, call): a name of the file 1.0, an import by its root 0.8, else the text itself 0.3; scope (file, name, id), imports (file, name, path)."""
    rest = F.expr("substring(call, length(root) + 1)")
    out = calls.withColumn("root", F.substring_index("call", ".", 1))
    out = out.join(scope.select("file", F.col("name").alias("call"), F.col("id").alias("own")), ["file", "call"], "left")
    out = out.join(imports.select("file", F.col("name").alias("root"), "path"), ["file", "root"], "left")
    return out.withColumn("dst", F.coalesce("own", F.concat("path", rest), "call")).withColumn("confidence", F.when(F.col("own").isNotNull(), 1.0).when(F.col("path").isNotNull(), 0.8).otherwise(0.3)).drop("root", "own", "path")


def first_per(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
