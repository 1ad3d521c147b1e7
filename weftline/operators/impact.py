"""Ranked impact of a change: who depends on a symbol, how near, and how exposed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.traverse import discovered, reach, shortest_paths, subgraph

HIGH, MEDIUM = 0.7, 0.3


def risk(distance: Column, assertions: Column, effects: Column, public: Column) -> Column:
    """(1 / distance) (1 + assertions / 2), half as much again with side effects, and again if public."""
    return 1.0 / distance * (1.0 + 0.5 * assertions) * F.when(effects, 1.5).otherwise(1.0) * F.when(public, 1.5).otherwise(1.0)


def risk_class(score: Column) -> Column:
    return F.when(score > HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def at_risk(nodes: DataFrame, edges: DataFrame, symbol: str, max_hops: int = 4, with_paths: bool = False, with_factors: bool = True, ordered: bool = True) -> DataFrame:
    """symbol, distance, risk_score (rounded half to even), risk_class (of the unrounded score), is_test, risk_factors, ord (discovery order), and path if asked for.

    Dependents are found against the direction of all edges; those without a node row only
    conduct.  Factors are inbound assertions first, then outbound mutations and side effects,
    each in edge order.  Without ``ordered`` there is no ord, and the traversal carries less.
    """
    found = subgraph(edges, symbol, "callers", max_hops) if with_paths else None
    reached = found.nodes if found else discovered(edges, symbol, "callers", max_hops) if ordered else reach(edges, symbol, "callers", max_hops).withColumn("ord", F.lit(None))
    hit = reached.where(F.col("id") != symbol).select("id", "hop", "ord").join(nodes.select("id", "is_public", "is_test"), "id")
    asserted, is_effect = F.col("kind") == "asserts_on", F.col("kind") == "side_effect"
    if with_factors:
        inbound = edges.where(asserted).select(F.col("dst").alias("id"), F.lit(0).alias("phase"), "edge_id", F.concat(F.lit("asserts_on:"), "src").alias("txt"))
        outbound = edges.where(F.col("kind").isin("mutates", "side_effect")).select(F.col("src").alias("id"), F.lit(1).alias("phase"), "edge_id", F.concat("kind", F.lit(":"), "dst").alias("txt"))
        marks = inbound.unionByName(outbound).join(hit.select("id"), "id", "left_semi")
        factors = F.transform(F.array_sort(F.collect_list(F.struct("phase", "edge_id", "txt"))), lambda x: x["txt"]).alias("risk_factors")
        marks = marks.groupBy("id").agg(F.count_if(F.col("phase") == 0).alias("assertions"), F.coalesce(F.bool_or(F.col("txt").startswith("side_effect:")), F.lit(False)).alias("effects"), factors)
    else:
        # Counts are summed where edges are read, before anything moves.
        inbound = edges.where(asserted).select(F.col("dst").alias("id"), F.lit(1).cast("long").alias("one"), F.lit(False).alias("effect"))
        outbound = edges.where(is_effect & F.col("dst").isNotNull()).select(F.col("src").alias("id"), F.lit(0).cast("long").alias("one"), F.lit(True).alias("effect"))
        marks = inbound.unionByName(outbound).groupBy("id").agg(F.sum("one").alias("assertions"), F.bool_or("effect").alias("effects"))
    out = hit.join(marks, "id", "left")
    distance = F.greatest("hop", F.lit(1))
    score = risk(distance, F.coalesce("assertions", F.lit(0)), F.coalesce("effects", F.lit(False)), F.col("is_public") == 1)
    cols = [F.col("id").alias("symbol"), distance.alias("distance"), F.bround(score, 4).alias("risk_score"), risk_class(score).alias("risk_class"), F.col("is_test"), *(["ord"] if ordered or with_paths else [])]
    if with_factors:
        cols.append(F.coalesce("risk_factors", F.expr("cast(array() as array<string>)")).alias("risk_factors"))
    out = out.select(*cols)
    if with_paths:
        paths = shortest_paths(found, max_hops).withColumnRenamed("id", "symbol")
        out = out.join(paths, "symbol", "left").withColumn("path", F.coalesce("path", F.array(F.lit(symbol), F.col("symbol"))))
    return out


def ranked(risks: DataFrame) -> DataFrame:
    """By rounded score, then discovery order."""
    return risks.orderBy(F.desc("risk_score"), "distance", "ord")


def summary(risks: DataFrame) -> DataFrame:
    count = lambda c, name: F.count_if(c).alias(name)
    return risks.agg(*(count(F.col("risk_class") == c, f"{c}_risk") for c in ("high", "medium", "low")), count(F.col("is_test") == 1, "tests_at_risk"))
