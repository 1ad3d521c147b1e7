"""Connected components of a list of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.spill import settle


def _large_star(e: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest of its neighbourhood."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours, and itself, to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable) of every node that is not the smallest of its own component.

    Minima are partially aggregated before each shuffle and the joins have one row for a
    node on one side, so a node with very many links is split by the skew-join rule.
    Null ends and loops are ignored; repeated links count once; no links, no rows.
    """
    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = settle(e)
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
        e = settle(_small_star(_large_star(e)))
