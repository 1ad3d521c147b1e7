"""Graph views of the driver's relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(letter: str, key: str):
    return F.concat(F.lit(f"{letter}:"), F.col(key).cast("string"))


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nations inherit regions, customers call nations, suppliers call nations, orders mutate customers and assert on suppliers; orders have side effects by return flag.  Positions follow the keys."""
    t = lambda name: table(spark, sf_dir, name)

    def edge(df, src, dst, kind, confidence, position):
        return df.select((position).cast("long").alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))

    step = 10**15
    line = t("lineitem")
    parts = [
        edge(t("nation"), _id("n", "n_nationkey"), _id("r", "n_regionkey"), "inherits", 1.0, F.col("n_nationkey")),
        edge(t("customer"), _id("c", "c_custkey"), _id("n", "c_nationkey"), "calls", 0.8, step + F.col("c_custkey")),
        edge(t("supplier"), _id("s", "s_suppkey"), _id("n", "s_nationkey"), "calls", 0.5, 2 * step + F.col("s_suppkey")),
        edge(t("orders"), _id("o", "o_orderkey"), _id("c", "o_custkey"), "mutates", 1.0, 3 * step + F.col("o_orderkey")),
        edge(line, _id("o", "l_orderkey"), _id("s", "l_suppkey"), "asserts_on", 0.3, 4 * step + F.col("l_orderkey") * 100000 + F.col("l_suppkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def effect_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling side effects of orders with a returned line."""
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return line.select((5 * 10**15 + F.col("l_orderkey")).cast("long").alias("edge_id"), _id("o", "l_orderkey").alias("src"), F.concat(F.lit("side_effect:network:"), "l_linestatus").alias("dst"), F.lit("side_effect").alias("kind"), F.lit(1.0).alias("confidence"))


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)

    def node(df, letter, key, kind, module, name, public, test):
        return df.select(_id(letter, key).alias("id"), F.lit(kind).alias("kind"), module.alias("module"), F.concat(module, F.lit(".py")).alias("file"), F.col(key).cast("int").alias("line_start"), name.alias("signature"), public.cast("int").alias("is_public"), test.cast("int").alias("is_test"))

    yes, no = F.lit(1), F.lit(0)
    parts = [
        node(t("region"), "r", "r_regionkey", "class", F.lit("region"), F.col("r_name"), yes, no),
        node(t("nation"), "n", "n_nationkey", "class", F.lit("nation"), F.col("n_name"), yes, no),
        node(t("customer"), "c", "c_custkey", "function", F.col("c_mktsegment"), F.col("c_name"), F.col("c_acctbal") >= 0, no),
        node(t("supplier"), "s", "s_suppkey", "function", F.lit("supplier"), F.col("s_name"), F.col("s_acctbal") >= 0, no),
        node(t("orders"), "o", "o_orderkey", "method", F.col("o_orderpriority"), F.col("o_orderpriority"), F.col("o_totalprice") >= 1000, F.col("o_orderstatus") == "F"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which type of event follows which for a user: a small dense graph with loops and cycles."""
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(by).alias("dst")).where("dst is not null").distinct()
    # At most the square of the number of event types: small enough for one ordered window.
    number = F.row_number().over(Window.orderBy("src", "dst")).cast("long")
    return pairs.select(number.alias("edge_id"), "src", "dst", F.lit("calls").alias("kind"), F.lit(1.0).alias("confidence"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("change").alias("op"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
