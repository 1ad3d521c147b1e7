"""Work that must not grow faster than its input: how rows meet, how they are dealt and what moves."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import projects
from weftline.operators import impact, routes, traverse
from weftline.plans import snapshot

CALL = "symbol string, language string, url_pattern string, method string, file string"


def _calls(spark, urls):
    return spark.createDataFrame([(f"s{i}", "python", u, "GET", "f.py") for i, u in enumerate(urls)], CALL)


def test_calls_meet_only_routes_of_their_segments(spark):
    calls = _calls(spark, [f"/api/s{i}/7" for i in range(300)]).withColumn("path", routes.call_path(F.col("url_pattern")))
    listed = _calls(spark, [f"/api/s{i}/:id" for i in range(300)]).withColumn("marked", routes.route_template(F.col("url_pattern"), routes.MARK)).select(F.col("symbol").alias("handler"), "marked")
    assert routes.candidates(calls, listed).count() == 300


def test_matches_are_those_of_the_patterns(spark):
    dice = random.Random(5)
    part = lambda extra: dice.choice(["a", "b", "a-b", "", *extra])
    made = lambda extra: "".join(f"/{part(extra)}" for _ in range(dice.randint(1, 4)))
    urls = [made(["7", "{x}"]) for _ in range(150)] + ["/a\n", "/a/b\n", "http://h/a/7", "a", "", "/"]
    listed = [made([":id", "{n}", "v-:id", "x{n}"]) for _ in range(80)] + ["/a", "/a/b", "/a/.*", "/(a|b)/:id", "/:id", "", "a"]
    found = routes.matches(_calls(spark, urls), _calls(spark, listed)).select("c_symbol", "r_symbol").collect()
    bare = lambda u: re.sub(r"/+$", "", u)
    path = lambda u: re.sub(r"\{[^}]+\}", routes.PARAM, re.sub(r"^[\s\S]*?://[^/]*", "", bare(u)) if "://" in bare(u) else bare(u))
    pattern = lambda u: "^" + re.sub(r"\{[a-zA-Z_]\w*\}", lambda _: routes.PARAM, re.sub(r":[a-zA-Z_]\w*", lambda _: routes.PARAM, bare(u))) + "$"
    wanted = [(f"s{i}", f"s{j}") for i, u in enumerate(urls) for j, r in enumerate(listed) if re.match(pattern(r), path(u))]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_files_of_small_rows_are_dealt_to_many_tasks(spark, tmp_path):
    spark.range(9_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = projects.source_files(spark, str(tmp_path), (projects.SCRIPT,))
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 9_000 and max(r["count"] for r in tasks) < 5_000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_not_dealt_by_a_file_that_owns_most(spark, monkeypatch):
    nodes = spark.range(400).select(F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("file"))
    edges = spark.range(400).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), (F.col("id") * 7 % 400).cast("string")).alias("dst"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("file"))
    hashes = spark.createDataFrame([("a", "x", 0), ("b", "y", 0)], "file string, sha256 string, indexed_at long")
    new = (nodes.where("file = 'a'").limit(7), edges.where("file = 'a'").limit(5), hashes.where("file = 'a'"))
    wanted = {False: 360 + 5, True: sum(1 for i in range(400) if i % 10 and (i * 7 % 400) % 10) + 5}
    for few in (True, False):
        if not few:
            monkeypatch.setattr(snapshot, "KEYS_SENT", 0)
        for compat in (False, True):
            n, e, h = snapshot.replace_files((nodes, edges, hashes), new, compat)
            assert (n.count(), e.count(), h.count()) == (360 + 7, wanted[compat], 2)
            for df in (n, e):
                assert "SortMergeJoin" not in _plan(df)
                assert few != ("ShuffledHashJoin" in _plan(df))


def test_ranked_impact_without_inspected_steps(spark, monkeypatch):
    dice = random.Random(3)
    pairs = [(f"n{dice.randrange(60)}", f"n{dice.randrange(60)}", dice.choice(["calls", "asserts_on", "mutates", "side_effect"])) for _ in range(250)]
    edges = spark.createDataFrame([(i, a, b, k, 1.0) for i, (a, b, k) in enumerate(pairs)], "edge_id long, src string, dst string, kind string, confidence double")
    nodes = spark.createDataFrame([(f"n{i}", i % 2, 0) for i in range(0, 60, 2)], "id string, is_public int, is_test int")
    wanted = [tuple(r) for r in impact.ranked(impact.at_risk(nodes, edges, "n1", 4)).select("symbol", "distance", "risk_score", "ord").collect()]
    monkeypatch.setattr(impact, "subgraph", lambda *_: pytest.fail("inspected steps and paths are not needed"))
    for sent in (50_000, 0):
        monkeypatch.setattr(traverse, "FRONT_SENT", sent)
        found = impact.at_risk(nodes, edges, "n1", 4, with_factors=False)
        assert [tuple(r) for r in impact.ranked(found).select("symbol", "distance", "risk_score", "ord").collect()] == wanted
        assert "ord" in found.columns
    old = traverse.subgraph(edges, "n1", "callers", 4).nodes
    assert {(r["id"], r["hop"], tuple(r["ord"])) for r in old.collect()} == {(r["id"], r["hop"], tuple(r["ord"])) for r in traverse.discovered(edges, "n1", "callers", 4).collect()}


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    store = snapshot.Store(spark, f"{tmp_path}/store", buckets=1)
    rows = spark.range(0, 20_000, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("src"), F.sha2((F.col("id") + 1).cast("string"), 256).alias("dst"), F.lit("calls").alias("kind"), F.concat(F.lit("f"), F.col("id") % 50).alias("file"))
    small = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    before = [spark.conf.get(c) for c in small]
    try:
        for c in small:
            spark.conf.set(c, "50k")
        store.insert_edges(rows)
    finally:
        for c, value in zip(small, before):
            spark.conf.set(c, value)
    assert len(list(tmp_path.glob("store/*/edges/bucket=0/*.parquet"))) > 1
    assert store.read("edges").agg(F.count_distinct("edge_id"), F.count_distinct("src")).first()[:] == (20_000, 20_000)
