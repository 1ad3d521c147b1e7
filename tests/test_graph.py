"""Traversal, impact and paths: exact cases, and random graphs against a plain queue."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weftline.operators import impact, overview, search, traverse

EDGE = "edge_id long, src string, dst string, kind string, confidence double"
NODE = "id string, kind string, module string, file string, line_start int, line_end int, signature string, docstring string, is_public int, is_test int"


def edges(spark, rows):
    return spark.createDataFrame([(i, *r, *(("calls", 1.0)[len(r) - 2 :])) for i, r in enumerate(rows)], EDGE)


def nodes(spark, ids, private=(), tests=()):
    return spark.createDataFrame([(i, "function", "m", "m.py", 1, 9, f"def {i}()", None, int(i not in private), int(i in tests)) for i in ids], NODE)


def queue_walk(rows, root, direction, hops):
    """The traversal by a first-in-first-out queue."""
    path, seen, order, inspected, cycles = {root: [root]}, {root}, [(root, 0)], [], []
    todo = deque([(root, 0)])
    while todo:
        at, hop = todo.popleft()
        if hop >= hops:
            continue
        out = [(i, r) for i, r in enumerate(rows) if r[0] == at]
        into = [(i, r) for i, r in enumerate(rows) if r[1] == at]
        found = {"callees": out, "callers": into, "both": out + [x for x in into if x[1][0] != at]}[direction]
        for i, r in found:
            other = r[1] if r[0] == at else r[0]
            inspected.append((i, hop + 1))
            if other in seen:
                if other in path[at]:
                    cycles.append(path[at][path[at].index(other) :] + [other])
                continue
            seen.add(other)
            path[other] = path[at] + [other]
            order.append((other, hop + 1))
            todo.append((other, hop + 1))
    return order, inspected, cycles


@pytest.mark.parametrize("direction", ["callees", "callers", "both"])
def test_random_graphs_follow_a_queue(spark, direction):
    rng = random.Random(5)
    names = [f"v{i}" for i in range(14)]
    rows = [(rng.choice(names), rng.choice(names)) for _ in range(30)] + [("v0", "v0"), ("v0", "v1"), ("v0", "v1")]
    found = traverse.subgraph(edges(spark, rows), "v0", direction, 4)
    order, inspected, cycles = queue_walk(rows, "v0", direction, 4)
    assert [(r[0], r[1]) for r in found.nodes.orderBy("hop", "ord").select("id", "hop").collect()] == order
    assert [(r[0], r[1]) for r in found.ordered_edges().select("edge_id", "hops").collect()] == inspected
    assert [r[0] for r in found.cycles.orderBy("hops", "ord").select("cycle").collect()] == cycles


def test_chain_confidence_and_limits(spark):
    e = edges(spark, [("A", "B", "calls", 1.0), ("B", "C", "calls", 0.3)])
    reach = lambda *a: {r[0] for r in traverse.subgraph(e, *a).nodes.collect()}
    assert reach("A", "callees", 3) == {"A", "B", "C"}
    assert reach("A", "callees", 1) == {"A", "B"}
    assert reach("A", "callees", 3, 0.5) == {"A", "B"}
    assert reach("C", "callers", 3) == {"A", "B", "C"}
    assert reach("nowhere", "both", 3) == {"nowhere"}
    assert traverse.subgraph(e, "A", "both", 3, strict_cycles=True).cycles.count() == 0
    assert traverse.subgraph(e, "A", "both", 0).edges.count() == 0


def scores(spark, rows, ids, symbol="target", **kw):
    found = impact.at_risk(nodes(spark, ids, **kw), edges(spark, rows), symbol, 8, with_paths=True)
    return {r["symbol"]: r for r in found.collect()}


def test_scores(spark):
    got = scores(spark, [("caller", "target"), ("test", "caller", "asserts_on")], ["caller", "target", "test"], tests=("test",))
    assert got["caller"]["risk_score"] == 2.25 and got["caller"]["risk_factors"] == ["asserts_on:test"]
    got = scores(spark, [("test", "target"), ("test", "target", "asserts_on")], ["test", "target"])
    assert got["test"]["risk_score"] == 1.5
    got = scores(spark, [("c", "target"), ("c", "side_effect:file_io:open", "side_effect")], ["c", "target"])
    assert got["c"]["risk_score"] == 2.25 and got["c"]["risk_factors"] == ["side_effect:side_effect:file_io:open"]
    got = scores(spark, [("_p", "target")], ["_p", "target"], private=("_p",))
    assert got["_p"]["risk_score"] == 1.0


def test_half_even_far_callers_and_shorter_paths(spark):
    chain = [(f"n{i + 1}", f"n{i}") for i in range(8)]
    got = scores(spark, chain + [("n8", "side_effect:network:x", "side_effect")], [f"n{i}" for i in range(9)], "n0", private=("n8",))
    assert got["n8"]["distance"] == 8 and got["n8"]["risk_score"] == 0.1875
    got = scores(spark, chain + [("n8", "side_effect:network:x", "side_effect"), ("t", "n8", "asserts_on")], [f"n{i}" for i in range(9)], "n0", private=("n8",))
    assert got["n8"]["risk_score"] == 0.2812  # 0.28125
    got = scores(spark, [("b", "a"), ("c", "b"), ("a", "c")], ["a", "b", "c"], "a")
    assert got["c"]["distance"] == 2 and got["c"]["path"] == ["a", "c"]


def test_dangling_ids_conduct(spark):
    got = scores(spark, [("ghost", "target"), ("far", "ghost")], ["far", "target"])
    assert set(got) == {"far"} and got["far"]["distance"] == 2


def test_overview(spark):
    e = edges(spark, [("a", "b"), ("a", "c", "mutates", 1.0), ("c", "a", "asserts_on", 1.0), ("ghost", "c", "mutates", 0.8)])
    n = nodes(spark, ["a", "b", "c"])
    assert [overview.edges_of(e, "a", d).count() for d in ("out", "in", "both")] == [2, 1, 3]
    assert {r["symbol"]: r["file"] for r in overview.mutations(n, e, "c").collect()} == {"a": "m.py", "ghost": ""}
    assert {r[0] for r in overview.entry_points(n, e).select("id").collect()} == {"a", "c"}
    assert overview.coverage(n, e).first().asDict() == {"total_public": 3, "covered": 1, "coverage_pct": 33.3}
    assert overview.coverage(n.limit(0), e).first()["coverage_pct"] == 0.0
    s = overview.symbol(n, e, "a").first()
    assert [x["dst"] for x in s["edges_out"]] == ["b", "c"] and [x["src"] for x in s["edges_in"]] == ["c"]
    assert overview.symbol(n, e, "x").first() is None


def test_search(spark):
    rows = [("auth.create_token", "Create a JWT token"), ("auth.verify_token", "Verify a JWT token, token and Café"), ("auth.login", "Log a user in"), ("x.other", None), ("x.more", "nothing"), ("x.third", "else")]
    n = spark.createDataFrame([(i, "class" if "login" in i else "function", "m", "m.py", 1, 2, None, d, 1, 0) for i, d in rows], NODE)
    ids = lambda q, **k: [r["id"] for r in search.search(n, q, **k).collect()]
    assert set(ids("JWT token")) == {"auth.create_token", "auth.verify_token"}
    assert ids("create_token") == ["auth.create_token"] and ids("token_create") == []
    assert ids("cafe") == ["auth.verify_token"] and ids("") == [] and ids("?!") == []
    assert ids("auth", kinds=["class"]) == ["auth.login"] and len(ids("auth", limit=2)) == 2
    assert all(r["score"] < 0 for r in search.search(n, "token").collect())
