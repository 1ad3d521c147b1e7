"""Stores over batches, the token index, receivers, routes in context, listings, the watcher and the tool server."""

import io
import json
import time

import pytest
from pyspark.sql import functions as F

from weftline.operators import routes, search, traverse
from weftline.plans import snapshot
from weftline.plans.engine import Project
from weftline.plans.server import TOOLS, Server
from weftline.sources import extract, files, receivers
from weftline.streaming import changelog, listing


def put(store, spark, texts, language="python"):
    rows = [(f, f.rpartition(".")[0].replace("/", "."), language, bytearray(t.encode())) for f, t in texts.items()]
    found = spark.createDataFrame(rows, "file string, module string, language string, content binary").withColumn("sha256", F.sha2("content", 256))
    facts = extract.facts(found).cache()
    store.replace(extract.node_rows(facts), extract.edge_rows(facts, store.next_edge()), found.select("file", "sha256", F.lit(1).cast("long").alias("indexed_at")))


def test_batches_keep_edges_apart_and_searchable(spark, tmp_path, monkeypatch):
    store = snapshot.Store(spark, str(tmp_path / "s"), buckets=3)
    monkeypatch.setattr(snapshot, "GENERATIONS", 3)
    for k in range(5):
        put(store, spark, {f"m{k}.py": f'def f{k}():\n    """Finds token_a of {"x " * k}."""\n    return g(1)\n\ndef g(x):\n    return x\n', "shared.py": f"def s{k}(): return open('x')\n"})
    nodes, edges, hashes = store.tables()
    ids = [r[0] for r in edges.select("edge_id").collect()]
    assert len(ids) == len(set(ids)) == 5 + 2 and hashes.count() == 6
    assert {r["id"] for r in nodes.collect()} == {f"m{k}.{x}" for k in range(5) for x in (f"f{k}", "g")} | {"shared.s4"}
    full = snapshot.Store(spark, str(tmp_path / "full"))
    put(full, spark, {f"m{k}.py": f'def f{k}():\n    """Finds token_a of {"x " * k}."""\n    return g(1)\n\ndef g(x):\n    return x\n' for k in range(5)} | {"shared.py": "def s4(): return open('x')\n"})
    for root, direction in (("m3.f3", "callees"), ("open", "callers")):
        reached = [sorted((r[0], r[1]) for r in traverse.reach(s.read("edges"), root, direction, 3).collect()) for s in (store, full)]
        assert reached[0] == reached[1] and len(reached[0]) == 2
    # The index gives what reading the texts gives, after replacements and merges of generations.
    assert len(store.manifest()["postings"]) <= 3
    for query in ("token_a", "token a", "finds x", "g x", "return", "s4", "s1", "x x", ""):
        got, want = (sorted((r["id"], round(r["score"], 9)) for r in df.collect()) for df in (store.search(query, limit=50), search.search(nodes, query, limit=50)))
        assert got == want, query
    store.delete(["m1.py"])
    assert store.search("finds", limit=50).count() == 4 and store.search("finds", ["class"]).count() == 0
    assert store.vacuum() >= 5 and store.search("finds", limit=50).count() == 4 and store.read("edges").count() == 6


def test_single_writes(spark, tmp_path):
    store = snapshot.Store(spark, str(tmp_path / "s"), buckets=2)
    put(store, spark, {"a.py": "def f(): return g()\n", "b.py": "def h(): pass\n"})
    assert store.file_hash("a.py") and store.file_hash("none.py") is None
    store.set_file_hash("a.py", "z", 9)
    assert store.file_hash("a.py") == "z" and store.read("file_hashes").count() == 2
    last = store.next_edge() - 1
    store.insert_edges(spark.createDataFrame([("x", "y", "calls", None), ("x", "w", "mutates", 0.5)], "src string, dst string, kind string, confidence double"))
    rows = {r["dst"]: r for r in store.read("edges").collect()}
    assert len(rows) == 3 and rows["y"]["confidence"] == 1.0 and rows["y"]["weight"] == 1 and rows["w"]["confidence"] == 0.5 and {rows["y"]["edge_id"], rows["w"]["edge_id"]} == {last + 1, last + 2}
    node = store.read("nodes").where("id = 'a.f'").withColumn("signature", F.lit("def f(new)"))
    store.upsert_nodes(node.withColumn("n", F.lit(1)).unionByName(node.withColumn("signature", F.lit("old")).withColumn("n", F.lit(0))), "n")
    assert store.read("nodes").where("id = 'a.f'").first()["signature"] == "def f(new)" and store.read("nodes").count() == 2 and store.read("edges").count() == 3
    # An id that another file takes over is there once.
    put(store, spark, {"c.py": "x = 1\n"})
    taken = store.read("nodes").where("id = 'c.x'").withColumns({"id": F.lit("b.h"), "file": F.lit("c.py")})
    store.replace(taken, store.read("edges").limit(0), store.read("file_hashes").where("file = 'c.py'"))
    assert {(r["id"], r["file"]) for r in store.read("nodes").collect()} == {("a.f", "a.py"), ("b.h", "c.py")}


def call(src, dst, confidence=0.3, kind="calls"):
    return {"src": src, "dst": dst, "kind": kind, "confidence": confidence}


def test_receivers():
    sources = {
        "greeter": "class Greeter:\n    def greet(self, name): return name\n",
        "caller": "from greeter import Greeter\nimport lib.deep as deep\n\ndef make() -> Greeter: ...\n\nclass Box(Greeter):\n    kept: Greeter\n    def __init__(self, d: 'deep.Diver | None' = None):\n        self.inner = Greeter()\n        self.d = d\n    def run(self):\n        self.inner.greet(1); self.stop(); super().greet(2); self.d.dive(); self.kept.greet(4)\n    def stop(self): pass\n\ndef use(g: Greeter, n: int):\n    h = Greeter()\n    h.greet('world')\n    g.greet(n)\n    make().greet(3)\n    with Greeter() as w:\n        w.greet(5)\n    h = n\n    n.greet(0)\n",
        "broken": "def (",
    }
    unsure = [call("caller.use", x) for x in ("h.greet", "g.greet", "greet", "w.greet")] + [call("caller.Box.run", x) for x in ("self.inner.greet", "self.stop", "greet", "self.d.dive", "self.kept.greet")]
    got = receivers.resolve_calls(unsure, sources)
    assert [(e["dst"], e["confidence"]) for e in got] == [("h.greet", 0.3)] + [("greeter.Greeter.greet", 0.5)] * 4 + [("caller.Box.stop", 0.5), ("greeter.Greeter.greet", 0.5), ("lib.deep.Diver.dive", 0.5), ("greeter.Greeter.greet", 0.5)]
    same = [call("caller.use", "g.greet", 1.0), call("caller.use", "g.greet", 0.3, "mutates"), call("caller.use", "unknown_xyz"), call("nowhere.f", "g.greet"), call("broken.f", "g.greet"), call("caller.use", "greeter.Greeter.greet", 0.8)]
    assert receivers.resolve_calls(same, sources) == same and receivers.resolve_calls([], sources) == []
    assert receivers.source_of("a.b.c.d", {"a", "a.b"}) == "a.b" and receivers.source_of("x.y", {"a"}) is None


def test_route_context_and_python_patterns(spark):
    text = "\r\n".join(f"line{i}" for i in range(1, 21))
    nodes = spark.createDataFrame([("f", "function", "a.py", 10, 12), ("g", "method", "a.py", 2, 40)], "id string, kind string, file string, line_start int, line_end int")
    sources = spark.createDataFrame([("a.py", "python", text)], "file string, language string, content string")
    got = {r["symbol"]: r for r in routes.units_of(nodes, sources).collect()}
    assert got["f"]["context"].split("\n") == [f"line{i}" for i in range(5, 14)] and got["f"]["body"].split("\n") == ["line10", "line11", "line12"]
    assert got["g"]["context"].split("\n") == [f"line{i}" for i in range(1, 6)] and got["g"]["body"].split("\n")[-1] == "line20"
    row = "symbol string, language string, url_pattern string, method string, file string"
    calls = spark.createDataFrame([(u, "javascript", u, "GET", "f") for u in ("/x/12", "/x/ab", "http://h/y/3", "/z(1", "/q/{id}", "/api/a.b/c", "/ab/c")], row)
    listed = spark.createDataFrame([(u, "python", u, "ANY", "g") for u in (r"/x/(?P<k>\d+)", r"/y/\d", "/z(1", "/q/(", r"/api/[a-z.]+/c", "/ab/?c", "/u|/x/ab")], row)
    got = {(r["c_symbol"], r["r_symbol"]) for r in routes.matches(calls, listed).collect()}
    assert got == {("/x/12", r"/x/(?P<k>\d+)"), ("http://h/y/3", r"/y/\d"), ("/z(1", "/z(1"), ("/api/a.b/c", r"/api/[a-z.]+/c"), ("/ab/c", "/ab/?c"), ("/x/ab", "/u|/x/ab")}


def test_names_decide_before_content(spark, tmp_path):
    for name in ("_in/__init__.py", "_in/x.py", ".ci/y.py", "a.py", "[id].js", "node_modules/b.js", "gen/c.go", "d.md", "_e.py", "sub dir/F.PY", ".git/g.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"// {name}\n")
    (tmp_path / ".gitignore").write_text("gen/\n")
    (tmp_path / "node_modules/b.js").chmod(0)
    got = {r["file"]: bytes(r["content"]).decode() for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {n: f"// {n}\n" for n in ("a.py", "[id].js", "_e.py", "sub dir/F.PY", "_in/__init__.py", "_in/x.py", ".ci/y.py")}
    assert [r["file"] for r in files.pick(spark, str(tmp_path), ["[id].js", "none.py", "d.md", "[id].js"]).collect()] == ["[id].js"]
    assert files.scan(spark, str(tmp_path / "sub dir")).count() == 1 and files.pick(spark, str(tmp_path), []).count() == 0


def test_bursts_of_tables_and_streams_agree(spark):
    rows = [(f"p{i % 3}", "change" if i % 4 else "delete", t) for i, t in enumerate((0.0, 0.1, 0.3, 0.35, 0.66, 1.0, 1.3, 1.29, 2.0, 2.0, 2.31))]
    df = spark.createDataFrame(rows, "path string, op string, s double").select("path", "op", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    got = sorted((round(r["burst_start"].timestamp(), 3), round(r["burst_end"].timestamp(), 3), r["path"], r["op"]) for r in changelog.debounced(df).collect())
    bursts, events = [], sorted(rows, key=lambda r: (r[2], r[1]))
    for p, op, t in events:
        if not bursts or t - bursts[-1][1] >= 0.3:
            bursts.append([t, t, {}])
        bursts[-1][1] = t
        bursts[-1][2][p] = op
    assert got == sorted((round(a, 3), round(b + 0.3, 3), p, op) for a, b, ops in bursts for p, op in ops.items())


def test_listing_and_watcher(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f(): pass\n")
    (src / "b.py").write_text("def g(): pass\n")
    log = listing.TreeLog(spark, str(src), str(tmp_path / "log"))
    assert log.poll() == 0
    (src / "a.py").unlink()
    (src / "b.py").write_text("def g2(): pass # longer\n")
    (src / "c.py").write_text("x = 1\n")
    assert log.poll() == 3 and log.poll() == 0
    assert {(r["path"], r["op"]) for r in spark.read.schema(changelog.SCHEMA).parquet(log.log).collect()} == {("a.py", "delete"), ("b.py", "modify"), ("c.py", "create")}

    project = Project(spark, str(src), str(tmp_path / "store"))
    project.index()
    project.watch(str(tmp_path / "watch"), every=0.2)
    try:
        (src / "b.py").unlink()
        (src / "d.py").write_text("def new(): pass\n")
        end = time.time() + 90
        ids = set()
        while time.time() < end and ids != {"c.x", "d.new"}:
            time.sleep(0.5)
            ids = {r["id"] for r in project.nodes.collect()}
        assert ids == {"c.x", "d.new"}
    finally:
        project.unwatch()
    assert project.watcher is None


def test_tool_server(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "auth.py").write_text('def login(x):\n    """Log in."""\n    return check(x)\n\ndef check(x):\n    return x\n')
    opened = []

    def open_():
        opened.append(1)
        return Project(spark, str(src), str(tmp_path / "store"))

    server = Server(open_)
    ask = [{"method": "initialize"}, {"method": "tools/list"}, {"method": "tools/call", "params": {"name": "get_symbol", "arguments": {"symbol_id": "auth.login"}}}, {"method": "tools/call", "params": {"name": "semantic_search", "arguments": {"query": "log in"}}}, {"method": "tools/call", "params": {"name": "none"}}, {"method": "odd"}, {"method": "tools/call", "params": {"name": "get_symbol", "arguments": {}}}]
    lines = [json.dumps({"jsonrpc": "2.0", "id": i, **m}) for i, m in enumerate(ask)] + ['{"jsonrpc": "2.0", "method": "notifications/initialized"}', "not json"]
    out = io.StringIO()
    server.serve(io.StringIO("\n".join(lines[:2]) + "\n"), out)
    assert not opened
    server.serve(io.StringIO("\n".join(lines[2:]) + "\n"), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(opened) == 1 and [r.get("id") for r in replies] == [*range(7), None]
    tools = {t["name"]: t["inputSchema"] for t in replies[1]["result"]["tools"]}
    assert set(tools) == set(TOOLS) and tools["get_symbol"]["required"] == ["symbol_id"] and tools["get_call_graph"]["properties"]["max_hops"] == {"type": "integer", "default": 3}
    answer = json.loads(replies[2]["result"]["content"][0]["text"])
    assert answer["id"] == "auth.login" and answer["source"].startswith("def login") and [e["dst"] for e in answer["edges_out"]] == ["auth.check"] and answer["edges_in"] == []
    assert json.loads(replies[3]["result"]["content"][0]["text"])["results"][0]["id"] == "auth.login"
    assert "error" in replies[4] and "error" in replies[5] and replies[6]["result"]["isError"] and replies[7]["error"]["code"] == -32700


@pytest.mark.parametrize("direction", ["callees", "callers", "both"])
def test_large_fronts_meet_dealt_edges(spark, monkeypatch, direction):
    rows = [(i, f"v{i % 17}", f"v{(i * 7 + 3) % 23}", "calls", 1.0) for i in range(60)]
    edges = spark.createDataFrame(rows, "edge_id long, src string, dst string, kind string, confidence double")
    plain = traverse.subgraph(edges, "v1", direction, 4)
    want = [sorted(map(str, df.collect())) for df in (plain.nodes, plain.edges.select("edge_id", "hops", "ord"), traverse.reach(edges, "v1", direction, 4))]
    monkeypatch.setattr(traverse, "FRONT_SENT", 0)
    other = traverse.subgraph(edges, "v1", direction, 4)
    assert [sorted(map(str, df.collect())) for df in (other.nodes, other.edges.select("edge_id", "hops", "ord"), traverse.reach(edges, "v1", direction, 4))] == want
    assert {(r["id"], r["hop"]) for r in other.nodes.collect()} == {tuple(r) for r in traverse.reach(edges, "v1", direction, 4).collect()}
