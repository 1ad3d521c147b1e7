"""Scan, extraction, snapshots, routes, change log and rendering on small projects."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import render
from weftline.operators import routes
from weftline.plans.engine import Project
from weftline.sources import extract, files, pythoncode, textcode
from weftline.streaming import changelog

SOURCES = {
    "auth.py": 'import hashlib\nfrom utils.helpers import clean\n\nclass Base:\n    def run(self):\n        return 1\n\nclass Session(Base):\n    """A session."""\n    def __init__(self):\n        self.token = None\n\n    def run(self):\n        open("x")\n        return clean(1)\n\ndef create_token(user: str, n=1, *a, **k) -> str:\n    """Create a JWT token."""\n    return hashlib.sha256(user).hexdigest()\n\nLIMIT: int = 3\n',
    "views.py": 'from auth import create_token\n\n@app.get("/api/users/:id")\ndef login(r):\n    return create_token(r)\n',
    "test_auth.py": "from auth import create_token\n\ndef test_create():\n    assert create_token('x') == 'y'\n",
    "web/app.js": 'import { h } from "./lib";\n\nfunction load(id) {\n  return fetch("http://host/api/users/7");\n}\n\nclass View extends Base {\n  show() {\n    this.n = load(1);\n  }\n}\n',
    "utils/__init__.py": "",
    "utils/helpers.py": "def clean(x):\n    return x\n",
    "broken.py": "def (",
    "node_modules/skip.js": "function no() {}",
    "generated/out.py": "def no(): pass\n",
    ".gitignore": "# none\n\ngenerated\n",
}


@pytest.fixture()
def project(spark, tmp_path):
    for name, text in SOURCES.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    return Project(spark, str(tmp_path / "src"), str(tmp_path / "store"))


def ids(df):
    return {r[0] for r in df.select("id").collect()}


def test_index_answers_and_reindex(project, tmp_path):
    first = project.index().first()
    assert first["files_parsed"] == 7 and first["files_skipped"] == 0
    assert {"auth.Session.run", "auth.create_token", "auth.LIMIT", "web.app.View.show", "utils.helpers.clean"} <= ids(project.nodes)
    e = {(r["src"], r["dst"], r["kind"], r["confidence"]) for r in project.edges.collect()}
    assert ("views.login", "auth.create_token", "calls", 0.8) in e
    assert ("auth.Session.run", "auth.Base.run", "overrides", 1.0) in e
    assert ("auth.Session.run", "side_effect:file_io:open", "side_effect", 1.0) in e
    assert ("auth.Session.__init__", "auth.Session.token", "mutates", 1.0) in e
    assert ("test_auth.test_create", "auth.create_token", "asserts_on", 1.0) in e
    assert ("auth", "utils.helpers.clean", "imports", 1.0) in e
    again = project.index().first()
    assert again["files_parsed"] == 0 and again["files_skipped"] == 7
    # A change replaces what its file produced and nothing else.
    (tmp_path / "src/utils/helpers.py").write_text("def tidy(x):\n    return x\n")
    before = project.edges.count()
    assert project.index().first()["files_parsed"] == 1
    assert "utils.helpers.tidy" in ids(project.nodes) and "utils.helpers.clean" not in ids(project.nodes) and project.edges.count() == before
    full = Project(project.spark, project.root, str(tmp_path / "other"))
    full.index()
    assert ids(full.nodes) == ids(project.nodes) and full.edges.count() == project.edges.count()
    project.delete_files(["views.py"])
    assert "views.login" not in ids(project.nodes) and project.store.vacuum() >= 2
    assert project.index_files(["views.py", "none.py", "x.txt"]).first()["files_parsed"] == 1

    graph = project.call_graph("auth.create_token", "callers")
    assert {n["id"] for n in graph["nodes"]} == {"auth.create_token", "views.login", "test_auth.test_create"}
    answer = project.impact_analysis("auth.create_token")
    assert answer["at_risk"] and sum(answer["summary"][k] for k in ("high_risk", "medium_risk", "low_risk")) == len(answer["at_risk"])
    assert project.semantic_search("JWT token")["results"][0]["id"] == "auth.create_token"
    assert "def create_token" in project.get_symbol("auth.create_token")["source"] and "error" in project.get_symbol("no.such")
    assert project.project_map()["graph_stats"]["total_nodes"] == project.nodes.count()
    assert [m["symbol"] for m in project.find_mutations("auth.Session.token")["mutated_by"]] == ["auth.Session.__init__"]
    rows = project.cross_language_edges()["cross_language_edges"]
    assert [(r["caller"], r["handler"], r["contract"], r["confidence"]) for r in rows] == [("web.app.load", "views.login", "GET /api/users/:id", 0.7)] * 2
    assert "auth.create_token (root)" in project.visualize_graph("auth.create_token") and "```mermaid" in project.visualize_impact("auth.create_token", format="mermaid")
    assert json.loads(project.answer("project_map"))["entry_points"]


def test_failed_write_keeps_the_old_state(project):
    project.index()
    before = project.store.version(), project.nodes.count()
    bad = project.nodes.withColumn("id", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        project.store.write({"nodes": bad, "edges": project.edges, "file_hashes": project.store.read("file_hashes")})
    assert (project.store.version(), project.nodes.count()) == before


def test_module_and_language_names(spark):
    cases = {"main.py": "main", "src/auth/utils.py": "src.auth.utils", "src/auth/__init__.py": "src.auth", "__init__.py": "", "a/b.tsx": "a.b"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", files.module_of(F.col("p"))).collect()} == cases
    got = spark.createDataFrame([("a.PY",), ("b.txt",), ("c",)], "p string").select(files.language_of(F.col("p"))).collect()
    assert [r[0] for r in got] == ["python", None, None]


def test_routes(spark):
    cases = [
        ("/api/users", "/api/users", "GET", "GET", True),
        ("/api/users", "/api/users", "POST", "GET", False),
        ("/api/users", "/api/users", "POST", "ANY", True),
        ("/api/users/12", "/api/users/:id", "GET", "GET", True),
        ("/api/users/12/", "/api/users/{id}", "GET", "GET", True),
        ("https://host:1/api/users?x", "/api/users", "GET", "GET", False),
        ("https://host:1/api/users", "/api/users", "GET", "GET", True),
        ("/api/users/{uid}", "/api/users/:id", "GET", "GET", False),
        ("/aXb", "/a.b", "GET", "GET", True),
        ("/a/b", "/a.b", "GET", "GET", True),
        ("/a(b", "/a(b", "GET", "GET", True),
        ("/x/orders", "/:any/orders", "GET", "GET", True),
    ]
    row = "symbol string, language string, url_pattern string, method string, file string"
    calls = spark.createDataFrame([(f"c{i}", "javascript", c[0], c[2], "f") for i, c in enumerate(cases)], row)
    listed = spark.createDataFrame([(f"r{i}", "python", c[1], c[3], "g") for i, c in enumerate(cases)], row)
    got = {(r["c_symbol"], r["r_symbol"]) for r in routes.matches(calls, listed).collect()}
    for i, c in enumerate(cases):
        assert ((f"c{i}", f"r{i}") in got) == c[4], c


def test_text_languages():
    nodes, edges = textcode.parse(b'package main\n\nimport "net/http"\n\n// Handler serves.\nfunc Handler(w http.ResponseWriter) {\n\thelper()\n\thttp.Get("/x")\n}\n\nfunc helper() {}\n', "main", "main.go", "go")
    assert {n["id"] for n in nodes} == {"main.Handler", "main.helper"} and nodes[0]["docstring"] == "Handler serves."
    kinds = {(e["dst"], e["kind"], e["confidence"]) for e in edges}
    assert {("main.helper", "calls", 1.0), ("http.Get", "calls", 0.3), ("side_effect:network:http.Get", "side_effect", 1.0), ("net/http", "imports", 1.0)} <= kinds
    nodes, edges = textcode.parse(b"import com.x.Foo;\n\npublic class A extends B {\n  public int f(int x) {\n    this.n = 1;\n    return g(x);\n  }\n  int g(int x) { return x; }\n}\n", "A", "A.java", "java")
    assert {n["id"]: n["kind"] for n in nodes} == {"A.A": "class", "A.A.f": "method", "A.A.g": "method"}
    assert {("B", "inherits"), ("A.A.g", "calls"), ("A.A.n", "mutates"), ("com.x.Foo", "imports")} <= {(e["dst"], e["kind"]) for e in edges}
    nodes, _ = textcode.parse(b"use std::fs;\nstruct S;\nimpl S {\n    pub fn go(&self) { go2(); }\n}\nfn go2() {}\n", "m", "m.rs", "rust")
    assert {"m.S", "m.S.go", "m.go2"} <= {n["id"] for n in nodes}


def test_python_details():
    f = pythoncode.parse(b"import a.b as c\ndef f(x, /, y: int = 2, *z, k=1, **kw) -> int:\n    def g(): c.d()\n    os.system('x'); v = q(1).r()\n", "m", "m.py")
    assert f.nodes[0]["signature"] == "def f(y: int = 2, *z, **kw) -> int"
    assert {("a.b.d", "calls", 0.8), ("r", "calls", 0.3), ("side_effect:process:os.system", "side_effect", 1.0), ("m.v", "mutates", 0.8)} <= {(e["dst"], e["kind"], e["confidence"]) for e in f.edges}
    assert pythoncode.parse(b"def (", "m", "m.py").nodes == []
    with pytest.raises(UnicodeDecodeError):
        pythoncode.parse(b"\xff\xfe", "m", "m.py")
    assert ".py" in extract.supported_extensions() and extract.get_parser("A/b.TSX") and extract.get_parser("a.md") is None


def test_debounced_stream(spark, tmp_path):
    log = [("a.py", "modify", 0.0, None), ("a.py", "modify", 0.1, None), ("b.txt", "create", 0.1, None), ("old.py", "move", 0.2, "new.py"), ("a.py", "delete", 5.0, None), ("node_modules/x.js", "modify", 5.0, None), ("late.py", "create", 60.0, None)]
    rows = spark.createDataFrame([(p, o, t, q) for p, o, t, q in log], "path string, op string, s double, dest_path string").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
    batch = {(r["burst_start"].timestamp(), r["path"], r["op"]) for r in changelog.debounced(changelog.events(rows)).collect()}
    assert batch == {(0.0, "a.py", "change"), (0.0, "old.py", "delete"), (0.0, "new.py", "change"), (5.0, "a.py", "delete"), (60.0, "late.py", "change")}
    rows.select("path", "op", "ts", "dest_path").coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(changelog.SCHEMA).parquet(str(tmp_path / "log"))
    done = []
    query = changelog.start(stream, lambda p: done.append(("delete", p)), lambda p: done.append(("change", p)), str(tmp_path / "ck"), trigger={"availableNow": True})
    query.awaitTermination(120)
    # The last burst is still open when the log ends.
    assert ("delete", ["a.py", "old.py"]) in done and ("change", ["new.py"]) in done


def test_rendering_and_cap():
    small = {"a": [1, 2]}
    assert render.capped(small) is small
    big = render.capped({"root": "x", "items": ["y" * 1000] * 100})
    assert big["truncated"] and len(big["items"]) == 5
    nodes = [{"id": "r", "is_public": 1, "is_test": 0}, {"id": "a", "is_public": 0, "is_test": 1}]
    edges = [{"src": "a", "dst": "r", "kind": "calls", "confidence": 1.0}] * 2 + [{"src": "r", "dst": "z", "kind": "mutates", "confidence": 0.4}]
    text = render.tree("r", nodes, edges, [["r", "a", "r"]])
    assert text.splitlines() == ["r (root)", "├── ← a [calls, 1.0] ⚠ TEST private", "└── → z [mutates, 0.4]", "", "⚠ Cycles detected: 1", "  r → a → r"]
    assert render.tree("q", [], edges, []) == "q (no connections found)"
    assert 'N1 -->|"calls 1.0"| N0' in render.mermaid("r", nodes, edges) and "mutates" not in render.mermaid("r", nodes, edges)
    risk = [{"symbol": "s", "risk_score": 0.9, "risk_factors": ["f"], "distance": 1, "is_test": 1}, {"symbol": "t", "risk_score": 0.1, "risk_factors": ["g"], "distance": 2, "is_test": 0}]
    summary = {"high_risk": 1, "medium_risk": 0, "low_risk": 1, "tests_at_risk": 1}
    text = render.impact_tree("c", risk, summary)
    assert "│ ▲ 0.9    s [f] ⚠ TEST" in text and "  ▲ 0.1    t\n" in text and "1 high, 0 medium, 1 low, 1 test(s)" in text
    assert "ROOT -.-> R1" in render.mermaid_impact("c", risk, summary)


def test_long_comments_are_whole():
    rows = [f"line {i} of the comment" for i in range(300)]
    block = "/* other */\nlet x = 1; // no\n/**\n" + "\n".join(rows) + "\n*/\nfunction f() {}\n"
    lines = "x()\n" + "\n".join(f"// {r}" for r in rows) + "\nfunction f() {}\n"
    for source, shown in ((block, "\n".join(rows)), (lines, "\n// ".join(rows)), ("// one\nfunction f() {}\n", "one"), ("x() // no\nfunction f() {}\n", None), ("function f() {}\n", None)):
        nodes, _ = textcode.parse(source.encode(), "m", "m.js", "javascript")
        assert nodes[0]["id"] == "m.f" and nodes[0]["docstring"] == shown
