"""Registered queries from source text, stores and change logs to answers, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import projects, render, views
from weftline.functions.lineage import checkpoint_dir, indexed, settle
from weftline.functions.views import table
from weftline.operators import impact, overview, routes, search, traverse
from weftline.plans import snapshot
from weftline.sources import extract, files
from weftline.streaming import changelog, listing

#: What supplier files of even keys become in a second batch.
CHANGED = projects.PYTHON._replace(
    text="from lib.n{m} import tool\n\ndef serve_{k}(r):\n    return tool(r)\n",
    nodes=(("sup.s{k}.serve_{k}", "function", 3, 4, "def serve_{k}(r)", None, 0),),
    edges=(("sup.s{k}.serve_{k}", "lib.n{m}.tool", "calls", 0.8), ("sup.s{k}", "lib.n{m}.tool", "imports", 1.0)),
)
SEARCHED, SEARCHED_KINDS = "supplier 1", ["function", "class"]
GAP_MINUTES = 10
NODE_COLUMNS = ("id", "kind", "file", "line_start", "line_end", "signature", "docstring", "is_public", "is_test")


def _facts(spark, d, templates=projects.TEMPLATES) -> DataFrame:
    return settle(extract.facts(projects.source_files(spark, d, templates)))


def extract_nodes(spark, d):
    rows = extract.node_rows(_facts(spark, d))
    return rows.select(*(F.col(c).cast("long") if c.startswith(("line", "is_")) else F.col(c) for c in NODE_COLUMNS))


def extract_edges(spark, d):
    return extract.edge_rows(_facts(spark, d)).select("src", "dst", "kind", "confidence", "file")


def source_contracts(spark, d):
    """From source text to the routes that client calls fit."""
    some = (projects.PYTHON, projects.SCRIPT)
    nodes = extract.node_rows(_facts(spark, d, some))
    sources = projects.source_files(spark, d, some).select("file", "language", F.col("content").cast("string").alias("content"))
    units = settle(routes.units_of(nodes, sources))
    return routes.contracts(routes.client_calls(units), routes.route_definitions(units)).select("caller", "handler", "contract", "confidence")


def _store(spark, d) -> snapshot.Store:
    """A store after three batches (supplier files and tests; even suppliers changed; scripts of some customers) and a deletion (suppliers of keys that 5 divides)."""
    store = snapshot.Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", buckets=4)

    def put(found: DataFrame) -> None:
        facts = settle(extract.facts(found))
        store.replace(extract.node_rows(facts), extract.edge_rows(facts, store.next_edge()), found.select("file", "sha256", F.lit(0).cast("long").alias("indexed_at")))

    put(projects.source_files(spark, d, (projects.PYTHON, projects.TEST)))
    put(projects.source_files(spark, d, (CHANGED,)).where("cast(regexp_extract(file, '[0-9]+', 0) as int) % 2 = 0"))
    put(projects.source_files(spark, d, (projects.SCRIPT,)).where("cast(regexp_extract(file, '[0-9]+', 0) as int) < 40"))
    gone = table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(F.concat(F.lit("sup/s"), "s_suppkey", F.lit(".py"))).collect()
    store.delete([r[0] for r in gone])
    return store


def store_after_batches(spark, d):
    """Every row of the store's nodes, edges and hashes; an edge_id is there once."""
    nodes, edges, hashes = _store(spark, d).tables()
    shown = lambda df, what, id_, dst, kind, n: df.select(F.lit(what).alias("what"), id_.alias("id"), dst.alias("dst"), kind.alias("kind"), "file", n.cast("long").alias("n"))
    none = F.lit(None).cast("string")
    counted = edges.groupBy("edge_id").agg(F.count("*").alias("n"), F.first(F.struct("src", "dst", "kind", "file")).alias("e")).select("e.*", "n")
    return shown(nodes, "node", F.col("id"), none, F.col("kind"), F.col("line_end")).unionByName(shown(counted, "edge", F.col("src"), F.col("dst"), F.col("kind"), F.col("n"))).unionByName(shown(hashes, "hash", F.col("sha256"), none, none, F.col("indexed_at")))


def store_search(spark, d):
    """The stored index of three columns, searched for two phrases among some kinds."""
    return _store(spark, d).search(SEARCHED, SEARCHED_KINDS, 15).select("id", "kind", F.round("score", 6).alias("score"))


def search_columns_kind(spark, d):
    nodes = extract.node_rows(_facts(spark, d, (projects.PYTHON, projects.TEST)))
    return search.search(nodes, SEARCHED, SEARCHED_KINDS, 15).select("id", "kind", F.round("score", 6).alias("score"))


def token_postings(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return search.postings(docs, "id", ["text"]).where("token like 'th%'").select("id", "token", F.size("places").cast("long").alias("n"), F.get("places", F.lit(0)).cast("long").alias("first"))


def debounced_changes(spark, d):
    out = changelog.debounced(views.change_log(spark, d).select(F.col("path").cast("string").alias("path"), "op", "ts"), f"{GAP_MINUTES} minutes")
    return out.select(F.unix_micros("burst_start").alias("first_us"), (F.unix_micros("burst_end") - GAP_MINUTES * 60_000_000).alias("last_us"), "path", "op")


def changed_listings(spark, d):
    """What two listings of a tree differ in."""
    new = table(spark, d, "documents").where("doc_id % 11 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.timestamp_seconds(F.col("doc_id") % 7 + F.when(F.col("doc_id") % 5 == 0, 9).otherwise(0)).alias("modified"), F.length("text").cast("long").alias("length"))
    old = table(spark, d, "documents").where("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.timestamp_seconds(F.col("doc_id") % 7).alias("modified"), F.length("text").cast("long").alias("length"))
    return listing.differences(old, new).select("path", "op")


def file_rules(spark, d):
    """Language, module, skipped and ignored, of paths made of the documents' rows."""
    name = F.element_at(F.array(*(F.lit(x) for x in PATHS)), (F.col("doc_id") % len(PATHS) + 1).cast("int"))
    rows = table(spark, d, "documents").select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.replace(name, F.lit("#"), F.col("doc_id").cast("string"))).alias("path"))
    return rows.select("path", files.language_of(F.col("path")).alias("language"), files.module_of(F.col("path")).alias("module"), files.skipped(F.col("path")).alias("skipped"), files.ignored(F.col("path"), list(IGNORED)).alias("ignored"), changelog.watched(F.col("path")).alias("watched"))


PATHS = ("a#.py", "__init__.py", "pkg/__init__.py", "node_modules/x#.js", "b/c.d/#.TSX", "gen/out#.go", "lib/#.rs", "J#.java", "notes#.md", "venv", "build.log/k#.py", "x_gen.py")
#: Ignore patterns, and what they match as RE2 of a whole path.
IGNORED = {"gen": r"(^|.*/)gen(/.*)?", "*.rs": r".*\.rs(/.*)?", "build.l?g/": r"(^|.*/)build\.l.g(/.*)?", "x_[a-h]en.py": r"(^|.*/)x_[a-h]en\.py(/.*)?"}


def edges_appended(spark, d):
    """Edges that lack columns, with their defaults."""
    edges = views.star_edges(spark, d).where("kind <> 'asserts_on'").select("src", "dst", "kind", F.when(F.col("kind") == "calls", F.col("confidence")).alias("confidence"))
    return snapshot.with_defaults(edges).select("src", "dst", "kind", "confidence", F.col("weight").cast("long").alias("weight"), "scope", "detail")


def _impact(spark, d, root, hops):
    from weftline.queries import _star

    nodes, edges = _star(spark, d, True)
    return impact.at_risk(nodes, edges, root, hops, with_factors=False)


def impact_positions(spark, d):
    """The ranked order of an answer."""
    from weftline.queries import ROOT

    risks = _impact(spark, d, ROOT, 4)
    return indexed(risks.select("symbol", "risk_score", "distance", "ord"), "pos", F.desc("risk_score"), "distance", "ord").select("pos", "symbol", "risk_score")


def impact_chart_lines(spark, d):
    """The lines of dependents in the chart of an answer."""
    from weftline.queries import MIDDLE

    rows = [r.asDict() for r in impact.ranked(_impact(spark, d, MIDDLE, 1)).collect()]
    summary = impact.summary(_impact(spark, d, MIDDLE, 1)).first().asDict()
    lines = [x for x in render.mermaid_impact(MIDDLE, rows, summary).splitlines() if x.startswith("    R")]
    return spark.createDataFrame(list(enumerate(lines)), "pos long, line string")


def tree_lines(spark, d):
    """The text tree around an event type, line by line."""
    found = traverse.subgraph(views.event_edges(spark, d), "click", "both", 2)
    nodes = [{"id": r["id"], "is_public": 1, "is_test": 0} for r in found.nodes.select("id").collect()]
    edges = [r.asDict() for r in found.ordered_edges().select("src", "dst", "kind", "confidence").collect()]
    return spark.createDataFrame(list(enumerate(render.tree("click", nodes, edges, []).splitlines())), "pos long, line string")


def impact_tree_lines(spark, d):
    """Headings and dependents of the text tree of an answer."""
    from weftline.queries import MIDDLE

    risks = settle(_impact(spark, d, MIDDLE, 1))
    text = render.impact_tree(MIDDLE, [r.asDict() for r in impact.ranked(risks).collect()], impact.summary(risks).first().asDict())
    return spark.createDataFrame(list(enumerate(x for x in text.splitlines() if "▲" in x or "──" in x)), "pos long, line string")


def project_map_rows(spark, d):
    """The whole overview as rows."""
    from weftline.queries import _star

    nodes, edges = _star(spark, d, True)
    part = lambda df, section, name, n: df.select(F.lit(section).alias("section"), name.alias("name"), n.cast("double").alias("n"))
    stats, cover = overview.stats(nodes, edges), overview.coverage(nodes, edges)
    parts = [
        part(overview.modules(nodes), "functions", F.col("module"), F.col("functions")),
        part(overview.modules(nodes), "classes", F.col("module"), F.col("classes")),
        part(overview.entry_points(nodes, edges), "entry", F.col("id"), F.lit(1)),
        part(overview.hot_symbols(nodes, edges), "hot", F.col("id"), F.col("in_degree")),
        *(part(cover, "coverage", F.lit(c), F.col(c)) for c in ("total_public", "covered", "coverage_pct")),
        *(part(stats, "stats", F.lit(c), F.col(c)) for c in ("total_nodes", "total_edges")),
        part(overview.edge_breakdown(edges), "kinds", F.col("kind"), F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_scope_rows(compat: bool):
    """The rows of nodes and edges that a replaced file leaves and brings."""

    def run(spark, d):
        from weftline.queries import _star

        nodes, edges = _star(spark, d)
        owner = lambda c: F.when(F.col(c).startswith("c:"), "customers").otherwise("rest")
        edges, nodes = edges.withColumn("file", owner("src")), nodes.withColumn("file", owner("id"))
        hashes = spark.createDataFrame([("customers", "x", 0), ("rest", "y", 0)], "file string, sha256 string, indexed_at long")
        new = (nodes.where("file = 'customers' and line_start % 2 = 0"), edges.where("file = 'customers' and edge_id % 2 = 0"), hashes.where("file = 'customers'"))
        n, e, _ = snapshot.replace_files((nodes, edges, hashes), new, compat)
        return n.select(F.lit("node").alias("what"), "id", F.lit(None).cast("string").alias("dst"), "file").unionByName(e.select(F.lit("edge").alias("what"), F.col("src").alias("id"), "dst", "file"))

    return run


def file_delete_rows(spark, d):
    from weftline.queries import _star

    nodes, edges = _star(spark, d)
    gone = spark.createDataFrame([("supplier",), ("BUILDING",)], "file string")
    hashes = spark.createDataFrame([], "file string, sha256 string, indexed_at long")
    n, e, _ = snapshot.without_files(nodes.withColumn("file", F.col("module")), edges.withColumn("file", F.lit("x")), hashes, gone, compat=True)
    return n.select("id", F.lit(None).cast("string").alias("dst")).unionByName(e.select(F.col("src").alias("id"), "dst"))


def queries() -> dict:
    return {
        "extract_nodes": extract_nodes,
        "extract_edges": extract_edges,
        "source_contracts": source_contracts,
        "store_after_batches": store_after_batches,
        "store_search": store_search,
        "search_columns_kind": search_columns_kind,
        "token_postings": token_postings,
        "debounced_changes": debounced_changes,
        "changed_listings": changed_listings,
        "file_rules": file_rules,
        "edges_appended": edges_appended,
        "impact_positions": impact_positions,
        "impact_chart_lines": impact_chart_lines,
        "tree_lines": tree_lines,
        "impact_tree_lines": impact_tree_lines,
        "project_map_rows": project_map_rows,
        "file_scope_rows": file_scope_rows(False),
        "file_scope_rows_compat": file_scope_rows(True),
        "file_delete_rows": file_delete_rows,
    }


# --- the same in SQL --------------------------------------------------------------------------


def _search_sql(nodes: str, kinds: list[str], limit: int) -> str:
    """BM25 of the single-word phrases of SEARCHED over three columns."""
    words = [p[0] for p in search.phrases(SEARCHED)]
    cut = lambda c: f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    counts = ", ".join(f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE) AS f{i}" for i, w in enumerate(words))
    figures = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(words)))
    idf = lambda i: f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN {search.LEAST_IDF} ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END)"
    score = "CAST(0.0 AS DOUBLE)" + "".join(f" - {idf(i)} * f{i} * {search.K1 + 1} / (f{i} + {search.K1} * (1 - {search.B} + {search.B} * dl / avgdl))" for i in range(len(words)))
    return f"""WITH n AS ({nodes}), tok AS (SELECT id, kind, list_concat(list_concat({cut("id")}, {cut("signature")}), {cut("docstring")}) AS t FROM n),
f AS (SELECT id, kind, CAST(len(t) AS DOUBLE) AS dl, {counts} FROM tok), g AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {figures} FROM f)
SELECT id, kind, round({score}, 6) AS score FROM f, g WHERE {" AND ".join(f"f{i} > 0" for i in range(len(words)))} AND kind IN ({", ".join(f"'{k}'" for k in kinds)}) ORDER BY 3, 1 LIMIT {limit}"""


def _after_batches(what: str) -> str:
    """Nodes or edges of the store after its batches."""
    sql = projects.nodes_sql if what == "nodes" else projects.edges_sql
    number = "CAST(regexp_extract(file, '[0-9]+') AS INT)"
    return f"""SELECT * FROM ({sql((projects.PYTHON,))}) WHERE {number} % 2 <> 0 AND {number} % 5 <> 0
UNION ALL SELECT * FROM ({sql((projects.TEST,))})
UNION ALL SELECT * FROM ({sql((CHANGED,))}) WHERE {number} % 2 = 0 AND {number} % 5 <> 0
UNION ALL SELECT * FROM ({sql((projects.SCRIPT,))}) WHERE {number} < 40"""


def _hashes_sql() -> str:
    number = "CAST(regexp_extract(file, '[0-9]+') AS INT)"
    of = lambda t: f"SELECT {projects._sql_filled(t.path, t)} AS file, sha256({projects._sql_filled(t.text, t)}) AS sha FROM {t.table}"
    return f"""SELECT * FROM ({of(projects.PYTHON)}) WHERE {number} % 2 <> 0 AND {number} % 5 <> 0
UNION ALL SELECT * FROM ({of(projects.TEST)}) UNION ALL SELECT * FROM ({of(CHANGED)}) WHERE {number} % 2 = 0 AND {number} % 5 <> 0
UNION ALL SELECT * FROM ({of(projects.SCRIPT)}) WHERE {number} < 40"""


def oracle_sql() -> dict[str, str]:
    from weftline import queries as q

    paths = ", ".join(f"'{p}'" for p in PATHS)
    ignored = " OR ".join(f"regexp_full_match(path, '{p}')" for p in IGNORED.values())
    folders = ", ".join(f"'{x}'" for x in files.SKIPPED_FOLDERS)
    languages = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in files.EXTENSIONS.items())
    extensions = ", ".join(f"'{k}'" for k in files.EXTENSIONS)
    suffix = r"regexp_extract(path, '(\.[^./]+)$', 1)"
    callable_ = "kind IN ('function', 'method')"
    part = lambda section, name, n, rest: f"SELECT '{section}' AS section, {name} AS name, CAST({n} AS DOUBLE) AS n {rest}"
    degree = "SELECT n.id, coalesce(d.c, 0) AS c FROM n LEFT JOIN (SELECT dst, count(*) AS c FROM e GROUP BY dst) d ON d.dst = n.id ORDER BY 2 DESC, 1 LIMIT 10"

    def scope(compat: bool) -> str:
        gone = "SELECT id FROM n1 WHERE file = 'customers'"
        kept = f"src NOT IN ({gone}) AND dst NOT IN ({gone})" if compat else "file <> 'customers'"
        return f"""WITH {q._E}, {q._N}, e1 AS (SELECT *, CASE WHEN src LIKE 'c:%' THEN 'customers' ELSE 'rest' END AS file FROM e), n1 AS (SELECT id, line_start, CASE WHEN id LIKE 'c:%' THEN 'customers' ELSE 'rest' END AS file FROM n)
SELECT 'node' AS what, id, CAST(NULL AS VARCHAR) AS dst, file FROM n1 WHERE file <> 'customers' OR line_start % 2 = 0
UNION ALL SELECT 'edge', src, dst, file FROM e1 WHERE {kept} UNION ALL SELECT 'edge', src, dst, file FROM e1 WHERE file = 'customers' AND edge_id % 2 = 0"""

    risk = q._RISK
    middle = risk.replace(f"'{q.ROOT}'", f"'{q.MIDDLE}'")
    return {
        "extract_nodes": f"SELECT id, kind, file, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end, signature, docstring, CAST(is_public AS BIGINT) AS is_public, CAST(is_test AS BIGINT) AS is_test FROM ({projects.nodes_sql()})",
        "extract_edges": projects.edges_sql(),
        "source_contracts": "SELECT 'web.c' || c_custkey || '.C' || c_custkey || '.load' AS caller, 'sup.s' || s_suppkey || '.serve_' || s_suppkey AS handler, 'GET /api/s' || s_suppkey || '/:id' AS contract, CAST(0.7 AS DOUBLE) AS confidence FROM customer JOIN supplier ON s_suppkey = c_custkey % 10, (VALUES (1), (2)) twice(x)",
        "store_after_batches": f"SELECT 'node' AS what, id, CAST(NULL AS VARCHAR) AS dst, kind, file, CAST(line_end AS BIGINT) AS n FROM ({_after_batches('nodes')}) UNION ALL SELECT 'edge', src, dst, kind, file, CAST(1 AS BIGINT) FROM ({_after_batches('edges')}) UNION ALL SELECT 'hash', sha, NULL, NULL, file, CAST(0 AS BIGINT) FROM ({_hashes_sql()})",
        "store_search": _search_sql(_after_batches("nodes"), SEARCHED_KINDS, 15),
        "search_columns_kind": _search_sql(projects.nodes_sql((projects.PYTHON, projects.TEST)), SEARCHED_KINDS, 15),
        "token_postings": f"WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, list_filter(string_split_regex(translate(lower(coalesce(text, '')), '{search._folds()[0]}', '{search._folds()[1]}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents), p AS (SELECT id, unnest(t) AS token, unnest(range(len(t))) AS place FROM t) SELECT id, token, count(*) AS n, min(place) AS first FROM p WHERE token LIKE 'th%' GROUP BY id, token",
        "debounced_changes": f"WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'change' END AS op, epoch_us(ts) AS u FROM events), a AS (SELECT *, lag(u) OVER (ORDER BY u) AS p FROM e), b AS (SELECT *, sum(CASE WHEN p IS NULL OR u - p >= {GAP_MINUTES * 60_000_000} THEN 1 ELSE 0 END) OVER (ORDER BY u, p NULLS FIRST ROWS UNBOUNDED PRECEDING) AS g FROM a), s AS (SELECT g, min(u) AS first_us, max(u) AS last_us FROM b GROUP BY g), l AS (SELECT g, path, op, row_number() OVER (PARTITION BY g, path ORDER BY u DESC, op DESC) AS r FROM b) SELECT s.first_us, s.last_us, l.path, l.op FROM l JOIN s ON s.g = l.g WHERE r = 1",
        "changed_listings": "WITH d AS (SELECT doc_id AS i, doc_id % 7 AS m, doc_id % 7 + CASE WHEN doc_id % 5 = 0 THEN 9 ELSE 0 END AS m2 FROM documents), b AS (SELECT coalesce(a.i, n.i) AS i, CASE WHEN a.i IS NULL THEN 'create' WHEN n.i IS NULL THEN 'delete' WHEN a.m <> n.m2 THEN 'modify' END AS op FROM (SELECT * FROM d WHERE i % 7 <> 0) a FULL JOIN (SELECT * FROM d WHERE i % 11 <> 0) n ON a.i = n.i) SELECT CAST(i AS VARCHAR) AS path, op FROM b WHERE op IS NOT NULL",
        "file_rules": f"WITH p AS (SELECT coalesce(source, 'none') || '/' || replace(([{paths}])[doc_id % {len(PATHS)} + 1], '#', CAST(doc_id AS VARCHAR)) AS path FROM documents), f AS (SELECT path, list_has_any(string_split(path, '/')[:-2], [{folders}]) AS skipped, list_has_any(string_split(path, '/'), [{folders}]) AS anywhere FROM p) SELECT path, CASE lower({suffix}) {languages} END AS language, replace(regexp_replace(regexp_replace(path, '\\.[^./]+$', ''), '(^|/)__init__$', ''), '/', '.') AS module, skipped, ({ignored}) AS ignored, {suffix} IN ({extensions}) AND NOT anywhere AS watched FROM f",
        "edges_appended": f"WITH {q._E} SELECT src, dst, kind, CASE WHEN kind = 'calls' THEN confidence ELSE 1.0 END AS confidence, CAST(1 AS BIGINT) AS weight, CAST(NULL AS VARCHAR) AS scope, CAST(NULL AS VARCHAR) AS detail FROM e WHERE kind <> 'asserts_on'",
        "impact_positions": f"WITH {q._EF}, {q._N},\n{q._walk_sql(q.ROOT, 'callers', 4)},\n{risk.replace('n.is_test,', 'n.is_test, r.rk,', 1)}\nSELECT row_number() OVER (ORDER BY round_even(score, 4) DESC, distance, rk) - 1 AS pos, symbol, round_even(score, 4) AS risk_score FROM risk",
        "impact_chart_lines": f"WITH {q._EF}, {q._N},\n{q._walk_sql(q.MIDDLE, 'callers', 1)},\n{middle.replace('n.is_test,', 'n.is_test, r.rk,', 1)},\no AS (SELECT *, row_number() OVER (ORDER BY round_even(score, 4) DESC, distance, rk) - 1 AS i FROM risk) SELECT 2 * i + 1 AS pos, '    R' || i || '[\"' || symbol || CASE WHEN is_test = 1 THEN ' ⚠' ELSE '' END || '<br/>risk: ' || CAST(round_even(score, 4) AS VARCHAR) || '\"]:::' || CASE WHEN round_even(score, 4) > 0.7 THEN 'high' WHEN round_even(score, 4) >= 0.3 THEN 'medium' ELSE 'low' END AS line FROM o UNION ALL SELECT 2 * i + 2, '    ROOT --> R' || i FROM o UNION ALL SELECT 0, '    ROOT[\"{q.MIDDLE}\"]:::changed'",
        "tree_lines": f"""WITH {q._V},
{q._walk_sql("click", "both", 2)},
s AS (SELECT *, row_number() OVER (ORDER BY hops, prk, o, eid) AS ix FROM seen),
nb AS (SELECT near, side, far, min(ix) AS ix FROM (SELECT dst AS near, 0 AS side, src AS far, ix FROM s UNION ALL SELECT src, 1, dst, ix FROM s) GROUP BY ALL),
f AS (SELECT side, far, row_number() OVER (ORDER BY side, ix) AS i, count(*) OVER () AS n FROM nb WHERE near = 'click'),
g AS (SELECT f.i, f.n, nb.side, nb.far, row_number() OVER (PARTITION BY f.i ORDER BY nb.side, nb.ix) AS j FROM f JOIN nb ON nb.near = f.far AND nb.far <> 'click'),
h AS (SELECT *, max(j) OVER (PARTITION BY i) AS m FROM g WHERE j <= 5),
l AS (SELECT 0 AS i, 0 AS j, 'click (root)' AS line UNION ALL SELECT i, 0, CASE WHEN i = n THEN '└' ELSE '├' END || '── ' || CASE side WHEN 0 THEN '←' ELSE '→' END || ' ' || far || ' [calls, 1.0]' FROM f
  UNION ALL SELECT i, j, CASE WHEN i = n THEN ' ' ELSE '│' END || '   ' || CASE WHEN j = m THEN '└' ELSE '├' END || '── ' || CASE side WHEN 0 THEN '←' ELSE '→' END || ' ' || far || ' [calls, 1.0]' FROM h)
SELECT row_number() OVER (ORDER BY i, j) - 1 AS pos, line FROM l""",
        "impact_tree_lines": f"""WITH {q._EF}, {q._N},
{q._walk_sql(q.MIDDLE, "callers", 1)},
{middle.replace("n.is_test,", "n.is_test, r.rk,", 1)},
o AS (SELECT *, round_even(score, 4) AS shown, row_number() OVER (ORDER BY round_even(score, 4) DESC, distance, rk) AS i FROM risk),
p AS (SELECT *, CASE WHEN shown > 0.7 THEN 1 WHEN shown >= 0.3 THEN 2 ELSE 3 END AS level FROM o),
c AS (SELECT level, level = 3 OR (level = 2 AND NOT EXISTS (SELECT 1 FROM p WHERE level = 3)) AS closes FROM p GROUP BY level),
l AS (SELECT level, 0 AS i, CASE WHEN level = 1 THEN '┌' WHEN closes THEN '└' ELSE '├' END || CASE level WHEN 1 THEN '{render._HEADINGS["high"]}' WHEN 2 THEN '{render._HEADINGS["medium"]}' ELSE '{render._HEADINGS["low"]}' END AS line FROM c
  UNION ALL SELECT p.level, i, CASE WHEN closes THEN ' ' ELSE '│' END || ' ▲ ' || CAST(shown AS VARCHAR) || repeat(' ', greatest(0, 5 - length(CAST(shown AS VARCHAR)))) || '  ' || symbol || CASE WHEN is_test = 1 THEN ' ⚠ TEST' ELSE '' END FROM p JOIN c ON c.level = p.level)
SELECT row_number() OVER (ORDER BY level, i) - 1 AS pos, line FROM l""",
        "project_map_rows": f"WITH {q._EF}, {q._N}, t AS (SELECT count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.kind = 'asserts_on' AND e.dst = n.id)) AS covered FROM n WHERE {callable_} AND is_public = 1)\n"
        + "\nUNION ALL ".join(
            [
                part("functions", "module", f"count(*) FILTER ({callable_})", "FROM n GROUP BY module"),
                part("classes", "module", "count(*) FILTER (kind = 'class')", "FROM n GROUP BY module"),
                part("entry", "id", "1", f"FROM n WHERE {callable_} AND NOT EXISTS (SELECT 1 FROM e WHERE e.kind = 'calls' AND e.dst = n.id)"),
                part("hot", "id", "c", f"FROM ({degree})"),
                part("coverage", "'total_public'", "total", "FROM t"),
                part("coverage", "'covered'", "covered", "FROM t"),
                part("coverage", "'coverage_pct'", "CASE WHEN total > 0 THEN round_even(100.0::DOUBLE * covered / total, 1) ELSE 0.0 END", "FROM t"),
                part("stats", "'total_nodes'", "count(*)", "FROM n"),
                part("stats", "'total_edges'", "count(*)", "FROM e"),
                part("kinds", "kind", "count(*)", "FROM e GROUP BY kind"),
            ]
        ),
        "file_scope_rows": scope(False),
        "file_scope_rows_compat": scope(True),
        "file_delete_rows": f"WITH {q._E}, {q._N}, gone AS (SELECT id FROM n WHERE module IN ('supplier', 'BUILDING')) SELECT id, CAST(NULL AS VARCHAR) AS dst FROM n WHERE module NOT IN ('supplier', 'BUILDING') UNION ALL SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = e.src) AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = e.dst)",
    }
