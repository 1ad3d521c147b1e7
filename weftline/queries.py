"""Registered queries over graph views of the driver tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline import source_queries
from weftline.functions import views
from weftline.functions.views import table
from weftline.operators import impact, overview, routes, search, traverse
from weftline.plans import snapshot
from weftline.streaming import changelog

Query = Callable[[SparkSession, str], DataFrame]
ROOT, LEAF, MIDDLE = "r:1", "o:7", "n:3"

#: Routes that the pages' addresses are matched with: symbol, method and URL pattern.
ROUTES = (("en_page", "GET", "/en/:id"), ("de_page", "ANY", "/de/{id}"), ("fr_page", "POST", "/fr/:id/"), ("es_page", "GET", "/es/{id}"), ("html_page", "ANY", "/en/{name}.html"), ("any_page", "GET", "/:lang/:id"))


def _star(spark, d, effects: bool = False) -> tuple[DataFrame, DataFrame]:
    edges = views.star_edges(spark, d)
    return views.star_nodes(spark, d), edges.unionByName(views.effect_edges(spark, d)) if effects else edges


def _positions(df: DataFrame, *order) -> DataFrame:
    """A result's rows with their place in the answer."""
    from weftline.functions.lineage import indexed

    return indexed(df, "pos", *order)


def _bfs(root: str, direction: str, hops: int, confidence: float = 0.0) -> Query:
    def run(spark, d):
        nodes, edges = _star(spark, d)
        found = traverse.reach(edges, root, direction, hops, confidence)
        return found.join(nodes.select("id", "kind"), "id").select("id", "kind", F.col("hop").cast("long").alias("hops"))

    return run


def subgraph_edges(spark, d):
    found = traverse.subgraph(_star(spark, d)[1], MIDDLE, "both", 2)
    return found.edges.groupBy("src", "dst", "kind", "confidence", F.col("hops").cast("long").alias("hops")).agg(F.count("*").alias("n"))


def bfs_tree_paths(spark, d):
    found = traverse.subgraph(_star(spark, d)[1], LEAF, "callees", 4)
    return found.nodes.select("id", F.col("hop").cast("long").alias("hop"), F.array_join("path", ">").alias("path"))


def cycles_event_graph(spark, d):
    found = traverse.subgraph(views.event_edges(spark, d), "click", "callees", 4)
    return found.cycles.select(F.array_join("cycle", ">").alias("cycle"), F.col("hops").cast("long").alias("hops")).groupBy("cycle", "hops").agg(F.count("*").alias("n"))


def bfs_order_event_graph(spark, d):
    found = traverse.subgraph(views.event_edges(spark, d), "click", "both", 3)
    return _positions(found.nodes, "hop", "ord").select(F.col("pos").alias("pos"), "id", F.col("hop").cast("long").alias("hop"))


def impact_ranked(spark, d):
    nodes, edges = _star(spark, d, True)
    risks = impact.at_risk(nodes, edges, ROOT, 4, with_factors=False, ordered=False)
    return risks.select("symbol", F.col("distance").cast("long").alias("distance"), "risk_score", "risk_class", F.col("is_test").cast("long").alias("is_test"))


def impact_summary(spark, d):
    nodes, edges = _star(spark, d, True)
    return impact.summary(impact.at_risk(nodes, edges, ROOT, 4, with_factors=False, ordered=False))


def impact_factors(spark, d):
    nodes, edges = _star(spark, d, True)
    return impact.at_risk(nodes, edges, MIDDLE, 2).select("symbol", F.array_join("risk_factors", ",").alias("factors"))


def impact_paths(spark, d):
    nodes, edges = _star(spark, d)
    return impact.at_risk(nodes, edges, MIDDLE, 2, with_paths=True, with_factors=False).select("symbol", F.array_join("path", ">").alias("path"))


def tree_second_level_cap5(spark, d):
    edges = _star(spark, d)[1]
    first = edges.where(F.col("dst") == MIDDLE).select(F.col("src").alias("parent"))
    second = edges.join(first, edges["dst"] == first["parent"]).groupBy("parent", "src", "kind").agg(F.max("confidence").alias("confidence"), F.min("edge_id").alias("edge_id"))
    return overview.first_per(second, ["parent"], 5, F.desc("confidence"), "edge_id").select("parent", F.col("src").alias("neighbour"), "kind", "confidence")


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("kind"), "text")


def _bm25(query: str, kind: str | None = None) -> Query:
    def run(spark, d):
        found = search.bm25(_docs(spark, d).select("id", "text"), query, columns=("text",))
        if kind:
            found = found.join(_docs(spark, d).where(F.col("kind") == kind).select("id"), "id", "left_semi")
        return found.select("id", F.round("score", 6).alias("score")).orderBy("score", "id").limit(10)

    return run


def _calls_routes(spark, d):
    calls = table(spark, d, "pages").select(F.concat(F.lit("p:"), F.col("page_id").cast("string")).alias("symbol"), F.lit("javascript").alias("language"), F.col("url").alias("url_pattern"), F.when(F.col("page_id") % 3 == 0, "ANY").when(F.col("page_id") % 3 == 1, "GET").otherwise("POST").alias("method"), F.lit("a.js").alias("file"))
    listed = spark.createDataFrame([(s, "javascript" if s == "any_page" else "python", u, m, "b.py") for s, m, u in ROUTES], "symbol string, language string, url_pattern string, method string, file string")
    # The addresses of pages have queries and fragments, which calls seldom have; they are cut off first.
    return calls.withColumn("url_pattern", F.regexp_replace("url_pattern", "[?#].*$", "")), listed


def route_matches(spark, d):
    return routes.matches(*_calls_routes(spark, d)).select(F.col("c_symbol").alias("caller"), F.col("r_symbol").alias("handler"))


def route_contracts(spark, d):
    return routes.contracts(*_calls_routes(spark, d)).select("caller", "handler", "contract", "confidence")


def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))


def link_hosts(spark, d):
    return table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).groupBy("host").agg(F.count("*").alias("n"))


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    new = docs.select(F.col("doc_id").cast("string").alias("file"), F.sha2("text", 256).alias("sha256"))
    old = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("file"), F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    return old, new


def change_detect(spark, d):
    from weftline.sources.files import changes

    old, new = _versions(spark, d)
    return changes(new, old).select("file", "changed")


def last_write_wins(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), "event_type", F.col("event_id").alias("seq"))
    return snapshot.last_wins(events, ["id"], "seq").select("id", "event_type")


def _replaced(compat: bool) -> Query:
    def run(spark, d):
        nodes, edges = _star(spark, d)
        edges = edges.withColumn("file", F.when(F.col("src").startswith("c:"), "customers").otherwise("rest"))
        nodes = nodes.withColumn("file", F.when(F.col("id").startswith("c:"), "customers").otherwise("rest"))
        hashes = spark.createDataFrame([("customers", "x", 0), ("rest", "y", 0)], "file string, sha256 string, indexed_at long")
        keep = F.col("line_start") % 2 == 0
        new_nodes = nodes.where("file = 'customers'").where(keep)
        new_edges = edges.where("file = 'customers'").where(F.col("edge_id") % 2 == 0)
        n, e, _ = snapshot.replace_files((nodes, edges, hashes), (new_nodes, new_edges, hashes.where("file = 'customers'")), compat)
        return n.groupBy("file").agg(F.count("*").alias("n_nodes")).join(e.groupBy("file").agg(F.count("*").alias("n_edges")), "file")

    return run


def file_delete_cascade(spark, d):
    nodes, edges = _star(spark, d)
    nodes = nodes.withColumn("file", F.col("module"))
    edges = edges.withColumn("file", F.lit("x"))
    hashes = spark.createDataFrame([], "file string, sha256 string, indexed_at long")
    gone = spark.createDataFrame([("supplier",), ("BUILDING",)], "file string")
    n, e, _ = snapshot.without_files(nodes, edges, hashes, gone, compat=True)
    return e.groupBy("kind").agg(F.count("*").alias("n_edges")).join(n.agg(F.count("*").alias("n_nodes")))


def debounce_sessions(spark, d):
    out = changelog.sessions(views.change_log(spark, d), "path", "6 hours")
    return out.select(F.col("path").alias("user_id"), F.unix_micros("burst_start").alias("first_us"), (F.unix_micros("burst_end") - 6 * 3600 * 1_000_000).alias("last_us"), "n")


def last_op_per_path(spark, d):
    return changelog.last_ops(views.change_log(spark, d).select("path", "op", "ts")).select(F.col("path").alias("user_id"), "op")


def override_self_join(spark, d):
    parts = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("class_name"), F.col("p_size").cast("string").alias("name"), F.concat_ws(".", "p_brand", "p_type", F.col("p_size").cast("string")).alias("id")).distinct()
    types = parts.select("file", "class_name").distinct()
    bases = types.withColumn("base", F.lag("class_name").over(Window.partitionBy("file").orderBy("class_name"))).where("base is not null")
    return overview.overrides(parts, bases)


def resolve_targets_coalesce(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("file"), F.concat("o_orderstatus", F.lit("."), (F.col("o_custkey") % 11).cast("string")).alias("call"))
    scope = spark.createDataFrame([(p, "F.3", f"{p}:own3") for p in ("1-URGENT", "2-HIGH")], "file string, name string, id string")
    imports = spark.createDataFrame([(p, "O", "pkg.open") for p in ("1-URGENT", "5-LOW")], "file string, name string, path string")
    return overview.resolve_targets(orders, scope, imports).select("k", "dst", "confidence")


def queries() -> dict[str, Query]:
    star = lambda f: lambda s, d: f(*_star(s, d))
    edges_at = lambda direction: lambda s, d: overview.edges_of(_star(s, d)[1], MIDDLE, direction).select("edge_id", "src", "dst", "kind", "confidence")
    return {
        "node_lookup": lambda s, d: overview.node(_star(s, d)[0], "c:5").select("id", "kind", "module", "signature"),
        "edges_out": edges_at("out"),
        "edges_in": edges_at("in"),
        "edges_both": edges_at("both"),
        "nodes_by_kind": lambda s, d: overview.nodes_of_kind(_star(s, d)[0], "class, function,").select("id", "kind"),
        "edges_conf_filter": lambda s, d: _star(s, d)[1].where(F.col("confidence") >= 0.5).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("n_dst")),
        "graph_stats": star(overview.stats),
        "edge_breakdown": lambda s, d: overview.edge_breakdown(_star(s, d, True)[1]),
        "module_summary": lambda s, d: overview.modules(_star(s, d)[0]),
        "in_degree": lambda s, d: overview.in_degree(*_star(s, d)).select("id", "in_degree"),
        "hot_symbols_top10": lambda s, d: overview.hot_symbols(*_star(s, d)).select("id", "in_degree"),
        "coverage_pct": star(overview.coverage),
        "entry_points": lambda s, d: overview.entry_points(*_star(s, d)).select("id"),
        "covered_symbols": lambda s, d: overview.covered(*_star(s, d)).select("id"),
        "mutators_left_join": lambda s, d: overview.mutations(*_star(s, d), "c:5").select("symbol", "file", F.col("line_start").cast("long").alias("line_start"), "confidence"),
        "bfs_callers_1": _bfs(ROOT, "callers", 1),
        "bfs_callers_2": _bfs(ROOT, "callers", 2),
        "bfs_callers_3": _bfs(ROOT, "callers", 3),
        "bfs_callers_4": _bfs(ROOT, "callers", 4),
        "bfs_callees": _bfs(LEAF, "callees", 4),
        "bfs_both": _bfs("c:5", "both", 2),
        "bfs_min_confidence": _bfs(ROOT, "callers", 3, 0.6),
        "subgraph_edges_with_hops": subgraph_edges,
        "bfs_tree_paths": bfs_tree_paths,
        "bfs_order_event_graph": bfs_order_event_graph,
        "cycles_event_graph": cycles_event_graph,
        "impact_ranked": impact_ranked,
        "impact_summary": impact_summary,
        "impact_factors": impact_factors,
        "impact_paths": impact_paths,
        "tree_second_level_cap5": tree_second_level_cap5,
        "bm25_token": _bm25("the"),
        "bm25_and": _bm25("the with"),
        "bm25_phrase": _bm25("of_the"),
        "bm25_kind_filter": _bm25("token", "de"),
        "route_matches": route_matches,
        "route_contracts": route_contracts,
        "page_links": page_links,
        "link_hosts": link_hosts,
        "change_detect": change_detect,
        "last_write_wins_upsert": last_write_wins,
        "file_scope_replace": _replaced(False),
        "file_scope_replace_compat": _replaced(True),
        "file_delete_cascade": file_delete_cascade,
        "debounce_sessions": debounce_sessions,
        "last_op_per_path": last_op_per_path,
        "override_self_join": override_self_join,
        "resolve_targets_coalesce": resolve_targets_coalesce,
        **source_queries.queries(),
    }


# --- the same in SQL --------------------------------------------------------------------------

_E = """e AS (
  SELECT CAST(n_nationkey AS BIGINT) AS edge_id, 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'inherits' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM nation
  UNION ALL SELECT 1000000000000000 + c_custkey, 'c:' || c_custkey, 'n:' || c_nationkey, 'calls', CAST(0.8 AS DOUBLE) FROM customer
  UNION ALL SELECT 2000000000000000 + s_suppkey, 's:' || s_suppkey, 'n:' || s_nationkey, 'calls', CAST(0.5 AS DOUBLE) FROM supplier
  UNION ALL SELECT 3000000000000000 + o_orderkey, 'o:' || o_orderkey, 'c:' || o_custkey, 'mutates', CAST(1.0 AS DOUBLE) FROM orders
  UNION ALL SELECT 4000000000000000 + l_orderkey * 100000 + l_suppkey, 'o:' || l_orderkey, 's:' || l_suppkey, 'asserts_on', CAST(0.3 AS DOUBLE) FROM lineitem)"""
_EF = _E.replace("e AS (", "e0 AS (", 1) + """,
e AS (SELECT * FROM e0 UNION ALL SELECT 5000000000000000 + l_orderkey, 'o:' || l_orderkey, 'side_effect:network:' || l_linestatus, 'side_effect', CAST(1.0 AS DOUBLE) FROM lineitem WHERE l_returnflag = 'R')"""
_N = """n AS (
  SELECT 'r:' || r_regionkey AS id, 'class' AS kind, 'region' AS module, 'region.py' AS file, r_regionkey AS line_start, r_name AS signature, 1 AS is_public, 0 AS is_test FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'class', 'nation', 'nation.py', n_nationkey, n_name, 1, 0 FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'function', c_mktsegment, c_mktsegment || '.py', c_custkey, c_name, CAST(c_acctbal >= 0 AS INT), 0 FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'function', 'supplier', 'supplier.py', s_suppkey, s_name, CAST(s_acctbal >= 0 AS INT), 0 FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey, 'method', o_orderpriority, o_orderpriority || '.py', o_orderkey, o_orderpriority, CAST(o_totalprice >= 1000 AS INT), CAST(o_orderstatus = 'F' AS INT) FROM orders)"""
_V = """e AS (SELECT row_number() OVER (ORDER BY src, dst) AS edge_id, src, dst, 'calls' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM (
  SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL))"""


def _walk_sql(root: str, direction: str, hops: int, confidence: float = 0.0, name: str = "", source: str = "e") -> str:
    """Common table expressions x, h0.., v0.., s1.. of a traversal unrolled by hop, in queue order."""
    where = f"WHERE confidence >= {confidence}" if confidence else "WHERE true"
    ahead = f"SELECT edge_id AS eid, src AS cur, dst AS nb, 0 AS o, src, dst, kind, confidence FROM {source} {where}"
    back = f"SELECT edge_id AS eid, dst AS cur, src AS nb, {{o}} AS o, src, dst, kind, confidence FROM {source} {where}"
    x = {"callees": ahead, "callers": back.format(o=0), "both": f"{ahead} UNION ALL {back.format(o=1)} AND src <> dst"}[direction]
    p = name
    out = [f"{p}x AS ({x})", f"{p}h0 AS (SELECT '{root}' AS id, 0 AS hop, CAST(1 AS BIGINT) AS rk, ['{root}'] AS path)", f"{p}v0 AS (SELECT id FROM {p}h0)"]
    for k in range(1, hops + 1):
        out += [
            f"{p}s{k} AS (SELECT {k} AS hops, x.*, h.rk AS prk, h.path FROM {p}h{k - 1} h JOIN {p}x x ON x.cur = h.id)",
            f"{p}c{k} AS (SELECT *, row_number() OVER (PARTITION BY nb ORDER BY prk, o, eid) AS pick FROM {p}s{k} s WHERE NOT EXISTS (SELECT 1 FROM {p}v{k - 1} v WHERE v.id = s.nb))",
            f"{p}h{k} AS (SELECT nb AS id, {k} AS hop, row_number() OVER (ORDER BY prk, o, eid) AS rk, list_append(path, nb) AS path FROM {p}c{k} WHERE pick = 1)",
            f"{p}v{k} AS (SELECT id FROM {p}v{k - 1} UNION ALL SELECT id FROM {p}h{k})",
        ]
    out.append(f"{p}reached AS (" + " UNION ALL ".join(f"SELECT * FROM {p}h{k}" for k in range(hops + 1)) + ")")
    out.append(f"{p}seen AS (" + " UNION ALL ".join(f"SELECT * FROM {p}s{k}" for k in range(1, hops + 1)) + ")")
    return ",\n".join(out)


def _bfs_sql(root: str, direction: str, hops: int, confidence: float = 0.0) -> str:
    return f"WITH {_E}, {_N},\n{_walk_sql(root, direction, hops, confidence)}\nSELECT r.id, n.kind, CAST(r.hop AS BIGINT) AS hops FROM reached r JOIN n ON n.id = r.id"


_RISK = f"""risk AS (SELECT r.id AS symbol, greatest(r.hop, 1) AS distance, n.is_test,
  1.0::DOUBLE / greatest(r.hop, 1) * (1.0 + 0.5::DOUBLE * coalesce(m.a, 0)) * CASE WHEN coalesce(m.f, false) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN n.is_public = 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS score
  FROM reached r JOIN n ON n.id = r.id LEFT JOIN (
    SELECT id, sum(a) AS a, bool_or(f) AS f FROM (SELECT dst AS id, 1 AS a, false AS f FROM e WHERE kind = 'asserts_on' UNION ALL SELECT src, 0, true FROM e WHERE kind = 'side_effect') GROUP BY id) m ON m.id = r.id
  WHERE r.id <> '{ROOT}')"""
_CLASS = "CASE WHEN score > 0.7 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END"
_FOLD = "lower(text)"


def _bm25_sql(phrases: list[list[str]], kind: str | None = None) -> str:
    folds = search._folds()
    cols, figures, score, need = [], [], "CAST(0.0 AS DOUBLE)", []
    for i, p in enumerate(phrases):
        test = " AND ".join(f"t[i + {j}] = '{w}'" for j, w in enumerate(p))
        cols.append(f"CAST(len(list_filter(range(1, len(t) + 1), lambda i: {test})) AS DOUBLE) AS f{i}")
        figures.append(f"count(*) FILTER (f{i} > 0) AS n{i}")
        idf = f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 0.0)"
        idf = f"CASE WHEN {idf} = 0 THEN {search.LEAST_IDF} ELSE {idf} END"
        score += f" - ({idf}) * f{i} * {search.K1 + 1} / (f{i} + {search.K1} * (1 - {search.B} + {search.B} * dl / avgdl))"
        need.append(f"f{i} > 0")
    keep = f"AND lang = '{kind}'" if kind else ""
    return f"""WITH tok AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, list_filter(string_split_regex(translate(lower(coalesce(text, '')), '{folds[0]}', '{folds[1]}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
f AS (SELECT id, lang, CAST(len(t) AS DOUBLE) AS dl, {", ".join(cols)} FROM tok),
g AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {", ".join(figures)} FROM f)
SELECT id, round({score}, 6) AS score FROM f, g WHERE {" AND ".join(need)} {keep} ORDER BY 2, 1 LIMIT 10"""


_ROUTE_ROWS = ", ".join(f"('{s}', '{m}', '{u}', '{'javascript' if s == 'any_page' else 'python'}')" for s, m, u in ROUTES)
_ROUTES = f"""r AS (SELECT *, '^' || regexp_replace(regexp_replace(regexp_replace(url, '/+$', ''), ':[a-zA-Z_]\\w*', '[^/]+', 'g'), '\\{{[a-zA-Z_]\\w*\\}}', '[^/]+', 'g') || '$' AS re FROM (VALUES {_ROUTE_ROWS}) v(handler, method, url, language)),
c AS (SELECT 'p:' || page_id AS caller, CASE page_id % 3 WHEN 0 THEN 'ANY' WHEN 1 THEN 'GET' ELSE 'POST' END AS method,
  regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^.*?://[^/]*', '') AS path FROM pages),
m AS (SELECT c.caller, r.handler, c.method AS cm, r.method AS rm, r.url, r.language FROM c, r WHERE (c.method = 'ANY' OR r.method = 'ANY' OR c.method = r.method) AND regexp_matches(c.path, r.re))"""


def _replaced_sql(compat: bool) -> str:
    gone = "SELECT id FROM n1 WHERE file = 'customers'"
    kept = f"src NOT IN ({gone}) AND dst NOT IN ({gone})" if compat else "file <> 'customers'"
    return f"""WITH {_E}, {_N}, e1 AS (SELECT *, CASE WHEN src LIKE 'c:%' THEN 'customers' ELSE 'rest' END AS file FROM e),
n1 AS (SELECT id, line_start, CASE WHEN id LIKE 'c:%' THEN 'customers' ELSE 'rest' END AS file FROM n),
n2 AS (SELECT id, file FROM n1 WHERE file <> 'customers' UNION ALL SELECT id, file FROM n1 WHERE file = 'customers' AND line_start % 2 = 0),
e2 AS (SELECT edge_id, file FROM e1 WHERE {kept} UNION ALL SELECT edge_id, file FROM e1 WHERE file = 'customers' AND edge_id % 2 = 0)
SELECT a.file, a.n_nodes, b.n_edges FROM (SELECT file, count(*) AS n_nodes FROM n2 GROUP BY file) a JOIN (SELECT file, count(*) AS n_edges FROM e2 GROUP BY file) b ON a.file = b.file"""


def oracle_sql() -> dict[str, str]:
    edge_cols = "edge_id, src, dst, kind, confidence"
    callable_ = "kind IN ('function', 'method')"
    undirected = "u AS (SELECT row_number() OVER (ORDER BY hops, prk, o, eid) - 1 AS ix, src, dst FROM seen), ue AS (SELECT 2 * ix AS edge_id, dst AS src, src AS dst, 'x' AS kind, 1.0 AS confidence FROM u UNION ALL SELECT 2 * ix + 1, src, dst, 'x', 1.0 FROM u)"
    return {
        **source_queries.oracle_sql(),
        "node_lookup": f"WITH {_N} SELECT id, kind, module, signature FROM n WHERE id = 'c:5'",
        "edges_out": f"WITH {_E} SELECT {edge_cols} FROM e WHERE src = '{MIDDLE}'",
        "edges_in": f"WITH {_E} SELECT {edge_cols} FROM e WHERE dst = '{MIDDLE}'",
        "edges_both": f"WITH {_E} SELECT {edge_cols} FROM e WHERE src = '{MIDDLE}' OR dst = '{MIDDLE}'",
        "nodes_by_kind": f"WITH {_N} SELECT id, kind FROM n WHERE kind IN ('class', 'function')",
        "edges_conf_filter": f"WITH {_E} SELECT kind, count(*) AS n, count(DISTINCT dst) AS n_dst FROM e WHERE confidence >= 0.5 GROUP BY kind",
        "graph_stats": f"WITH {_E}, {_N} SELECT (SELECT count(*) FROM n) AS total_nodes, (SELECT count(*) FROM e) AS total_edges",
        "edge_breakdown": f"WITH {_EF} SELECT kind, count(*) AS n FROM e GROUP BY kind",
        "module_summary": f"WITH {_N} SELECT module, min(file) AS file, count(*) FILTER ({callable_}) AS functions, count(*) FILTER (kind = 'class') AS classes FROM n GROUP BY module",
        "in_degree": f"WITH {_E}, {_N} SELECT n.id, coalesce(d.c, 0) AS in_degree FROM n LEFT JOIN (SELECT dst, count(*) AS c FROM e GROUP BY dst) d ON d.dst = n.id",
        "hot_symbols_top10": f"WITH {_E}, {_N} SELECT n.id, coalesce(d.c, 0) AS in_degree FROM n LEFT JOIN (SELECT dst, count(*) AS c FROM e GROUP BY dst) d ON d.dst = n.id ORDER BY 2 DESC, 1 LIMIT 10",
        "coverage_pct": f"WITH {_E}, {_N}, t AS (SELECT count(*) AS total_public, count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.kind = 'asserts_on' AND e.dst = n.id)) AS covered FROM n WHERE {callable_} AND is_public = 1) SELECT total_public, covered, CASE WHEN total_public > 0 THEN round_even(100.0::DOUBLE * covered / total_public, 1) ELSE 0.0 END AS coverage_pct FROM t",
        "entry_points": f"WITH {_E}, {_N} SELECT id FROM n WHERE {callable_} AND NOT EXISTS (SELECT 1 FROM e WHERE e.kind = 'calls' AND e.dst = n.id)",
        "covered_symbols": f"WITH {_E}, {_N} SELECT id FROM n WHERE {callable_} AND is_public = 1 AND EXISTS (SELECT 1 FROM e WHERE e.kind = 'asserts_on' AND e.dst = n.id)",
        "mutators_left_join": f"WITH {_E}, {_N} SELECT e.src AS symbol, coalesce(n.file, '') AS file, CAST(coalesce(n.line_start, 0) AS BIGINT) AS line_start, e.confidence FROM e LEFT JOIN n ON n.id = e.src WHERE e.kind = 'mutates' AND e.dst = 'c:5'",
        **{f"bfs_callers_{k}": _bfs_sql(ROOT, "callers", k) for k in (1, 2, 3, 4)},
        "bfs_callees": _bfs_sql(LEAF, "callees", 4),
        "bfs_both": _bfs_sql("c:5", "both", 2),
        "bfs_min_confidence": _bfs_sql(ROOT, "callers", 3, 0.6),
        "subgraph_edges_with_hops": f"WITH {_E},\n{_walk_sql(MIDDLE, 'both', 2)}\nSELECT src, dst, kind, confidence, CAST(hops AS BIGINT) AS hops, count(*) AS n FROM seen GROUP BY ALL",
        "bfs_tree_paths": f"WITH {_E},\n{_walk_sql(LEAF, 'callees', 4)}\nSELECT id, CAST(hop AS BIGINT) AS hop, array_to_string(path, '>') AS path FROM reached",
        "bfs_order_event_graph": f"WITH {_V},\n{_walk_sql('click', 'both', 3)}\nSELECT row_number() OVER (ORDER BY hop, rk) - 1 AS pos, id, CAST(hop AS BIGINT) AS hop FROM reached",
        "cycles_event_graph": f"WITH {_V},\n{_walk_sql('click', 'callees', 4)}\nSELECT array_to_string(list_append(path[list_position(path, nb):], nb), '>') AS cycle, CAST(hops AS BIGINT) AS hops, count(*) AS n FROM seen WHERE list_contains(path, nb) GROUP BY ALL",
        "impact_ranked": f"WITH {_EF}, {_N},\n{_walk_sql(ROOT, 'callers', 4)},\n{_RISK}\nSELECT symbol, CAST(distance AS BIGINT) AS distance, round_even(score, 4) AS risk_score, {_CLASS} AS risk_class, CAST(is_test AS BIGINT) AS is_test FROM risk",
        "impact_summary": f"WITH {_EF}, {_N},\n{_walk_sql(ROOT, 'callers', 4)},\n{_RISK}\nSELECT count(*) FILTER ({_CLASS} = 'high') AS high_risk, count(*) FILTER ({_CLASS} = 'medium') AS medium_risk, count(*) FILTER ({_CLASS} = 'low') AS low_risk, count(*) FILTER (is_test = 1) AS tests_at_risk FROM risk",
        "impact_factors": f"WITH {_EF}, {_N},\n{_walk_sql(MIDDLE, 'callers', 2)},\nk AS (SELECT dst AS id, 0 AS phase, edge_id, 'asserts_on:' || src AS txt FROM e WHERE kind = 'asserts_on' UNION ALL SELECT src, 1, edge_id, kind || ':' || dst FROM e WHERE kind IN ('mutates', 'side_effect'))\nSELECT r.id AS symbol, coalesce(string_agg(k.txt, ',' ORDER BY k.phase, k.edge_id, k.txt), '') AS factors FROM reached r JOIN n ON n.id = r.id LEFT JOIN k ON k.id = r.id WHERE r.id <> '{MIDDLE}' GROUP BY r.id",
        "impact_paths": f"WITH {_E}, {_N},\n{_walk_sql(MIDDLE, 'callers', 2)},\n{undirected},\n{_walk_sql(MIDDLE, 'callees', 2, name='q_', source='ue')}\nSELECT r.id AS symbol, array_to_string(coalesce(q.path, ['{MIDDLE}', r.id]), '>') AS path FROM reached r JOIN n ON n.id = r.id LEFT JOIN q_reached q ON q.id = r.id WHERE r.id <> '{MIDDLE}'",
        "tree_second_level_cap5": f"WITH {_E}, s AS (SELECT p.src AS parent, e.src AS neighbour, e.kind, max(e.confidence) AS confidence, min(e.edge_id) AS edge_id FROM e JOIN (SELECT src FROM e WHERE dst = '{MIDDLE}') p ON e.dst = p.src GROUP BY ALL) SELECT parent, neighbour, kind, confidence FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY confidence DESC, edge_id) AS rn FROM s) WHERE rn <= 5",
        "bm25_token": _bm25_sql([["the"]]),
        "bm25_and": _bm25_sql([["the"], ["with"]]),
        "bm25_phrase": _bm25_sql([["of", "the"]]),
        "bm25_kind_filter": _bm25_sql([["token"]], "de"),
        "route_matches": f"WITH {_ROUTES} SELECT caller, handler FROM m",
        "route_contracts": f"WITH {_ROUTES} SELECT caller, handler, rm || ' ' || url AS contract, CAST(round(least(0.95, 0.6 + CASE WHEN cm = rm AND cm <> 'ANY' THEN 0.15 ELSE 0 END + CASE WHEN language <> 'javascript' THEN 0.1 ELSE 0 END), 2) AS DOUBLE) AS confidence FROM m",
        "page_links": "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages",
        "link_hosts": "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1",
        "change_detect": "WITH o AS (SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS old FROM documents WHERE doc_id % 7 <> 0) SELECT CAST(doc_id AS VARCHAR) AS file, sha256(text) IS DISTINCT FROM o.old AS changed FROM documents LEFT JOIN o ON o.file = CAST(doc_id AS VARCHAR)",
        "last_write_wins_upsert": "SELECT id, event_type FROM (SELECT CAST(user_id AS VARCHAR) AS id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
        "file_scope_replace": _replaced_sql(False),
        "file_scope_replace_compat": _replaced_sql(True),
        "file_delete_cascade": f"WITH {_E}, {_N}, gone AS (SELECT id FROM n WHERE module IN ('supplier', 'BUILDING')) SELECT kind, count(*) AS n_edges, (SELECT count(*) FROM n WHERE module NOT IN ('supplier', 'BUILDING')) AS n_nodes FROM e WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = e.src) AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = e.dst) GROUP BY kind",
        "debounce_sessions": "WITH a AS (SELECT user_id, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), b AS (SELECT *, sum(CASE WHEN p IS NULL OR u - p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, min(u) AS first_us, max(u) AS last_us, count(*) AS n FROM b GROUP BY user_id, g",
        "last_op_per_path": "SELECT user_id, op FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'change' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'change' END DESC) AS rn FROM events) WHERE rn = 1",
        "override_self_join": "WITH p AS (SELECT DISTINCT p_brand AS file, p_type AS c, CAST(p_size AS VARCHAR) AS name FROM part), b AS (SELECT file, c, lag(c) OVER (PARTITION BY file ORDER BY c) AS base FROM (SELECT DISTINCT file, c FROM p)) SELECT p.file || '.' || p.c || '.' || p.name AS src, q.file || '.' || q.c || '.' || q.name AS dst FROM p JOIN b ON b.file = p.file AND b.c = p.c JOIN p q ON q.file = p.file AND q.c = b.base AND q.name = p.name",
        "resolve_targets_coalesce": "WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS file, o_orderstatus AS root, CAST(o_custkey % 11 AS VARCHAR) AS rest FROM orders) SELECT k, CASE WHEN root = 'F' AND rest = '3' AND file IN ('1-URGENT', '2-HIGH') THEN file || ':own3' WHEN root = 'O' AND file IN ('1-URGENT', '5-LOW') THEN 'pkg.open.' || rest ELSE root || '.' || rest END AS dst, CAST(CASE WHEN root = 'F' AND rest = '3' AND file IN ('1-URGENT', '2-HIGH') THEN 1.0 WHEN root = 'O' AND file IN ('1-URGENT', '5-LOW') THEN 0.8 ELSE 0.3 END AS DOUBLE) AS confidence FROM o",
    }
