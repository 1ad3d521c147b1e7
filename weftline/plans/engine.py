"""The programming interface: a project's tables and the ten answers over them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import render
from weftline.functions.lineage import settle
from weftline.operators import impact, overview, routes, traverse
from weftline.plans.snapshot import Store
from weftline.sources import extract, files
from weftline.streaming.listing import Watcher


#: Rows that an answer brings to the driver for each of its lists; one with more says so (``cut``), and the DataFrames hold all.
ANSWER_ROWS = 20_000


def _listed(out: dict, name: str, rows: DataFrame, as_value: Callable = lambda r: r.asDict(recursive=True)) -> None:
    """Puts rows, of which there may be any number, into an answer as a list of bounded length."""
    found = rows.limit(ANSWER_ROWS + 1).collect()
    if len(found) > ANSWER_ROWS:
        out["cut"] = [*out.get("cut", []), name]
    out[name] = [as_value(r) for r in found[:ANSWER_ROWS]]


class Project:
    """Source files under ``root`` and their graph in the store.  ``resolver`` may rename unsure targets of Python calls (edges, file) -> edges, in place of the types of receivers."""

    def __init__(self, spark: SparkSession, root: str, store: str, resolver: Callable | None = None):
        self.spark, self.root, self.resolver = spark, root.rstrip("/"), resolver
        self.store = Store(spark, store)
        self.watcher = None

    # --- writing --------------------------------------------------------------------------

    def _apply(self, found: DataFrame, skipped: int, began: float) -> DataFrame:
        facts = settle(extract.facts(found, self.resolver))
        nodes, edges = extract.node_rows(facts), extract.edge_rows(facts, self.store.next_edge())
        hashes = found.select("file", "sha256", F.unix_timestamp().alias("indexed_at"))
        n_files = found.count()
        if n_files:
            self.store.replace(nodes, edges, hashes)
        counts = facts.agg(F.count_if(F.col("what") == "node").alias("n"), F.count_if(F.col("what") == "edge").alias("e")).first()
        return self.spark.createDataFrame([(counts["n"], counts["e"], n_files, skipped, int((time.time() - began) * 1000))], "nodes_indexed long, edges_indexed long, files_parsed long, files_skipped long, duration_ms long")

    def index(self) -> DataFrame:
        """Indexes new and changed files: one row of counters (of rows found, repeated ids included)."""
        began = time.time()
        found = settle(files.changes(files.scan(self.spark, self.root), self.store.read("file_hashes")))
        return self._apply(found.where("changed").drop("changed"), found.where("not changed").count(), began)

    def index_files(self, names: list[str]) -> DataFrame:
        """Indexes the named files whether or not they changed; unknown languages and missing files are left out."""
        began = time.time()
        return self._apply(settle(files.pick(self.spark, self.root, names)), 0, began)

    def delete_files(self, names: list[str]) -> None:
        self.store.delete(names)

    def watch(self, folder: str, every: float = 1.0) -> None:
        """Keeps the store up to date with the tree until ``unwatch``; the change log and its checkpoint go to the folder."""
        self.unwatch()
        self.watcher = Watcher(self.spark, self.root, folder, self.index_files, self.delete_files, every).start()

    def unwatch(self) -> None:
        if self.watcher is not None:
            self.watcher.stop()
        self.watcher = None

    # --- reading --------------------------------------------------------------------------

    @property
    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("edges")

    def call_graph(self, symbol: str, direction: str = "both", max_hops: int = 3, min_confidence: float = 0.5) -> dict:
        """root, nodes, edges and cycles_detected, in discovery order."""
        found = traverse.subgraph(self.edges, symbol, direction, max_hops, min_confidence)
        nodes = traverse.with_rows(found, self.nodes).orderBy("hops", "ord")
        out: dict = {"root": symbol}
        _listed(out, "nodes", nodes.select("id", "kind", "file", "line_start", "hops", "is_public", "is_test"))
        _listed(out, "edges", found.ordered_edges().select("src", "dst", "kind", "confidence", "hops"))
        _listed(out, "cycles_detected", found.cycles.orderBy("hops", "ord").select("cycle"), lambda r: r[0])
        return out

    def impact_analysis(self, symbol: str, max_hops: int = 4) -> dict:
        """changed_symbol, at_risk by falling score, and the summary."""
        risks = settle(impact.at_risk(self.nodes, self.edges, symbol, max_hops, with_paths=True))
        out: dict = {"changed_symbol": symbol}
        _listed(out, "at_risk", impact.ranked(risks).select("symbol", "distance", "risk_score", "risk_factors", "path", "is_test"))
        return out | {"summary": impact.summary(risks).first().asDict()}

    def semantic_search(self, query: str, kinds: str = "", limit: int = 10) -> dict:
        wanted = [k.strip() for k in kinds.split(",") if k.strip()]
        rows = self.store.search(query, wanted or None, limit)
        return {"results": [r.asDict() for r in rows.select("id", "kind", "signature", "docstring", "file", "line_start", "score").collect()]}

    def get_symbol(self, symbol: str) -> dict:
        row = overview.node(self.nodes, symbol).first()
        if row is None:
            return {"error": f"Symbol not found: {symbol}"}
        text = files.pick(self.spark, self.root, [row["file"]]).select(files.source_lines(F.col("content").cast("string"), F.lit(row["line_start"]), F.lit(row["line_end"]))).first()
        out = row.asDict() | {"source": text[0] if text else None}
        _listed(out, "edges_out", overview.edges_of(self.edges, symbol, "out").orderBy("edge_id").select("dst", "kind", "confidence"))
        _listed(out, "edges_in", overview.edges_of(self.edges, symbol, "in").orderBy("edge_id").select("src", "kind", "confidence"))
        return out

    def project_map(self) -> dict:
        nodes, edges = self.nodes, self.edges
        hot = overview.hot_symbols(nodes, edges).collect()
        total = overview.stats(nodes, edges).first()
        out: dict = {}
        _listed(out, "modules", overview.modules(nodes).orderBy("module"))
        _listed(out, "entry_points", overview.entry_points(nodes, edges).select("id").orderBy("id"), lambda r: r[0])
        return out | {
            "hot_symbols": [{"symbol": r["id"], "in_degree": r["in_degree"]} for r in hot],
            "test_coverage": overview.coverage(nodes, edges).first().asDict(),
            "graph_stats": total.asDict() | {"edge_breakdown": {r[0]: r[1] for r in overview.edge_breakdown(edges).collect()}},
        }

    def find_mutations(self, symbol: str) -> dict:
        out: dict = {"target": symbol}
        _listed(out, "mutated_by", overview.mutations(self.nodes, self.edges, symbol).orderBy("edge_id").drop("edge_id"))
        return out

    def cross_language_edges(self) -> dict:
        nodes = self.nodes.withColumn("language", files.language_of(F.col("file")))
        sources = files.scan(self.spark, self.root).select("file", F.col("content").cast("string").alias("content"), "language")
        units = settle(routes.units_of(nodes.drop("language"), sources))
        found = settle(routes.contracts(routes.client_calls(units), routes.route_definitions(units)).drop("detail"))
        out: dict = {}
        _listed(out, "cross_language_edges", found.orderBy("caller", "handler", "contract"))
        return out | {"total": found.count()}

    def visualize_graph(self, symbol: str, direction: str = "both", max_hops: int = 3, min_confidence: float = 0.0, format: str = "tree") -> str:
        g = self.call_graph(symbol, direction, max_hops, min_confidence)
        return render.mermaid(symbol, g["nodes"], g["edges"]) if format == "mermaid" else render.tree(symbol, g["nodes"], g["edges"], g["cycles_detected"])

    def visualize_impact(self, symbol: str, max_hops: int = 4, format: str = "tree") -> str:
        answer = self.impact_analysis(symbol, max_hops)
        return (render.mermaid_impact if format == "mermaid" else render.impact_tree)(symbol, answer["at_risk"], answer["summary"])

    def answer(self, tool: str, **arguments) -> str:
        """A tool's answer as JSON of bounded size (text tools: their text)."""
        import json

        out = getattr(self, tool)(**arguments)
        out = out.first().asDict() if isinstance(out, DataFrame) else out
        return out if isinstance(out, str) else json.dumps(render.capped(out))
