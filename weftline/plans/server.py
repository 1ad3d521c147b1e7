"""The ten answers as tools over standard input and output: JSON-RPC 2.0, a message a line, in the way of the public Model Context Protocol.

The project is indexed and watched from the first call of a tool on, not before.
"""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Callable
from typing import IO

from weftline.plans.engine import Project

PROTOCOL = "2024-11-05"
#: Tool name: method of the project, what it says, and parameters that the tool calls otherwise.
TOOLS: dict[str, tuple[str, str, dict[str, str]]] = {
    "index_project_tool": ("index", "Index new and changed files of the project.", {}),
    "get_call_graph": ("call_graph", "What calls a symbol and what it calls, up to some hops.", {}),
    "impact_analysis": ("impact_analysis", "What depends on a symbol, ranked by risk.", {}),
    "semantic_search": ("semantic_search", "Symbols whose names, signatures or docstrings match a query.", {}),
    "get_symbol": ("get_symbol", "A symbol with its source and its direct edges.", {"symbol": "symbol_id"}),
    "project_map": ("project_map", "Modules, entry points, hot symbols, test coverage and totals.", {}),
    "find_mutations": ("find_mutations", "What writes a field.", {"symbol": "symbol_id"}),
    "cross_language_edges": ("cross_language_edges", "Client calls and the service routes they fit.", {}),
    "visualize_graph": ("visualize_graph", "The graph around a symbol as a text tree or a chart.", {}),
    "visualize_impact": ("visualize_impact", "The impact of a symbol as a text tree or a chart.", {}),
}
_KINDS = {"str": "string", "int": "integer", "float": "number"}


class Server:
    """Answers requests about one project; ``open_`` makes it at the first call of a tool."""

    def __init__(self, open_: Callable[[], Project], watch_in: str | None = None):
        self._open, self._watch_in, self._project = open_, watch_in, None

    @property
    def project(self) -> Project:
        if self._project is None:
            project = self._open()
            project.index().collect()
            if self._watch_in:
                project.watch(self._watch_in)
            self._project = project
        return self._project

    def tools(self) -> list[dict]:
        """Names, descriptions and parameters of the tools, from the methods' own signatures."""
        out = []
        for name, (method, says, renamed) in TOOLS.items():
            own = {k: p for k, p in inspect.signature(getattr(Project, method)).parameters.items() if k != "self"}
            properties = {renamed.get(k, k): {"type": _KINDS.get(str(p.annotation), "string")} | ({} if p.default is p.empty else {"default": p.default}) for k, p in own.items()}
            needed = [renamed.get(k, k) for k, p in own.items() if p.default is p.empty]
            out.append({"name": name, "description": says, "inputSchema": {"type": "object", "properties": properties, "required": needed}})
        return out

    def call(self, name: str, arguments: dict) -> str:
        method, _, renamed = TOOLS[name]
        back = {v: k for k, v in renamed.items()}
        known = inspect.signature(getattr(Project, method)).parameters
        return self.project.answer(method, **{back.get(k, k): v for k, v in arguments.items() if back.get(k, k) in known})

    def handle(self, message: dict) -> dict | None:
        """The response to a request; none to a notification."""
        if "id" not in message:
            return None
        params = message.get("params") or {}
        reply = {"jsonrpc": "2.0", "id": message["id"]}
        match message.get("method"):
            case "initialize":
                return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "weftline", "version": "0"}}}
            case "ping":
                return reply | {"result": {}}
            case "tools/list":
                return reply | {"result": {"tools": self.tools()}}
            case "tools/call" if params.get("name") in TOOLS:
                try:
                    text, failed = self.call(params["name"], params.get("arguments") or {}), False
                except Exception as e:
                    text, failed = str(e), True
                return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
            case "tools/call":
                return reply | {"error": {"code": -32602, "message": f"unknown tool: {params.get('name')}"}}
        return reply | {"error": {"code": -32601, "message": f"unknown method: {message.get('method')}"}}

    def serve(self, source: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
        """Answers line by line until the input ends."""
        for line in source:
            if not line.strip():
                continue
            try:
                reply = self.handle(json.loads(line))
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                print(json.dumps(reply), file=out, flush=True)
        if self._project is not None:
            self._project.unwatch()


def main() -> None:
    """Serves the tree in the working directory, or that of the first argument; the store and change log are beside it in .weftline, or in the folder of the second argument."""
    import os

    from pyspark.sql import SparkSession

    root = os.path.abspath(sys.argv[1] if len(sys.argv) > 1 else ".")
    store = sys.argv[2].rstrip("/") if len(sys.argv) > 2 else f"{root}/.weftline"

    def open_() -> Project:
        spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
        return Project(spark, root, f"{store}/graph")

    Server(open_, f"{store}/changes").serve()
