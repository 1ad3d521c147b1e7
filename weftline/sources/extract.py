"""From source files to node and edge rows: one pass of a Python function over (file, module, language, content)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import indexed
from weftline.functions.vocabulary import EXTENSIONS
from weftline.schema import EDGES, NODES
from weftline.sources import pythoncode, receivers, textcode

#: A parser takes (content, module, file) and returns (nodes, edges).
Parser = Callable[[bytes, str, str], tuple[list[dict], list[dict]]]


def _python(content: bytes, module: str, file: str):
    facts = pythoncode.parse(content, module, file)
    return facts.nodes, facts.edges


def _text(language: str) -> Parser:
    return lambda content, module, file: textcode.parse(content, module, file, language)


_parsers: dict[str, Parser] = {"python": _python} | {name: _text(name) for name in ("javascript", "typescript", "go", "rust", "java")}


def register_parser(language: str, extensions: list[str], parser: Parser) -> None:
    """Adds or replaces the parser of a language and its file extensions."""
    _parsers[language] = parser
    EXTENSIONS.update(dict.fromkeys(extensions, language))


def supported_extensions() -> list[str]:
    return sorted({*EXTENSIONS, ".py"})


def get_parser(path: str) -> Parser | None:
    """The parser for a path by its extension."""
    suffix = "." + path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    return _parsers.get(EXTENSIONS.get(suffix, ""))


FACTS = "file string, seq int, what string, fact string"


def facts(files: DataFrame, resolver: Callable[[list[dict], str], list[dict]] | None = None) -> DataFrame:
    """(file, seq, what, fact): every node and edge of every file as JSON, in source order.  Unsure Python calls get the target that their receiver's type gives, or what a resolver of one's own makes of them."""
    parsers = dict(_parsers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, module, language, content in batch[["file", "module", "language", "content"]].itertuples(index=False):
                # A language without a parser is read as Python, which mostly gives nothing.
                nodes, edges = parsers.get(language, _python)(bytes(content), module, file)
                if language == "python":
                    edges = resolver(edges, file) if resolver is not None else receivers.resolve_calls(edges, {module: bytes(content)})
                out += [(file, i, what, json.dumps(x)) for what, rows in (("node", nodes), ("edge", edges)) for i, x in enumerate(rows)]
            yield pd.DataFrame(out, columns=["file", "seq", "what", "fact"])

    return files.select("file", "module", "language", "content").mapInPandas(run, FACTS)


def node_rows(found: DataFrame) -> DataFrame:
    """Nodes with ``seq``, the place in their file."""
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODES.fields)
    return found.where("what = 'node'").select("seq", F.from_json("fact", names).alias("n")).select("seq", "n.*")


def edge_rows(found: DataFrame, start: int = 0) -> DataFrame:
    """Edges with defaults and edge_id, from ``start`` on."""
    read = found.where("what = 'edge'").select("file", "seq", F.from_json("fact", "src string, dst string, kind string, confidence double, weight int, scope string, detail string").alias("e")).select("file", "seq", "e.*")
    return numbered(read.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "weight": F.coalesce("weight", F.lit(1)), "scope": F.col("scope"), "detail": F.col("detail")}), start)


def numbered(edges: DataFrame, start: int = 0) -> DataFrame:
    """edges with edge_id = start, start + 1, ... by file and place in the file; a store's later batches start above all it has, so ids are unique and order edges by when they came."""
    return indexed(edges, "edge_id", "file", "seq").withColumn("edge_id", F.col("edge_id") + start).select(*EDGES.names)
