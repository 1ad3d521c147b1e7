"""Source files made of the driver's rows, and what extraction must find in them, for queries from source text to answers.

Each template makes one file for each row of a table: {k} is the row's key, {m} a second
number.  The rows of nodes and edges are written down by hand beside the text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.views import table
from weftline.sources import files


class Template(NamedTuple):
    """path and text; the table, its key and the second number (as SQL); nodes (id, kind, first line, last line, signature, docstring, is_test) and edges (src, dst, kind, confidence)."""

    path: str
    table: str
    key: str
    second: str
    text: str
    nodes: tuple
    edges: tuple


PYTHON = Template(
    "sup/s{k}.py", "supplier", "s_suppkey", "s_nationkey",
    '''import os
from lib.n{m} import tool as t{k}

class Base{k}:
    def run(self):
        return 1

class S{k}(Base{k}):
    """Supplier {k}."""
    limit = 3

    def run(self):
        self.total = {k}
        open("f")
        return t{k}(1)

@app.get("/api/s{k}/:id")
def serve_{k}(r, n: int = 2):
    b = Base{k}()
    b.run()
    return helper_{k}(r)

def helper_{k}(x):
    """Helps supplier {k} of nation {m}."""
    return unknown_{m}(x)

LIMIT_{k} = {k}
''',
    (
        ("sup.s{k}.Base{k}", "class", 4, 6, "class Base{k}", None, 0),
        ("sup.s{k}.Base{k}.run", "method", 5, 6, "def run(self)", None, 0),
        ("sup.s{k}.S{k}", "class", 8, 15, "class S{k}", "Supplier {k}.", 0),
        ("sup.s{k}.S{k}.run", "method", 12, 15, "def run(self)", None, 0),
        ("sup.s{k}.serve_{k}", "function", 18, 21, "def serve_{k}(r, n: int = 2)", None, 0),
        ("sup.s{k}.helper_{k}", "function", 23, 25, "def helper_{k}(x)", "Helps supplier {k} of nation {m}.", 0),
        ("sup.s{k}.LIMIT_{k}", "variable", 27, 27, None, None, 0),
    ),
    (
        ("sup.s{k}.S{k}", "sup.s{k}.Base{k}", "inherits", 1.0),
        ("sup.s{k}.S{k}.run", "open", "calls", 0.3),
        ("sup.s{k}.S{k}.run", "lib.n{m}.tool", "calls", 0.8),
        ("sup.s{k}.S{k}.run", "sup.s{k}.S{k}.total", "mutates", 1.0),
        ("sup.s{k}.S{k}.run", "side_effect:file_io:open", "side_effect", 1.0),
        ("sup.s{k}.S{k}.run", "sup.s{k}.Base{k}.run", "overrides", 1.0),
        ("sup.s{k}.serve_{k}", "app.get", "calls", 0.3),
        ("sup.s{k}.serve_{k}", "sup.s{k}.Base{k}", "calls", 1.0),
        ("sup.s{k}.serve_{k}", "sup.s{k}.Base{k}.run", "calls", 0.5),
        ("sup.s{k}.serve_{k}", "sup.s{k}.helper_{k}", "calls", 1.0),
        ("sup.s{k}.serve_{k}", "sup.s{k}.b", "mutates", 0.8),
        ("sup.s{k}.helper_{k}", "unknown_{m}", "calls", 0.3),
        ("sup.s{k}", "os", "imports", 1.0),
        ("sup.s{k}", "lib.n{m}.tool", "imports", 1.0),
    ),
)
TEST = Template(
    "sup/test_s{k}.py", "supplier", "s_suppkey", "s_nationkey",
    "from sup.s{k} import helper_{k}\n\ndef test_h():\n    assert helper_{k}(1) == 1\n",
    (("sup.test_s{k}.test_h", "function", 3, 4, "def test_h()", None, 1),),
    (
        ("sup.test_s{k}.test_h", "sup.s{k}.helper_{k}", "calls", 0.8),
        ("sup.test_s{k}.test_h", "sup.s{k}.helper_{k}", "asserts_on", 1.0),
        ("sup.test_s{k}", "sup.s{k}.helper_{k}", "imports", 1.0),
    ),
)
SCRIPT = Template(
    "web/c{k}.js", "customer", "c_custkey", "c_custkey % 10",
    'import { h } from "./lib";\n\nclass C{k} extends Base {\n  load(id) {\n    this.n = draw{k}(id);\n    return fetch("http://host/api/s{m}/7");\n  }\n}\n\n// Draws {k}.\nfunction draw{k}(x) {\n  return x;\n}\n',
    (
        ("web.c{k}.C{k}", "class", 3, 8, "class C{k}", None, 0),
        ("web.c{k}.C{k}.load", "method", 4, 7, "load(id)", None, 0),
        ("web.c{k}.draw{k}", "function", 11, 13, "function draw{k}(x)", "Draws {k}.", 0),
    ),
    (
        ("web.c{k}.C{k}", "Base", "inherits", 0.8),
        ("web.c{k}.C{k}.load", "web.c{k}.draw{k}", "calls", 1.0),
        ("web.c{k}.C{k}.load", "fetch", "calls", 0.3),
        ("web.c{k}.C{k}.load", "side_effect:network:fetch", "side_effect", 1.0),
        ("web.c{k}.C{k}.load", "web.c{k}.C{k}.n", "mutates", 1.0),
        ("web.c{k}", "./lib", "imports", 1.0),
    ),
)
SCRIPT_TEST = Template(
    "web/n{k}.test.ts", "nation", "n_nationkey", "n_regionkey",
    "import { f } from './n{k}';\n\nfunction area{k}(x: number): number {\n  return x;\n}\n\nfunction check{k}() {\n  expect(\n    area{k}(1)\n  ).toBe(1);\n}\n",
    (("web.n{k}.test.area{k}", "function", 3, 5, "function area{k}(x: number): number", None, 1), ("web.n{k}.test.check{k}", "function", 7, 11, "function check{k}()", None, 1)),
    (
        ("web.n{k}.test.check{k}", "expect(\n    area{k}(1)\n  ).toBe", "calls", 0.3),
        ("web.n{k}.test.check{k}", "expect", "calls", 0.3),
        ("web.n{k}.test.check{k}", "web.n{k}.test.area{k}", "asserts_on", 0.8),
        ("web.n{k}.test.check{k}", "web.n{k}.test.area{k}", "calls", 1.0),
        ("web.n{k}.test.check{k}", "web.n{k}.test.area{k}", "asserts_on", 0.8),
        ("web.n{k}.test", "./n{k}", "imports", 1.0),
    ),
)
GO = Template(
    "svc/n{k}.go", "nation", "n_nationkey", "n_regionkey",
    'package svc\n\nimport "net/http"\n\n// Handler{k} serves.\nfunc Handler{k}(w http.ResponseWriter) {\n\thelp{k}()\n\thttp.Get("/x")\n}\n\nfunc help{k}() {}\n',
    (("svc.n{k}.Handler{k}", "function", 6, 9, "func Handler{k}(w http.ResponseWriter)", "Handler{k} serves.", 0), ("svc.n{k}.help{k}", "function", 11, 11, "func help{k}()", None, 0)),
    (
        ("svc.n{k}.Handler{k}", "svc.n{k}.help{k}", "calls", 1.0),
        ("svc.n{k}.Handler{k}", "http.Get", "calls", 0.3),
        ("svc.n{k}.Handler{k}", "side_effect:network:http.Get", "side_effect", 1.0),
        ("svc.n{k}", "net/http", "imports", 1.0),
    ),
)
RUST = Template(
    "core/n{k}.rs", "nation", "n_nationkey", "n_regionkey",
    'use std::fs;\n\nstruct S{k};\n\nimpl S{k} {\n    pub fn go(&mut self) {\n        self.n = 1;\n        help{k}();\n    }\n}\n\nfn help{k}() {}\n',
    (
        ("core.n{k}.S{k}", "class", 3, 3, "class S{k}", None, 0),
        ("core.n{k}.S{k}", "class", 5, 10, "class S{k}", None, 0),
        ("core.n{k}.S{k}.go", "method", 6, 9, "pub fn go(&mut self)", None, 0),
        ("core.n{k}.help{k}", "function", 12, 12, "fn help{k}()", None, 0),
    ),
    (
        ("core.n{k}.S{k}.go", "core.n{k}.help{k}", "calls", 1.0),
        ("core.n{k}.S{k}.go", "core.n{k}.S{k}.n", "mutates", 1.0),
        ("core.n{k}", "std::fs", "imports", 1.0),
    ),
)
JAVA = Template(
    "j/J{k}.java", "nation", "n_nationkey", "n_regionkey",
    "import com.x.Foo;\n\n/** The {k}. */\npublic class J{k} extends B implements I, K {\n  public int f(int x) {\n    this.n = 1;\n    return g(x);\n  }\n  int g(int x) { return x; }\n}\n",
    (
        ("j.J{k}.J{k}", "class", 4, 10, "class J{k}", "The {k}.", 0),
        ("j.J{k}.J{k}.f", "method", 5, 8, "public int f(int x)", None, 0),
        ("j.J{k}.J{k}.g", "method", 9, 9, "int g(int x)", None, 0),
    ),
    (
        ("j.J{k}.J{k}", "B", "inherits", 0.8),
        ("j.J{k}.J{k}", "I", "inherits", 0.8),
        ("j.J{k}.J{k}", "K", "inherits", 0.8),
        ("j.J{k}.J{k}.f", "j.J{k}.J{k}.g", "calls", 1.0),
        ("j.J{k}.J{k}.f", "j.J{k}.J{k}.n", "mutates", 1.0),
        ("j.J{k}", "com.x.Foo", "imports", 1.0),
    ),
)
TEMPLATES = (PYTHON, TEST, SCRIPT, SCRIPT_TEST, GO, RUST, JAVA)


#: Files made, and so parsed, by one task.
FILES_OF_TASK = 4_000


def _filled(template: str | None, key, second):
    if template is None:
        return F.lit(None).cast("string")
    return F.replace(F.replace(F.lit(template), F.lit("{k}"), key), F.lit("{m}"), second)


def source_files(spark: SparkSession, sf_dir: str, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(file, relative, language, module, content, sha256) as a scan gives them."""
    out, counts = None, {}
    for t in templates:
        key, second = F.col(t.key).cast("string"), F.expr(t.second).cast("string")
        keys = table(spark, sf_dir, t.table).select(*{t.key, *(c for c in table(spark, sf_dir, t.table).columns if c in t.second)})
        if t.table not in counts:
            counts[t.table] = keys.count()
        # A row is a few bytes where it is read and milliseconds of work where its file is parsed.
        rows = keys.repartition(-(-counts[t.table] // FILES_OF_TASK) or 1, t.key).select(_filled(t.path, key, second).alias("file"), _filled(t.text, key, second).cast("binary").alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("file", F.col("file").alias("relative"), files.language_of(F.col("file")).alias("language"), files.module_of(F.col("file")).alias("module"), "content", F.sha2("content", 256).alias("sha256"))


def _sql_filled(template: str | None, t: Template) -> str:
    if template is None:
        return "NULL"
    quoted = template.replace("'", "''")
    return f"replace(replace('{quoted}', '{{k}}', CAST({t.key} AS VARCHAR)), '{{m}}', CAST({t.second} AS VARCHAR))"


def nodes_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The nodes that extraction must find, as SQL over the driver's tables."""
    rows = []
    for t in templates:
        for id_, kind, first, last, signature, doc, is_test in t.nodes:
            rows.append(f"SELECT {_sql_filled(id_, t)} AS id, '{kind}' AS kind, {_sql_filled(t.path, t)} AS file, {first} AS line_start, {last} AS line_end, {_sql_filled(signature, t)} AS signature, {_sql_filled(doc, t)} AS docstring, 1 AS is_public, {is_test} AS is_test FROM {t.table}")
    return "\nUNION ALL ".join(rows)


def edges_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The edges that extraction must find."""
    rows = []
    for t in templates:
        for src, dst, kind, confidence in t.edges:
            rows.append(f"SELECT {_sql_filled(src, t)} AS src, {_sql_filled(dst, t)} AS dst, '{kind}' AS kind, CAST({confidence} AS DOUBLE) AS confidence, {_sql_filled(t.path, t)} AS file FROM {t.table}")
    return "\nUNION ALL ".join(rows)
