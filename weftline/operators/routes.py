"""Matching of client calls to service routes by URL pattern, and their extraction from source text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from weftline.functions.lineage import settle
from weftline.functions.vocabulary import CLIENT_PATTERNS, METHOD_NAMES, ROUTE_PATTERNS
from weftline.sources.files import LINE_ENDS

PARAM = "[^/]+"
#: A parameter in a route whose other characters are compared.
MARK = "\u0001"


def bare_path(url: Column) -> Column:
    """The path a call names: without scheme and host, without trailing slashes."""
    bare = F.regexp_replace(url, "/+$", "")
    return F.when(F.contains(bare, F.lit("://")), F.regexp_replace(bare, r"^[\s\S]*?://[^/]*", "")).otherwise(bare)


def call_path(url: Column) -> Column:
    """As bare_path, with the call's own placeholders as the text they match by."""
    return F.regexp_replace(bare_path(url), r"\{[^}]+\}", PARAM)


def route_template(url: Column, param: str) -> Column:
    """The route without trailing slashes, with ``param`` for :name and {name}."""
    bare = F.regexp_replace(url, "/+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r":[a-zA-Z_]\w*", param), r"\{[a-zA-Z_]\w*\}", param)


@F.pandas_udf(BooleanType())
def _fits(path: pd.Series, pattern: pd.Series, bare: pd.Series, route: pd.Series) -> pd.Series:
    """Whether paths match patterns of Python's dialect; where a pattern is none, whether the texts are equal.  The engine that judges a pattern also runs it."""

    def compiled(p: str):
        try:
            return re.compile(p)
        except re.error:
            return None

    known = {p: compiled(p) for p in set(pattern)}
    return pd.Series([bool(known[p].match(x)) if known[p] else b == r for x, p, b, r in zip(path, pattern, bare, route)], dtype=bool)


def methods_agree(a: Column, b: Column) -> Column:
    free = lambda m: m.isNull() | (m == "") | (m == "ANY")
    return free(a) | free(b) | (a == b)


def candidates(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Calls (path, ...) with the plain routes (marked, ...) that have as many segments and agree where those hold no parameter."""
    # A pattern's end also fits before a last line end.
    path = F.regexp_replace("path", r"(?:\r\n|[\n\r\u0085\u2028\u2029])\z", "")
    routes = routes.withColumn("parts", F.split("marked", "/")).withColumn("holes", F.transform("parts", lambda p: F.contains(p, F.lit(MARK))))
    fixed = lambda parts: F.array_join(F.filter(parts, lambda _, i: ~F.get("holes", i)), "/")
    shapes = routes.select("holes").distinct()
    shaped = calls.withColumn("parts", F.split(path, "/")).join(F.broadcast(shapes), F.size("parts") == F.size("holes"))
    return shaped.withColumn("rest", fixed("parts")).drop("parts").join(routes.withColumn("rest", fixed("parts")).drop("parts"), ["holes", "rest"]).drop("holes", "rest")


def matches(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Every call with every route it fits: calls (symbol, language, url_pattern, method, file), routes likewise.  Duplicates stay.

    A plain route (letters, digits, common signs and whole parameters) only fits calls with as
    many segments that are equal to its own wherever those hold no parameter.  So calls take
    the few shapes (number of segments, which of them hold parameters) that routes have, the
    join is an equality on all other segments, and the pattern is tested on what meets.
    Routes with signs of regular expressions can span segments; they meet the calls of their
    first segment where that is plain text with another segment after it, and otherwise all
    calls of a method that agrees.  One that does not compile fits its own text.
    """
    left = settle(calls.select(*(F.col(c).alias(f"c_{c}") for c in calls.columns)).withColumns({"path": call_path(F.col("c_url_pattern")), "bare": bare_path(F.col("c_url_pattern"))}))
    right = routes.select(*(F.col(c).alias(f"r_{c}") for c in routes.columns))
    right = settle(right.withColumns({"marked": route_template(F.col("r_url_pattern"), MARK), "pattern": F.concat(F.lit("^"), route_template(F.col("r_url_pattern"), PARAM), F.lit("$"))}))
    right = right.withColumn("plain", F.col("marked").rlike(f"^[A-Za-z0-9_~%/:,;=&!@#{MARK}-]*$"))
    agree = methods_agree(F.col("c_method"), F.col("r_method"))
    fits = agree & F.expr("path rlike pattern")
    known = candidates(left, right.where("plain")).where(fits)
    odd = right.where("not plain").withColumn("named", F.col("marked").rlike(r"^/[A-Za-z0-9_~%-]+/[^?*+{|]") & ~F.contains("marked", F.lit("|")))
    if odd.isEmpty():
        return known.drop("plain", "path", "bare", "pattern", "marked")
    head = lambda p: F.coalesce(F.get(F.split(p, "/"), F.lit(1)), F.lit(""))
    near = left.join(odd.where("named"), (head("path") == head("marked")) & agree)
    any_ = left.join(odd.where("not named"), agree)
    free = near.unionByName(any_).where(_fits("path", "pattern", "bare", F.regexp_replace("r_url_pattern", "/+$", ""))).drop("named")
    return known.unionByName(free).drop("plain", "path", "bare", "pattern", "marked")


def confidence(call_method: Column, route_method: Column, call_language: Column, route_language: Column, in_files: Column | None = None) -> Column:
    """0.6, 0.15 more for the same named method, 0.1 more across languages (of rows that have files), at most 0.95."""
    same = (call_method == route_method) & (call_method != "ANY")
    across = call_language != route_language
    across = across if in_files is None else across & in_files
    return F.round(F.least(F.lit(0.95), 0.6 + F.when(same, 0.15).otherwise(0.0) + F.when(across, 0.1).otherwise(0.0)), 2)


def contracts(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """caller, caller_language, handler, handler_language, integration, contract, confidence and detail (JSON) of each match."""
    m = matches(calls, routes).withColumn("method", F.coalesce("r_method", F.lit("ANY")))
    in_files = (F.coalesce("c_file", F.lit("")) != "") & (F.coalesce("r_file", F.lit("")) != "")
    return m.select(
        F.col("c_symbol").alias("caller"),
        F.col("c_language").alias("caller_language"),
        F.col("r_symbol").alias("handler"),
        F.col("r_language").alias("handler_language"),
        F.lit("rest_api").alias("integration"),
        F.concat_ws(" ", "method", "r_url_pattern").alias("contract"),
        confidence(F.col("c_method"), F.col("r_method"), F.col("c_language"), F.col("r_language"), in_files).alias("confidence"),
        F.to_json(F.struct(F.col("c_symbol").alias("caller"), F.col("r_symbol").alias("handler"), F.col("r_url_pattern").alias("route"), "method")).alias("detail"),
    )


def _extract(units: DataFrame, patterns: dict, text: str) -> DataFrame:
    """A row for each match of each pattern of a unit's language: (symbol, language, url_pattern, method, file)."""
    names = F.create_map(*(F.lit(v) for kv in METHOD_NAMES.items() for v in kv))

    def found(p) -> Column:
        urls = F.regexp_extract_all(F.col(text), F.lit(p.regex), F.lit(p.url))
        raw = F.regexp_extract_all(F.col(text), F.lit(p.regex), F.lit(p.method)) if p.method else F.transform(urls, lambda u: F.lit("ANY"))
        return F.arrays_zip(urls.alias("u"), raw.alias("m"))

    every = F.lit(None)
    for language, listed in patterns.items():
        every = F.when(F.col("language") == language, F.concat(*(found(p) for p in listed))).otherwise(every)
    rows = units.select("symbol", "language", "file", F.explode(every).alias("x"))
    return rows.select("symbol", "language", F.col("x.u").alias("url_pattern"), F.coalesce(names[F.col("x.m")], F.upper("x.m")).alias("method"), "file")


def route_definitions(units: DataFrame) -> DataFrame:
    """Routes in the context of callables; units (symbol, language, file, context)."""
    return _extract(units, ROUTE_PATTERNS, "context")


def client_calls(units: DataFrame) -> DataFrame:
    """HTTP calls in the bodies of callables; units (symbol, language, file, body)."""
    return _extract(units, CLIENT_PATTERNS, "body")


def units_of(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Callables with their own lines (body) and the lines from five before to three after their first (context); sources (file, content, language)."""
    joined = nodes.where(F.col("kind").isin("function", "method")).join(sources, "file").withColumn("lines", F.split("content", LINE_ENDS))
    start, end = F.greatest("line_start", F.lit(1)), F.col("line_end")
    body = F.array_join(F.slice("lines", start, F.greatest(end - start + 1, F.lit(0))), "\n")
    low = F.greatest(start - 5, F.lit(1))
    context = F.array_join(F.slice("lines", low, start + 4 - low), "\n")
    return joined.select(F.col("id").alias("symbol"), "language", "file", body.alias("body"), context.alias("context"))
