"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Method.  Documents are the leaves' token supply in a tree of domain, language and source.
A budget of tokens is propagated from the root: at each node it is shared among the
children by weight; a child whose supply (times the greatest number of epochs) is short of
its share gets all it has, and what it lacks goes to its siblings by weight; only what a
whole subtree lacks reaches the ancestor's level.  That is water-filling, which has a
closed form over children sorted by supply per weight, so each level is one window over
that level's nodes and no iteration.  Shares are whole tokens (decimal arithmetic), rounded
down, so a node may stay below its budget by less than one token for each child.

A leaf's budget is whole epochs and a rest.  For the rest, the next epoch's order is by
a seeded hash, and the epoch's prefix up to the rest is taken: documents that begin before
it, the one that crosses it whole.  The line is found by hash buckets: sums of buckets are
aggregated first, and only the bucket with the line is ordered, so no leaf is ever one
window, though it hold a third of all rows.  Selection then is a comparison with the line
of the leaf.  A plan of up to ``LEAVES_SENT`` leaves is sent to all tasks, and texts are not
shuffled; of a larger one, narrow rows meet the plan (a hot leaf is split by the skew rule),
and texts meet what was chosen by their keys, never by their leaf.

Defined cases: a null language, source or domain is a node named "(none)"; empty and null
texts have no tokens and are taken in whole epochs, and in the prefix where they fall in it;
ties in the hash are by key; equal keys are taken together; a weight that is not listed is
1 and a weight of 0 gives nothing; a budget above the supply takes all epochs; an empty
table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.spill import release, table

LEVELS = ("domain", "lang", "source")
#: Production parameters of the registered query and of the pipeline's last stage.
SEED = 17
EPOCHS = 3
#: Leaves (rows of a few dozen bytes and three names) that may be broadcast.
LEAVES_SENT = 50_000
BUDGET_SHARE = (3, 5)
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
    "source": {},
}
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """The domain of a source of this corpus: its number modulo 4; sources without a number are d0."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), (F.coalesce(F.when(number != "", number).cast("int"), F.lit(0)) % 4).cast("string"))


def tokens_of(text: Column) -> Column:
    """Words of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, name: Column, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for value, w in sorted(weights.get(level, {}).items()):
        out = F.when(name == value, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def allocate(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent columns, name, cap, weight, given: the parent's budget) with ``budget``: the parent's budget shared by weight, shortages passed to siblings."""
    nodes = nodes.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0)).cast("long"))
    nodes = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(-1.0)))
    by = Window.partitionBy(*parent).orderBy("ratio", name) if parent else Window.orderBy("ratio", name)
    up_to = by.rowsBetween(Window.unboundedPreceding, -1)
    onward = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumn("left", F.col("given") - F.coalesce(F.sum("cap").over(up_to), F.lit(0))).withColumn("rest_weight", F.sum("weight").over(onward))
    full = F.expr("cast(cap as decimal(20,0)) * cast(rest_weight as decimal(12,0)) <= cast(weight as decimal(12,0)) * cast(left as decimal(20,0))")
    nodes = nodes.withColumn("full", full)
    # The first child that is not filled fixes the price of all that follow.
    all_of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    nodes = nodes.withColumn("line", F.min(F.when(~F.col("full"), F.struct("ratio", name, "left", "rest_weight"))).over(all_of))
    share = F.expr("(cast(weight as decimal(12,0)) * cast(line.left as decimal(20,0))) div cast(line.rest_weight as decimal(12,0))")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(share).cast("long"))


def budgets(leaves: DataFrame, *, share: tuple[int, int] = BUDGET_SHARE, total: int | None = None, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] = WEIGHTS) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget, whole epochs and rest.  The budget is ``total`` tokens, or a share of the supply."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    given = leaves.agg((F.lit(total) if total is not None else F.expr(f"coalesce(sum(tokens), 0) * {share[0]} div {share[1]}")).cast("long").alias("given"))
    keys: list[str] = []
    for level in LEVELS:
        parent, keys = keys, [*keys, level]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, F.col(level), weights))
        nodes = nodes.join(given, parent) if parent else nodes.join(F.broadcast(given))
        given = allocate(nodes, parent, level).select(*keys, F.col("budget").alias("given"))
    out = leaves.join(given.withColumnRenamed("given", "budget"), list(LEVELS))
    return out.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def _order(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def plan(rows: DataFrame, *, seed: int = SEED, **how) -> DataFrame:
    """A row for each leaf: whole epochs, and the line (order, key) up to which the next epoch is taken; rows are (row_key, domain, lang, source, n_tokens)."""
    keys = list(LEVELS)
    supply = table(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")))
    # Few leaves are one partition, which needs no exchange at any level; more are dealt by parent.
    leaves = table(budgets(supply.coalesce(1) if supply.limit(LEAVES_SENT + 1).count() <= LEAVES_SENT else supply, **how))
    partly = leaves.where("rest > 0").select(*keys, "epochs", "rest")
    some = rows.join(partly, keys).withColumn("order", _order(seed, F.col("epochs"), F.col("row_key"))).withColumn("bucket", F.substring("order", 1, 3))
    sums = some.groupBy(*keys, "rest", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    last = sums.where("start < rest and rest <= start + in_bucket").select(*keys, "bucket", "start")
    inside = some.join(last, [*keys, "bucket"])
    before = Window.partitionBy(*keys).orderBy("order", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.col("start") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).where("at < rest")
    lines = inside.groupBy(*keys).agg(F.max(F.struct("order", "row_key")).alias("line"))
    release(rows.sparkSession)
    return leaves.join(lines, keys, "left").select(*keys, "tokens", "budget", "epochs", "line")


def take(docs: DataFrame, leaf_plan: DataFrame, leaf: list[Column], *, key: str = "doc_id", seed: int = SEED, sent: int = LEAVES_SENT) -> DataFrame:
    """docs that the plan takes, with ``copies`` (a column of that name is replaced); ``leaf`` gives domain, language and source of a row."""
    names = docs.columns
    own = [*(c.alias(n) for c, n in zip(leaf, LEVELS)), F.col(key).cast("long").alias("row_key")]
    lines = leaf_plan.select(*LEVELS, "epochs", "line")
    in_prefix = F.struct(_order(seed, F.col("epochs"), F.col("row_key")).alias("order"), F.col("row_key")) <= F.col("line")
    copies = (F.col("epochs") + F.coalesce(in_prefix, F.lit(False)).cast("int")).alias("copies")
    inner = docs.select(F.struct(*(F.col(c) for c in names)).alias("row"), *own)
    if leaf_plan.limit(sent + 1).count() <= sent:
        taken = inner.join(F.broadcast(lines), list(LEVELS)).select("row", copies)
    else:
        chosen = docs.select(*own).distinct().join(lines, list(LEVELS)).select(*(F.col(c).alias(f"c_{c}") for c in (*LEVELS, "row_key")), copies).where("copies > 0")
        same = F.lit(True)
        for c in (*LEVELS, "row_key"):
            same = same & F.col(c).eqNullSafe(F.col(f"c_{c}"))
        taken = inner.join(chosen, same).select("row", "copies")
    return taken.where("copies > 0").select(*(F.col("row")[c].alias(c) for c in names if c.lower() != "copies"), "copies")


def leaf_of(lang: str = "lang", source: str = "source") -> list[Column]:
    none = F.lit("(none)")
    return [domain_of(F.col(source)), F.coalesce(F.col(lang), none), F.coalesce(F.col(source), none)]


def narrow_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What budgeting needs of each document, counted once."""
    return table(docs.select(F.col(key).cast("long").alias("row_key"), *(c.alias(n) for c, n in zip(leaf_of(), LEVELS)), tokens_of(F.col(text)).alias("n_tokens")))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = SEED, **how) -> DataFrame:
    """The documents of the mix, unchanged, with ``copies``: how often each is taken."""
    leaf_plan = table(plan(narrow_rows(docs, key, text), seed=seed, **how))
    release(docs.sparkSession)
    return take(docs, leaf_plan, leaf_of(), key=key, seed=seed)


def contract(spark, sf_dir: str) -> DataFrame:
    """op3: every document of the mix, its leaf, its tokens and its copies."""
    rows = narrow_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    leaf_plan = table(plan(rows))
    out = take(rows, leaf_plan, [F.col(c) for c in LEVELS], key="row_key")
    return out.select(F.col("row_key").alias("doc_id"), *LEVELS, "n_tokens", F.col("copies").cast("long").alias("copies"))


def _level_sql(level: str, parent: list[str], source: str, weights: dict[str, int]) -> str:
    keys = ", ".join([*parent, level])
    weight = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in sorted(weights.items())) + " ELSE 1 END" if weights else "1"
    join = f"JOIN b_{parent[-1]} p ON " + " AND ".join(f"n.{c} = p.{c}" for c in parent) if parent else "CROSS JOIN total p"
    part = "PARTITION BY " + ", ".join(parent) if parent else ""
    return f"""
n_{level} AS (SELECT n.*, p.given FROM (SELECT {keys}, CASE WHEN {weight} > 0 THEN sum(cap) ELSE 0 END::HUGEINT AS cap, {weight}::HUGEINT AS weight FROM leaves GROUP BY {keys}) n {join}),
o_{level} AS (SELECT *, CASE WHEN weight > 0 THEN cap::DOUBLE / weight::DOUBLE ELSE -1.0 END AS ratio FROM n_{level}),
s_{level} AS (SELECT *, given - coalesce(sum(cap) OVER ({part} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
    sum(weight) OVER ({part} ORDER BY ratio, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rw FROM o_{level}),
f_{level} AS (SELECT *, cap * rw <= weight * rem AS filled FROM s_{level}),
l_{level} AS (SELECT *, min(CASE WHEN NOT filled THEN {{'r': ratio, 'k': {level}, 'rem': rem, 'rw': rw}} END) OVER ({part}) AS line FROM f_{level}),
b_{level} AS (SELECT {keys}, CASE WHEN filled THEN cap ELSE (weight * line.rem) // line.rw END AS given FROM l_{level}),"""


ORACLE_SQL = f"""
WITH rows_ AS (
  SELECT doc_id, 'd' || CAST(coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INT), 0) % 4 AS VARCHAR) AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {EPOCHS} AS cap FROM rows_ GROUP BY ALL),
total AS (SELECT coalesce(sum(tokens), 0) * {BUDGET_SHARE[0]} // {BUDGET_SHARE[1]} AS given FROM leaves),
{"".join(_level_sql(c, list(LEVELS[:i]), "leaves", WEIGHTS[c]) for i, c in enumerate(LEVELS))}
e AS (SELECT l.domain, l.lang, l.source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs, given - CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END * tokens AS rest
  FROM leaves l JOIN b_source b ON l.domain = b.domain AND l.lang = b.lang AND l.source = b.source),
laid AS (SELECT r.*, e.epochs, e.rest,
    coalesce(sum(n_tokens) OVER (PARTITION BY r.domain, r.lang, r.source ORDER BY md5('{SEED}:' || CAST(e.epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
  FROM rows_ r JOIN e ON r.domain = e.domain AND r.lang = e.lang AND r.source = e.source)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN begun < rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM laid WHERE epochs + CASE WHEN begun < rest THEN 1 ELSE 0 END > 0
"""
