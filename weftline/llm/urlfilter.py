"""URL filters by a temporal list join.

Method.  A list is a log of dated entries: from its date on, a host, a domain (with all
hosts below it) or a URL prefix is listed (add) or no longer (remove).  Entries of one key
become validity intervals, [date, date of the key's next entry).  A capture is evaluated
against the list as it was when it was fetched: its host, the domains above it and the
prefixes of its path are keys, and the as-of join takes the one interval of a key that
holds the fetch time.  Intervals of a key do not overlap, so a key gives a capture one
match at most.  A URL has a key for each label of its host and each segment of its path,
so an entry of any depth is found.

The join is an equality on the key with a condition on time: a host with a third of all
captures is on the large side only, which the skew rule splits; the list's side is sent
whole only if Spark measures it below its broadcast threshold.

Defined cases: a URL without a host or null matches nothing and is kept; hosts are
compared in lower case, without user, port and final dot; of entries of one key and time
the removal wins; a repeated entry changes nothing; a capture at the time of an entry sees
it; a null fetch time matches nothing; an empty list keeps all; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEMO_DAYS = 400


def host_of(url: Column) -> Column:
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """All keys under which a URL may be listed: host:h, domain:d for h and each domain above it, prefix:h/a, prefix:h/a/b and so on."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, -i, i), ".")))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    prefixes = F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.when(host != "", F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)).otherwise(F.array().cast("array<string>"))


def intervals(log: DataFrame) -> DataFrame:
    """(entry, category, since, until) in which a key is listed, from a log (entry, category, action, at)."""
    last = log.where(F.col("entry").isNotNull() & F.col("at").isNotNull()).groupBy("entry", "at").agg(F.max_by(F.struct("action", "category"), F.struct((F.col("action") == "remove").cast("int"), F.col("category"))).alias("e"))
    by = Window.partitionBy("entry").orderBy("at")
    return last.withColumn("until", F.lead("at").over(by)).where(F.col("e.action") == "add").select("entry", F.col("e.category").alias("category"), F.col("at").alias("since"), "until")


def match(captures: DataFrame, log: DataFrame, *, url: str = "url", fetched: str = "fetched", key: str = "page_id") -> DataFrame:
    """(key, entry, category, since) for every interval that holds a capture at its fetch time."""
    probes = captures.select(F.col(key), F.col(fetched).alias("fetched_"), F.explode(F.array_distinct(keys_of(F.col(url)))).alias("entry"))
    listed = intervals(log)
    found = probes.join(listed, (probes["entry"] == listed["entry"]) & (listed["since"] <= probes["fetched_"]) & (listed["until"].isNull() | (probes["fetched_"] < listed["until"])))
    return found.select(probes[key], listed["entry"], "category", "since")


def keep_unlisted(captures: DataFrame, log: DataFrame, *, url: str = "url", fetched: str = "fetched", key: str = "page_id") -> DataFrame:
    """captures of which no key is listed when they are fetched."""
    return captures.join(match(captures, log, url=url, fetched=fetched, key=key).select(key).distinct(), key, "left_anti").select(*captures.columns)


def demo_tables(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and a list log for tables that have no dates: a fetch day from the id, and for some hosts and domains an addition, a removal and a second addition on days from their hash."""
    captures = pages.select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(DEMO_DAYS)).alias("fetched"))
    host = host_of(F.col("url"))
    hosts = pages.select(host.alias("h")).where("h <> ''").distinct()
    named = hosts.select(F.concat(F.lit("host:"), "h").alias("entry")).unionByName(hosts.select(F.concat(F.lit("domain:"), F.substring_index("h", ".", -3)).alias("entry")).distinct())
    number = F.conv(F.substring(F.md5(F.col("entry").cast("binary")), 1, 4), 16, 10).cast("int")
    named = named.withColumn("c", number).where("c % 5 < 2").withColumn("category", F.concat(F.lit("c"), (F.col("c") % 3).cast("string")))
    dated = [("add", F.col("c") % 97), ("remove", F.col("c") % 97 + 60 + F.col("c") % 31), ("add", F.col("c") % 97 + 200)]
    days = F.array(*(F.struct(F.lit(action).alias("action"), at.alias("at")) for action, at in dated))
    return captures, named.select("entry", "category", F.explode(days).alias("d")).select("entry", "category", "d.action", "d.at")


def contract(spark, sf_dir: str) -> DataFrame:
    """op8: for every page the number of listed keys and the first of them at its fetch day, and whether it is kept."""
    captures, log = demo_tables(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = match(captures, log).groupBy("page_id").agg(F.count("*").alias("n_listed"), F.min(F.struct("entry", "category")).alias("e"))
    out = captures.join(found, "page_id", "left")
    return out.select("page_id", "fetched", F.coalesce("n_listed", F.lit(0)).alias("n_listed"), F.col("e.entry").alias("entry"), F.col("e.category").alias("category"), F.col("n_listed").isNull().alias("kept"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, (page_id * 37) % {DEMO_DAYS} AS fetched,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') AS h FROM pages),
h AS (SELECT DISTINCT h, array_to_string(list_slice(string_split(h, '.'), -3, -1), '.') AS d FROM p WHERE h <> ''),
named AS (SELECT 'host:' || h AS entry FROM h UNION SELECT 'domain:' || d FROM h),
kept AS (SELECT entry, c, 'c' || (c % 3) AS category FROM (SELECT entry, CAST('0x' || substr(md5(entry), 1, 4) AS INT) AS c FROM named) WHERE c % 5 < 2),
log AS (SELECT entry, category, 'add' AS action, c % 97 AS day FROM kept UNION ALL SELECT entry, category, 'remove', c % 97 + 60 + c % 31 FROM kept UNION ALL SELECT entry, category, 'add', c % 97 + 200 FROM kept),
spans AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY entry ORDER BY day) AS until FROM log) WHERE action = 'add'),
probes AS (SELECT page_id, fetched, 'host:' || p.h AS entry FROM p WHERE h <> '' UNION ALL SELECT page_id, fetched, 'domain:' || h.d FROM p JOIN h ON h.h = p.h),
found AS (SELECT page_id, count(*) AS n, min(s.entry) AS entry, min_by(s.category, s.entry) AS category FROM probes q JOIN spans s ON s.entry = q.entry AND s.day <= q.fetched AND (s.until IS NULL OR q.fetched < s.until) GROUP BY page_id)
SELECT p.page_id, p.fetched, coalesce(f.n, 0) AS n_listed, f.entry, f.category, f.n IS NULL AS kept FROM p LEFT JOIN found f ON f.page_id = p.page_id
"""
