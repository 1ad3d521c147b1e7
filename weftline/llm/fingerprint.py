"""Document fingerprints: bottom-k sketches of word shingles, with DataFrame functions only.

Method.  A text's shingles (five words, lower case; fewer words make one shingle) are
hashed to 64 bits; the sketch is the ascending list of the k smallest distinct hashes.
The sketch of a union is the k smallest of two sketches, so parts merge in any order.
From two sketches follow the resemblance (share of the union's k smallest that both
have), the containment, and from one the number of distinct shingles.

A fingerprint is the sketch in hexadecimal; equal texts have equal ones.  Two empty
sketches resemble each other entirely, an empty one and another not at all.

Neighbours in id order (for the digest of op4) are found without a global sort: ids are
cut into ranges at quantiles of a bounded sample of them (so that far-off ids or dense
stretches make no range large), each range is one window partition, and the first document
of each range is sent to the range before as well (a row for each range).  There are
``RANGES_A_TASK`` ranges for each task of the scan, ``MOST_RANGES`` at most.  Texts are
shuffled once.

Defined cases: null texts are empty; a row with a null id has no place in the order and is
its own next document; repeated ids follow each other by text; the only document is its own
next; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WIDTH = 128, 5
RANGES_A_TASK, MOST_RANGES = 64, 1 << 17
#: Sampled ids for each range.
SAMPLED = 8
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all shingles of the whole text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")

    def hashed(w: Column) -> Column:
        n = F.size(w)
        return F.when(n >= width, F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, width)))).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashed)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    return smallest(shingle_hashes(text), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of what a and b sketch together."""
    return smallest(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated Jaccard similarity, 0 to 1."""
    both = let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)).cast("double") / F.size(u)))
    return both.cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles; exact below k."""
    # The k-th smallest of n uniform values is near k / n of the whole range.
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def merge_parts(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each key of many parts, in two steps so that no list of a hot key grows with its rows: hash ranges of a key are cut to k before they meet.  A key whose parts are all empty (or null) keeps an empty sketch."""
    salted = df.select(*keys, F.explode_outer(column).alias("h")).distinct().withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(64)))
    rank = F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(F.asc_nulls_last("h")))
    return salted.withColumn("r", rank).where(F.col("r") <= k).groupBy(*keys).agg(smallest(F.collect_list("h"), k).alias(column))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.hex(x)), ",")


def range_starts(keys: DataFrame, most: int = MOST_RANGES, a_task: int = RANGES_A_TASK) -> list[int]:
    """Ascending first ids of ranges with about as many rows each, from a hashed sample of the ids (column row_key)."""
    seen = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.count("row_key").alias("n")).agg(F.count("*").alias("tasks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ranges = max(1, min(most, a_task * seen["tasks"], seen["n"]))
    share = min(1.0, SAMPLED * ranges / max(1, seen["n"]))
    sample = keys.where((F.pmod(F.xxhash64(F.lit(41), "row_key"), F.lit(1 << 30)) / float(1 << 30) < share) & F.col("row_key").isNotNull())
    # At most about SAMPLED * MOST_RANGES ids meet in one row; only the quantiles reach the driver.
    ordered = sample.agg(F.sort_array(F.collect_list("row_key")).alias("ids"))
    at = F.transform(F.sequence(F.lit(1), F.lit(max(1, ranges - 1))), lambda i: F.try_element_at("ids", (F.floor(i * F.size("ids") / F.lit(ranges)) + 1).cast("int")))
    return sorted({v for v in ordered.select(at.alias("at")).first()["at"] if v is not None})


def range_of(key: Column, starts: list[int]) -> Column:
    """The number of range starts at or below the key: a binary search in a constant array."""
    if not starts:
        return F.when(key.isNull(), 0).otherwise(0)  # no literal: a number to group by would be a position
    listed = F.expr(f"cast(split('{','.join(map(str, starts))}', ',') as array<bigint>)")
    half = lambda acc: F.shiftright(acc["lo"] + acc["hi"], 1)
    # Of lo .. hi, hi is the first start above the key, or the number of starts.
    step = lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).when(F.element_at(listed, half(acc) + 1) <= key, F.struct((half(acc) + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), half(acc).alias("hi")))
    rounds = F.sequence(F.lit(1), F.lit(len(starts).bit_length()))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.lit(len(starts)).alias("hi")), step, lambda acc: acc["lo"])


def with_next(docs: DataFrame, ranges: int = MOST_RANGES) -> tuple[DataFrame, Window]:
    """(row_key, text, follows, next_text) in windows of one range of ids, and the window; rows with ``follows`` only close a range and are to be dropped after use."""
    placed = docs.where("row_key is not null")
    starts = range_starts(docs.select("row_key"), ranges)
    at = range_of(F.col("row_key"), starts)
    # One id for each range that has documents.
    heads = placed.groupBy(at.alias("range")).agg(F.min("row_key").alias("row_key"))
    order = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(order), F.last("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.withColumn("before", before).select("row_key", "before")
    closing = placed.join(F.broadcast(heads), "row_key").select(F.col("before").alias("range"), "row_key", "text", F.lit(True).alias("follows"))
    # Rows without an id are dealt out by their text and need no neighbour.  All rows meet before the one exchange: a union after it would cost another.
    place = F.when(F.col("row_key").isNotNull(), at).otherwise(-1 - F.pmod(F.xxhash64("text"), F.lit(max(1, len(starts)))).cast("int"))
    own = docs.select(place.alias("range"), "row_key", "text", F.lit(False).alias("follows"))
    by = Window.partitionBy("range").orderBy("follows", "row_key", "text")
    after = F.when(F.col("row_key").isNull(), F.col("text")).otherwise(F.lead("text").over(by))
    return own.unionByName(closing).withColumn("next_text", after), by


def contract(spark, sf_dir: str) -> DataFrame:
    """The digest of op4 for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    placed, by = with_next(docs)
    n = F.char_length("text")
    moved = F.floor(n / F.lit(4)).cast("int")
    # Every own row has a following one, since a closing row ends each range.
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - moved), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), moved))
    out = placed.withColumns({"n_chars": n.cast("long"), "edited": F.when(~F.col("follows"), edited), "own": sketch(F.col("text"))})
    out = out.withColumn("next_own", F.when(F.col("row_key").isNull(), F.col("own")).otherwise(F.lead("own").over(by))).where(~F.col("follows"))
    out = out.withColumn("edited_own", sketch(F.col("edited")))
    return out.select(
        F.col("row_key").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited_own")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("edited_own")).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_own")).alias("near_next"),
        distinct_count(F.col("own")).alias("distinct_shingles"),
    )
