"""Full-text search: token postings and BM25 with phrases.

Texts of the columns are cut into case-folded runs of letters and digits without
diacritics.  A query is split at white space and punctuation other than the underscore;
each part is a phrase (its own tokens next to each other in one column), and all phrases
must occur.

Two ways give the same scores: ``bm25`` reads texts once and counts in them; a stored index
(``postings`` by token, ``lengths`` by document) answers from the rows of the query's tokens.
"""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import settle

K1, B = 1.2, 0.75
#: The least inverse document frequency.
LEAST_IDF = 1e-6


def tokens(text: Column) -> Column:
    # Decomposition is not a Spark function; the letters of Latin-1 and Latin Extended-A are folded by a map.
    return F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), *_folds()), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _folds() -> tuple[str, str]:
    """Letters with diacritics up to U+024F and their bases, by decomposition."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isalpha() and base[0].isascii():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def phrases(query: str) -> list[list[str]]:
    """Token lists of the query's phrases; parts without letters or digits are left out."""
    table = str.maketrans(*_folds())
    parts = [re.findall(r"[^\W_]+", p.lower().translate(table)) for p in re.split(r"\W+", query)]
    return [p for p in parts if p]


def token_arrays(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, the token arrays of the columns (toks) and their number (dl): one pass over the text, no shuffle."""
    toks = F.array(*(tokens(F.col(c)) for c in columns))
    return docs.select(F.col(key).alias("id"), toks.alias("toks")).withColumn("dl", F.aggregate("toks", F.lit(0), lambda a, t: a + F.size(t)))


def postings(docs: DataFrame, key: str, columns: list[str], gen: int = 0) -> DataFrame:
    """(token, id, col, places, gen): the places of each token in each column of each document."""
    listed = token_arrays(docs, key, columns).select("id", F.posexplode("toks").alias("col", "toks")).select("id", "col", F.posexplode("toks").alias("place", "token"))
    return listed.groupBy("id", "col", "token").agg(F.sort_array(F.collect_list("place")).alias("places")).select("token", "id", "col", "places", F.lit(gen).cast("long").alias("gen"))


def lengths(docs: DataFrame, key: str, columns: list[str], gen: int = 0) -> DataFrame:
    """(id, file, dl, gen) of each document."""
    file = F.col("file") if "file" in docs.columns else F.lit(None).cast("string")
    dl = F.aggregate(F.array(*(F.size(tokens(F.col(c))) for c in columns)), F.lit(0), lambda a, n: a + n)
    return docs.select(F.col(key).alias("id"), file.alias("file"), dl.alias("dl"), F.lit(gen).cast("long").alias("gen"))


def hits(phrase: list[str]) -> Column:
    """Occurrences of a phrase within single columns."""
    n = len(phrase)
    if n == 1:
        in_column = lambda t: F.size(F.filter(t, lambda x: x == phrase[0]))
    else:
        wanted = F.array(*(F.lit(p) for p in phrase))
        in_column = lambda t: F.when(F.size(t) < n, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: (F.element_at(t, i) == phrase[0]) & (F.slice(t, i, n) == wanted))))
    return F.aggregate("toks", F.lit(0), lambda a, t: a + in_column(t))


def _score(counted: DataFrame, n: int, avgdl: float, found: list[int]) -> DataFrame:
    """(id, score) from rows (id, dl, f0, f1, ...) of documents, of which those with all phrases are kept."""
    score, every = F.lit(0.0), F.lit(True)
    for i, n_i in enumerate(found):
        idf = max(math.log((n - n_i + 0.5) / (n_i + 0.5)), 0.0) or LEAST_IDF
        f = F.col(f"f{i}").cast("double")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / avgdl))
        every = every & (F.col(f"f{i}") > 0)
    return counted.where(every).select("id", score.alias("score"))


def bm25(docs: DataFrame, query: str, *, key: str = "id", columns: tuple[str, ...] = ("id", "signature", "docstring")) -> DataFrame:
    """(id, score) of the documents that contain all phrases; the lower, the better.  Corpus figures are over all documents."""
    parts = phrases(query)
    counted = token_arrays(docs, key, list(columns))
    if not parts:
        return counted.limit(0).select("id", F.lit(0.0).alias("score"))
    # Texts are read once: what is kept of a document is its length and its counts.
    counted = settle(counted.select("id", "dl", *(hits(p).alias(f"f{i}") for i, p in enumerate(parts))))
    figures = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(parts)))).first()
    return _score(counted, figures["n"], figures["avgdl"] or 1.0, [figures[f"n{i}"] for i in range(len(parts))])


def score_postings(posted: DataFrame, length: DataFrame, parts: list[list[str]]) -> DataFrame:
    """As bm25, from postings of the query's tokens and the lengths of all documents; postings whose generation is not that of the length count no more."""
    if not parts:
        return length.limit(0).select("id", F.lit(0.0).alias("score"))
    words = sorted({t for p in parts for t in p})
    live = posted.repartition("id").join(length.select("id", "gen", "dl"), ["id", "gen"])
    none = F.expr("cast(array() as array<int>)")
    at = {w: f"w{i}" for i, w in enumerate(words)}
    per = live.groupBy("id", "dl", "col").agg(*(F.coalesce(F.first(F.when(F.col("token") == w, F.col("places")), ignorenulls=True), none).alias(c) for w, c in at.items()))

    def moved(places: Column, back: int) -> Column:
        return F.transform(places, lambda x: x - F.lit(back))

    def count(phrase: list[str]) -> Column:
        """Places at which the phrase begins in this column."""
        begins = F.col(at[phrase[0]])
        for j, w in enumerate(phrase[1:], 1):
            begins = F.array_intersect(begins, moved(F.col(at[w]), j))
        return F.size(begins)

    counted = settle(per.groupBy("id", "dl").agg(*(F.sum(count(p)).alias(f"f{i}") for i, p in enumerate(parts))))
    whole = length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    figures = counted.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(parts)))).first()
    return _score(counted, whole["n"], whole["avgdl"] or 1.0, list(figures))


def best(found: DataFrame, nodes: DataFrame, kinds: list[str] | None = None, limit: int = 10) -> DataFrame:
    """The best of scored ids with all columns of their nodes; kinds restrict what is returned, not the corpus figures."""
    out = found.join(nodes, "id")
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    return out.orderBy("score", "id").limit(limit)


def search(nodes: DataFrame, query: str, kinds: list[str] | None = None, limit: int = 10, columns: tuple[str, ...] = ("id", "signature", "docstring")) -> DataFrame:
    """The best nodes with all their columns and the score, by reading their texts."""
    return best(bm25(nodes, query, columns=columns), nodes, kinds, limit)
