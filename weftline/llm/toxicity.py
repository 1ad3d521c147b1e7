"""Toxicity scores from non-negative positive-unlabelled learning.

Method.  Texts marked toxic are the positives; a hashed sample of all learning rows,
marked or not, is the unlabelled set.  A linear model over the presence of hashed words
is trained with numpy to minimise the non-negative positive-unlabelled risk

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with logistic loss, where pi is the share of toxic texts among marked learning rows
(or a parameter).  When the corrected negative risk falls below zero, the step goes
against it, as the method prescribes.  The score is the model's probability.

Samples are bounded (``POSITIVES`` and ``UNLABELLED`` texts, by the hash of the key,
from rows that are not held out); scoring covers every whole text.  The settings of the
model were chosen by ``fold_quality``, which fits on some folds of the learning rows and
measures on another; held-out rows have no part in it.  The share pi is kept within
``PRIORS``, where the method's risk is defined.

Defined cases: null and empty texts get the score of a text without any known word;
without a positive learning row every score is 0; repeated marks count once and a text
is positive if any says so; null marks are ignored; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import samples
from weftline.llm import textblocks as tb

POSITIVES, UNLABELLED, WORDS = 2500, 6000, 2048
THRESHOLD = 0.3
PRIORS = (0.001, 0.9)
#: Standard errors from which a word counts as standing out (chance words that pass get small weights).
STANDS_OUT, RIDGE = 3.0, 2e-4
_BITS = 20
SCHEMA = "row_key long, score double"


def word_slots(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed slot of every word."""
    words = tb.words_of(offsets, data, tb.ALNUM_SPLIT)
    return words.doc, (words.hash >> np.uint64(64 - _BITS)).astype(np.int64)


class Model:
    def __init__(self, column: np.ndarray, weights: np.ndarray, bias: float):
        self.column, self.weights, self.bias = column, weights, bias

    def score(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        if self.column is None:
            return np.zeros(len(offsets) - 1)
        z = presence(offsets, data, self.column, len(self.weights)) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def presence(offsets: np.ndarray, data: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """Which chosen words a document has; column maps a slot to its place or -1."""
    rows = len(offsets) - 1
    doc, slot = word_slots(offsets, data)
    at = column[slot]
    known = at >= 0
    x = np.zeros(rows * width, np.float32)
    x[doc[known] * width + at[known]] = 1
    return x.reshape(rows, width)


def _slot_counts(texts: list[str]) -> np.ndarray:
    """In how many texts each slot occurs."""
    out = np.zeros(1 << _BITS, np.int64)
    offsets, data = tb.string_parts(pa.array(texts, pa.large_string()))
    for a, b in tb.blocks(offsets):
        doc, slot = word_slots(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
        out += np.bincount(np.unique(doc << _BITS | slot) & ((1 << _BITS) - 1), minlength=1 << _BITS)
    return out


def _matrix(texts: list[str], column: np.ndarray, width: int) -> np.ndarray:
    offsets, data = tb.string_parts(pa.array(texts, pa.large_string()))
    parts = [presence(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], column, width) for a, b in tb.blocks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, width), np.float32)


def fit(positive: list[str], unlabelled: list[str], prior: float, *, width: int = WORDS, steps: int = 300, ridge: float = RIDGE, stands_out: float = STANDS_OUT) -> Model:
    """A model from toxic texts and unlabelled ones, of which a share ``prior`` is toxic."""
    if not positive or not unlabelled:
        return Model(None, np.zeros(0), 0.0)
    n_p, n_u = len(positive), len(unlabelled)
    in_p, in_u = _slot_counts(positive), _slot_counts(unlabelled)
    # Words by how far their share among toxic texts stands out from that among all, in standard errors.
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    apart = np.abs(in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    apart[in_p + in_u < 3] = 0
    order = np.argsort(-apart, kind="stable")[:width]
    chosen = np.sort(order[apart[order] >= stands_out])
    column = np.full(1 << _BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    xp, xu = _matrix(positive, column, len(chosen)), _matrix(unlabelled, column, len(chosen))
    w, bias = np.zeros(len(chosen), np.float32), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        zp, zu = xp @ w + bias, xu @ w + bias
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Gradients of the mean losses by the margins.
        gp_pos, gp_neg, gu_neg = -sigmoid(-zp) / n_p, sigmoid(zp) / n_p, sigmoid(zu) / n_u
        gp, gu = (prior * (gp_pos - gp_neg), gu_neg) if rest >= 0 else (prior * gp_neg, -gu_neg)
        grad = np.append(gp.astype(np.float32) @ xp + gu.astype(np.float32) @ xu + 2 * ridge * w, gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        w, bias = (w - move[:-1]).astype(np.float32), bias - float(move[-1])
    return Model(column, w, bias)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from rows that are not held out: toxic ones and a sample of all."""
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~samples.held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    marks = marks.select("k", (F.col("y") > 0).alias("y"))
    found = marks.agg(F.count_if("y").alias("p"), F.count("*").alias("n")).first()
    if not found["p"]:
        return Model(None, np.zeros(0), 0.0)
    prior = prior if prior is not None else min(PRIORS[1], max(PRIORS[0], found["p"] / found["n"]))
    rows = docs.where(F.col(key).isNotNull() & ~samples.held_out(F.col(key))).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # The chosen keys are at most ``positives``, so they may travel to the texts.
    chosen = marks.where("y").orderBy(F.xxhash64(F.lit(11), "k"), "k").limit(positives).select("k")
    toxic = rows.join(F.broadcast(chosen), "k", "left_semi")
    n = rows.count()
    some = rows.where(samples.share_of(F.col("k"), 13) < min(1.0, unlabelled / max(1, n)))
    return fit(sorted(r["t"] for r in toxic.select("t").collect()), sorted(r["t"] for r in some.select("t").collect()), prior)


def fold_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", unlabelled: int = UNLABELLED, **settings) -> list[tuple[float, float]]:
    """(area under the curve, share of right predictions at the threshold) on each fold of the learning rows by a model of the other folds; for choosing settings of ``fit``, on tables of which the marked rows fit the driver."""
    fold = (F.crc32(F.col(key).cast("string").cast("binary")) % samples.FOLDS).alias("fold")
    rows = docs.where(F.col(key).isNotNull() & ~samples.held_out(F.col(key))).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), fold)
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max(label) > 0).alias("y"))
    marked = [(r["fold"], r["t"], r["y"]) for r in rows.join(marks, "k").orderBy("k").select("fold", "t", "y").collect()]
    some = [(r["fold"], r["t"]) for r in rows.where(samples.share_of(F.col("k"), 13) < min(1.0, unlabelled / max(1, rows.count()))).orderBy("k").select("fold", "t").collect()]
    out = []
    for f in (i for i in range(samples.FOLDS) if i != samples.HELD_OUT):
        positive, own = [t for g, t, y in marked if g != f and y], [(t, y) for g, t, y in marked if g == f]
        prior = min(PRIORS[1], max(PRIORS[0], len(positive) / max(1, sum(g != f for g, _, _ in marked))))
        model = fit(positive, [t for g, t in some if g != f], prior, **settings)
        offsets, data = tb.string_parts(pa.array([t for t, _ in own], pa.large_string()))
        score = np.concatenate([model.score(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]) for a, b in tb.blocks(offsets)]) if own else np.zeros(0)
        y = np.array([y for _, y in own], dtype=bool)
        rank = np.argsort(np.argsort(score)) + 1
        area = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / max(1, y.sum() * (~y).sum())
        out.append((float(area), float(((score >= THRESHOLD) == y).mean()) if own else 0.0))
    return out


def _scorer(model_of):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            offsets, data = tb.string_parts(batch.column(1))
            parts = [model.score(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]) for a, b in tb.blocks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], names=["row_key", "score"])

    return score


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row_key and score of every row."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("text")).mapInArrow(_scorer(model_of), SCHEMA)


def contract(spark, sf_dir: str) -> DataFrame:
    """The digest of op10 for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select(F.col("row_key").alias("doc_id"), samples.held_out(F.col("row_key")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
