"""Hierarchical language identification.

Method.  Texts become hashed letter trigrams of the whole text.  A first layer of
linear support vector machines, one against the rest, predicts the language family;
within it, one-versus-one linear support vector machines separate the languages and
vote, ties going to the larger sum of margins.  All are trained here, with numpy, on
a bounded sample of labelled rows (``PER_LANGUAGE`` texts of each language, from rows
that are not held out); prediction runs over every whole text with a model of a few
hundred kB.

A score only weighs the learned languages against each other.  Whether a text is in any of
them is told by its fit: the mean logarithm of how much likelier its trigrams are in the
language that suits it best than by chance (0).  The least fit is learned from the learning
rows, each measured by tables that the other folds gave.

Defined cases: a null text, an empty text and one without letters are ``und`` with
score 0; rows with a null language are predicted but never learned from; without any
learning row everything is ``und``; repeated rows are predicted alike; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import samples
from weftline.llm import textblocks as tb

UND = "und"
PER_LANGUAGE = 500
FEATURES = 4096
#: Documents of a block: short texts become rows as wide as long ones.
BLOCK_ROWS = 256
#: Below this score a document's language counts as unsure (of n families of m languages each a score is at least 1 / nm).
LEAST_SCORE = 0.2
#: The least fit lies halfway between chance and the fit which this share of held-back learning rows do not reach; what each bucket counts before any row is seen; folds.
FIT_SHARE, FIT_PRIOR, FIT_FOLDS = 0.002, 0.01, 4
#: Families of languages (a fixed table of general knowledge); a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi bn ur mr gu pa ne",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Letters keep their (folded) byte, all else is one separator.
_LETTERS = np.full(256, 32, dtype=np.uint64)
for _b in [*range(0x61, 0x7B), *range(0x80, 0x100)]:
    _LETTERS[_b] = _b
for _b in range(0x41, 0x5B):
    _LETTERS[_b] = _b + 32
SCHEMA = "row_key long, lang_pred string, score double"


def _buckets(c: np.ndarray) -> np.ndarray:
    """The hashed trigram that begins at each but the last two of the letters c."""
    code = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    return ((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(52)).astype(np.int64)


#: The trigram of separators alone, which says nothing about a language.
_BLANK = int(_buckets(np.full(3, 32, dtype=np.uint64))[0])


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row of unit length for each document: damped counts of its hashed trigrams."""
    rows, n = len(offsets) - 1, len(data)
    if n < 3:
        return np.zeros((rows, FEATURES), np.float32)
    code = _buckets(_LETTERS[data])
    doc = np.repeat(np.arange(rows), np.diff(offsets))
    within = doc[:-2] == doc[2:]
    counts = np.bincount((doc[:-2] * FEATURES + code)[within], minlength=rows * FEATURES).reshape(rows, FEATURES)
    x = np.sqrt(counts).astype(np.float32)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def shares(x: np.ndarray) -> np.ndarray:
    """From features, the share of each trigram in its document, separators apart; zeros where there is none."""
    q = x * x
    q[:, _BLANK] = 0
    return q / np.maximum(q.sum(axis=1, keepdims=True), 1e-9)


def has_letter(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    ascii_ = (_LETTERS[data] != 32) & (data < 0x80)
    sums = np.concatenate([[0], np.cumsum(ascii_)])
    found = np.diff(sums[offsets]) > 0
    for i in np.flatnonzero(~found):
        part = data[offsets[i] : offsets[i + 1]]
        found[i] = bool((part >= 0x80).any()) and any(ch.isalpha() for ch in part.tobytes().decode("utf-8", "ignore"))
    return found


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by accelerated gradient steps; both classes weigh alike.  y is +1 or -1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    past, t = w.copy(), 1.0
    step = 1.0 / (1.0 / cost + 4.0)
    for _ in range(steps):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = w + np.float32((t - 1) / t_next) * (w - past)
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight * y
        grad = v / np.float32(cost)
        grad[:-1] -= 2 * (slack @ x)
        grad[-1] = -2 * slack.sum()
        past, w, t = w, v - np.float32(step) * grad, t_next
    return w[:-1], float(w[-1])


def slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The steepness of a logistic curve over margins (Platt's method without the offset)."""
    best = min(np.geomspace(0.5, 32, 25), key=lambda a: np.logaddexp(0, -a * y * margin).mean() + 0.002 * a)
    return float(best)


class Model:
    """Families, and within each its languages and their pairs."""

    def __init__(self, texts: list[str], langs: list[str]):
        offsets, data = tb.string_parts(pa.array(texts, pa.large_string()))
        x = np.concatenate([features(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]) for a, b in tb.blocks(offsets, rows=BLOCK_ROWS)]) if texts else np.zeros((0, FEATURES), np.float32)
        lang = np.array(langs)
        family = np.array([FAMILY_OF.get(v, v) for v in langs])
        self.families = sorted(set(family.tolist()))
        self.languages = {f: sorted(set(lang[family == f].tolist())) for f in self.families}
        self.first = [self._fit(x, np.where(family == f, 1.0, -1.0).astype(np.float32)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.languages[f], 2):
                some = (lang == a) | (lang == b)
                self.pairs[f, a, b] = self._fit(x[some], np.where(lang[some] == a, 1.0, -1.0).astype(np.float32))
        # Fold by fold, so that no second copy of x is held.
        names = sorted(set(langs))
        counts = np.zeros((FIT_FOLDS, len(names), FEATURES))
        for i in range(FIT_FOLDS):
            q = shares(x[i::FIT_FOLDS])
            for k, name in enumerate(names):
                counts[i, k] = q[lang[i::FIT_FOLDS] == name].sum(axis=0)
        whole = counts.sum(axis=0)
        held = np.concatenate([self._suits(x[i::FIT_FOLDS], self._ratios(whole - counts[i])) for i in range(FIT_FOLDS)]) if names else np.zeros(0)
        held = held[np.isfinite(held)]
        self.ratios = self._ratios(whole)
        reached = float(np.quantile(held, FIT_SHARE)) if len(held) else 0.0
        self.least_fit = min(reached, reached / 2)

    @staticmethod
    def _ratios(counts: np.ndarray) -> np.ndarray:
        """For each language, the logarithm of how much likelier each trigram is than by chance."""
        seen = np.maximum(counts, 0) + FIT_PRIOR
        return np.log(seen / seen.sum(axis=1, keepdims=True) * FEATURES).astype(np.float32)

    @staticmethod
    def _suits(x: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        """The fit of each row to the language that suits it best; a row without trigrams fits none."""
        q = shares(x)
        return np.where(q.any(axis=1), (q @ ratios.T).max(axis=1), -np.inf)

    @staticmethod
    def _fit(x, y):
        w, b = train_svm(x, y)
        return w, b, slope(x @ w + b, y)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        if not self.families:
            return np.full(n, UND, dtype=object), np.zeros(n)
        if self.first:
            p = np.stack([1 / (1 + np.exp(-a * (x @ w + b))) for w, b, a in self.first], axis=1).astype(np.float64)
            which, score = p.argmax(axis=1), (p / p.sum(axis=1, keepdims=True)).max(axis=1)
        else:
            which, score = np.zeros(n, int), np.ones(n)
        out = np.empty(n, dtype=object)
        for i, f in enumerate(self.families):
            own = np.flatnonzero(which == i)
            names = self.languages[f]
            if not len(own):
                continue
            votes, sums = np.zeros((len(own), len(names))), np.zeros((len(own), len(names)))
            for a, b in combinations(range(len(names)), 2):
                w, bias, steep = self.pairs[f, names[a], names[b]]
                p = 1 / (1 + np.exp(-steep * (x[own] @ w + bias).astype(np.float64)))
                votes[np.arange(len(own)), np.where(p >= 0.5, a, b)] += 1
                sums[:, a] += p
                sums[:, b] += 1 - p
            best = (votes + sums / (len(names) + 1)).argmax(axis=1)
            out[own] = [names[k] for k in best]
            if len(names) > 1:
                score[own] *= sums[np.arange(len(own)), best] / (len(names) - 1)
        return out, score

    def label(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._label(features(offsets, data), offsets, data)

    def _label(self, x: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lang, score = self.predict(x)
        none = ~has_letter(offsets, data)
        lang[none], score[none] = UND, 0.0
        return lang, np.clip(score, 0.0, 1.0)

    def known(self, offsets: np.ndarray, data: np.ndarray, least: float) -> np.ndarray:
        """Whether each text has a language, a score of ``least`` and the least fit."""
        x = features(offsets, data)
        lang, score = self._label(x, offsets, data)
        good = (lang != UND) & (score >= least)
        good[good] = self._suits(x[good], self.ratios) >= self.least_fit
        return good


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from a sample of the rows of docs that are not held out."""
    rows = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0) & ~samples.held_out(F.col(key)))
    sample = samples.sample_by(rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")), "k", "l", per_language, 5)
    got = sorted((r["l"], r["t"]) for r in sample.select("t", "l").collect())
    return Model([t for _, t in got], [v for v, _ in got])


def _labeller(model_of):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            offsets, data = tb.string_parts(batch.column(1))
            langs, scores = [], []
            for a, b in tb.blocks(offsets, rows=BLOCK_ROWS):
                lang, score = model.label(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                langs += lang.tolist()
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row_key", "lang_pred", "score"])

    return label


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row_key, lang_pred and score of every row."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("text")).mapInArrow(tb.frugal(_labeller(model_of)), SCHEMA)


def keep_known(docs: DataFrame, model: Model, *, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """docs without those whose language cannot be told: no letters, no trigram, a score below ``least``, or a fit to every learned language below what learning rows show.  Rows stay as they are."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of.value
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            offsets, data = tb.string_parts(batch.column(at))
            good = np.zeros(batch.num_rows, dtype=bool)
            for a, b in tb.blocks(offsets, rows=BLOCK_ROWS):
                good[a:b] = own.known(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], least)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(tb.frugal(keep), docs.schema)


def contract(spark, sf_dir: str) -> DataFrame:
    """The digest of op5 for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs))
    return out.select(F.col("row_key").alias("doc_id"), samples.held_out(F.col("row_key")).alias("held_out"), "lang_pred", "score")
