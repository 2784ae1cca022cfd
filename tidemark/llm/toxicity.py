"""Toxicity scores from a counterfactually regularised linear classifier.

A text's features are its distinct words and their beginnings.  The classifier
is a logistic regression; besides a quadratic penalty it pays for every labelled
sentence whose score moves when the identity terms in it are swapped for others
of their lines, each swap in turn: the squared difference of both scores.
Neutral mentions of a group therefore gain or lose nothing by the group that
they mention.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.store import prepare

SAMPLE_ROWS = 4000  #: labelled documents learned from, at most, of each class half, chosen by hash of doc_id
FEATURES = 4000  #: features kept at most, by association with the label
LEAST_Z = 5.0  #: and of those only the ones whose association is no chance
PREFIXES = (4, 5, 6)
RIDGE = 3e-5
COUNTERFACTUAL = 10.0
THRESHOLD = 0.7
CACHE_WORDS = 300_000

#: Terms that name groups of people, by language; a term is swapped within its line.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwarze", "weiße"), ("ausländer", "flüchtlinge"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs", "arabes"), ("immigrés", "étrangers"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos", "árabes"), ("inmigrantes", "extranjeros"),
)

_EDGE = re.compile(r"^\W+|\W+$")


def word_features(token: str) -> list[str]:
    """Features of one white-space separated, lower-cased token."""
    word = _EDGE.sub("", token)
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)] if word else []


def text_features(text: str) -> set[str]:
    return {f for token in set(text.lower().split()) for f in word_features(token)}


_LINE = {term: (line, n) for line in IDENTITY for n, term in enumerate(line)}


def swaps(text: str) -> list[str]:
    """The text under every swap: the r-th one puts for each identity term the one r places on in its line, as long as some line has as many."""
    tokens = text.lower().split()
    at = [(n, word) for n, token in enumerate(tokens) if (word := _EDGE.sub("", token)) in _LINE]
    out = []
    for r in range(1, max((len(_LINE[word][0]) for _, word in at), default=1)):
        other = list(tokens)
        for n, word in at:
            line, place = _LINE[word]
            other[n] = tokens[n].replace(word, line[(place + r) % len(line)])
        out.append(" ".join(other))
    return out


def _pack(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], np.int64)
    return np.array([f for r in rows for f in r], np.int64), np.repeat(np.arange(len(rows)), sizes)


def objective(w: np.ndarray, b: float, y: np.ndarray, rows: tuple, plus: tuple, minus: tuple, pairs: int) -> tuple[float, np.ndarray, float]:
    """(loss, gradient by weight, gradient by intercept): mean log loss, ridge, and COUNTERFACTUAL times the mean squared move of the linear score."""
    index, row = rows
    z = np.bincount(row, w[index], len(y)) + b
    loss = float(np.mean(np.logaddexp(0, z) - y * z)) + RIDGE / 2 * float(w @ w)
    error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    g = np.bincount(index, error[row], len(w)) + RIDGE * w
    if pairs:
        move = np.bincount(plus[1], w[plus[0]], pairs) - np.bincount(minus[1], w[minus[0]], pairs)
        loss += COUNTERFACTUAL / pairs * float(move @ move)
        g += 2 * COUNTERFACTUAL / pairs * (np.bincount(plus[0], move[plus[1]], len(w)) - np.bincount(minus[0], move[minus[1]], len(w)))
    return loss, g, float(error.sum())


class Classifier:
    """Weights by feature; ``score`` of a text without features is the intercept's.  ``pairs`` counts the swapped texts that the penalty saw."""

    def __init__(self, texts: list[str], labels: list[int], steps: int = 400) -> None:
        self.weights: dict[str, float] = {}
        self.pairs = 0
        y = np.array(labels, float)
        self.intercept = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else -2.0
        self._cache: dict[str, tuple[str, ...]] = {}
        if not len(y) or y.min() == y.max():
            return
        rows = [text_features(t) for t in texts]
        seen: dict[str, list[int]] = {}
        for r, label in zip(rows, labels, strict=True):
            for f in r:
                seen.setdefault(f, [0, 0])[label] += 1
        positive, negative = y.sum(), len(y) - y.sum()

        def z_score(n: int, p: int) -> float:
            """How many standard errors apart the feature's shares of both classes are."""
            share = (n + p) / len(y)
            return abs(p / positive - n / negative) / np.sqrt(max(share * (1 - share), 1e-12) * (1 / positive + 1 / negative))

        strength = {f: z for f, (n, p) in seen.items() if n + p >= 3 and (z := z_score(n, p)) >= LEAST_Z}
        names = sorted(sorted(strength, key=lambda f: (-strength[f], f))[:FEATURES])
        at = {f: n for n, f in enumerate(names)}
        packed = _pack([[at[f] for f in sorted(r) if f in at] for r in rows])
        pairs = [(r, text_features(s)) for r, t in zip(rows, texts, strict=True) for s in swaps(t)]
        self.pairs = len(pairs)
        if not pairs:
            warnings.warn("no labelled text holds an identity term: the counterfactual penalty has nothing to act on", stacklevel=2)
        plus = _pack([[at[f] for f in sorted(r - s) if f in at] for r, s in pairs])
        minus = _pack([[at[f] for f in sorted(s - r) if f in at] for r, s in pairs])
        w, b = np.zeros(len(names)), self.intercept
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, steps + 1):  # Adam on all rows
            _, g, gb = objective(w, b, y, packed, plus, minus, len(pairs))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            rate = 0.1 / (1 + step / 200)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
        self.weights, self.intercept = {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, float(b)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "intercept": self.intercept, "pairs": self.pairs, "_cache": {}}

    def score(self, text: str) -> float:
        cache, found = self._cache, set()
        for token in set(text.lower().split()):
            known = cache.get(token)
            if known is None:
                known = cache[token] = tuple(f for f in word_features(token) if f in self.weights)
            if known:
                found.update(known)
        if len(cache) > CACHE_WORDS:
            cache.clear()
        z = self.intercept + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier from labelled documents that are not held out; the sample is bounded by SAMPLE_ROWS."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out())
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}  # repeated labels are one
    span = 1 << 30
    limit = {label: int(min(1.0, SAMPLE_ROWS / 2 / max(n, 1)) * span) for label, n in counts.items()}
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(span)) < F.when(F.col("toxic") == 1, F.lit(limit.get(1, 0))).otherwise(F.lit(limit.get(0, 0)))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the sample's ids are bounded by its documented size, so they may be broadcast
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    return Classifier([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text, ...); ``labels`` has doc_id and toxic.

    Defined cases: null and empty texts get the intercept's score; without
    labels of both classes every text gets the intercept's; labels that are null
    or neither 0 nor 1 are ignored; a document labelled twice is learned from
    once for each distinct label, and of rows that share a doc_id the least text
    counts; repeated rows are scored alike; further
    columns are ignored.
    """
    prepare(spark)
    model = spark.sparkContext.broadcast(train(spark, docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.array([model.value.score(x.as_py() or "") for x in batch.column(2)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
