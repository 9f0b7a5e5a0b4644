"""Operator 10: quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; everything else is
unlabelled web text.  A linear model over text features minimises the
non-negative unbiased risk

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

with the logistic loss; where the second part falls below zero, the step goes
the other way, as the estimator asks.  The class prior is estimated from the
labelled training rows.  The fit uses a bounded sample (``positives`` and
``unlabelled`` rows, the lowest hashes of their ids); every document is scored.

Defined results: null and empty texts have zero features and a score like any
other; repeated rows and null ids give one result row each (a null id is
training text and matches no label); without positives all scores are the
prior.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, quality_rules

STATS = ("words", "symbols", "pipes", "duplicate_lines", "repeats", "upper", "word_length", "digits", "punctuation", "distinct", "top_word", "line_length", "beyond_ascii", "short_words")
#: Hat functions per measure, and buckets of hashed words.
KNOTS, WORDS = 9, 512
SIZE = len(STATS) * KNOTS + WORDS
PUNCTUATION = b".,;:!?'\"()-"


def stats(text: str | None) -> tuple[list[float], np.ndarray]:
    """Measures of a text, each made to grow evenly, and its hashed words."""
    raw = (text or "").encode()
    words = raw.split()
    n = max(1, len(words))
    size = max(1, len(raw))
    counts = quality_rules.measure(text)
    _, chars, symbols, duplicate, repeats, lines, upper, letters = counts
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    bag = np.zeros(WORDS, np.float32)
    for w, k in seen.items():
        bag[xxhash.xxh32_intdigest(w.lower()) % WORDS] += k
    bag = np.sqrt(bag / n)
    root = lambda a, b: math.sqrt(a / b)
    return [math.log1p(len(words)), root(symbols, n), root(raw.count(b"|"), n), root(duplicate, max(1, lines)), root(repeats, n), root(upper, max(1, letters)),
            math.log1p(chars / n), root(without(b"0123456789"), size), root(without(PUNCTUATION), n), len(seen) / n, root(max(seen.values(), default=0), n),
            math.log1p(n / max(1, lines)), root(without(bytes(range(128, 256))), size), sum(k for w, k in seen.items() if len(w) < 3) / n], bag


def spread(values: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Hat functions: each value is shared by its two neighbouring knots."""
    out = np.zeros((len(values), len(STATS), KNOTS), np.float32)
    for j in range(len(STATS)):
        at = np.interp(values[:, j], knots[j], np.arange(KNOTS))
        low = np.minimum(at.astype(int), KNOTS - 2)
        rows = np.arange(len(values))
        out[rows, j, low] = 1 - (at - low)
        out[rows, j, low + 1] = at - low
    return out.reshape(len(values), -1)


def knots_of(values: np.ndarray) -> np.ndarray:
    """Increasing knots of each measure: evenly spaced over its range, as rare
    values far out are what sets bad text apart."""
    low, high = values.min(0), values.max(0)
    return np.linspace(low, np.maximum(high, low + 1e-6), KNOTS).T


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias that minimise the non-negative risk."""
    ones = lambda x: np.hstack([x, np.ones((len(x), 1), np.float32)])
    p, u = ones(positive), ones(unlabelled)
    w, m, v = (np.zeros(p.shape[1], np.float32) for _ in range(3))
    w[-1] = math.log(prior / (1 - prior))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        below = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        pull = -prior * (p.T @ sigmoid(-gp)) / len(p)
        rest = (u.T @ sigmoid(gu)) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
        grad = (pull + rest if below >= 0 else -rest) + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def lowest(ids: DataFrame, rows: int) -> DataFrame:
    return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, held: object, positives: int, unlabelled: int) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Knots, weights (None without positives) and the class prior."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held & F.col("quality").isNotNull())
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    prior = min(0.99, max(0.01, 0.5 if share is None else share))
    # at most positives + unlabelled ids: a proven bound for the broadcast
    ids = lowest(known.where("quality = 1").select("doc_id"), positives).withColumn("positive", F.lit(True)).unionByName(
        lowest(texts.where("doc_id is not null").select("doc_id"), unlabelled).withColumn("positive", F.lit(False)))

    def scan(batches):
        for batch in batches:
            found = [stats(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(s, np.float32).tobytes() for s, _ in found], pa.binary()), pa.array([b.tobytes() for _, b in found], pa.binary())], ["positive", "stats", "bag"])

    rows = texts.join(F.broadcast(ids), "doc_id").select("positive", "text").mapInArrow(scan, "positive boolean, stats binary, bag binary").collect()
    values = np.array([np.frombuffer(r.stats, np.float32) for r in rows], np.float32).reshape(-1, len(STATS))
    is_positive = np.array([r.positive for r in rows], bool)
    if not is_positive.any() or is_positive.all():
        return np.zeros((len(STATS), KNOTS)), None, prior
    knots = knots_of(values)
    features = np.hstack([spread(values, knots), np.array([np.frombuffer(r.bag, np.float32) for r in rows], np.float32)])
    return knots, fit(features[is_positive], features[~is_positive], prior), prior


def score(docs: DataFrame, labels: DataFrame, held: object, positives: int = 6000, unlabelled: int = 12000) -> DataFrame:
    """doc_id, held_out and score of every document; rows where ``held`` is
    true teach nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held, positives, unlabelled))

    def scan(batches):
        knots, weights, prior = shared.value
        for batch in batches:
            scores = np.full(batch.num_rows, prior)
            if weights is not None and batch.num_rows:
                found = [stats(t) for t in batch.column(2).to_pylist()]
                features = np.hstack([spread(np.array([s for s, _ in found], np.float32), knots), np.array([b for _, b in found])])
                scores = 1 / (1 + np.exp(-np.clip(features @ weights[:-1] + weights[-1], -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, score double")
