"""Operator 12: toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a score of its own, the
logistic of a linear model over its distinct words, and a document is toxic if
any sentence is: its score is the noisy-or

    1 - (1 - leak) * (1 - s_1) * (1 - s_2) * ...

with a small leak for labels that no sentence explains.  Only documents are labelled; the likelihood of their labels trains the sentence
model, and its gradient puts the blame on the sentences that explain a label.
The same scores then locate the offending sentences.

A sentence ends at ``.``, ``!``, ``?`` or a line break; one of more than
``LONGEST`` words is cut into stretches of that many.  Words are runs of letters
A-Z (lower-cased) and of characters beyond ASCII, told apart by 64-bit hashes.

The fit uses a bounded sample: at most ``documents`` labelled training rows (the
lowest hashes of their ids) of together at most ``words`` words, and words that
stand in at least ``least_docs`` of them.  Every whole text is scored.

Defined results: null and empty texts, and texts without words, are one empty
sentence, scored by the bias alone; repeated rows and null ids give one result
row each (a null id matches no label); an id labelled more than once counts as
toxic if any of its labels is; without a toxic and a clean training row every
score is the share of toxic training rows, 0 where there are none.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .divergence import TERM_BYTES

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Words of a stretch; a longer sentence is cut.
LONGEST = 60


def sentences(text: str) -> tuple[list[tuple[int, int]], list[list[bytes]]]:
    """Spans (code points, end exclusive) and words of the sentences that have words."""
    spans, words = [], []
    for m in SENTENCE.finditer(text):
        own = m.group().encode("utf-8", "replace").translate(TERM_BYTES).split()
        if len(own) <= LONGEST:
            if own:
                spans.append(m.span())
                words.append(own)
            continue
        places = [w.span() for w in WORD.finditer(text, *m.span())]
        for k in range(0, len(own), LONGEST):
            spans.append((places[k][0], places[min(k + LONGEST, len(own)) - 1][1]))
            words.append(own[k:k + LONGEST])
    return spans, words


class Bags:
    """Sentences of some texts: ``hashes`` of the distinct words of each, flat,
    with the sentence (``of``) of every hash and the text of every sentence."""

    def __init__(self, texts: list[str]):
        self.spans, flat, sizes, owner = [], [], [], []
        for k, text in enumerate(texts):
            spans, words = sentences(text)
            if not spans:
                spans, words = [(0, 0)], [[]]
            self.spans += spans
            owner += [k] * len(spans)
            for w in words:
                flat += w
                sizes.append(len(w))
        self.owner = np.array(owner, np.int64)
        of = np.repeat(np.arange(len(sizes)), sizes)
        hashes = common.hash_words(flat)
        order = np.lexsort((hashes, of))
        of, hashes = of[order], hashes[order]
        first = np.ones(len(of), bool)
        first[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
        self.of, self.hashes = of[first], hashes[first]


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Weights of known word hashes (sorted), the bias of a sentence and the leak."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float, leak: float):
        self.hashes, self.weights, self.bias, self.leak = hashes, weights, bias, leak

    def sentence_scores(self, bags: Bags) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, bags.hashes), max(0, len(self.hashes) - 1))
        pull = np.where(self.hashes[at] == bags.hashes, self.weights[at], 0.0) if len(self.hashes) else np.zeros(len(bags.hashes))
        return logistic(self.bias + np.bincount(bags.of, pull, len(bags.owner)))


def noisy_or(scores: np.ndarray, owner: np.ndarray, n: int, leak: float = 0.0) -> np.ndarray:
    return -np.expm1(np.bincount(owner, np.log1p(-scores), n) + np.log1p(-leak))


def fit(word: np.ndarray, of: np.ndarray, owner: np.ndarray, toxic: np.ndarray, size: int, steps: int = 600, rate: float = 0.05, ridge: float = 5e-5) -> tuple[np.ndarray, float, float]:
    """Weights of ``size`` words, the bias of a sentence and the leak: the labels'
    likelihood under the leaky noisy-or of the sentences, by Adam on the whole
    sample.  The leak stands for labels that no sentence explains; without it
    such texts would be learnt by heart."""
    w, n, s = np.zeros(size + 2), len(toxic), len(owner)
    m, v = np.zeros(size + 2), np.zeros(size + 2)
    share = float(np.clip(toxic.mean(), 1e-6, 1 - 1e-6))
    w[-2:] = np.log(share * n / s) - 2, np.log(share / (1 - share))
    for t in range(1, steps + 1):
        scores, leak = logistic(w[-2] + np.bincount(of, w[word], s)), logistic(w[-1])
        clean = np.exp(np.bincount(owner, np.log1p(-scores), n) + np.log1p(-leak))
        blame = np.where(toxic, -clean / np.maximum(1 - clean, 1e-12), 1.0)
        slope = blame[owner] * scores / n
        grad = np.concatenate([np.bincount(word, slope[of], size) + ridge * np.sign(w[:-2]) * np.minimum(1, np.abs(w[:-2])), [slope.sum(), leak * blame.mean()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-2], float(w[-2]), float(logistic(w[-1]))


def train(docs: DataFrame, labels: DataFrame, held: Column, documents: int, words: int, least_docs: int) -> Model | float:
    """The sentence model, or a score for all where the labels can't train one."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic")).where(~held & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    # at most ``documents`` rows: a proven bound for the broadcast
    known = known.groupBy("doc_id").agg((F.max(F.col("toxic") == 1)).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(batches):
        for batch in common.parts(batches, 50):
            for key, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                bags = Bags([text or ""])
                packed = [pa.array([x.tobytes()], pa.binary()) for x in (bags.hashes, np.bincount(bags.of, minlength=len(bags.owner)).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([toxic.as_py()]), *packed, pa.array([len(bags.hashes)])], ["doc_id", "toxic", "hashes", "sizes", "n"])

    found = texts.join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text").mapInArrow(scan, "doc_id long, toxic boolean, hashes binary, sizes binary, n long")
    # the window holds at most ``documents`` rows and their repeats
    running = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "n").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("sum", F.sum("n").over(running)).where(F.col("sum") <= words).select("toxic", "hashes", "sizes").collect()
    toxic = np.array([r.toxic for r in rows], bool)
    if not toxic.any() or toxic.all():
        return float(toxic.mean()) if len(toxic) else 0.0
    hashes = [np.frombuffer(r.hashes, np.uint64) for r in rows]
    sizes = [np.frombuffer(r.sizes, np.int32) for r in rows]
    table, docs_of = np.unique(np.concatenate([np.unique(h) for h in hashes]), return_counts=True)
    table = table[docs_of >= least_docs]
    flat, of = np.concatenate(hashes), np.repeat(np.arange(sum(map(len, sizes))), np.concatenate(sizes))
    at = np.minimum(np.searchsorted(table, flat), max(0, len(table) - 1))
    hit = table[at] == flat if len(table) else np.zeros(len(flat), bool)
    owner = np.repeat(np.arange(len(sizes)), list(map(len, sizes)))
    return Model(table, *fit(at[hit], of[hit], owner, toxic, len(table)))


def score(docs: DataFrame, labels: DataFrame, held: Column, documents: int = 12_000, words: int = 6_000_000, least_docs: int = 5, offending: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and the offending sentences (start, end, score;
    those whose own score reaches ``offending``) of every document; rows where
    ``held`` is true teach nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held, documents, words, least_docs))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches):
        model = shared.value
        for batch in common.parts(batches, 100):
            n = batch.num_rows
            if isinstance(model, float):
                scores, found = np.full(n, model), [[] for _ in range(n)]
            else:
                bags = Bags([t or "" for t in batch.column(2).to_pylist()])
                own = model.sentence_scores(bags)
                scores, found = noisy_or(own, bags.owner, n, model.leak), [[] for _ in range(n)]
                for k in np.flatnonzero(own >= offending).tolist():
                    start, end = bags.spans[k]
                    found[bags.owner[k]].append({"start": start, "end": end, "score": float(own[k])})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(found, kind)], ["doc_id", "held_out", "score", "offending"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, score double, offending array<struct<start:long,end:long,score:double>>")
