"""Operator 2: personal data by patterns and a skip-chain random field.

Patterns find the base spans.  A conditional random field then labels the
tokens around them: adjacent tokens form the chain, and distant tokens with
the same digits or the same address are tied by skip edges, each to the base
token that has them too, so that a number named once in full is found again in
a shortened form however often it comes.  Loopy messages run over each
document's tokens; base tokens are observed.

Emission and transition weights are trained here, piecewise: smoothed log
ratios of the counts over the whole corpus, with base labels as truth, also
for the tokens tied to a base token.

Defined results: null and empty texts have no spans; null ids and repeated
rows give one result row each.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of the contract.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Runs without blanks; those with a MARK are the tokens that the field labels.
RUN = re.compile(r"\S+")
MARK = re.compile(r"[0-9@]")
EDGE_MARKS = "\"'`,;:!?.#%$&*|<>[]{}=~"
SHAPES = 4096
LABELS = 1 + len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ ends one run of local characters, so that run's start is the
    leftmost start; found from the @ on, in linear time: no character is local
    to two of them but those of a domain, which the next @ may read again."""
    out, free = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every base match, in the spans' order."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(found)


def shape(token: str) -> int:
    """Bucket of the token's shape: letters and digits by class, letter runs
    as one, digit runs by length."""
    form = re.sub(r"[^\W\d_]+", "a", token)
    form = re.sub(r"[0-9]", "0", form)
    return zlib.crc32(form[:64].encode()) % SHAPES


def tokens_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, label, shape) of the tokens with a digit or an @; the
    label is that of the first base span that the token meets, else 0."""
    out = []
    ends = sorted((b, a, kind) for a, kind, b in spans)
    for m in RUN.finditer(text):
        if not MARK.search(m.group()):
            continue
        a, b = m.span()
        core = m.group().lstrip(EDGE_MARKS)
        a = b - len(core)
        core = core.rstrip(EDGE_MARKS)
        b = a + len(core)
        k = bisect_right(ends, (a, len(text), 9))
        label = 1 + ends[k][2] if k < len(ends) and ends[k][1] < b else 0
        if label or DIGIT.search(core) or "@" in core:
            out.append((a, b, label, shape(core)))
    return out


def keys_of(token: str) -> list[str]:
    """What ties distant tokens: the address, or the digits and their last
    seven."""
    low = token.lower()
    digits = re.sub(r"[^0-9]", "", token)
    keys = ["@" + low] if "@" in token else []
    if len(digits) >= 6:
        keys.append(digits)
    if len(digits) >= 7:
        keys.append("~" + digits[-7:])
    return keys


def edges_of(text: str, tokens: list[tuple[int, int, int, int]]) -> tuple[list, list]:
    """Chain edges between neighbours in the text, and skip edges between
    each token and the first base token with a common key; where no base token
    has the key, between each token and the next one.  The digits of an address
    tie it to no number."""
    chain = [(k, k + 1) for k, (x, y) in enumerate(pairwise(tokens)) if y[0] - x[1] <= 3 and not text[x[1]:y[0]].strip(EDGE_MARKS + " \t\n")]
    meets: dict[str, list[int]] = {}
    for k, (a, b, label, _) in enumerate(tokens):
        for key in keys_of(text[a:b]):
            if label == 1 and key[0] != "@":
                continue
            meets.setdefault(key, []).append(k)
    hubs, loose = set(), set()
    for key, met in meets.items():
        hub = next((k for k in met if tokens[k][2]), None)
        if hub is None:
            loose.update(pairwise(met))
        else:
            hubs.update((min(hub, k), max(hub, k)) for k in met if k != hub)
    tied = {k for e in hubs for k in e}
    return chain, sorted(hubs | {e for e in loose - set(chain) if not tied.issuperset(e)})


def ties_of(tokens: list[tuple[int, int, int, int]], skip: list) -> list[int]:
    """Each token's label for training: its own or that of the base token it
    is tied to, else 0."""
    out = [t[2] for t in tokens]
    for a, b in skip:
        for k, other in ((a, b), (b, a)):
            out[k] = out[k] or tokens[other][2]
    return out


FOUND = "doc_id long, starts array<int>, kinds array<int>, ends array<int>, token_starts array<int>, token_ends array<int>, labels array<int>, shapes array<int>, chain array<int>, skip array<int>, ties array<int>"


def found_in(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    """Rows of FOUND."""
    rows = []
    for text in texts:
        text = text or ""
        spans = base_spans(text)
        tokens = tokens_of(text, spans) if "@" in text or DIGIT.search(text) else []
        chain, skip = edges_of(text, tokens)
        rows.append(([s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], *([t[k] for t in tokens] for k in range(4)),
                     [v for e in chain for v in e], [v for e in skip for v in e], ties_of(tokens, skip)))
    columns = list(zip(*rows)) or [[]] * 10
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.list_(pa.int32())) for c in columns)], [c.split()[0] for c in FOUND.split(", ")])


def find(docs: DataFrame) -> DataFrame:
    """Base spans, candidate tokens and their edges, one row a document."""
    def run(batches):
        for batch in batches:
            yield found_in(batch.column(0), batch.column(1).to_pylist())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def train(found: DataFrame, smoothing: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Emission log probabilities by shape and transition log ratios, from
    counts over all documents.  The driver gets at most 4096 * 5 + 25 sums."""
    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for labels, shapes, chain in zip(*(batch.column(k).to_pylist() for k in range(3))):
                seen.update((s, y) for s, y in zip(shapes, labels))
                seen.update((-1 - labels[a], labels[b]) for a, b in zip(chain[::2], chain[1::2]))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["a", "b", "n"])

    emission, transition = np.full((SHAPES, LABELS), smoothing / LABELS), np.full((LABELS, LABELS), smoothing)
    emission[:, 0] += smoothing
    for a, b, n in found.select("ties", "shapes", "chain").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        if a >= 0:
            emission[a, b] += n
        else:
            transition[-1 - a, b] += n
    joint = transition / transition.sum()
    return np.log(emission / emission.sum(1, keepdims=True)), np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))


def messages(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int, damping: float = 0.3) -> np.ndarray:
    """Beliefs after ``rounds`` of loopy sum-product over all edges at once.
    unary: nodes x labels; edges: m x 2; potentials: m x labels x labels."""
    if not len(edges):
        belief = unary
    else:
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        sent = np.zeros((len(source), unary.shape[1]))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, target, sent)
            out = np.logaddexp.reduce((belief[source] - sent[back])[:, :, None] + pot, axis=1)
            out -= out.max(1, keepdims=True)
            sent = damping * sent + (1 - damping) * out
        belief = unary.copy()
        np.add.at(belief, target, sent)
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


class Field:
    """The trained field.  ``agreement``: log potential of equal labels on a
    skip edge; ``least``: probability that an added span's tokens need."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray, agreement: float = 3.0, least: float = 0.8, rounds: int = 8):
        self.emission, self.transition, self.least, self.rounds = emission, transition, least, rounds
        self.skip = agreement * np.eye(LABELS)

    def added(self, batch: pa.RecordBatch) -> list[list[dict]]:
        """The added spans of each row of FOUND: neighbouring tokens of one
        label that no base span has."""
        starts, ends, labels, shapes, chains, skips = (batch.column(k).to_pylist() for k in range(4, 10))
        edges, kinds, at = [], [], 0
        for tokens, chain, skip in zip(starts, chains, skips):
            for flat, kind in ((chain, 0), (skip, 1)):
                edges += [(at + a, at + b) for a, b in zip(flat[::2], flat[1::2])]
                kinds += [kind] * (len(flat) // 2)
            at += len(tokens)
        observed = np.array([y for x in labels for y in x], int)
        unary = self.emission[np.array([y for x in shapes for y in x], int)]
        unary[observed > 0] = -1e9  # beyond what any number of messages adds up to
        unary[np.flatnonzero(observed), observed[observed > 0]] = 0.0
        potentials = np.stack([self.transition, self.skip])[np.array(kinds, int)]
        belief = messages(unary, np.array(edges, int).reshape(-1, 2), potentials, self.rounds)
        best = np.where((observed == 0) & (belief.max(1) >= self.least), belief.argmax(1), 0)
        out, at = [], 0
        for a, b, chain in zip(starts, ends, chains):
            joined, spans = set(zip(chain[::2], chain[1::2])), []
            for k in range(len(a)):
                label = int(best[at + k])
                if label and spans and k and best[at + k - 1] == label and (k - 1, k) in joined:
                    spans[-1]["end"] = b[k]
                elif label:
                    spans.append({"start": a[k], "kind": label - 1, "end": b[k]})
            out.append(spans)
            at += len(a)
        return out


def infer(found: DataFrame, field: Field) -> DataFrame:
    """doc_id, the base spans (arrays) and those that the field adds."""
    schema = "doc_id long, starts array<int>, kinds array<int>, ends array<int>, added array<struct<start:int,kind:int,end:int>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(field.added(batch), kind)], ["doc_id", "starts", "kinds", "ends", "added"])

    return found.mapInArrow(run, schema)


def spans(docs: DataFrame, **options) -> DataFrame:
    """Base and added spans of every document; options as of ``Field``."""
    found = common.store(find(docs), "pii")
    return infer(found, Field(*train(found), **options))


def mask(docs: DataFrame, **options) -> DataFrame:
    """The documents, each span replaced by its kind in brackets and n_chars
    counted anew; texts without spans stay as they are.  The text is read
    twice (to train, then to mask) and never shuffled."""
    found = common.store(find(docs), "pii")
    field = Field(*train(found), **options)
    common.discard(found)
    row = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = found_in(pa.nulls(len(texts), pa.int64()), texts)
            base = zip(*(found.column(k).to_pylist() for k in (1, 2, 3)))
            new = [replaced(t, [*zip(*b), *((x["start"], x["kind"], x["end"]) for x in more)]) for t, b, more in zip(texts, base, field.added(found))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], ["row", "text"])

    masked = row.mapInArrow(run, row.schema)
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return masked.select(*(fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def replaced(text: str | None, spans: list) -> str | None:
    """The text with its spans (start, kind, end) cut out; where spans meet,
    the first names the gap."""
    if not text or not spans:
        return text
    out, free = [], 0
    for start, kind, end in sorted(spans):
        if start >= free:
            out += [text[free:start], f"[{KINDS[kind]}]"]
        free = max(free, end)
    return "".join([*out, text[free:]])
