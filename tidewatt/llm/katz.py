"""Operator 6: Katz backoff language model, trained and evaluated on Spark.

Texts become chunks of token numbers, stored once in a table bucketed by
chunk.  Counts meet in hash buckets whose number grows with the corpus: first
word counts, then counts of word pairs by context.  Every bucket answers the
chunks that asked, so a chunk gets exactly the counts it needs, and evaluates
its documents token by token: a seen pair has its discounted share, any other
recurses to the word, and an unseen word to the mass that words leave over.

* Good-Turing: counts up to ``most`` are discounted by the corpus' counts of
  counts; see ``discounts``.
* Backoff weights are exactly normalised: for every context, the discounted
  shares and the backed-off rest add up to one over all words and the unknown.
* Chunks pre-aggregate, so a frequent pair is one entry a chunk; contexts with
  more than a bucket's fair share of all tokens (a bounded list) are split
  over buckets by their follower, and their sums added up.

The order is two: pairs of words back off to words.  Words are told apart by
64-bit hashes.

Defined results: null and empty texts are one end token; a corpus without
training rows leaves every token unknown with probability one; repeated rows
count as often as they stand; null ids count as the empty text for the fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens of a chunk (a longer text is a chunk of its own), and of a bucket.
CHUNK, BUCKET = 1_000_000, 2_000_000
#: Tokens of a context that may be split, at least.
LEAST_HOT = 1000
#: Hashes of the marks before and after a text.
BEGIN, END = np.int64(1), np.int64(2)


def pack(x: np.ndarray) -> bytes:
    """Type, then the compressed byte planes."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return x.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data) -> np.ndarray:
    kind = np.dtype(bytes(data[:1]).decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data[1:])), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def small(x: np.ndarray) -> np.ndarray:
    """Narrowest of 32 and 64 bits for counts."""
    return x.astype(np.int32) if not len(x) or x.max() < 1 << 31 else x.astype(np.int64)


def places(where: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each value that occurs, in order."""
    order = np.argsort(where, kind="stable")
    values, starts = np.unique(where[order], return_index=True)
    return dict(zip(values.tolist(), np.split(order, starts[1:])))


# --- chunks ----------------------------------------------------------------------

CHUNKS = "words binary, counts binary, tokens binary, doc_ids array<long>, sizes array<int>, held array<boolean>"


def chunk_table(docs: DataFrame, held: object) -> DataFrame:
    """Chunks of whole documents: sorted word hashes, their counts in training
    texts, and all token numbers."""
    def scan(batches):
        table: dict[bytes, int] = {}
        numbers, ids, sizes, marks = [], [], [], []
        total = 0

        def flush():
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in table), np.uint64, len(table)).view(np.int64)
            words, rank = np.unique(hashes, return_inverse=True)
            tokens = rank[np.concatenate(numbers)] if total else np.empty(0, np.int64)
            training = np.repeat(~np.array(marks, bool), sizes)
            counts = np.bincount(tokens[training], minlength=len(words))
            blob = lambda x: pa.array([pack(x)], pa.binary())
            return pa.RecordBatch.from_arrays([blob(words), blob(small(counts)), blob(tokens.astype(np.int32)), pa.array([ids], pa.list_(pa.int64())),
                                               pa.array([sizes], pa.list_(pa.int32())), pa.array([marks], pa.list_(pa.bool_()))], [x.split()[0] for x in CHUNKS.split(", ")])

        for batch in common.parts(batches):
            for doc_id, text, mark in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or "").encode().translate(common.ASCII_LOWER).split()
                if ids and total + len(words) > CHUNK:
                    yield flush()
                    table, numbers, ids, sizes, marks, total = {}, [], [], [], [], 0
                numbers.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words)))
                ids.append(doc_id)
                sizes.append(len(words))
                marks.append(mark)
                total += len(words)
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    return rows.mapInArrow(scan, CHUNKS).withColumn("chunk", F.monotonically_increasing_id())


class Pairs:
    """A chunk's distinct (context, follower) pairs.  Numbers up to ``size``
    are words; begin and end follow."""

    def __init__(self, row: dict):
        self.words = unpack(row["words"])
        self.size = len(self.words)
        self.hashes = np.concatenate([self.words, [BEGIN, END]])
        tokens = unpack(row["tokens"]).astype(np.int64)
        sizes = np.array(row["sizes"], np.int64)
        self.docs = np.repeat(np.arange(len(sizes)), sizes + 1)
        ends = np.cumsum(sizes + 1) - 1
        self.follower = np.full(len(tokens) + len(sizes), self.size + 1, np.int64)
        inside = np.ones(len(self.follower), bool)
        inside[ends] = False
        self.follower[inside] = tokens
        context = np.empty_like(self.follower)
        context[1:] = self.follower[:-1]
        context[ends - sizes] = self.size
        self.held = np.array(row["held"], bool)
        codes, self.pair = np.unique(context * (self.size + 2) + self.follower, return_inverse=True)
        self.context, self.next = np.divmod(codes, self.size + 2)
        self.count = np.bincount(self.pair[~self.held[self.docs]], minlength=len(codes))

    def buckets(self, counts: np.ndarray, buckets: int, hot: int) -> np.ndarray:
        """Each pair's bucket: its context's, or for hot contexts its own."""
        h = self.hashes[self.context]
        own = counts[self.context] >= hot
        h = np.where(own, h ^ common.mix64(self.hashes[self.next].view(np.uint64)).view(np.int64), h)
        return (common.mix64(h.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def word_counts(row: dict, training: int, buckets: int) -> np.ndarray:
    """Corpus counts of a chunk's words, begin and end, from the answers."""
    words = unpack(row["words"])
    part = places(common.mix64(words.view(np.uint64)) % np.uint64(buckets))
    out = np.zeros(len(words) + 2, np.int64)
    for answer in row["word_answers"]:
        out[part[answer["bucket"]]] = unpack(answer["counts"])
    out[-2:] = training
    return out


# --- model -----------------------------------------------------------------------

def discounts(counts_of_counts: list[int], most: int) -> list[float]:
    """Factors d[r] for r up to the largest k <= ``most`` at which Good-Turing
    holds (0 < d < 1 for all r); without one, (r - 0.5) / r up to ``most``.
    counts_of_counts[r - 1]: things met r times, for r up to most + 1."""
    n = [0, *counts_of_counts]
    for k in range(most, 0, -1):
        if not all(n[1:k + 2]):
            continue
        a = (k + 1) * n[k + 1] / n[1]
        if a >= 1:
            continue
        d = [((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return d
    return [(r - 0.5) / r for r in range(1, most + 1)]


class Words:
    """Discounted word probabilities."""

    def __init__(self, stats: list[int], training: int, most: int):
        """stats: known words, tokens without ends, then counts of counts."""
        known, tokens, *n = stats
        self.known, self.total = known + (training > 0), tokens + training
        if 0 < training <= most + 1:
            n[training - 1] += 1
        self.d = np.array([1.0, *discounts(n, most)])
        kept = sum(c * r * (1 - x) for r, (c, x) in enumerate(zip(n, self.d[1:]), 1))
        self.unknown = kept / self.total if kept else 1.0 if not self.total else 1 / (self.total + 1)
        self.scale = 1.0 if kept or not self.total else self.total / (self.total + 1)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        d = np.where(counts < len(self.d), self.d[np.minimum(counts, len(self.d) - 1)], 1.0)
        return np.where(counts > 0, self.scale * d * counts / max(self.total, 1), self.unknown)


def context_stats(owner: np.ndarray, size: int, counts: np.ndarray, shares: np.ndarray, most: int) -> np.ndarray:
    """Per context: its count, how many followers were met 1 to ``most``
    times, and the followers' word probabilities in total."""
    seen = counts > 0
    owner, counts, shares = owner[seen], counts[seen], shares[seen]
    out = np.zeros((size, most + 2))
    out[:, 0] = np.bincount(owner, counts, size)
    for r in range(1, most + 1):
        out[:, r] = np.bincount(owner[counts == r], minlength=size)
    out[:, -1] = np.bincount(owner, shares, size)
    return out


def weights(stats: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale of the seen shares, backoff weight) of each context.  A context
    that no discount touches gives up one count in count + 1."""
    total = np.maximum(stats[:, 0], 1)
    r = np.arange(1, len(d))
    left = (stats[:, 1:len(d)] * r * (1 - d[1:])).sum(1) / total
    scale = np.where(left > 0, 1.0, stats[:, 0] / (stats[:, 0] + 1))
    left = np.where(left > 0, left, 1 / (stats[:, 0] + 1))
    return scale, np.where(stats[:, 0] > 0, left / (1 - stats[:, -1]), 1.0)


# --- Spark -----------------------------------------------------------------------

def ask(rows: DataFrame, scan, schema: str, answer, out: str) -> DataFrame:
    """Questions of all chunks meet by bucket; ``answer`` maps a bucket's
    questions to rows of ``out``."""
    return rows.mapInArrow(scan, schema).groupBy("bucket").applyInPandas(answer, out)


def gathered(answers: DataFrame, fields: list[str], name: str) -> DataFrame:
    return answers.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", *fields)).alias(name))


def records(batch: pa.RecordBatch):
    for k in range(batch.num_rows):
        yield {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}


def ask_words(chunks: DataFrame, buckets: int, most: int) -> DataFrame:
    def scan(batches):
        for batch in batches:
            for row in records(batch):
                words, counts = unpack(row["words"]), unpack(row["counts"])
                parts = places(common.mix64(words.view(np.uint64)) % np.uint64(buckets))
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([row["chunk"]] * len(parts), pa.int64()),
                                                  pa.array([pack(words[p]) for p in parts.values()], pa.binary()), pa.array([pack(counts[p]) for p in parts.values()], pa.binary())],
                                                 ["bucket", "chunk", "words", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [unpack(x) for x in pdf["words"]]
        every, where = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(where, np.concatenate([unpack(x) for x in pdf["counts"]]).astype(float), len(every)).astype(np.int64)
        cuts = np.cumsum([len(w) for w in words])[:-1]
        stats = [int((counts > 0).sum()), int(counts.sum()), *(int((counts == r).sum()) for r in range(1, most + 2))]
        rows = [(c, b, pack(small(counts[w])), None) for c, b, w in zip(pdf["chunk"], pdf["bucket"], np.split(where, cuts))]
        return pd.DataFrame([*rows, (-1, pdf["bucket"].iloc[0], None, stats)], columns=["chunk", "bucket", "counts", "stats"])

    return ask(chunks.select("chunk", "words", "counts"), scan, "bucket int, chunk long, words binary, counts binary", answer, "chunk long, bucket int, counts binary, stats array<long>")


def summed(answers: DataFrame, size: int) -> list[int]:
    row = answers.where("chunk < 0").agg(*(F.sum(F.col("stats")[k]) for k in range(size))).first()
    return [int(x or 0) for x in row]


def ask_pairs(told: DataFrame, model: Words, training: int, buckets: int, hot: int, most: int) -> DataFrame:
    """Corpus counts of each chunk's pairs and its contexts' sums; rows of
    chunk -1 have counts of counts, and the partial sums of hot contexts."""
    names = ["bucket", "chunk", "contexts", "context", "words", "shares", "follower", "counts"]

    def scan(batches):
        for batch in batches:
            for row in records(batch):
                pairs, counts = Pairs(row), word_counts(row, training, buckets)
                for b, part in places(pairs.buckets(counts, buckets, hot)).items():
                    contexts, context = np.unique(pairs.context[part], return_inverse=True)
                    words, follower = np.unique(pairs.next[part], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([row["chunk"]], pa.int64()), *(pa.array([pack(x)], pa.binary()) for x in (
                        pairs.hashes[contexts], context.astype(np.int32), pairs.hashes[words], small(counts[words]), follower.astype(np.int32), small(pairs.count[part])))], names)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        column = {name: [unpack(x) for x in pdf[name]] for name in names[2:]}
        contexts, context_of = np.unique(np.concatenate(column["contexts"]), return_inverse=True)
        words, at, word_of = np.unique(np.concatenate(column["words"]), return_index=True, return_inverse=True)
        word_shares = model.probability(np.concatenate(column["shares"])[at].astype(np.int64))
        codes, steps = [], (0, 0)
        for a, b, c, f in zip(column["contexts"], column["words"], column["context"], column["follower"]):
            codes.append(context_of[steps[0] + c].astype(np.int64) * len(words) + word_of[steps[1] + f])
            steps = steps[0] + len(a), steps[1] + len(b)
        sizes, codes = [len(c) for c in codes], np.concatenate(codes)
        own = np.split(context_of, np.cumsum([len(a) for a in column["contexts"]])[:-1])
        met = np.concatenate(column["counts"])
        del column, word_of  # what follows needs as much room again
        every, pair = np.unique(codes, return_inverse=True)
        del codes
        counts = np.bincount(pair, met, len(every)).astype(np.int64)
        owner, follower = np.divmod(every, len(words))
        stats = context_stats(owner, len(contexts), counts, word_shares[follower], most)
        of_counts = [int((counts == r).sum()) for r in range(1, most + 2)]
        rows = []
        for chunk, bucket, p, c in zip(pdf["chunk"], pdf["bucket"], np.split(pair, np.cumsum(sizes)[:-1]), own):
            sums = stats[c]
            rows.append((chunk, bucket, pack(small(counts[p])), pack(small(sums[:, :-1].astype(np.int64).ravel())), pack(sums[:, -1]), None, None))
        # contexts whose sum here reaches a bucket's part of a hot context are told as a whole
        big = [{"context": int(contexts[k]), "sums": stats[k].tolist()} for k in np.flatnonzero(np.isin(contexts, hot_contexts))]
        rows.append((-1, pdf["bucket"].iloc[0], None, None, None, of_counts, big))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "counts", "sums", "shares", "stats", "hot"])

    hot_contexts = hot_words(told, training, buckets, hot)
    out = "chunk long, bucket int, counts binary, sums binary, shares binary, stats array<long>, hot array<struct<context:long,sums:array<double>>>"
    schema = "bucket int, chunk long, " + ", ".join(f"{n} binary" for n in names[2:])
    return ask(told, scan, schema, answer, out)


def hot_words(told: DataFrame, training: int, buckets: int, hot: int) -> np.ndarray:
    """Hashes of the contexts with ``hot`` tokens or more; at most as many as
    hot goes into the corpus."""
    def scan(batches):
        for batch in batches:
            for row in records(batch):
                words, counts = unpack(row["words"]), word_counts(row, training, buckets)
                yield pa.RecordBatch.from_arrays([pa.array(words[counts[:-2] >= hot], pa.int64())], ["word"])

    found = [r.word for r in told.select("words", "word_answers").mapInArrow(scan, "word long").distinct().collect()]
    return np.array([*found, *([int(BEGIN)] if training >= hot else [])], np.int64)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held: object, most: int = 5) -> DataFrame:
    """Base and model log10 probabilities of every document; the rows where
    ``held`` is true teach the model nothing."""
    spark = docs.sparkSession
    parts = common.partitions_of(spark)
    path = common.new_path(spark, "chunks")
    table = "tidewatt_" + path.rpartition("/")[2].replace("-", "_")
    chunk_table(docs, held).write.option("path", path).option("compression", "zstd").bucketBy(parts, "chunk").saveAsTable(table)
    chunks = spark.table(table)
    sizes = chunks.select(F.explode(F.arrays_zip("sizes", "held")).alias("x")).agg(F.sum("x.sizes").alias("tokens"), F.sum(F.expr("cast(not x.held as long)")).alias("training")).first()
    training = int(sizes.training or 0)
    buckets = max(2, -(-int(sizes.tokens or 0) // BUCKET))
    word_answers = common.store(ask_words(chunks, buckets, most), "word-counts")
    model = Words(summed(word_answers, most + 3), training, most)
    hot = max(LEAST_HOT, model.total // (4 * buckets))
    told = chunks.join(gathered(word_answers, ["counts"], "word_answers"), "chunk", "left")
    told = told.withColumn("word_answers", F.coalesce("word_answers", F.array()))
    pair_answers = common.store(ask_pairs(told, model, training, buckets, hot, most), "pair-counts")
    d = np.array([1.0, *discounts(summed(pair_answers, most + 1), most)])
    hot_sums = {r.context: np.array(r.sums) for r in pair_answers.where("chunk < 0").select(F.explode("hot").alias("h")).groupBy(F.col("h.context").alias("context"))
                .agg(F.array(*(F.sum(F.col("h.sums")[k]) for k in range(most + 2))).alias("sums")).collect()}

    def scan(batches):
        for batch in batches:
            for row in records(batch):
                yield evaluate(row)

    def evaluate(row: dict) -> pa.RecordBatch:
        pairs, counts = Pairs(row), word_counts(row, training, buckets)
        split = places(pairs.buckets(counts, buckets, hot))
        met = np.zeros(len(pairs.context), np.int64)
        stats = np.zeros((pairs.size + 2, most + 2))
        for answer in row["pair_answers"]:
            part = split[answer["bucket"]]
            met[part] = unpack(answer["counts"])
            contexts = np.unique(pairs.context[part])
            stats[contexts, :-1] = unpack(answer["sums"]).reshape(-1, most + 1)
            stats[contexts, -1] = unpack(answer["shares"])
        for k in np.flatnonzero(np.isin(pairs.hashes, list(hot_sums))):
            stats[k] = hot_sums[int(pairs.hashes[k])]
        scale, alpha = weights(stats, d)
        shares = model.probability(counts)
        factor = np.where(met < len(d), d[np.minimum(met, len(d) - 1)], 1.0)
        context = pairs.context
        p = np.where(met > 0, scale[context] * factor * met / np.maximum(stats[context, 0], 1), alpha[context] * shares[pairs.next])
        n = len(pairs.held)
        total = lambda x: np.bincount(pairs.docs, x, n)
        base = np.log10((counts + 1) / (model.total + model.known + 1))
        return pa.RecordBatch.from_arrays([
            pa.array(row["doc_ids"], pa.int64()), pa.array(pairs.held), pa.array(np.bincount(pairs.docs, minlength=n), pa.int64()),
            pa.array(total(counts[pairs.follower] > 0).astype(np.int64)), pa.array(np.full(n, model.total), pa.int64()),
            pa.array(total(base[pairs.follower])), pa.array(total(np.log10(p)[pairs.pair]))], [x.split()[0] for x in SCORES.split(", ")])

    full = told.join(gathered(pair_answers, ["counts", "sums", "shares"], "pair_answers"), "chunk", "left")
    return full.withColumn("pair_answers", F.coalesce("pair_answers", F.array())).mapInArrow(scan, SCORES)
