"""Operator 3: benchmark decontamination as a prefix-filtered set join.

A benchmark window is the set of its word shingles.  All shingles are ordered
by rarity in the corpus; as a window must be contained whole, its necessary
prefix is its one rarest shingle.  Documents join on that token; the window's
length and the token's place in it bound where it can start; then the whole
run of shingles is compared.  Which document shingles can matter at all is
decided by a bit table of the benchmark's shingles, of bounded size.

Defined results: null and empty texts have no words; items without words
have no windows; items that share a window are all reported; null item ids
are left out of the item lists but their windows count as hits; null ids and
repeated rows give one result row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Consecutive words of a window, and of a shingle inside it.
WINDOW, SHINGLE = 13, 3
# Fixed values of the word rule: digits, a-z and everything beyond ASCII.
WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TO_WORDS = bytes(common.ASCII_LOWER[b] if common.ASCII_LOWER[b] in WORD_BYTES else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


def run_hashes(hashed: np.ndarray, width: int) -> np.ndarray:
    return common.shingle_hashes(hashed, width).view(np.int64) if len(hashed) >= width else np.empty(0, np.int64)


def windows(benchmark: DataFrame) -> DataFrame:
    """item_id, window (its hash), words, width and the window's shingles."""
    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashed = common.hash_words(words_of(text))
                size = min(len(hashed), WINDOW)
                width = min(size, SHINGLE)
                if not size:
                    continue
                runs = run_hashes(hashed, width)
                for k, window in enumerate(run_hashes(hashed, size)):
                    rows.append((item, int(window), size, width, runs[k:k + size - width + 1].tolist()))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["item_id", "window", "words", "width", "shingles"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        run, "item_id long, window long, words int, width int, shingles array<long>")


def sifted(docs: DataFrame, table: common.BitTable, widths: list[int]) -> DataFrame:
    """doc_id, n_words, and the places and hashes of the shingles that the
    bit table lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        sieve = shared.value
        for batch in batches:
            counts, places, hashes = [], [], []
            for text in batch.column(1).to_pylist():
                hashed = common.hash_words(words_of(text))
                counts.append(len(hashed))
                found = [(np.flatnonzero(sieve.has(x)), x) for x in (run_hashes(hashed, w) for w in widths)]
                places.append(np.concatenate([p for p, _ in found]).astype(np.int32) if found else [])
                hashes.append(np.concatenate([x[p] for p, x in found]) if found else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))],
                                             ["doc_id", "n_words", "places", "hashes"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, places array<int>, hashes array<long>")
    return found.withColumn("row", F.monotonically_increasing_id())


def prefixes(distinct: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each window with its rarest shingle and that shingle's place.  Windows
    with a shingle that no document has are left out: they can't occur."""
    rarity = corpus.select(F.explode("hashes").alias("token")).groupBy("token").agg(F.count("*").alias("rarity"))
    tokens = distinct.select("window", F.posexplode("shingles").alias("offset", "token"))
    ranked = tokens.join(rarity, "token", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), "token", "offset")).alias("first"))
    return distinct.join(ranked.where("first.rarity > 0"), "window").select("window", "words", "shingles", F.col("first.token").alias("token"), F.col("first.offset").alias("offset"))


def candidates(corpus: DataFrame, prefix: DataFrame) -> DataFrame:
    """row, start and window wherever a prefix token leaves room for its window."""
    tokens = corpus.select("row", "n_words", F.explode(F.arrays_zip("places", "hashes")).alias("at")).select("row", "n_words", F.col("at.places").alias("place"), F.col("at.hashes").alias("token"))
    joined = tokens.join(prefix, "token").withColumn("start", F.col("place") - F.col("offset"))
    return joined.where((F.col("start") >= 0) & (F.col("start") + F.col("words") <= F.col("n_words"))).select("row", "start", "words", "window", "shingles")


def verified(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """row, n_hit and the windows that occur, each compared shingle by
    shingle with the document's own."""
    def run(batches):
        for batch in batches:
            rows, hits, kept = batch.column(0), [], []
            for places, hashes, tries in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                own = set(zip(places.as_py(), hashes.as_py()))
                real = [t for t in tries if all((t["start"] + k, s) in own for k, s in enumerate(t["shingles"]))]
                covered, end = 0, -1
                for a, b in sorted((t["start"], t["start"] + t["words"]) for t in real):
                    covered += max(0, b - max(a, end))
                    end = max(end, b)
                hits.append(covered)
                kept.append(sorted({t["window"] for t in real}))
            yield pa.RecordBatch.from_arrays([rows, pa.array(hits, pa.int64()), pa.array(kept, pa.list_(pa.int64()))], ["row", "n_hit", "windows"])

    tries = found.groupBy("row").agg(F.collect_list(F.struct("start", "words", "window", "shingles")).alias("tries"))
    return corpus.select("row", "places", "hashes").join(tries, "row").mapInArrow(run, "row long, n_hit long, windows array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings) and contaminated, of
    every document, plus ``row``, its number in the corpus."""
    items = common.store(windows(benchmark), "windows")
    distinct = items.groupBy("window").agg(F.first("words").alias("words"), F.first("width").alias("width"), F.first("shingles").alias("shingles"))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # 1 to SHINGLE
    table = common.BitTable.of(items.select(F.explode("shingles").alias("token")), "token")
    corpus = common.store(sifted(docs, table, widths), "sifted")
    hits = common.store(verified(corpus, candidates(corpus, prefixes(distinct, corpus))).where("n_hit > 0"), "hits")
    named = (hits.select("row", F.explode("windows").alias("window")).join(items.select("window", "item_id").distinct(), "window")
             .groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    joined = corpus.select("row", "doc_id", "n_words").join(hits.select("row", "n_hit"), "row", "left").join(named, "row", "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return joined.select("row", "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                         ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, columns as given."""
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = contamination(keyed.select(F.col("_key").alias("doc_id"), "text"), benchmark)
    bad = found.where("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return keyed.join(bad, F.col("_key") == F.col("_bad"), "left_anti").select(docs.columns)
