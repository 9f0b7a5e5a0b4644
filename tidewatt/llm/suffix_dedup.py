"""Operator 5: removal of repeated byte strings by depth-limited radix sort.

Suffixes are ordered only through their first ``threshold`` bytes, and by
most-significant-digit passes that drop a group as soon as it has one member.
So that unique text costs little, suffixes move in runs: the threshold-byte
windows that start in a run share their anchor, the window's smallest hashed
CORE-byte string (leftmost on a tie), which equal windows share at the same
place.  The digits are

1. the anchor's string: runs whose anchor occurs once leave;
   runs that are equal as a whole are repeated and leave as well;
2. for what remains, the bytes common to a block of eight suffixes,
   and again equal blocks are repeated as a whole;
3. the single suffixes of blocks that were neither alone nor equal.

Equal groups after the last pass are exactly the repeated windows.  Digits are
compared by 128-bit hashes where a match removes text.

A passage of over 50 words may be shorter than the threshold.  It is reported,
never removed, by the same digits over words: runs of windows of WORDS words by
their anchor of WORD_CORE words, whole runs, then the single windows of texts
that no whole run has settled.

Defined results: null and empty texts have no bytes; texts under the threshold
keep all; identical repeated rows are repeats of each other, but share no
passage, as they are one document; null ids give one result row each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CORE = 50
BLOCK = 8
#: Words of the shortest passage that counts, and of its anchor's string.
WORDS = 51
WORD_CORE = 12
#: Bytes hashed at once; a longer text is hashed alone.
CHUNK = 1_000_000
PLACE = np.uint64((1 << 30) - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SOLID = np.array([chr(b) not in common.BLANKS for b in range(256)])


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window, from running minima inside blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def anchored(hashed: np.ndarray, width: int, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start and anchor of the runs of windows that share the
    smallest of their ``width`` hashes; windows may start where ``fits``."""
    ranked = (hashed & ~PLACE) | np.arange(len(hashed), dtype=np.uint64)
    anchor = (sliding_min(ranked, width) & PLACE).astype(np.int64)
    starts = np.flatnonzero(fits[:len(anchor)])
    own = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    return starts[at], starts[np.append(at[1:], len(starts)) - 1] if len(at) else starts, own[at]


class Runs:
    """The runs of suffixes in some texts: arrays doc, first and last start,
    anchor (places in ``raw``) and the anchor string's hash."""

    def __init__(self, texts: list[bytes], threshold: int, tables: tuple[np.ndarray, np.ndarray]):
        self.raw = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        self.begins = ends - sizes
        n = len(self.raw)
        if n < threshold:
            self.doc = self.first = self.last = self.anchor = self.core = np.empty(0, np.int64)
            return
        up, down = tables
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(self.raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashed = common.mix64((sums[CORE:] - sums[:-CORE]) * down[:n - CORE + 1])
        self.first, self.last, self.anchor = anchored(hashed, threshold - CORE + 1, np.arange(n) + threshold <= np.repeat(ends, sizes))
        self.doc = np.searchsorted(ends, self.first, "right")
        self.core = hashed[self.anchor].view(np.int64)


class WordRuns:
    """The runs of windows of ``size`` words in some texts: arrays doc, first
    and last start, the anchor string's hash and ``whole``, the run's own."""

    def __init__(self, texts: list[bytes], size: int, tables: tuple[np.ndarray, np.ndarray]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        edges = np.flatnonzero(np.diff(SOLID[raw], prepend=False))
        begins, ends = edges[::2], edges[1::2]
        self.up, self.down = tables
        self.size, n = size, len(begins)
        if n < size:
            self.doc = self.first = self.last = np.empty(0, np.int64)
            self.core = self.whole = np.empty(0, np.int64)
            return
        sums = self.sums(raw.astype(np.uint64) + np.uint64(1))
        self.words = common.mix64((sums[ends] - sums[begins]) * self.down[begins] + (ends - begins).astype(np.uint64))
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begins, "right")
        sums = self.sums(self.words)
        cores = common.mix64((sums[WORD_CORE:] - sums[:-WORD_CORE]) * self.down[:n - WORD_CORE + 1])
        self.first, self.last, anchor = anchored(cores, size - WORD_CORE + 1, doc[:n - size + 1] == doc[size - 1:])
        self.doc, self.core = doc[self.first], cores[anchor].view(np.int64)
        shape = common.mix64(((self.last - self.first) << 32 | (anchor - self.first)).astype(np.uint64))
        self.whole = common.mix64((sums[self.last + size] - sums[self.first]) * self.down[self.first] + shape).view(np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[:len(values)], out=out[1:])
        return out

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Doc and 128-bit hash of every window of the chosen runs."""
        sizes = (self.last - self.first + 1)[runs]
        starts = np.repeat(self.first[runs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        halves = []
        for words in (self.words, common.mix64(self.words ^ BASE)) if len(starts) else ():
            sums = self.sums(words)
            halves.append(common.mix64((sums[starts + self.size] - sums[starts]) * self.down[starts]).view(np.int64))
        return np.repeat(self.doc[runs], sizes), *(halves or [starts, starts])


def digest(data: bytes, seed: int) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(data, seed)
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def chunks(batches, threshold: int, kind=Runs, least: int | None = None, wanted: common.BitTable | None = None):
    """(keys, runs) over the batches' texts of ``least`` bytes and a wanted
    key, CHUNK bytes or one text at a time."""
    least = threshold if least is None else least
    limit, tables = 0, None
    keys, texts, size = [], [], 0

    def flush():
        nonlocal limit, tables
        if size + len(texts) > limit:
            limit = size + len(texts)
            tables = powers(BASE, limit), powers(INVERSE, limit)
        return np.array(keys, np.int64), kind(texts, threshold, tables)

    for batch in batches:
        if wanted is not None:
            batch = batch.filter(pa.array(wanted.has(batch.column(0).to_numpy())))
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if len(raw) < least:
                continue
            if texts and size + len(raw) > CHUNK:
                yield flush()
                keys, texts, size = [], [], 0
            keys.append(key)
            texts.append(raw)
            size += len(raw)
    if texts:
        yield flush()


def run_digests(runs: Runs, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    raw = runs.raw
    pairs = [digest(raw[a:b + threshold], c - a) for a, b, c in zip(runs.first.tolist(), runs.last.tolist(), runs.anchor.tolist())]
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def record(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def group_runs(texts: DataFrame, threshold: int) -> DataFrame:
    """First pass: distinct runs by anchor string, with their number and the
    smallest key of a text that has them."""
    def scan(batches):
        for keys, runs in chunks(batches, threshold):
            r1, r2 = run_digests(runs, threshold)
            yield record({"core": runs.core, "r1": r1, "r2": r2, "key": keys[runs.doc]})

    rows = texts.mapInArrow(scan, "core long, r1 long, r2 long, key long")
    return rows.groupBy("core", "r1", "r2").agg(F.count("*").alias("n"), F.min("key").alias("owner"))


def pick_runs(texts: DataFrame, threshold: int, repeated: common.BitTable, open_runs: common.BitTable) -> DataFrame:
    """Second scan: runs that may be repeated as a whole (``bytes`` null), and
    the bytes of one owner of each run whose anchor has several runs."""
    sieves = texts.sparkSession.sparkContext.broadcast((repeated, open_runs))

    def scan(batches):
        whole, open_ = sieves.value
        for keys, runs in chunks(batches, threshold):
            r1, r2 = run_digests(runs, threshold)
            key, begin = keys[runs.doc], runs.begins[runs.doc]
            a = whole.has(r1)
            yield record({"key": key[a], "first": (runs.first - begin)[a], "last": (runs.last - begin)[a], "anchor": (runs.anchor - runs.first)[a], "r1": r1[a], "r2": r2[a],
                          "bytes": pa.nulls(int(a.sum()), pa.binary())})
            b = open_.has(r1 ^ key)
            for lot in np.array_split(np.flatnonzero(b), 1 + int(b.sum()) // 20_000):
                yield record({"key": key[lot], "first": (runs.first - begin)[lot], "last": (runs.last - begin)[lot], "anchor": (runs.anchor - runs.first)[lot], "r1": r1[lot], "r2": r2[lot],
                              "bytes": pa.array([runs.raw[x:y + threshold] for x, y in zip(runs.first[lot].tolist(), runs.last[lot].tolist())], pa.binary())})

    return texts.mapInArrow(scan, "key long, first long, last long, anchor long, r1 long, r2 long, bytes binary")


def block_nodes(opened: DataFrame, threshold: int) -> DataFrame:
    """Second digit: blocks of BLOCK suffixes by their place before the anchor.
    ``digit``: the bytes that all windows of the block have in common."""
    schema = "run long, key long, block int, first long, last long, digit long, d1 long, d2 long"

    def scan(batches):
        for batch in batches:
            rows = []
            for run, key, first, last, anchor, raw in zip(*(c.to_pylist() for c in batch.columns)):
                for block in range((anchor - (last - first)) // BLOCK, anchor // BLOCK + 1):
                    low, high = max(0, anchor - BLOCK * block - BLOCK + 1), min(last - first, anchor - BLOCK * block)
                    top = anchor - BLOCK * block
                    common_part = xxhash.xxh3_64_intdigest(raw[top:top + threshold - BLOCK + 1], block) - (1 << 63)
                    rows.append((run, key, block, first + low, first + high, common_part, *digest(raw[low:high + threshold], anchor - low)))
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in schema.split(", ")])

    return opened.select("run", "key", "first", "last", "anchor", "bytes").mapInArrow(scan, schema)


def suffix_nodes(opened: DataFrame, blocks: DataFrame, threshold: int) -> DataFrame:
    """Last digits: the single suffixes of the open blocks."""
    schema = "key long, first long, d1 long, d2 long"

    def scan(batches):
        for batch in batches:
            rows = []
            for key, first, last, anchor, raw, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                for block in blocks:
                    low, high = max(0, anchor - BLOCK * block - BLOCK + 1), min(last - first, anchor - BLOCK * block)
                    rows.extend((key, first + k, *digest(raw[k:k + threshold], anchor - k)) for k in range(low, high + 1))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "first", "d1", "d2"])

    wanted = blocks.groupBy("run").agg(F.collect_list("block").alias("blocks"))
    return opened.join(wanted, "run").select("key", "first", "last", "anchor", "bytes", "blocks").mapInArrow(scan, schema)


def repeated_spans(docs: DataFrame, threshold: int) -> DataFrame:
    """key, start and end (byte places) of repeated strings of ``threshold``
    bytes or more; spans may overlap."""
    grouped = common.store(group_runs(docs.select("key", "text"), threshold), "suffix-runs")
    equal = grouped.where("n > 1")
    shared = grouped.groupBy("core").agg(F.count("*").alias("runs")).where("runs > 1")
    owners = grouped.join(shared, "core", "left_semi").select(F.col("r1").bitwiseXOR(F.col("owner")).alias("owner"))
    picked = common.store(
        pick_runs(docs.select("key", "text"), threshold, common.BitTable.of(equal, "r1"), common.BitTable.of(owners, "owner")).withColumn("run", F.monotonically_increasing_id()), "suffix-picked")
    span = lambda first, last: [F.col(first).alias("start"), (F.col(last) + threshold).alias("end")]
    whole = picked.where("bytes is null").join(equal, ["r1", "r2"], "left_semi").select("key", *span("first", "last"))
    opened = picked.where("bytes is not null")
    by_digit, by_block = Window.partitionBy("digit"), Window.partitionBy("digit", "d1", "d2")
    blocks = block_nodes(opened, threshold).withColumns({"in_digit": F.count("*").over(by_digit), "in_block": F.count("*").over(by_block), "number": F.row_number().over(by_block.orderBy("run"))})
    blocks = common.store(blocks.where("in_digit > 1").drop("digit", "d1", "d2"), "suffix-blocks")
    open_blocks = blocks.where("in_digit > in_block and number = 1")  # a lone block, or one of its equals
    suffixes = suffix_nodes(opened, open_blocks, threshold).withColumn("n", F.count("*").over(Window.partitionBy("d1", "d2"))).where("n > 1")
    return whole.unionByName(blocks.where("in_block > 1").select("key", *span("first", "last"))).unionByName(suffixes.select("key", *span("first", "first")))


def shared_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """key of every text with a passage of ``words`` words or more that a text
    of another key has as well; a key may come twice."""
    texts, least = docs.select("key", "text"), 2 * words - 1

    def scan(batches):
        for keys, runs in chunks(batches, words, WordRuns, least):
            row = np.stack([runs.core, runs.whole, keys[runs.doc]])
            new = np.ones(row.shape[1], bool)  # equal neighbours: a text that repeats itself
            new[1:] = (row[:, 1:] != row[:, :-1]).any(axis=0)
            yield record(dict(zip(("core", "whole", "key"), row[:, new])))

    by_core, by_run = Window.partitionBy("core"), Window.partitionBy("core", "whole")
    across = lambda window: F.min("key").over(window) != F.max("key").over(window)
    rows = texts.mapInArrow(scan, "core long, whole long, key long").withColumns({"several": across(by_core), "settled": across(by_run), "owner": F.min("key").over(by_run)})
    rows = common.store(rows.where("several").drop("several"), "passage-runs")
    settled = rows.where("settled").select("key").distinct()
    open_cores = rows.join(settled, "key", "left_anti").select("core").distinct()
    opened = common.store(rows.join(open_cores, "core", "left_semi").where("not settled or key = owner").select("key", F.col("core").bitwiseXOR(F.col("key")).alias("run")), "passage-open")
    sieves = docs.sparkSession.sparkContext.broadcast((common.BitTable.of(opened, "key"), common.BitTable.of(opened, "run")))

    def single(batches):
        wanted, open_ = sieves.value
        for keys, runs in chunks(batches, words, WordRuns, least, wanted):
            doc, d1, d2 = runs.windows(np.flatnonzero(open_.has(runs.core ^ keys[runs.doc])))
            yield record({"key": keys[doc], "d1": d1, "d2": d2})

    windows = texts.mapInArrow(single, "key long, d1 long, d2 long").withColumn("several", across(Window.partitionBy("d1", "d2")))
    return settled.unionByName(windows.where("several").select("key"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedupe(docs: DataFrame, threshold: int = 400) -> DataFrame:
    """doc_id, n_bytes, spans (removed, maximal), ``kept`` (the remaining bytes;
    a cut may fall inside a character), kept_sha256 and has_passage (a passage
    of WORDS words or more is in another document as well)."""
    if threshold < CORE + BLOCK:
        raise ValueError(f"threshold is {CORE + BLOCK} bytes at least")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(texts, threshold).select("key", F.struct("start", "end").alias("span"), F.lit(False).alias("passage"))
    spans = spans.unionByName(shared_passages(texts).withColumn("passage", F.lit(True)), allowMissingColumns=True)
    spans = spans.groupBy("key").agg(F.array_sort(F.collect_set("span")).alias("found"), F.max("passage").alias("passage"))

    def cut(batches):
        for batch in common.parts(batches):
            doc, sizes, spans, left = batch.column(0), [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                gone = merged([(x["start"], x["end"]) for x in found or ()])
                pieces, at = [], 0
                for a, b in gone:
                    pieces.append(raw[at:a])
                    at = b
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in gone])
                left.append(b"".join([*pieces, raw[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            hashes = [hashlib.sha256(x).hexdigest() for x in left]
            yield pa.RecordBatch.from_arrays([doc, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(left, pa.binary()), pa.array(hashes, pa.string()), batch.column(3)],
                                             ["doc_id", "n_bytes", "spans", "kept", "kept_sha256", "has_passage"])

    joined = texts.join(spans, "key", "left").select("doc_id", "text", "found", F.coalesce("passage", F.lit(False)))
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string, has_passage boolean")
