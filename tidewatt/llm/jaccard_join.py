"""Operator 8: exact n-gram Jaccard join over size-banded tiles.

A document's set holds its distinct 5-word shingles, by 64-bit hash.

* Documents with one and the same set are one class; its first row stands for it.
* Two sets that link share one of their lowest n - ceil(0.8 n) + 1 hashes.
  Tokens that a single class has are dropped at once.
* Rows are dealt into tiles by token and size band (sizes within 1.25 of each
  other); a large tile is cut into slices and dealt out by pairs of slices.
  Inside a tile, hashed bitmaps bound each pair's overlap from above by bit
  counts.  A tile tells which rows such pairs join, as stars, never all
  pairs.  The components of these edges hold every link: pairs in
  different ones are proven apart.  A first round over each row's two lowest
  tokens joins near copies, so the second needs only the tokens whose rows
  still lie in several components.
* Each component's sets then meet once, whole, in tiles of the same kind, with
  wider bitmaps and, for pairs that these can't rule out, exact sorted-array
  intersection.  Pairs that a tile has already connected are skipped, and
  again only stars of joined rows are told.

So a group of thousands of near copies or near misses costs bit counts for its
pairs, but rows only in proportion to its members.

Defined results: null and empty texts have an empty set and link with nothing;
a null doc_id takes its component's smallest id (null if there is none);
repeated rows are copies of each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph

WORDS = 5
PERCENT = 80
#: Rows of a tile's slice.
SLICE = 512
#: Bits a hash of the bitmaps of the exact tiles.
WIDE = 16
BAND = math.log(100 / PERCENT)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = (text or "").encode().translate(common.ASCII_LOWER).split()
    return np.unique(common.shingle_hashes(common.hash_words(words), WORDS))


def bitmap(hashes: np.ndarray, size: int = 0) -> bytes:
    """One bit per hash, in ``size`` bits: the next power of two, 64 at least."""
    size = size or max(64, 1 << (len(hashes) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes >> np.uint64(20)) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key, row, n, the set's digest, its lowest hashes and bitmap."""
    def scan(batches):
        for batch in batches:
            sizes, d1, d2, tokens, bits = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_set(text)
                n = len(hashes)
                x = xxhash.xxh3_128_intdigest(hashes.tobytes())
                sizes.append(n)
                d1.append((x >> 64) - (1 << 63))
                d2.append((x & (1 << 64) - 1) - (1 << 63))
                tokens.append(hashes[:n + (PERCENT * n) // -100 + 1].view(np.int64) if n else [])
                bits.append(bitmap(hashes) if n else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                                              pa.array(tokens, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "key", "n", "d1", "d2", "tokens", "bits"])

    rows = keyed(docs).select("doc_id", "key", "text").mapInArrow(scan, "doc_id long, key long, n long, d1 long, d2 long, tokens array<long>, bits binary")
    return rows.withColumn("row", F.monotonically_increasing_id())


def shared_tokens(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """token and row of the classes' first rows, for tokens that two rows have."""
    counted = rows.select("row", F.explode("tokens").alias("token")).withColumn("n_rows", F.count("*").over(Window.partitionBy("token")))
    return counted.where("n_rows > 1").drop("n_rows").join(classes.select("row"), "row", "left_semi")


def folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, the wider ones folded to the narrowest."""
    width = min(len(b) for b in bits)
    out = np.empty((len(bits), width // 8), np.uint64)
    for k, b in enumerate(bits):
        out[k] = np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0)
    return out


def forest(sizes: np.ndarray, maps: np.ndarray, home: np.ndarray, part: np.ndarray, low: int, high: int, group: np.ndarray, test=None) -> list[tuple[int, int]]:
    """Connects the tile's rows, by place, over the pairs that could link or,
    with ``test``, that it accepts.  Rows come by size.  A pair needs a home
    row, a row from slice ``low`` and one from ``high``, and different groups.
    Every set of groups that this joins is told as a star: the first row of
    its first group with the first rows of the others."""
    before, group = group, group.copy()
    last = np.searchsorted(sizes, sizes * 100 // PERCENT, "right")
    for k in range(len(sizes)):
        j = np.arange(k + 1, last[k])
        apart = (group[j] != group[k]) & (home[j] | home[k])
        if low != high:
            apart &= part[j] == low + high - part[k]
        j = j[apart]
        if not len(j):
            continue
        need = -(-PERCENT * (sizes[k] + sizes[j]) // (100 + PERCENT))
        most = sizes[k] - np.bitwise_count(maps[k] & ~maps[j]).sum(1).astype(np.int64)
        j, need = j[most >= need], need[most >= need]
        most = sizes[j] - np.bitwise_count(maps[j] & ~maps[k]).sum(1).astype(np.int64)
        j, most = j[most >= need], most[most >= need]
        # without a test one pair a group is enough; with one, likely pairs first
        order = np.unique(group[j], return_index=True)[1] if test is None else np.argsort(-most, kind="stable")
        for other in j[order]:
            if group[other] != group[k] and (test is None or test(k, other)):
                group[group == group[other]] = group[k]
    firsts = np.unique(before, return_index=True)[1]
    firsts.sort()
    root: dict[int, int] = {}
    return [(root[g], k) for k, g in zip(firsts.tolist(), group[firsts].tolist()) if root.setdefault(g, k) != k]


def dealt(rows: DataFrame, group: str, banded) -> DataFrame:
    """Adds a tile to rows (row, n and ``group``): band, low, high, home and
    slice.  Where ``banded`` is true a row goes to its size band's tile and, as
    a guest, to the next lower one's; else its group is one tile."""
    band = F.floor(F.log(F.col("n")) / F.lit(BAND)).cast("int")
    place = lambda b, home: F.struct(b.alias("band"), F.lit(home).alias("home"))
    at = F.when(banded, F.array(place(band, True), place(band - 1, False))).otherwise(F.array(place(F.lit(-1), True)))
    tiled = rows.withColumn("at", F.explode(at)).select("*", "at.band", "at.home").drop("at")
    sizes = tiled.groupBy(group, "band").agg(F.count("*").alias("tile_rows"), F.max("home").alias("any_home")).where("tile_rows > 1 and any_home")
    tiled = tiled.join(sizes.drop("any_home"), [group, "band"]).withColumn("slices", F.ceil(F.col("tile_rows") / SLICE).cast("int"))
    tiled = tiled.withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return tiled.withColumns({"low": F.least("slice", "other"), "high": F.greatest("slice", "other")}).drop("tile_rows", "slices", "other")


def in_tiles(rows: DataFrame, group: str, column: str, work) -> DataFrame:
    """Edges (a, b) that ``work`` finds in each tile's rows."""
    keys = [group, "band", "low", "high"]

    def scan(batches):
        rows, at = [], None

        def told():
            rows.sort(key=lambda r: (r[2], r[0]))
            found = work(rows, at[2], at[3]) if len(rows) > 1 else []
            ids = [r[0] for r in rows]
            return pa.RecordBatch.from_arrays([pa.array([min(ids[x], ids[y]) for x, y in found], pa.int64()), pa.array([max(ids[x], ids[y]) for x, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for *key, row, label, n, home, part, data in zip(*(c.to_pylist() for c in batch.columns)):
                if at != key:
                    if rows:
                        yield told()
                    rows, at = [], key
                rows.append((row, label, n, home, part, data))
        if rows:
            yield told()

    sorted_ = rows.select(*keys, "row", "label", "n", "home", "slice", column).repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(scan, "a long, b long").distinct()


def columns_of(rows: list[tuple]) -> list[np.ndarray]:
    """sizes, home, slice and group of a tile's rows."""
    sizes, home, part = (np.array([r[k] for r in rows], t) for k, t in ((2, np.int64), (3, bool), (4, np.int64)))
    return [sizes, home, part, np.unique([r[1] for r in rows], return_inverse=True)[1]]


def possible(rows: list[tuple], low: int, high: int) -> list[tuple[int, int]]:
    sizes, home, part, group = columns_of(rows)
    return forest(sizes, folded([r[5] for r in rows]), home, part, low, high, group)


def certain(rows: list[tuple], low: int, high: int) -> list[tuple[int, int]]:
    sizes, home, part, _ = columns_of(rows)
    sets = [np.frombuffer(r[5], np.uint64) for r in rows]
    width = 1 << (WIDE * int(sizes[-1]) - 1).bit_length()
    maps = np.stack([np.frombuffer(bitmap(x, max(64, width)), np.uint64) for x in sets])

    def test(x: int, y: int) -> bool:
        small, large = sets[x], sets[y]  # by size
        both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
        return 100 * both >= PERCENT * (len(small) + len(large) - both)

    return forest(sizes, maps, home, part, low, high, np.arange(len(rows)), test)


def possible_edges(tokens: DataFrame, light: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Edges between rows of a token whose bit counts don't rule a link out,
    for the tokens whose rows have several labels."""
    label = F.col("row")
    known = light
    if labels is not None:
        known, label = light.join(labels.withColumnRenamed("node", "row"), "row", "left"), F.coalesce("label", "row")
    known = known.select("row", "n", "bits", label.alias("label"))
    met = tokens.join(known.drop("bits"), "row")
    if labels is not None:
        by_token = Window.partitionBy("token")
        met = met.withColumns({"least": F.min("label").over(by_token), "most": F.max("label").over(by_token)}).where("least <> most").drop("least", "most")
    tiled = dealt(met.drop("label"), "token", F.lit(True)).join(known.drop("n"), "row")
    return in_tiles(tiled, "token", "bits", possible)


def exact_links(docs: DataFrame, light: DataFrame, labels: DataFrame) -> DataFrame:
    """Stars of linked rows inside each component of possible links."""
    members = common.store(labels.withColumnRenamed("node", "row").join(light.drop("bits"), "row"), "members")
    sieve = docs.sparkSession.sparkContext.broadcast(common.BitTable.of(members, "key"))

    def scan(batches):
        table = sieve.value
        for batch in batches:
            batch = batch.filter(pa.array(table.has(batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["key", "hashes"])

    # a member's row stands for all rows of its key: copies are one class
    sets = keyed(docs).select("key", "text").mapInArrow(scan, "key long, hashes binary").dropDuplicates(["key"])
    sizes = members.groupBy("label").agg(F.count("*").alias("members"))
    tiled = dealt(members.join(sizes, "label"), "label", F.col("members") > SLICE).drop("members")
    return in_tiles(tiled.join(sets, "key"), "label", "hashes", certain)


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, key, row, n and component_id (smallest linked doc_id) of every
    row, and ``keeper``: the component's first row."""
    rows = common.store(signatures(docs), "signatures")
    full = rows.where("n > 0")
    classes = common.store(full.groupBy("d1", "d2").agg(F.min("row").alias("row")), "classes")
    light = full.select("row", "key", "n", "bits")
    tokens = common.store(shared_tokens(full, classes), "tokens")
    lowest = tokens.groupBy("row").agg(F.slice(F.array_sort(F.collect_list("token")), 1, 2).alias("tokens")).select("row", F.explode("tokens").alias("token"))
    near = common.store(possible_edges(lowest, light, None), "edges")
    far = common.store(possible_edges(tokens, light, graph.components(near)), "edges")
    labels = graph.components(exact_links(docs, light, graph.components(near.unionByName(far))))
    common.discard(tokens)
    placed = rows.select("doc_id", "key", "row", "n", "d1", "d2").join(classes.withColumnRenamed("row", "first"), ["d1", "d2"], "left")
    placed = placed.join(labels, F.col("first") == F.col("node"), "left").select("doc_id", "key", "row", "n", F.coalesce("label", "first", "row").alias("label"))
    # documents without words stand alone
    named = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    named = named.select("label", "component_id", F.col("best.row").alias("keeper_row"))
    return placed.join(named, "label").select("doc_id", "key", "row", "n", "component_id", (F.col("row") == F.col("keeper_row")).alias("keeper"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, columns as given."""
    columns = docs.columns
    keepers = linked(docs).where("keeper").select(F.col("key").alias("_kept"))
    keyed_docs = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return keyed_docs.join(keepers, F.col("_key") == F.col("_kept"), "left_semi").dropDuplicates(["_key"]).select(columns)
