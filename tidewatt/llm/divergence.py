"""Operator 11: source divergence audit with dominance skybands.

Every language keeps the terms of at least ``least_docs`` of its documents, V of
them.  A language, and each of its (language, source) groups, gives a kept term
that occurs ``count`` times in it the share

    p = 1 + floor(1000000000 * (count + 5) / (N + 5 * V))

with N the sum of its counts over kept terms; all arithmetic is in integers.

* ``term`` rows: the ``ranks`` terms with group count > 0 whose share most
  exceeds the language's.  Within a group a term with a higher group count, a
  lower language count and an earlier UTF-8 form ranks before, so a term that
  ``ranks`` others dominate this way can't be among the first ``ranks``.  Pieces
  of a group's terms, dealt out by hash, retain their skybands; the skybands of
  adjacent pieces are merged; what is left is ranked exactly.
* ``pair`` rows: for every other source of the language the sum over all kept
  terms of the shares' absolute differences.  Two sources differ by the same
  amount on every term that neither has, so only terms that occur are added up:
  tiles of ``TILE`` x ``TILE`` sources and one piece of the terms at a time, and
  each tile passes on sums alone.

Terms are counted per task before the shuffle and dealt by (language, term), so
neither a hot source nor a frequent term meets in one task.

Defined results: null text, lang and source read as ''; a text without terms
still makes its group occur; repeated rows and null ids are documents of their
own; ties of value go to the earlier UTF-8 item; an empty table gives no rows; a
language without kept terms has pair rows of value 0 and no term rows; a group
that is its language's only source has no pair rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Letters A-Z lower-cased, a-z and all bytes of characters beyond ASCII stay; the rest parts terms.
TERM_BYTES = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
#: Distinct (group, term) counts that a task holds before it passes them on.
HELD = 150_000
#: Kept terms of a piece, pieces merged at once, and sources of a tile.
PIECE, MERGED, TILE = 8192, 16, 64


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs; several rows of a term may
    come from each task."""
    def scan(batches):
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def flush():
            for (lang, source), (seen, docs_of) in counts.items():
                terms = pa.array(list(seen), pa.binary()).view(pa.string())
                label = lambda name: pa.array([name] * len(terms), pa.string())
                yield pa.RecordBatch.from_arrays([label(lang), label(source), terms, pa.array(seen.values(), pa.int64()), pa.array([docs_of[t] for t in seen], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in common.parts(batches):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = text.as_buffer().to_pybytes().translate(TERM_BYTES).split()
                if not words:
                    continue
                seen, docs_of = counts.setdefault((lang, source), (Counter(), Counter()))
                before = len(seen)
                seen.update(words)
                docs_of.update(set(words))
                size += len(seen) - before
                if size > HELD:
                    yield from flush()
                    counts, size = {}, 0
        yield from flush()

    return docs.mapInArrow(scan, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count; decimals keep the product exact at any corpus size."""
    wide = lambda c: c.cast("decimal(38,0)")
    return 1 + F.call_function("div", wide(F.lit(1_000_000_000)) * wide(count + 5).cast("decimal(20,0)"), wide(total + 5 * terms))


def skyband(high: np.ndarray, low: np.ndarray, k: int, step: int = 512) -> np.ndarray:
    """Places of the items that fewer than ``k`` earlier items dominate, having
    ``high`` as high and ``low`` as low.  Dominance is transitive, so retained
    items alone tell whether an item has ``k`` dominators."""
    held_high, held_low, held_at = high[:0], low[:0], np.empty(0, np.int64)
    for at in range(0, len(high), step):
        h, w = high[at:at + step], low[at:at + step]
        above = ((held_high[:, None] >= h) & (held_low[:, None] <= w)).sum(0)
        above += (np.triu((h[:, None] >= h) & (w[:, None] <= w), 1)).sum(0)
        keep = above < k
        held_high, held_low = np.append(held_high, h[keep]), np.append(held_low, w[keep])
        held_at = np.append(held_at, at + np.flatnonzero(keep))
    return held_at


def retain(terms: DataFrame, piece: Column, k: int) -> DataFrame:
    """Skyband of every (lang, source, piece)."""
    def thin(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("term").cast(pa.binary())))
        return table.take(pa.array(skyband(table.column("n").to_numpy(), table.column("lang_n").to_numpy(), k)))

    dealt = terms.withColumn("piece", piece)
    return dealt.groupBy("lang", "source", "piece").applyInArrow(thin, dealt.schema)


def tile_sums(cells: DataFrame) -> DataFrame:
    """a, b (source numbers, a < b), lang and, over the terms of a piece that
    occur, the sum of the shares' differences less those of unseen terms.  Rows
    without a term name the sources of a tile and their unseen share."""
    schema = "lang string, a long, b long, more long"

    def add(table: pa.Table) -> pa.Table:
        lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "tile_a", "tile_b"))
        number, p = table.column("number").to_numpy(), table.column("p").to_numpy()
        unseen = table.column("term").is_null().to_numpy()
        base = np.zeros(2 * TILE, np.int64)
        slot = np.where(number // TILE == i, 0, TILE) + number % TILE
        base[slot[unseen]] = p[unseen]
        row = table.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        shares = np.tile(base, (int(row.max()) + 1, 1))
        shares[row[~unseen], slot[~unseen]] = p[~unseen]
        left, right = (0, TILE), (0, TILE) if i == j else (TILE, 2 * TILE)
        out: list[tuple] = []
        has = np.zeros(2 * TILE, bool)
        has[slot[unseen]] = True
        for x in range(*left):
            if has[x]:
                gaps = np.abs(shares[:, x:x + 1] - shares[:, slice(*right)]).sum(0) - len(shares) * np.abs(base[x] - base[slice(*right)])
                out += [(i * TILE + x, j * TILE + y, int(gaps[y])) for y in range(TILE) if has[right[0] + y] and (i != j or x < y)]
        a, b, more = zip(*out) if out else ((), (), ())
        return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(more, pa.int64())], ["lang", "a", "b", "more"])

    return cells.groupBy("lang", "tile_a", "tile_b", "piece").applyInArrow(add, schema)


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value."""
    named = groups.withColumn("number", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    named = common.store(named.withColumn("tiles", F.expr(f"(max(number) over (partition by lang)) div {TILE} + 1")), "divergence-groups")
    unseen = named.select("lang", "number", F.lit(None).cast("string").alias("term"), F.col("unseen").alias("p"), "tiles", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    seen = cells.join(named.select("lang", "source", "number", "tiles"), ["lang", "source"]).select("lang", "number", "term", "p", "tiles", "piece")
    own = F.expr(f"number div {TILE}")
    tiled = seen.unionByName(unseen).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiled = tiled.withColumns({"tile_a": F.least(own, "other"), "tile_b": F.greatest(own, "other")}).drop("tiles", "other")
    sums = tile_sums(tiled).groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    side = lambda name: named.select("lang", F.col("number").alias(name), F.col("source").alias(f"{name}_source"), F.col("unseen").alias(f"{name}_unseen"))
    valued = sums.join(side("a"), ["lang", "a"]).join(side("b").join(named.select("lang", "terms").distinct(), "lang"), ["lang", "b"])
    value = F.col("more") + F.col("terms") * F.abs(F.col("a_unseen") - F.col("b_unseen"))
    ends = F.array(*(F.struct(F.col(f"{x}_source").alias("source"), F.col(f"{y}_source").alias("item")) for x, y in ("ab", "ba")))
    return valued.select("lang", value.alias("value"), F.inline(ends)).select("lang", "source", "item", "value")


def audit(docs: DataFrame, least_docs: int = 30, ranks: int = 50) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    known = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = term_counts(known).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    kept = common.store(kept.where(F.col("docs") >= least_docs).drop("docs"), "divergence-terms")
    cells = kept.select("lang", "term", "lang_n", F.inline("cells"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = known.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "terms", "lang_total"]).withColumn("pieces", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / PIECE)))
    unseen = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(0)
    groups = common.store(groups.withColumn("unseen", unseen.cast("long")), "divergence-sizes")

    piece = F.pmod(F.xxhash64("term"), F.col("pieces")).cast("long")
    sized = cells.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "lang_n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
                                                          share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"), piece.alias("piece"))
    pairs = pair_values(sized.select("lang", "source", "term", "p", "piece"), groups)
    above = sized.where("p > q").select("lang", "source", "term", "n", "lang_n", (F.col("p") - F.col("q")).alias("value"), "piece")
    banded = retain(above, F.col("piece"), ranks)
    merged = retain(banded, F.expr(f"piece div {MERGED}"), ranks)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    terms = ranked(merged.select("lang", "source", F.col("term").alias("item"), "value"), "term").where(F.col("rank") <= ranks)
    return ranked(pairs, "pair").unionByName(terms)
