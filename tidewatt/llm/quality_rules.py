"""Operator 4: quality rules with adaptive thresholds.

Every document's measures go into mergeable KLL quantile sketches, one per
language and source; sketches of small groups are replaced by the merged
sketch of their language (a language that is small too has no fences).  A measure fails where it lies
beyond a fence around the group's median whose width is a multiple of the
group's own spread.  No sketch is ever rebuilt from rows: merging is enough,
so a hot source is pre-aggregated in every task.

Defined results: null and empty texts have no words and fail the base rule;
null languages and sources are groups of their own; repeated rows and null
ids give one result row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123)])
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_upper", "n_letters"]
#: measure: (smallest spread that counts, fence below the median too)
MEASURES = {"symbol_rate": (0.02, False), "dup_line_rate": (0.07, False), "repeat_rate": (0.035, False), "upper_rate": (0.04, False), "word_length": (0.8, True)}


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words that lie in a ``width``-word window found twice or more."""
    n = len(ids)
    if n <= width:
        return 0
    code = ids[:n - width + 1].astype(np.int64)
    for k in range(1, width):  # exact: runs so far are renumbered densely
        code = code * (int(ids.max()) + 1) + ids[k:n - width + 1 + k]
        code = np.unique(code, return_inverse=True)[1]
    twice = np.bincount(code)[code] > 1
    if not twice.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    raw = (text or "").encode()
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, common.BLANKS.encode()))
    chars = len(text or "") - blanks
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    upper = len(raw) - len(raw.translate(None, UPPER))
    letters = len(raw) - len(raw.translate(None, LETTERS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(ids), len(lines), upper, letters


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document."""
    def run(batches):
        for batch in batches:
            rows = [measure(t) for t in batch.column(3).to_pylist()]
            columns = list(zip(*rows)) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "lang", "source", *COUNTS])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return picked.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def rates(counted: DataFrame) -> DataFrame:
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.withColumns({
        "symbol_rate": part("n_symbols", "n_words"), "dup_line_rate": part("n_dup_lines", "n_lines"),
        "repeat_rate": part("n_repeat_words", "n_words"), "upper_rate": part("n_upper", "n_letters"),
        "word_length": part("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })


def sketch_table(rated: DataFrame, size: int) -> DataFrame:
    """One row of sketches per language and source, from the documents that
    pass the base rule."""
    return rated.where(~F.col("base_failed")).groupBy("lang", "source").agg(
        F.count("*").alias("rows"), *(F.kll_sketch_agg_double(m, F.lit(size)).alias(m) for m in MEASURES))


def thresholds(sketches: DataFrame, size: int, least_rows: int, reach: float) -> DataFrame:
    """low_* and high_* per language and source, from the group's own sketch
    or, under ``least_rows``, the merged one of its language."""
    by_lang = sketches.groupBy(F.col("lang").alias("l_lang")).agg(
        F.sum("rows").alias("l_rows"), *(F.kll_merge_agg_double(m, F.lit(size)).alias(f"l_{m}") for m in MEASURES))
    joined = sketches.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang"))).where(F.greatest("rows", "l_rows") >= least_rows)
    pick = lambda m: F.when(F.col("rows") >= least_rows, F.col(m)).otherwise(F.col(f"l_{m}"))
    out = []
    for m, (least, below) in MEASURES.items():
        q25, q50, q75 = (F.kll_sketch_get_quantile_double(pick(m), F.lit(q)) for q in (0.25, 0.5, 0.75))
        out.append((q50 + reach * F.greatest(q75 - q50, F.lit(least))).alias(f"high_{m}"))
        if below:
            out.append((q50 - reach * F.greatest(q50 - q25, F.lit(least))).alias(f"low_{m}"))
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *out)


def judge(docs: DataFrame, size: int = 4096, least_rows: int = 30, reach: float = 6.0) -> DataFrame:
    """Counts, rates, base_failed and the verdict ``kept`` of every document.

    ``size`` is the sketches' k (groups up to about that size are exact),
    ``reach`` the fence in spreads from the median."""
    rated = common.store(rates(measures(docs)), "measures")
    fences = thresholds(sketch_table(rated, size), size, least_rows, reach)
    joined = rated.join(fences, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for m, (_, below) in MEASURES.items():
        inside &= F.col(m) <= F.col(f"high_{m}")
        if below:
            inside &= F.col(m) >= F.col(f"low_{m}")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def keep(docs: DataFrame, **options) -> DataFrame:
    """The kept documents, columns as given.  Verdicts are matched by a hash
    of id and text, so repeated rows stay repeated."""
    columns = docs.columns
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text", "lang", "source"))
    verdicts = judge(keyed.drop("doc_id").withColumnRenamed("_key", "doc_id"), **options)
    kept = verdicts.where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return keyed.join(kept, F.col("_key") == F.col("_kept"), "left_semi").select(columns)
