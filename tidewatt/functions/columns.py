"""Null-safe scalar column helpers shared by every operator.

All of these stay inside Catalyst (whole-stage codegen); none is a UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """``num / nullif(den, 0)``: NULL for a zero or NULL denominator (ANSI-safe)."""
    return col_(num) / F.nullif(col_(den), F.lit(0.0))


def nullable_sum(*cols) -> Column:
    """Row sum that skips NULLs and is NULL only when every input is NULL
    (pandas ``sum(axis=1, min_count=1)``)."""
    cs = [col_(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs])
    any_present = reduce(lambda a, b: a | b, [c.isNotNull() for c in cs])
    return F.when(any_present, total)


def zero_filled_sum(*cols) -> Column:
    """Row sum with NULL read as 0 (pandas ``fillna(0)`` then ``+``)."""
    return reduce(lambda a, b: a + b, [F.coalesce(col_(c), F.lit(0.0)) for c in cols])


def clip(c, lo=None, hi=None) -> Column:
    """pandas ``clip``: bounds the value, NULL stays NULL (Spark's
    ``greatest``/``least`` would skip the NULL and return the bound)."""
    src = col_(c)
    out = src
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(src.isNotNull(), out)


def nan_to_null(c) -> Column:
    """pandas NaN means missing; convert once at ingest so NaN never reaches
    aggregates or comparisons (Spark orders NaN above every number)."""
    c = col_(c)
    return F.when(~F.isnan(c), c)


def row_mean(*cols) -> Column:
    """Mean across columns, skipping NULLs (pandas ``mean(axis=1)``)."""
    arr = F.filter(F.array(*[col_(c).cast(DoubleType()) for c in cols]), lambda x: x.isNotNull())
    n = F.size(arr)
    s = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n > 0, s / n)


def row_std(*cols) -> Column:
    """Sample std across columns, skipping NULLs; NULL below two values
    (pandas ``std(axis=1)``, ddof=1)."""
    arr = F.filter(F.array(*[col_(c).cast(DoubleType()) for c in cols]), lambda x: x.isNotNull())
    n = F.size(arr)
    mean = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / n
    ss = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(ss / (n - 1)))


def round_half_up(c, places: int) -> Column:
    """``F.round``, which goes through the decimal text of every value, only
    where that decides: below a million and clear of a tie, the nearest whole
    number of units over the scale is the same double."""
    src, scale = col_(c), F.lit(float(10 ** places))
    units = F.rint(src * scale)
    clear = (F.abs(src) < 1e6) & (F.abs(src * scale - units) < 0.499)
    return F.when(clear, units / scale).otherwise(F.round(src, places)) if 0 <= places <= 6 else F.round(src, places)


def round_doubles(df, places: int = 6, money: list[str] = (), money_places: int = 4):
    """Round every DOUBLE column (report formatting, C25); ``money`` columns
    (large totals) to ``money_places``."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, DoubleType):
            pl = money_places if f.name in money else places
            out.append((round_half_up(f.name, pl) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def to_ntz(c) -> Column:
    return col_(c).cast("timestamp_ntz")
