"""Grid alignment and joins.

Design for scale: raw observations are first reduced to at most one row per
(series, slot) with a partial (map-side) aggregate, so a series that holds a
third of all raw rows still produces only ``span / 15 min`` rows; the windows
that follow are partitioned by ``series_id`` and bounded by the time span,
not by the raw volume.  Joins are equi-joins on ``(series_id, ts)`` so they
hash on both columns and never pile one series onto one reducer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.functions.columns import col_
from tidewatt.session import MTU_MINUTES

KEY = "series_id"


def floor_slot(ts, minutes: int = MTU_MINUTES) -> Column:
    """Start of the slot containing ``ts`` (keeps TIMESTAMP_NTZ)."""
    return F.window(col_(ts), f"{minutes} minutes").start


def ceil_slot(ts, minutes: int = MTU_MINUTES) -> Column:
    """First slot start at or after ``ts``."""
    fl = floor_slot(ts, minutes)
    return F.when(fl == col_(ts), fl).otherwise(fl + F.expr(f"INTERVAL {minutes} MINUTES"))


def slot_aggregate(df: DataFrame, value_cols: dict[str, Column], key: str = KEY,
                   ts: str = "ts", minutes: int = MTU_MINUTES) -> DataFrame:
    """H2 batch twin: tumbling-slot aggregates per series (partial agg first)."""
    return (df.groupBy(F.col(key), floor_slot(ts, minutes).alias("ts"))
            .agg(*[c.alias(n) for n, c in value_cols.items()]))


def resample_grid(df: DataFrame, key: str = KEY, ts: str = "ts",
                  minutes: int = MTU_MINUTES) -> DataFrame:
    """B1: the regular grid ``floor(min ts) .. floor(max ts)`` per series.

    Only ``(series, min, max)`` crosses the shuffle; the explode runs where
    the bounds land, so no group is ever collected."""
    bounds = df.groupBy(key).agg(F.min(floor_slot(ts, minutes)).alias("_lo"),
                                 F.max(floor_slot(ts, minutes)).alias("_hi"))
    return bounds.select(
        F.col(key),
        F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {minutes} MINUTES"))).alias(ts))


def grid_from_rows(df: DataFrame, cols: list[str], key: str = KEY, ts: str = "ts",
                   minutes: int = MTU_MINUTES) -> DataFrame:
    """B1 in one pass for on-grid rows (e.g. slot aggregates, unique per
    (series, ts)): each row is followed by the empty slots up to the next row
    (``lead`` + ``posexplode``).  Same grid as ``resample_grid`` + left join,
    without the bounds aggregate, the second scan and the join; the output
    stays partitioned by series for the windows that follow."""
    w = Window.partitionBy(key).orderBy(ts)
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    d = df.withColumn("_next", F.lead(ts).over(w))
    seq = F.sequence(F.col(ts), F.coalesce(F.col("_next") - step, F.col(ts)), step)
    ex = d.select(key, *cols, F.posexplode(seq).alias("_i", "_g"))
    return ex.select(key, F.col("_g").alias(ts),
                     *[F.when(F.col("_i") == 0, F.col(c)).alias(c) for c in cols],
                     (F.col("_i") == 0).alias("_present"))


def ffill_on_grid(df: DataFrame, cols: list[str], key: str = KEY, ts: str = "ts") -> DataFrame:
    """B2 for on-grid data already on the grid (``_present`` marks source
    rows): the values of the latest present row; a NULL inside that row
    stays NULL (struct trick)."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    row = F.last(F.when(F.col("_present"), F.struct(*[F.col(c) for c in cols])), ignorenulls=True).over(w)
    out = df.withColumn("_row", row)
    return out.withColumns({c: F.col("_row")[c] for c in cols}).drop("_row")


def reindex_on_grid(df: DataFrame, grid: DataFrame | None = None, key: str = KEY,
                    ts: str = "ts", minutes: int = MTU_MINUTES) -> DataFrame:
    """B1 + B4: rows exactly on the grid survive, off-grid points drop out;
    ``_present`` marks grid slots that had a source row."""
    if grid is None:
        grid = resample_grid(df, key, ts, minutes)
    return grid.join(df.withColumn("_present", F.lit(True)), [key, ts], "left") \
               .withColumn("_present", F.coalesce("_present", F.lit(False)))


def asof_ffill(grid: DataFrame, data: DataFrame, cols: list[str], key: str = KEY,
               ts: str = "ts", minutes: int = MTU_MINUTES) -> DataFrame:
    """B2: for each grid time, the values of the latest *row* at or before it.

    A NULL inside that row stays NULL (struct trick: ``last(struct,
    ignorenulls)`` skips only rows that do not exist).  Raw rows are reduced
    to the latest row per (series, ceil-slot) with ``max_by`` -- a partial
    aggregate -- so off-grid points still count and the window sees at most
    one data row per slot."""
    packed = F.struct(*[F.col(c) for c in cols])
    reduced = (data.groupBy(F.col(key), ceil_slot(ts, minutes).alias(ts))
               .agg(F.max_by(packed, F.col(ts)).alias("_row")))
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(reduced, [key, ts], "left")
    filled = joined.withColumn("_row", F.last("_row", ignorenulls=True).over(w))
    return filled.select(*[c for c in grid.columns],
                         *[F.col("_row")[c].alias(c) for c in cols])


def interpolate_time(df: DataFrame, cols: list[str], limit: int = 4, key: str = KEY,
                     ts: str = "ts", minutes: int = MTU_MINUTES, ffill: list[str] = ()) -> DataFrame:
    """Linear-in-time interpolation of gaps on the regular grid, at most
    ``limit`` slots per gap (the first ``limit`` of a longer gap), leading
    gaps stay NULL, a trailing gap repeats the last value at most ``limit``
    times.  ``ffill`` columns get B2's as-of fill (needs ``_present``) in the
    same pass.

    Two running-frame Window execs (ascending and descending order) find the
    previous / next valid point of every column -- O(n) per series; the gap
    ordinal is counted in grid steps, so no row numbering is needed."""
    w_prev = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    # "next valid" as a running frame over the reversed order (an UNBOUNDED
    # FOLLOWING frame would re-aggregate per row, O(n^2))
    w_next = Window.partitionBy(key).orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)
    secs = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    base_cols = [c for c in df.columns if c != "_secs"]
    sel = [F.col(c) for c in base_cols] + [secs.alias("_secs")]
    base = df
    for i, c in enumerate(cols):
        valid = F.col(c).isNotNull()
        sel.append(F.last(F.when(valid, F.struct(secs.alias("t"), F.col(c).alias("v"))),
                          ignorenulls=True).over(w_prev).alias(f"_p{i}"))
    if ffill:
        sel.append(F.last(F.when(F.col("_present"), F.struct(*[F.col(c) for c in ffill])),
                          ignorenulls=True).over(w_prev).alias("_row"))
    mid = base.select(*sel)
    mid = mid.select("*", *[F.last(F.when(F.col(c).isNotNull(), F.struct(F.col("_secs").alias("t"),
                                                                         F.col(c).alias("v"))),
                                   ignorenulls=True).over(w_next).alias(f"_n{i}") for i, c in enumerate(cols)])
    filled = {}
    step = minutes * 60.0
    for i, c in enumerate(cols):
        p, n = F.col(f"_p{i}"), F.col(f"_n{i}")
        k = F.round((F.col("_secs") - p["t"]) / step)
        interp = p["v"] + (n["v"] - p["v"]) * (F.col("_secs") - p["t"]) / (n["t"] - p["t"])
        filled[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                     .when(p.isNull() | (k > limit), F.lit(None).cast("double"))
                     .when(n.isNull(), p["v"])
                     .otherwise(interp))
    for c in ffill:
        filled[c] = F.col("_row")[c]
    return mid.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in base_cols])


def join_sources(grid: DataFrame, sources: list[DataFrame], key: str = KEY,
                 ts: str = "ts") -> DataFrame:
    """Left-join every source onto the grid on (series, ts)."""
    return reduce(lambda acc, s: acc.join(s, [key, ts], "left"), sources, grid)


def align_full(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Side-by-side concat = full outer join on the keys."""
    return left.join(right, on, "full")


def holiday_flags(df: DataFrame, holidays: DataFrame, day: str = "day",
                  holiday_col: str = "date") -> DataFrame:
    """is_holiday / is_holiday_eve / is_holiday_after for each row's day.

    The holiday list is exploded into the three days it marks and pivoted
    once, so the fact side meets a single left join on the day."""
    h = holidays.select(F.col(holiday_col).cast("date").alias("_h")).distinct()
    marks = h.select(F.explode(F.array(
        F.struct(F.col("_h").alias("_d"), F.lit(1).alias("k")),
        F.struct(F.date_sub("_h", 1).alias("_d"), F.lit(2).alias("k")),
        F.struct(F.date_add("_h", 1).alias("_d"), F.lit(3).alias("k")))).alias("m")).select("m.*")
    flags = marks.groupBy(F.col("_d").alias(day)).agg(
        F.max((F.col("k") == 1).cast("int")).alias("is_holiday"),
        F.max((F.col("k") == 2).cast("int")).alias("is_holiday_eve"),
        F.max((F.col("k") == 3).cast("int")).alias("is_holiday_after"))
    out = df.join(flags, day, "left")
    return out.fillna(0, ["is_holiday", "is_holiday_eve", "is_holiday_after"])


def days_to_holiday(days: DataFrame, holidays: DataFrame, day: str = "day",
                    holiday_col: str = "date", cap: int = 30) -> DataFrame:
    """Days until the next holiday on or after the day, clipped 0..cap
    (cap when none follows).  Forward as-of on the small day dimension:
    union days and holidays, take the first holiday at or after each day."""
    d = days.select(F.col(day).cast("date").alias("_d"), F.lit(None).cast("date").alias("_h")).distinct()
    h = holidays.select(F.col(holiday_col).cast("date").alias("_d"), F.col(holiday_col).cast("date").alias("_h"))
    u = d.unionByName(h)
    # reversed running frame: a holiday row sorts after (in reverse: before)
    # the plain day row of the same date, so a holiday day sees itself
    w = Window.orderBy(F.col("_d").desc(), F.col("_h").isNull().asc()).rowsBetween(Window.unboundedPreceding, 0)
    nxt = u.withColumn("_next", F.last("_h", ignorenulls=True).over(w)).filter(F.col("_h").isNull())
    delta = F.datediff("_next", "_d")
    return nxt.select(F.col("_d").alias(day),
                      F.when(F.col("_next").isNull(), F.lit(cap))
                      .otherwise(F.least(F.greatest(delta, F.lit(0)), F.lit(cap))).alias("days_to_holiday"))


def reindex_values(target_keys: DataFrame, values: DataFrame, on: list[str],
                   fill: dict | None = None) -> DataFrame:
    """Align values to another key set; missing -> NULL or ``fill``."""
    out = target_keys.join(values, on, "left")
    return out.fillna(fill) if fill else out


def sub_daily_broadcast(mtus: DataFrame, daily: DataFrame, cols: list[str], key: str = KEY,
                        ts: str = "ts", day: str = "day") -> DataFrame:
    """Daily values onto every MTU of the day; a missing day carries the
    previous day's values forward (per series)."""
    j = mtus.join(daily, [key, day], "left")
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumns({c: F.last(F.col(c), ignorenulls=True).over(w) for c in cols})
