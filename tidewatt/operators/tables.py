"""Operational tables: audit, deliveries, KPI log, splits.

The studied system keeps these in SQLite / JSON files behind a lock; here
they are Parquet tables in the shared checkpoint folder, written with append
or anti-join-then-append so re-runs are idempotent and survive executor loss.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.session import materialize

KEY = "series_id"


def audit_query(audit: DataFrame, user: str | None = None, action: str | None = None,
                since: int | None = None, limit: int = 500) -> DataFrame:
    """optional user / action / since filters (empty or 0 = no filter),
    newest first, limit clamped to 1..5000.  Filters push down to the scan;
    ``orderBy.limit`` plans a per-partition top-k (TakeOrderedAndProject)."""
    df = audit
    if user:
        df = df.filter(F.col("user_id") == user)
    if action:
        df = df.filter(F.col("action") == action)
    if since:
        df = df.filter(F.col("ts") >= since)
    n = max(1, min(int(limit), 5000))
    return df.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


def append_audit(rows: DataFrame, path: str) -> None:
    """insert-only audit log (append mode, never overwrite)."""
    rows.write.mode("append").parquet(path)


def latest_window(df: DataFrame, target: str, n: int = 192, min_rows: int = 96,
                  key: str = KEY, ts: str = "ts") -> DataFrame:
    """the last ``n`` rows with a target per series; series with fewer
    than ``min_rows`` such rows are left out (the API refuses them)."""
    d = df.filter(F.col(target).isNotNull())
    w = Window.partitionBy(key).orderBy(F.col(ts).desc())
    d = d.withColumn("_rk", F.row_number().over(w)) \
         .withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return d.filter((F.col("_rk") <= n) & (F.col("_cnt") >= min_rows)).drop("_rk", "_cnt")


def worst_days(daily: DataFrame, n: int = 5, metric: str = "capture_ratio", order: str = "date") -> DataFrame:
    """the n lowest-capture days (a top-k report; ties by date)."""
    return daily.orderBy(F.col(metric).asc(), F.col(order).asc()).limit(n)


#: Joined rows that one task holds, as long as the dealt table is no larger.
TASK_ROWS = 2_000_000


def deal(many: DataFrame, each: DataFrame, keys: list[str], by: str, distinct: bool = False) -> DataFrame:
    """Inner join of ``many`` (assets, subscriptions) with ``each`` (the rows of
    their zone, the events they list) where a few ``keys`` have most rows of
    both: joined on the keys alone, a key would be one task.

    Rows of ``many`` (``distinct``: each once) are dealt by ``by`` to as many
    parts as the joined rows need at TASK_ROWS a part, and every part gets a
    copy of ``each`` (a part has at least four times the rows of ``each``, so
    that copies stay a small share of the result).  All rows of a ``by`` stay
    in one task: windows and groups on ``by`` and ``_part`` move nothing.
    Both tables are read once more for their sizes."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    sizes = count(each, "_each").join(count(many, "_many"), keys, "left")
    rows, copy = sizes.agg(F.sum(F.col("_each") * F.col("_many")), F.sum("_each")).first()
    n = max(2 * many.sparkSession.sparkContext.defaultParallelism, -(-(rows or 0) // max(TASK_ROWS, 4 * (copy or 0))))
    dealt = many.withColumn("_part", F.pmod(F.hash(by), F.lit(n))).repartitionById(n, "_part")
    copies = each.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartitionById(n, "_part")
    return (dealt.distinct() if distinct else dealt).join(copies, ["_part", *keys])


def fanout_subscriptions(events: DataFrame, subs: DataFrame, event_col: str = "event",
                         owner_col: str = "owner") -> DataFrame:
    """one delivery row per (event, active subscription that lists it):
    the owner's subscriptions where the event names an owner, everybody's
    where its owner is NULL.  Subscriptions are exploded to one row per listed
    event; named owners meet on (event, owner), and only the ownerless events
    on the event alone.  An event has few owners, so that subscriptions are
    dealt to tasks by their id.  The signing key is derived from the stored
    hash (sha256 hex)."""
    s = (subs.filter(F.col("disabled") == 0)
         .select(F.explode(F.split("events", ",")).alias(event_col), F.col("owner").alias(owner_col),
                 F.col("id").alias("subscription_id"), "url", F.sha2("secret_hash", 256).alias("signing_key")))
    events = materialize(events)
    named = deal(s, events.filter(F.col(owner_col).isNotNull()), [event_col, owner_col], "subscription_id", distinct=True)
    open_ = deal(s.withColumnRenamed(owner_col, "_owner"), events.filter(F.col(owner_col).isNull()), [event_col], "subscription_id", distinct=True)
    return named.unionByName(open_.drop("_owner")).select(*events.columns, "subscription_id", "url", "signing_key")


def last_delivery_status(deliveries: DataFrame, key: str = "subscription_id",
                         ts: str = "delivered_at") -> DataFrame:
    """latest delivery time, status and error per subscription
    (``max_by`` of a struct: one partial aggregate, no sort)."""
    rec = F.struct(F.col(ts).alias("t"), F.col("status").alias("s"), F.col("error").alias("e"))
    g = deliveries.groupBy(key).agg(F.max_by(rec, F.col(ts)).alias("r"))
    return g.select(key, F.col("r.t").alias("last_delivered_at"), F.col("r.s").alias("last_status"),
                    F.col("r.e").alias("last_error"))


def union_folds(parts: list[DataFrame]) -> DataFrame:
    """concatenate per-fold results by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def complete_training_rows(df: DataFrame, drop_last: int = 48, key: str = KEY, ts: str = "ts") -> DataFrame:
    """F8: rows with no NULL in any column, minus the last ``drop_last`` per
    series; a series left empty by the cut falls back to all its complete
    rows."""
    c = df.dropna()
    w = Window.partitionBy(key).orderBy(F.col(ts).desc())
    c = c.withColumn("_rk", F.row_number().over(w)) \
         .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return c.filter((F.col("_rk") > drop_last) | (F.col("_n") <= drop_last)).drop("_rk", "_n")


def append_once(log: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Add only rows whose key is not logged yet (left anti join)."""
    new = incoming.join(log.select(*key), key, "left_anti")
    return log.unionByName(new)


def walkforward_folds(frame: DataFrame, test_days: int = 16, week_days: int = 7, n_folds: int = 3,
                      valid_days: int = 7, min_rows: int = 96, key: str = KEY, ts: str = "ts") -> DataFrame:
    """K2: fold table per series -- ``n_folds`` weeks from ``end - test_days``,
    the last trimmed to ``end + 1 s``, folds under a day dropped -- and the
    train / valid / week row counts of each (range join on the small fold
    table, then a partial aggregate).  Folds with < ``min_rows`` week rows
    are dropped."""
    ends = frame.groupBy(key).agg(F.max(ts).alias("_end"))
    folds = ends.select(key, "_end", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    start = F.col("_end") - F.expr(f"INTERVAL {test_days} DAYS") + F.col("fold") * F.expr(f"INTERVAL {week_days} DAYS")
    folds = folds.withColumn("fold_start", start)
    fend = F.least(F.col("fold_start") + F.expr(f"INTERVAL {week_days} DAYS"),
                   F.col("_end") + F.expr("INTERVAL 1 SECOND"))
    folds = folds.withColumn("fold_end", fend).filter(
        F.col("fold_end") >= F.col("fold_start") + F.expr("INTERVAL 1 DAYS")).drop("_end")
    j = frame.select(key, ts).join(folds, key)
    role = (F.when(F.col(ts) < F.col("fold_start") - F.expr(f"INTERVAL {valid_days} DAYS"), "train")
            .when(F.col(ts) < F.col("fold_start"), "valid")
            .when(F.col(ts) < F.col("fold_end"), "week"))
    j = j.withColumn("role", role)
    g = j.groupBy(key, "fold", "fold_start", "fold_end").agg(
        F.count_if(F.col(ts) < F.col("fold_start")).alias("n_train_pool"),
        F.count_if(F.col("role") == "valid").alias("n_valid"),
        F.count_if(F.col("role") == "week").alias("n_week"))
    return g.filter(F.col("n_week") >= min_rows)


def rolling_origin_folds(frame: DataFrame, n_folds: int = 3, test_days: int = 3, valid_days: int = 3,
                         min_train: int = 1000, min_test: int = 50, min_valid: int = 50,
                         key: str = KEY, ts: str = "ts") -> DataFrame:
    """K3: disjoint test windows walking back from the end; a fold needs
    ``min_train`` / ``min_test`` / ``min_valid`` rows."""
    ends = frame.groupBy(key).agg(F.max(ts).alias("_end"))
    folds = ends.select(key, "_end", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    folds = folds.withColumn("test_end", F.col("_end") - F.col("fold") * F.expr(f"INTERVAL {test_days} DAYS")) \
                 .withColumn("test_start", F.col("test_end") - F.expr(f"INTERVAL {test_days} DAYS")) \
                 .withColumn("valid_start", F.col("test_start") - F.expr(f"INTERVAL {valid_days} DAYS")).drop("_end")
    j = frame.select(key, ts).join(folds, key)
    t = F.col(ts)
    g = j.groupBy(key, "fold", "test_start", "test_end").agg(
        F.count_if(t < F.col("valid_start")).alias("n_train"),
        F.count_if((t >= F.col("valid_start")) & (t < F.col("test_start"))).alias("n_valid"),
        F.count_if((t >= F.col("test_start")) & (t < F.col("test_end"))).alias("n_test"))
    return g.filter((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test) &
                    (F.col("n_valid") >= min_valid))


def time_split_col(ts: Column | str, end: Column, valid_days: int, test_days: int) -> Column:
    t = F.col(ts) if isinstance(ts, str) else ts
    test_start = end - F.expr(f"INTERVAL {test_days} DAYS")
    valid_start = test_start - F.expr(f"INTERVAL {valid_days} DAYS")
    return F.when(t >= test_start, "test").when(t >= valid_start, "valid").otherwise("train")
