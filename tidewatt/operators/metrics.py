"""Aggregations and KPI operators.

All of them are ``groupBy`` aggregates (partial + final, map-side combine),
so a hot key costs one partial row per input partition, never a hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.functions.columns import col_

KEY = "series_id"
# Naive peak-shaving bands (local hours, [start, end)).
NAIVE_CHARGE_HOURS = (2, 6)
NAIVE_DISCHARGE_HOURS = (18, 22)
SPREAD_PCT_GRID = [0, 5, 10, 15, 20, 25, 30, 40]


def null_ratios(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """E1 (step 1): share of NULLs per column in one pass, long form."""
    cols = cols or df.columns
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, null_ratio)")


def null_ratio_prune(df: DataFrame, max_ratio: float = 0.70, keep: list[str] = ()) -> DataFrame:
    """Drop columns with more than ``max_ratio`` NULLs.  The schema is
    data-dependent, so this is a two-step job: one aggregate row is read on
    the driver (one value per column, never data rows)."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    drop = [c for c in df.columns if c not in keep and row[c] is not None and row[c] > max_ratio]
    return df.drop(*drop)


def daily_spread_mean(df: DataFrame, lo="q05", hi="q95", key=KEY, day="day") -> DataFrame:
    """mean(q_hi - q_lo) per series-day."""
    return df.groupBy(key, day).agg(F.avg(col_(hi) - col_(lo)).alias("spread_mean"))


def spread_thresholds(daily: DataFrame, col="spread_mean", key=KEY, low=0.33, high=0.66) -> DataFrame:
    """The 33 / 66 % (linear) quantiles of daily spreads per series."""
    return daily.groupBy(key).agg(F.percentile(col, low).alias("thr_low"),
                                  F.percentile(col, high).alias("thr_high"))


def point_aggs(actual: str, pred: str) -> list[Column]:
    """E4 partial aggregates (finish with ``point_finish``)."""
    err = col_(actual) - col_(pred)
    return [F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
            F.sum(err * err).alias("_sse"), (F.var_pop(actual) * F.count(actual)).alias("_sst"),
            F.avg(actual).alias("mean_actual"), F.count(F.lit(1)).alias("n")]


def point_finish(g: DataFrame) -> DataFrame:
    return g.withColumn("r2", F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_sse") / F.col("_sst"))) \
            .drop("_sse", "_sst")


def point_metrics(df: DataFrame, actual: str, pred: str, by: list[str]) -> DataFrame:
    """MAE, RMSE, R^2, mean actual, n (R^2 NULL on a flat actual)."""
    return point_finish(df.groupBy(*by).agg(*point_aggs(actual, pred)))


def pinball(actual, pred, alpha: float) -> Column:
    """E5 per row: max(alpha*d, (alpha-1)*d), d = actual - pred."""
    d = col_(actual) - col_(pred)
    return F.greatest(F.lit(alpha) * d, F.lit(alpha - 1.0) * d)


def interval_metrics(df: DataFrame, actual: str, by: list[str], lo="q05", mid="q50", hi="q95") -> DataFrame:
    """E5 + E6: pinball losses and coverage below / inside / above, mean spread."""
    a = col_(actual)
    return df.groupBy(*by).agg(
        F.avg(pinball(a, lo, 0.05)).alias("pinball_q05"),
        F.avg(pinball(a, mid, 0.50)).alias("pinball_q50"),
        F.avg(pinball(a, hi, 0.95)).alias("pinball_q95"),
        F.avg((a < col_(lo)).cast("double")).alias("coverage_below"),
        F.avg(((a >= col_(lo)) & (a <= col_(hi))).cast("double")).alias("coverage_inside"),
        F.avg((a > col_(hi)).cast("double")).alias("coverage_above"),
        F.avg(col_(hi) - col_(lo)).alias("mean_spread"))


def capture_ratio(realized, perfect) -> Column:
    """Realized / perfect, 0 when perfect <= 0."""
    return F.when(col_(perfect) > 0, col_(realized) / col_(perfect)).otherwise(F.lit(0.0))


def capture_summary(daily: DataFrame, by: list[str] = (), capture="capture_ratio",
                    realized="realized_eur", perfect="perfect_eur") -> DataFrame:
    """Distribution of daily capture plus totals, per group
    (no group = one summary row)."""
    aggs = [
        F.count(F.lit(1)).alias("total_days"),
        F.avg(capture).alias("mean_capture"),
        F.median(capture).alias("median_capture"),
        F.min(capture).alias("min_capture"),
        F.max(capture).alias("max_capture"),
        F.percentile(capture, 0.10).alias("p10_capture"),
        F.percentile(capture, 0.90).alias("p90_capture"),
        F.stddev_samp(capture).alias("std_capture"),
        F.sum(perfect).alias("total_perfect_eur"),
        F.sum(realized).alias("total_realized_eur"),
        (F.sum(realized) / F.greatest(F.sum(perfect), F.lit(1e-9))).alias("overall_capture"),
        F.avg(realized).alias("mean_eur_per_day"),
    ]
    return daily.groupBy(*by).agg(*aggs) if by else daily.agg(*aggs)


def horizon_counts(daily: DataFrame, col="horizon_days", key=KEY) -> DataFrame:
    """Value counts of the chosen horizon as a MAP<INT, BIGINT> per key."""
    c = daily.groupBy(key, col).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(key).agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct(F.col(col).cast("int"), F.col("n"))))).alias("horizon_counts"))


def best_by(df: DataFrame, metric: str, by: list[str], tie: list[str]) -> DataFrame:
    """The row with the highest ``metric`` per group; ties keep the first
    grid value (smallest ``tie``).  A top-1 per group via row_number."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc(), *[F.col(t).asc() for t in tie])
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def naive_schedule(df: DataFrame, hour="hour", power="power_mw") -> DataFrame:
    """E12 (rows): full-power charge 02-06 h, discharge 18-22 h (local)."""
    c0, c1 = NAIVE_CHARGE_HOURS
    d0, d1 = NAIVE_DISCHARGE_HOURS
    h = col_(hour)
    return df.withColumns({"n_charge_mw": F.when((h >= c0) & (h < c1), col_(power)).otherwise(F.lit(0.0)),
                           "n_discharge_mw": F.when((h >= d0) & (h < d1), col_(power)).otherwise(F.lit(0.0))})


def naive_aggs(price: str, delta_h: float = 0.25) -> list[Column]:
    """E12 partial sums (expects the naive_schedule columns and the asset spec)."""
    return [
        F.sum((F.col("n_discharge_mw") - F.col("n_charge_mw")) * F.col(price) * delta_h).alias("_rev"),
        F.sum((F.col("n_charge_mw") + F.col("n_discharge_mw")) * delta_h).alias("_thr"),
        F.sum(F.col("n_discharge_mw") * delta_h).alias("_dis"),
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("_days"),
        F.first("energy_mwh").alias("_e"), F.first(F.col("soc_max_frac") - F.col("soc_min_frac")).alias("_w"),
        F.first("max_cycles_per_day").alias("_cyc"), F.first("degradation_eur_per_mwh").alias("_deg"),
        F.first(F.col("eta_charge") * F.col("eta_discharge")).alias("_rte")]


def naive_finish(g: DataFrame) -> DataFrame:
    """E12 final columns from ``naive_aggs``: legs scaled to the cycle budget,
    round-trip efficiency charged on positive revenue."""
    cap = F.col("_e") * F.col("_w") * F.col("_cyc") * F.col("_days")
    scale = F.when((F.col("_thr") > cap) & (F.col("_thr") > 0), cap / F.col("_thr")).otherwise(F.lit(1.0))
    rev = F.col("_rev") * scale
    gross = F.when(rev > 0, rev * F.col("_rte")).otherwise(rev)
    deg = F.col("_deg") * F.col("_thr") * scale
    return g.withColumns({"naive_net_eur": gross - deg, "naive_gross_eur": gross, "naive_degradation_eur": deg,
                          "naive_cycles": F.col("_dis") * scale / F.col("_e")}) \
            .drop("_rev", "_thr", "_dis", "_days", "_e", "_w", "_cyc", "_deg", "_rte")


def naive_baseline(df: DataFrame, price: str, by: list[str], delta_h: float = 0.25) -> DataFrame:
    """Revenue of the naive peak-shaving plan per group, legs scaled down
    uniformly to the cycle budget ``energy x (soc_max - soc_min) x cycles x
    days``; the round-trip efficiency is charged on positive revenue.

    Expects asset columns power_mw, energy_mwh, eta_charge, eta_discharge,
    soc_min_frac, soc_max_frac, max_cycles_per_day, degradation_eur_per_mwh
    and a ``day`` column."""
    s = naive_schedule(df.withColumn("hour", F.hour("ts")))
    return naive_finish(s.groupBy(*by).agg(*naive_aggs(price, delta_h)))


def realized_revenue(schedule: DataFrame, prices: DataFrame | None, on: list[str], by: list[str],
                     price="price", delta_h: float = 0.25, extra: list[Column] = ()) -> DataFrame:
    """Schedule x realised prices - degradation, per group (``prices``
    None when the schedule already carries the realised price; ``extra``
    aggregates ride in the same pass)."""
    j = schedule if prices is None else schedule.join(prices, on, "left")
    net = F.col("discharge_mw") - F.col("charge_mw")
    return j.groupBy(*by).agg(
        F.sum(F.col(price) * net * delta_h).alias("realized_gross_eur"),
        F.sum(F.col("degradation_eur_per_mwh") * (F.col("charge_mw") + F.col("discharge_mw")) * delta_h)
        .alias("realized_degradation_eur"), *extra) \
        .withColumn("realized_eur", F.col("realized_gross_eur") - F.col("realized_degradation_eur"))


def revenue_per_mwh_aggs(price: str, delta_h: float = 0.25) -> list[Column]:
    """E15 parts: |net| energy traded and gross at ``price`` (divide after)."""
    net = F.col("discharge_mw") - F.col("charge_mw")
    return [F.sum(F.abs(net) * delta_h).alias("abs_net_mwh"),
            F.sum(F.col(price) * net * delta_h).alias("_gross_fc")]


def dispatch_kpis(schedule: DataFrame, by: list[str], price="price", delta_h: float = 0.25) -> DataFrame:
    """E11 + E15: gross, degradation, net, cycles, throughput, idle count,
    daily and annualised values, revenue per MWh traded."""
    net = F.col("discharge_mw") - F.col("charge_mw")
    thr = (F.col("charge_mw") + F.col("discharge_mw")) * delta_h
    g = schedule.groupBy(*by).agg(
        F.sum(F.col(price) * net * delta_h).alias("gross_revenue_eur"),
        F.sum(F.col("degradation_eur_per_mwh") * thr).alias("degradation_eur"),
        F.sum(F.col("discharge_mw") * delta_h / F.col("energy_mwh")).alias("cycles_used"),
        F.sum(thr).alias("energy_traded_mwh"),
        F.sum(F.abs(net) * delta_h).alias("abs_net_mwh"),
        F.sum(F.coalesce(F.col("is_idle"), F.lit(False)).cast("int")).alias("idle_count"),
        F.count(F.lit(1)).alias("total_mtus"))
    days = F.col("total_mtus") * delta_h / 24.0
    return (g.withColumn("net_profit_eur", F.col("gross_revenue_eur") - F.col("degradation_eur"))
            .withColumn("daily_profit_eur", F.col("net_profit_eur") / days)
            .withColumn("annualized_revenue_eur", F.col("daily_profit_eur") * 365.0)
            .withColumn("revenue_per_mwh", F.col("gross_revenue_eur") / F.nullif(F.col("abs_net_mwh"), F.lit(0.0))))


def uplift(kpis: DataFrame, naive: DataFrame, on: list[str]) -> DataFrame:
    """E11 (customer view): daily uplift over the naive plan and the ratio."""
    j = kpis.join(naive, on, "left")
    days = F.col("total_mtus") * 0.25 / 24.0
    naive_daily = F.col("naive_net_eur") / days
    return (j.withColumn("naive_daily_eur", naive_daily)
            .withColumn("uplift_eur_day", F.col("daily_profit_eur") - naive_daily)
            .withColumn("annualized_uplift_eur", (F.col("daily_profit_eur") - naive_daily) * 365.0)
            .withColumn("capture_vs_naive", F.when(F.col("naive_net_eur") > 1e-6,
                                                   F.col("net_profit_eur") / F.col("naive_net_eur"))))


def feed_health(df: DataFrame, feeds: dict[str, list[str]], key=KEY, ts="ts", source: str = "cache") -> DataFrame:
    """Per feed, rows where any of its columns is non-null, the columns
    available, a status and the latest observation -- one pass."""
    rows = []
    for name, cols in feeds.items():
        avail = sorted(c for c in cols if c in df.columns)
        any_nn = F.coalesce(*[F.col(c).cast("double") for c in avail]).isNotNull() if avail else F.lit(False)
        rows.append((name, avail, any_nn))
    aggs = [F.count_if(nn).alias(f"_n{i}") for i, (_, _, nn) in enumerate(rows)]
    g = df.groupBy(key).agg(F.max(ts).alias("last_observation"), *aggs)
    status_word = {"live": "Live", "cache": "Cached"}.get(source, "Demo")
    # one aggregate pass, then one row per feed by exploding an array of structs
    per_feed = F.array(*[F.struct(F.lit(name).alias("feed"), F.col(f"_n{i}").alias("rows"),
                                  F.lit(",".join(avail)).alias("columns"))
                         for i, (name, avail, _) in enumerate(rows)])
    out = g.select(key, "last_observation", F.explode(per_feed).alias("f")).select(
        key, "f.feed", F.when(F.col("f.rows") > 0, F.lit(status_word)).otherwise(F.lit("Unavailable")).alias("status"),
        "f.rows", "f.columns", "last_observation")
    return out


def monthly_metering(calls: DataFrame, key_tiers: DataFrame, tiers: DataFrame,
                     key="key_id", ts="ts") -> DataFrame:
    """Calls per key and calendar month (UTC), quota use, tier gates and
    the metered charge.  Tiers (4 rows, fixed) are broadcast."""
    month = F.date_format(col_(ts), "yyyy-MM")
    c = calls.groupBy(key, month.alias("period")).agg(F.count(F.lit(1)).alias("monthly_calls"))
    t = F.broadcast(tiers.withColumnRenamed("name", "tier"))
    j = c.join(key_tiers, key, "left").withColumn("tier", F.coalesce("tier", F.lit("free"))).join(t, "tier")
    quota_pct = F.when(F.col("monthly_call_quota") > 0,
                       F.col("monthly_calls") * 100.0 / F.col("monthly_call_quota"))
    return j.select(key, "period", "tier", "monthly_calls", "monthly_call_quota",
                    quota_pct.alias("quota_used_pct"),
                    ((F.col("monthly_call_quota") > 0) & (F.col("monthly_calls") > F.col("monthly_call_quota")))
                    .alias("over_quota"),
                    "can_use_optimize", "can_use_webhooks",
                    (F.col("price_eur_month") + F.col("monthly_calls") * F.col("payg_price_eur_cents") / 100.0)
                    .alias("amount_eur"))


def mean_ensemble(scored: list[DataFrame], on: list[str], pred="prediction", out="prediction") -> DataFrame:
    """Mean prediction across members (union + groupBy, no driver loop)."""
    u = scored[0].select(*on, pred)
    for s in scored[1:]:
        u = u.unionByName(s.select(*on, pred))
    return u.groupBy(*on).agg(F.avg(pred).alias(out))
