"""Registered queries: metrics, weights, ranks, splits, operational tables
(E4-E10, E14, E16, E17, E19, D7-D16, M5, K1-K3, F1-F8, A1, A4, A9, A10, A13, C24, C25, flagship)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatt.functions import composites as cp
from tidewatt.functions.columns import round_doubles
from tidewatt.operators import metrics, tables, walkforward, windows
from tidewatt.operators import forecast as fc_ops
from tidewatt.plans import fixtures as fx
from tidewatt.plans.sqlutil import oracle
from tidewatt.session import scratch_path
from tidewatt.sources import feeds

Q, SQL = {}, {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


DEFAULT_SPEC = [("power_mw", 50.0), ("energy_mwh", 100.0), ("eta_charge", 0.95), ("eta_discharge", 0.95),
                ("soc_min_frac", 0.05), ("soc_max_frac", 0.95), ("max_cycles_per_day", 1.5),
                ("degradation_eur_per_mwh", 2.0)]


def with_default_spec(df):
    return df.withColumns({k: F.lit(v) for k, v in DEFAULT_SPEC})


_SQL_NAIVE_DAY = """nd AS (
  SELECT series_id, day,
    sum((CASE WHEN hour(ts) >= 18 AND hour(ts) < 22 THEN 50.0 ELSE 0.0 END
         - CASE WHEN hour(ts) >= 2 AND hour(ts) < 6 THEN 50.0 ELSE 0.0 END) * q50 * 0.25) AS rev,
    sum((CASE WHEN hour(ts) >= 18 AND hour(ts) < 22 THEN 50.0 ELSE 0.0 END
         + CASE WHEN hour(ts) >= 2 AND hour(ts) < 6 THEN 50.0 ELSE 0.0 END) * 0.25) AS thr,
    sum(CASE WHEN hour(ts) >= 18 AND hour(ts) < 22 THEN 50.0 ELSE 0.0 END * 0.25) AS dis
  FROM fc GROUP BY 1, 2),
nds AS (SELECT *, CASE WHEN thr > 135.0 AND thr > 0 THEN 135.0 / thr ELSE 1.0 END AS scale FROM nd),
naive AS (
  SELECT series_id, day,
    CASE WHEN rev * scale > 0 THEN rev * scale * 0.9025 ELSE rev * scale END - 2.0 * thr * scale AS naive_net_eur,
    dis * scale / 100.0 AS naive_cycles
  FROM nds)"""


# Flagship: per series-day forecast error of the lag-96 forecast and the naive plan on it.
@reg("FLAGSHIP_daily_forecast_and_naive", oracle([fx.SQL_FORECAST, _SQL_NAIVE_DAY, """pm AS (
  SELECT series_id, day, avg(abs(price - q50)) AS mae, sqrt(avg((price - q50) * (price - q50))) AS rmse,
    CASE WHEN var_pop(price) * count(price) > 0
         THEN 1.0 - sum((price - q50) * (price - q50)) / (var_pop(price) * count(price)) END AS r2,
    avg(price) AS mean_actual, count(*) AS n
  FROM fc GROUP BY 1, 2)"""],
     "SELECT pm.*, naive.naive_net_eur, naive.naive_cycles FROM pm JOIN naive USING (series_id, day)",
     ["mae", "rmse", "r2", "mean_actual", "naive_net_eur", "naive_cycles"]))
def flagship(spark, d):
    """Forecast errors and the naive plan per series-day in one aggregate pass."""
    f = fx.forecast_frame(spark, d).withColumns({**{k: F.lit(v) for k, v in DEFAULT_SPEC}, "hour": F.hour("ts")})
    g = metrics.naive_schedule(f).groupBy("series_id", "day").agg(
        *metrics.point_aggs("price", "q50"), *metrics.naive_aggs("q50"))
    out = metrics.naive_finish(metrics.point_finish(g)).drop("naive_gross_eur", "naive_degradation_eur")
    return round_doubles(out)


# E4 per series.
@reg("E4_point_metrics", oracle([fx.SQL_FORECAST], """
SELECT series_id, avg(abs(price - q50)) AS mae, sqrt(avg((price - q50) * (price - q50))) AS rmse,
  CASE WHEN var_pop(price) * count(price) > 0
       THEN 1.0 - sum((price - q50) * (price - q50)) / (var_pop(price) * count(price)) END AS r2,
  avg(price) AS mean_actual, count(*) AS n
FROM fc GROUP BY 1""", ["mae", "rmse", "r2", "mean_actual"]))
def e4(spark, d):
    return round_doubles(metrics.point_metrics(fx.forecast_frame(spark, d), "price", "q50", ["series_id"]))


# E5 + E6 + D14 per series.
@reg("E5_E6_D14_interval_metrics", oracle([fx.SQL_FORECAST, """dd AS (
  SELECT *, CASE WHEN lag(price) OVER w IS NOT NULL THEN
      CAST(sign(price - lag(price) OVER w) = sign(q50 - lag(q50) OVER w) AS DOUBLE) END AS hit
  FROM fc WINDOW w AS (PARTITION BY series_id ORDER BY ts))"""], """
SELECT series_id,
  avg(greatest(0.05 * (price - q05), (0.05 - 1.0) * (price - q05))) AS pinball_q05,
  avg(greatest(0.5 * (price - q50), (0.5 - 1.0) * (price - q50))) AS pinball_q50,
  avg(greatest(0.95 * (price - q95), (0.95 - 1.0) * (price - q95))) AS pinball_q95,
  avg(CAST(price < q05 AS DOUBLE)) AS coverage_below,
  avg(CAST(price >= q05 AND price <= q95 AS DOUBLE)) AS coverage_inside,
  avg(CAST(price > q95 AS DOUBLE)) AS coverage_above,
  avg(q95 - q05) AS mean_spread, avg(hit) AS direction_accuracy
FROM dd GROUP BY 1""", ["pinball_q05", "pinball_q50", "pinball_q95", "coverage_below", "coverage_inside",
                        "coverage_above", "mean_spread", "direction_accuracy"]))
def e5(spark, d):
    f = fx.forecast_frame(spark, d).withColumn("_hit", windows.direction_hits("price", "q50"))
    im = metrics.interval_metrics(f, "price", ["series_id"])
    da = f.groupBy("series_id").agg(F.avg("_hit").alias("direction_accuracy"))
    return round_doubles(im.join(da, "series_id"))


# Daily capture table from the daily feeds: perfect = order totals of the day,
# realised = discounted line revenue of those orders (line side pre-aggregated).
SQL_CAPS = """li AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem GROUP BY 1),
cap_days AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date, sum(o.o_totalprice) AS perfect_eur, sum(coalesce(li.rev, 0)) AS realized_eur
  FROM orders o LEFT JOIN li ON li.l_orderkey = o.o_orderkey GROUP BY 1),
caps AS (SELECT *, CASE WHEN perfect_eur > 0 THEN realized_eur / perfect_eur ELSE 0.0 END AS capture_ratio
         FROM cap_days)"""


def capture_days(spark, d):
    li = fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    o = fx.table(spark, d, "orders")
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    g = j.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.sum("o_totalprice").alias("perfect_eur"), F.sum(F.coalesce("rev", F.lit(0.0))).alias("realized_eur"))
    return g.withColumn("capture_ratio", metrics.capture_ratio("realized_eur", "perfect_eur"))


_SUM_COLS = ["mean_capture", "median_capture", "min_capture", "max_capture", "p10_capture", "p90_capture",
             "std_capture", "total_perfect_eur", "total_realized_eur", "overall_capture", "mean_eur_per_day"]
_SUM_SQL = """count(*) AS total_days, avg(capture_ratio) AS mean_capture, median(capture_ratio) AS median_capture,
  min(capture_ratio) AS min_capture, max(capture_ratio) AS max_capture,
  quantile_cont(capture_ratio, 0.1) AS p10_capture, quantile_cont(capture_ratio, 0.9) AS p90_capture,
  stddev_samp(capture_ratio) AS std_capture, sum(perfect_eur) AS total_perfect_eur,
  sum(realized_eur) AS total_realized_eur, sum(realized_eur) / greatest(sum(perfect_eur), 1e-9) AS overall_capture,
  avg(realized_eur) AS mean_eur_per_day"""


_MONEY = ["total_perfect_eur", "total_realized_eur"]


@reg("E7_E14_capture_summary", oracle([SQL_CAPS], f"SELECT {_SUM_SQL} FROM caps", _SUM_COLS, _MONEY))
def e7(spark, d):
    return round_doubles(metrics.capture_summary(capture_days(spark, d)), money=_MONEY)


_SQL_FOLDS = """wk AS (SELECT *, CAST(floor(datediff('day', (SELECT min(date) FROM caps), date) / 7) AS INTEGER) AS fold
       FROM caps),
fs AS (SELECT fold, """ + _SUM_SQL + """ FROM wk GROUP BY fold)"""


def weekly(spark, d):
    c = capture_days(spark, d)
    (first,) = c.agg(F.min("date")).first()
    return c.withColumn("fold", F.floor(F.datediff("date", F.lit(first)) / 7).cast("int"))


@reg("E8_fold_summary", oracle([SQL_CAPS, _SQL_FOLDS], "SELECT * FROM fs", _SUM_COLS, _MONEY))
def e8(spark, d):
    return round_doubles(metrics.capture_summary(weekly(spark, d), ["fold"]), money=_MONEY)


@reg("E10_best_by", oracle([SQL_CAPS, _SQL_FOLDS], """
SELECT fold, overall_capture, total_realized_eur FROM (
  SELECT *, row_number() OVER (ORDER BY overall_capture DESC, fold ASC) AS rk FROM fs) WHERE rk = 1""",
     ["overall_capture", "total_realized_eur"]))
def e10(spark, d):
    s = metrics.capture_summary(weekly(spark, d), ["fold"])
    best = s.agg(F.max_by(F.struct("fold", "overall_capture", "total_realized_eur"), F.struct("overall_capture", -F.col("fold"))).alias("best"))
    return round_doubles(best.where("best is not null").select("best.*"))


@reg("D15_rolling_kpi", oracle([SQL_CAPS], """
SELECT date, capture_ratio, avg(capture_ratio) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
  AS rolling_capture_30 FROM caps""", ["capture_ratio", "rolling_capture_30"]))
def d15(spark, d):
    c = capture_days(spark, d).withColumn("_k", F.lit("kpi"))
    out = c.withColumn("rolling_capture_30", windows.rolling_kpi("capture_ratio", 30, key="_k", order="date"))
    return round_doubles(out.select("date", "capture_ratio", "rolling_capture_30"))


@reg("F3_worst_days", oracle([SQL_CAPS],
     "SELECT date, capture_ratio, realized_eur, perfect_eur FROM caps ORDER BY capture_ratio ASC, date ASC LIMIT 5",
     ["capture_ratio", "realized_eur", "perfect_eur"]))
def f3(spark, d):
    w = tables.worst_days(capture_days(spark, d))
    return round_doubles(w.select("date", "capture_ratio", "realized_eur", "perfect_eur"))


@reg("C25_format_output", oracle([SQL_CAPS], """
SELECT strftime(CAST(date AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS date_iso, round(capture_ratio, 3) AS capture_ratio,
  round(perfect_eur, 2) AS perfect_eur FROM caps"""))
def c25(spark, d):
    c = capture_days(spark, d)
    return c.select(cp.iso_time(F.col("date").cast("timestamp_ntz")).alias("date_iso"),
                    F.round("capture_ratio", 3).alias("capture_ratio"), F.round("perfect_eur", 2).alias("perfect_eur"))


@reg("A13_append_once", oracle([SQL_CAPS, """logged AS (SELECT date, capture_ratio FROM caps WHERE date < DATE '1998-01-01'),
incoming AS (SELECT date, capture_ratio FROM caps WHERE date >= DATE '1997-06-01')"""], """
SELECT * FROM logged UNION ALL
SELECT i.* FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM logged l WHERE l.date = i.date)""", ["capture_ratio"]))
def a13(spark, d):
    c = capture_days(spark, d).select("date", "capture_ratio")
    log = c.filter(F.col("date") < F.lit("1998-01-01").cast("date"))
    inc = c.filter(F.col("date") >= F.lit("1997-06-01").cast("date"))
    return round_doubles(tables.append_once(log, inc, ["date"]))


# Horizon value counts per series, as a JSON map.
@reg("E9_horizon_counts", oracle([fx.SQL_FORECAST, """sp AS (SELECT series_id, day, avg(q95 - q05) AS spread_mean FROM fc GROUP BY 1, 2),
thr AS (SELECT series_id, quantile_cont(spread_mean, 0.33) AS thr_low, quantile_cont(spread_mean, 0.66) AS thr_high
        FROM sp GROUP BY 1),
hz AS (SELECT sp.series_id, CAST(CASE WHEN spread_mean <= thr_low THEN 4 WHEN spread_mean <= thr_high THEN 3 ELSE 2 END
                                 AS INTEGER) AS horizon_days FROM sp JOIN thr USING (series_id)),
hc AS (SELECT series_id, horizon_days, count(*) AS n FROM hz GROUP BY 1, 2)"""], """
SELECT series_id, CAST(to_json(map_from_entries(list({'k': horizon_days, 'v': n} ORDER BY horizon_days))) AS VARCHAR)
  AS horizon_counts
FROM hc GROUP BY series_id"""))
def e9(spark, d):
    daily = metrics.daily_spread_mean(fx.forecast_frame(spark, d))
    h = daily.join(metrics.spread_thresholds(daily), "series_id").withColumn(
        "horizon_days", cp.choose_horizon("spread_mean", "thr_low", "thr_high"))
    m = metrics.horizon_counts(h)
    return m.select("series_id", F.to_json("horizon_counts").alias("horizon_counts"))


# Sample weights on the forecast frame (reference time = series' last ts).
_CUTOFF = "2024-01-15"


@reg("D7_D10_sample_weights", oracle([fx.SQL_FORECAST, f"""w0 AS (
  SELECT series_id, ts, day, price, max(ts) OVER (PARTITION BY series_id) AS ref_ts,
    count(*) OVER (PARTITION BY series_id, day) AS nday,
    avg(price) OVER (PARTITION BY series_id, day) AS day_mean,
    quantile_cont(price, 0.85) OVER (PARTITION BY series_id, day) AS p85
  FROM fc),
w1 AS (
  SELECT *, pow(0.5, greatest((epoch(ref_ts) - epoch(ts)) / 86400.0, 0.0) / 90.0)
      * exp(-0.5 * pow(least(abs(dayofyear(ts) - dayofyear(ref_ts)), 365 - abs(dayofyear(ts) - dayofyear(ref_ts))) / 30.0, 2))
      * (1.0 + 0.5 * CAST(ts >= TIMESTAMP '2025-10-01 00:00:00' AS DOUBLE)) AS w_recency_seasonal,
    CASE WHEN nday >= 2 THEN 1.0 + abs(price - day_mean) / 25.0 ELSE 1.0 END AS w_economic,
    CASE WHEN ts >= TIMESTAMP '{_CUTOFF} 00:00:00' THEN 1.0
         WHEN nday >= 2 AND price >= p85 THEN 1.0 ELSE 0.15 END AS w_curriculum
  FROM w0)"""], """
SELECT series_id, ts, w_recency_seasonal, w_economic, w_curriculum,
  w_recency_seasonal * w_economic * w_curriculum
    / greatest(avg(w_recency_seasonal * w_economic * w_curriculum) OVER (PARTITION BY series_id), 1e-9) AS weight
FROM w1""", ["w_recency_seasonal", "w_economic", "w_curriculum", "weight"]))
def d7_d10(spark, d):
    f = fx.forecast_frame(spark, d).withColumn("ref_ts", F.max("ts").over(Window.partitionBy("series_id")))
    f = f.withColumns({"w_recency_seasonal": windows.recency_seasonal_weight("ts", "ref_ts"),
                       "w_economic": windows.economic_weight("price"),
                       "w_curriculum": windows.curriculum_weight("price", _CUTOFF)})
    f = f.withColumn("weight", windows.normalize_weights(["w_recency_seasonal", "w_economic", "w_curriculum"]))
    return round_doubles(f.select("series_id", "ts", "w_recency_seasonal", "w_economic", "w_curriculum", "weight"))


# D11 rank label, D12 rank blend (score = q95), D13 variance correction.
@reg("D11_D13_rank_blend_variance", oracle([fx.SQL_FORECAST, """r0 AS (
  SELECT *, count(*) OVER (PARTITION BY series_id, day) AS n,
    rank() OVER (PARTITION BY series_id, day ORDER BY price) AS rk_min,
    count(*) OVER (PARTITION BY series_id, day, price) AS ties,
    row_number() OVER (PARTITION BY series_id, day ORDER BY q95, ts) AS pos_r,
    row_number() OVER (PARTITION BY series_id, day ORDER BY q50, ts) AS pos_q,
    avg(q50) OVER (PARTITION BY series_id, day) AS q_mean, stddev_pop(q50) OVER (PARTITION BY series_id, day) AS q_std,
    stddev_pop(price) OVER (PARTITION BY series_id) AS target_std
  FROM fc)"""], """
SELECT r.series_id, r.ts,
  CASE WHEN r.n >= 2 THEN CAST(least(greatest(round_even((r.rk_min + (r.ties - 1) / 2.0) / r.n * 31, 0), 0), 31) AS INTEGER)
       ELSE 0 END AS rank_label,
  CASE WHEN r.n >= 2 THEN 0.6 * r.q50 + 0.4 * t.q50 ELSE r.q50 END AS q50_blend,
  CASE WHEN r.n >= 2 AND r.q_std >= 1e-3
       THEN r.q_mean + (r.q50 - r.q_mean) * greatest(r.target_std / r.q_std, 0.5) ELSE r.q50 END AS q50_varcorr
FROM r0 r LEFT JOIN r0 t ON t.series_id = r.series_id AND t.day = r.day AND t.pos_q = r.pos_r""",
     ["q50_blend", "q50_varcorr"]))
def d11_d13(spark, d):
    f = fx.forecast_frame(spark, d)
    f = f.withColumn("rank_label", windows.rank_label("price"))
    f = windows.blend_rank_with_q50(f, "q50", "q95", weight=0.4)
    f = f.withColumn("target_std", F.stddev_pop("price").over(Window.partitionBy("series_id")))
    f = f.withColumn("q50_varcorr", windows.variance_correction("q50", "target_std"))
    return round_doubles(f.select("series_id", "ts", "rank_label", "q50_blend", "q50_varcorr"))


# K1 time split + M5 conformal calibration on the validation residuals.
_SQL_SPLIT = """sp AS (
  SELECT *, CASE WHEN ts >= max(ts) OVER (PARTITION BY series_id) - INTERVAL 7 DAY THEN 'test'
                 WHEN ts >= max(ts) OVER (PARTITION BY series_id) - INTERVAL 14 DAY THEN 'valid'
                 ELSE 'train' END AS split
  FROM fc)"""


def split_frame(spark, d):
    f = fx.forecast_frame(spark, d)
    return fc_ops.time_split(f, valid_days=7, test_days=7)


@reg("K1_time_split", oracle([fx.SQL_FORECAST, _SQL_SPLIT],
     "SELECT split, series_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM sp GROUP BY 1, 2"))
def k1(spark, d):
    s = split_frame(spark, d)
    return s.groupBy("split", "series_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"),
                                               F.max("ts").alias("last_ts"))


@reg("M5_conformal_calibrate", oracle([fx.SQL_FORECAST, _SQL_SPLIT, """sh AS (
  SELECT series_id, quantile_cont(price - q05, 0.05) AS q05_shift, quantile_cont(price - q95, 0.95) AS q95_shift
  FROM sp WHERE split = 'valid' GROUP BY 1)"""], """
SELECT t.series_id, t.ts, t.q05 + coalesce(sh.q05_shift, 0.0) AS q05, t.q50, t.q95 + coalesce(sh.q95_shift, 0.0) AS q95
FROM sp t LEFT JOIN sh USING (series_id) WHERE t.split = 'test'""", ["q05", "q50", "q95"]))
def m5(spark, d):
    s = split_frame(spark, d)
    shifts = fc_ops.conformal_shift(s.filter("split = 'valid'"), {"q05": 0.05, "q95": 0.95}, "price")
    out = fc_ops.conformal_calibrate(s.filter("split = 'test'"), shifts, ["q05", "q95"])
    return round_doubles(out.select("series_id", "ts", "q05", "q50", "q95"))


# K2 walk-forward folds and K3 rolling-origin folds (assignment counts).
@reg("K2_walkforward_folds", oracle([fx.SQL_FORECAST, """ends AS (SELECT series_id, max(ts) AS end_ts FROM fc GROUP BY 1),
folds AS (
  SELECT series_id, CAST(i AS INTEGER) AS fold, end_ts - INTERVAL 16 DAY + i * INTERVAL 7 DAY AS fold_start,
    least(end_ts - INTERVAL 16 DAY + (i + 1) * INTERVAL 7 DAY, end_ts + INTERVAL 1 SECOND) AS fold_end
  FROM ends, range(3) r(i))"""], """
SELECT f.series_id, f.fold, f.fold_start, f.fold_end,
  count(*) FILTER (WHERE m.ts < f.fold_start) AS n_train_pool,
  count(*) FILTER (WHERE m.ts >= f.fold_start - INTERVAL 7 DAY AND m.ts < f.fold_start) AS n_valid,
  count(*) FILTER (WHERE m.ts >= f.fold_start AND m.ts < f.fold_end) AS n_week
FROM folds f JOIN fc m ON m.series_id = f.series_id
WHERE f.fold_end >= f.fold_start + INTERVAL 1 DAY
GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (WHERE m.ts >= f.fold_start AND m.ts < f.fold_end) >= 96"""))
def k2(spark, d):
    return tables.walkforward_folds(fx.forecast_frame(spark, d))


@reg("K3_rolling_origin_cv", oracle([fx.SQL_MARKET, """ends AS (SELECT series_id, max(ts) AS end_ts FROM market GROUP BY 1),
folds AS (
  SELECT series_id, CAST(i AS INTEGER) AS fold, end_ts - i * INTERVAL 3 DAY AS test_end,
    end_ts - i * INTERVAL 3 DAY - INTERVAL 3 DAY AS test_start,
    end_ts - i * INTERVAL 3 DAY - INTERVAL 6 DAY AS valid_start
  FROM ends, range(3) r(i))"""], """
SELECT f.series_id, f.fold, f.test_start, f.test_end,
  count(*) FILTER (WHERE m.ts < f.valid_start) AS n_train,
  count(*) FILTER (WHERE m.ts >= f.valid_start AND m.ts < f.test_start) AS n_valid,
  count(*) FILTER (WHERE m.ts >= f.test_start AND m.ts < f.test_end) AS n_test
FROM folds f JOIN market m ON m.series_id = f.series_id
GROUP BY 1, 2, 3, 4
HAVING count(*) FILTER (WHERE m.ts < f.valid_start) >= 1000
   AND count(*) FILTER (WHERE m.ts >= f.test_start AND m.ts < f.test_end) >= 50
   AND count(*) FILTER (WHERE m.ts >= f.valid_start AND m.ts < f.test_start) >= 50"""))
def k3(spark, d):
    return tables.rolling_origin_folds(fx.market_grid(spark, d))


# P2 on the seasonal-naive forecast and the naive plan: the walk-forward chain
# (folds, conformal shift, threshold, week, summary) end to end in SQL.
_SQL_P2 = """ends AS (SELECT series_id, max(ts) AS end_ts FROM fc GROUP BY 1),
folds AS (
  SELECT * FROM (
    SELECT series_id, CAST(i AS INTEGER) AS fold, end_ts - INTERVAL 16 DAY + i * INTERVAL 7 DAY AS fold_start,
      least(end_ts - INTERVAL 16 DAY + (i + 1) * INTERVAL 7 DAY, end_ts + INTERVAL 1 SECOND) AS fold_end
    FROM ends, range(3) r(i)) x WHERE fold_end >= fold_start + INTERVAL 1 DAY),
ro AS (
  SELECT m.*, f.fold, CASE WHEN m.ts < f.fold_start THEN 'valid' ELSE 'week' END AS role
  FROM fc m JOIN folds f ON m.series_id = f.series_id AND m.ts >= f.fold_start - INTERVAL 7 DAY AND m.ts < f.fold_end),
sh AS (
  SELECT series_id, fold, quantile_cont(price - q05, 0.05) AS s05, quantile_cont(price - q50, 0.5) AS s50, quantile_cont(price - q95, 0.95) AS s95
  FROM ro WHERE role = 'valid' GROUP BY 1, 2),
ca AS (
  SELECT ro.series_id, ro.fold, role, ts, day, price, (q95 + s95) - (q05 + s05) AS spread,
    CASE WHEN hour(ts) >= 18 AND hour(ts) < 22 THEN 1.0 WHEN hour(ts) >= 2 AND hour(ts) < 6 THEN -1.0 ELSE 0.0 END::DOUBLE AS net
  FROM ro JOIN sh USING (series_id, fold)),
gr AS (
  SELECT series_id, fold, unnest([0, 5, 10, 15, 20, 25, 30, 40]) AS pct,
    unnest(quantile_cont(spread, [0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40])) AS v
  FROM ca WHERE role = 'valid' GROUP BY 1, 2),
pgrid AS (SELECT series_id, fold, pct, CASE WHEN pct = 0 THEN 0.0 ELSE v END AS threshold FROM gr),
tried AS (
  SELECT series_id, fold, pct, day, sum(CASE WHEN net <> 0 AND NOT spread < threshold THEN price * net * 0.25 ELSE 0 END) AS gross,
    count(*) FILTER (WHERE net <> 0 AND NOT spread < threshold) * 0.25 AS mwh
  FROM ca JOIN pgrid USING (series_id, fold) WHERE role = 'valid' GROUP BY 1, 2, 3, 4),
best AS (
  SELECT series_id, fold, pct FROM (
    SELECT series_id, fold, pct, round(sum((gross - 2.0 * mwh) * least(1.0, coalesce(2.7 / nullif(mwh, 0), 1.0))), 6) AS total FROM tried GROUP BY 1, 2, 3) x
  QUALIFY row_number() OVER (PARTITION BY series_id, fold ORDER BY total DESC, pct) = 1),
wk AS (
  SELECT ca.series_id, ca.fold, day, first(pct) AS pct, first(threshold) AS threshold,
    sum(CASE WHEN net <> 0 AND NOT spread < threshold THEN price * net * 0.25 ELSE 0 END) AS gross,
    count(*) FILTER (WHERE net <> 0 AND NOT spread < threshold) * 0.25 AS mwh,
    sum(CASE WHEN net <> 0 AND price * net * 0.25 > 0.5 THEN price * net * 0.25 - 0.5 ELSE 0 END) AS top,
    count(*) FILTER (WHERE net <> 0 AND price * net * 0.25 > 0.5) * 0.25 AS top_mwh, count(*) FILTER (WHERE spread < threshold) AS idle
  FROM ca JOIN best USING (series_id, fold) JOIN pgrid USING (series_id, fold, pct) WHERE role = 'week' GROUP BY 1, 2, 3),
res AS (
  SELECT series_id, fold, count(*) AS n_days, sum((gross - 2.0 * mwh) * least(1.0, coalesce(2.7 / nullif(mwh, 0), 1.0))) AS realized_eur,
    sum(top * least(1.0, coalesce(2.7 / nullif(top_mwh, 0), 1.0))) AS perfect_eur, CAST(sum(idle) AS BIGINT) AS idle_mtus,
    first(pct) AS pct, first(threshold) AS threshold
  FROM wk GROUP BY 1, 2)"""


@reg("P2_walkforward_naive", oracle([fx.SQL_FORECAST, _SQL_P2], """
SELECT *, CASE WHEN perfect_eur > 0 THEN realized_eur / perfect_eur ELSE 0.0 END AS capture_ratio FROM res""",
     ["realized_eur", "perfect_eur", "capture_ratio", "threshold"]))
def p2_naive(spark, d):
    f = fx.forecast_frame(spark, d)
    return round_doubles(walkforward.naive_walkforward(f, tables.walkforward_folds(f)))


# per-fold week results concatenated.
@reg("F7_union_folds", oracle([fx.SQL_FORECAST, """ends AS (SELECT series_id, max(ts) AS end_ts FROM fc GROUP BY 1)"""],
     " UNION ALL ".join(
         f"SELECT {i} AS fold, f.series_id, avg(f.price) AS week_mean_price, count(*) AS n FROM fc f JOIN ends e "
         f"USING (series_id) WHERE f.ts >= e.end_ts - INTERVAL 16 DAY + INTERVAL {7 * i} DAY "
         f"AND f.ts < e.end_ts - INTERVAL 16 DAY + INTERVAL {7 * (i + 1)} DAY GROUP BY f.series_id"
         for i in range(3)), ["week_mean_price"]))
def f7(spark, d):
    f = fx.forecast_frame(spark, d)
    f = f.withColumn("_end", F.max("ts").over(Window.partitionBy("series_id")))
    parts = []
    for i in range(3):  # the last week is cut short by the data's end
        lo = F.col("_end") - F.expr("INTERVAL 16 DAYS") + F.expr(f"INTERVAL {7 * i} DAYS")
        hi = F.col("_end") - F.expr("INTERVAL 16 DAYS") + F.expr(f"INTERVAL {7 * (i + 1)} DAYS")
        p = f.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).groupBy("series_id").agg(
            F.avg("price").alias("week_mean_price"), F.count(F.lit(1)).alias("n"))
        parts.append(p.withColumn("fold", F.lit(i)))
    return round_doubles(tables.union_folds(parts))


# last 192 rows with a target per series.
@reg("F2_latest_window", oracle([fx.SQL_FORECAST], """
SELECT series_id, ts, price FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rk,
    count(*) OVER (PARTITION BY series_id) AS cnt FROM fc WHERE price IS NOT NULL) x
WHERE rk <= 192 AND cnt >= 96""", ["price"]))
def f2(spark, d):
    return round_doubles(tables.latest_window(fx.forecast_frame(spark, d), "price").select("series_id", "ts", "price"))


# F8: complete rows minus the last 48 per series.
@reg("F8_complete_training_rows", oracle([fx.SQL_MARKET, """lf AS (
  SELECT series_id, ts, price, lag(price, 672) OVER (PARTITION BY series_id ORDER BY ts) AS price_lag672, load_mw
  FROM market),
c AS (SELECT * FROM lf WHERE price IS NOT NULL AND price_lag672 IS NOT NULL AND load_mw IS NOT NULL)"""], """
SELECT series_id, ts, price, price_lag672, load_mw FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rk,
    count(*) OVER (PARTITION BY series_id) AS n FROM c) x
WHERE rk > 48 OR n <= 48""", ["price", "price_lag672", "load_mw"]))
def f8(spark, d):
    m = fx.market_grid(spark, d).select("series_id", "ts", "price", "load_mw")
    m = m.withColumn("price_lag672", F.lag("price", 672).over(Window.partitionBy("series_id").orderBy("ts")))
    return round_doubles(tables.complete_training_rows(m))


# F1 + C24: audit query and JSON details.
_SINCE = "(SELECT min(ts) FROM audit) + 864000"


@reg("F1_audit_query", oracle([fx.SQL_AUDIT], f"""
SELECT id, ts, user_id, action, resource, ip_address, details FROM audit
WHERE action = 'purchase' AND ts >= {_SINCE} ORDER BY ts DESC, id DESC LIMIT 500"""))
def f1(spark, d):
    a = fx.audit_rows(spark, d)
    since = a.agg(F.min("ts")).first()[0] + 864000
    return tables.audit_query(a, action="purchase", since=since, limit=500)


@reg("C24_json_details", oracle([fx.SQL_AUDIT], """
SELECT id, CAST(json_extract_string(details, '$.k') AS INTEGER) AS k,
  CAST(json_object('k', CAST(json_extract_string(details, '$.k') AS VARCHAR)) AS VARCHAR) AS details_norm
FROM audit"""))
def c24(spark, d):
    a = fx.audit_rows(spark, d).withColumn("m", feeds.json_details("details"))
    return a.select("id", F.col("m")["k"].try_cast("int").alias("k"), F.to_json("m").alias("details_norm"))


# F5 + F6: webhook fan-out (owner-scoped) and last delivery per subscription.
_SQL_EVENTS = """segs AS (SELECT c_mktsegment AS owner, row_number() OVER (ORDER BY c_mktsegment) - 1 AS rk
         FROM (SELECT DISTINCT c_mktsegment FROM customer)),
ser AS (SELECT series_id, row_number() OVER (ORDER BY series_id) - 1 AS rk FROM (SELECT DISTINCT series_id FROM fc)),
ev AS (
  SELECT 'optimize.completed' AS event, f.series_id, f.day, segs.owner,
         CAST(f.day AS TIMESTAMP) + INTERVAL 11 HOUR AS delivered_at
  FROM (SELECT DISTINCT series_id, day FROM fc) f JOIN ser USING (series_id) JOIN segs ON segs.rk = ser.rk
  UNION ALL
  SELECT 'forecast.refreshed', min(series_id), day, NULL, CAST(day AS TIMESTAMP) + INTERVAL 11 HOUR FROM fc GROUP BY day),
deliv AS (
  SELECT ev.*, s.id AS subscription_id, s.url, sha256(s.secret_hash) AS signing_key
  FROM ev JOIN subs s ON ev.owner IS NULL OR s.owner = ev.owner
  WHERE s.disabled = 0 AND list_contains(string_split(s.events, ','), ev.event))"""


def webhook_events(spark, d):
    f = fx.forecast_frame(spark, d).select("series_id", "day").distinct()
    segs = (fx.table(spark, d, "customer").select(F.col("c_mktsegment").alias("owner")).distinct()
            .withColumn("rk", F.row_number().over(Window.orderBy("owner")) - 1))
    ser = f.select("series_id").distinct().withColumn("rk", F.row_number().over(Window.orderBy("series_id")) - 1)
    ev = f.join(ser, "series_id").join(segs, "rk").withColumn("event", F.lit("optimize.completed"))
    # one refresh a day concerns every owner
    every = f.groupBy("day").agg(F.min("series_id").alias("series_id")).withColumns(
        {"event": F.lit("forecast.refreshed"), "owner": F.lit(None).cast("string")})
    ev = ev.select("event", "series_id", "day", "owner").unionByName(every)
    return ev.select("event", "series_id", "day", "owner",
                     (F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 11 HOURS")).alias("delivered_at"))


@reg("F5_fanout_subscriptions", oracle([fx.SQL_FORECAST, fx.SQL_SUBS, _SQL_EVENTS],
     "SELECT event, series_id, day, owner, delivered_at, subscription_id, url, signing_key FROM deliv"))
def f5(spark, d):
    return tables.fanout_subscriptions(webhook_events(spark, d), fx.subscriptions(spark, d))


@reg("F6_last_delivery_status", oracle([fx.SQL_FORECAST, fx.SQL_SUBS, _SQL_EVENTS, """dl AS (
  SELECT subscription_id, delivered_at,
    CASE WHEN dayofmonth(day) > 28 AND url LIKE '%0' THEN 500 ELSE 200 END AS status,
    CASE WHEN dayofmonth(day) > 28 AND url LIKE '%0' THEN 'HTTP 500' END AS error
  FROM deliv)"""], """
SELECT subscription_id, r.t AS last_delivered_at, r.s AS last_status, r.e AS last_error FROM (
  SELECT subscription_id, arg_max(struct_pack(t := delivered_at, s := status, e := error), delivered_at) AS r
  FROM dl GROUP BY 1) x"""))
def f6(spark, d):
    dl = tables.fanout_subscriptions(webhook_events(spark, d), fx.subscriptions(spark, d))
    # receivers whose endpoint ends in 0 fail at month end (a data-derived outage)
    fail = (F.dayofmonth("day") > 28) & F.col("url").endswith("0")
    dl = dl.withColumns({"status": F.when(fail, 500).otherwise(200),
                         "error": F.when(fail, F.lit("HTTP 500"))})
    return tables.last_delivery_status(dl)


# Feed health per series.
_FEEDS = {"market prices": ["price"], "weather": ["cloud_pct"], "load and RES": ["load_mw", "solar_mw", "wind_mw"],
          "fuels": ["ttf_eur_mwh", "eua_eur_t"]}


@reg("E16_feed_health", oracle([fx.SQL_MARKET], " UNION ALL ".join(
    f"SELECT series_id, '{name}' AS feed, CASE WHEN {cnt} > 0 THEN 'Cached' ELSE 'Unavailable' END AS status, "
    f"{cnt} AS rows, '{','.join(sorted(c for c in cols if c in fx.SIGNALS + ['price']))}' AS columns, "
    f"max(ts) AS last_observation FROM market GROUP BY series_id"
    for name, cols in _FEEDS.items()
    for cnt in [("count(*) FILTER (WHERE " + " OR ".join(f"{c} IS NOT NULL" for c in cols if c in fx.SIGNALS)
                 + ")") if any(c in fx.SIGNALS for c in cols) else "CAST(0 AS BIGINT)"])))
def e16(spark, d):
    m = fx.market_grid(spark, d)
    return metrics.feed_health(m.select("series_id", "ts", *fx.SIGNALS), _FEEDS)


# Monthly metering per key with tiers.
@reg("E17_monthly_metering", oracle([fx.SQL_CALLS, fx.SQL_TIERS, fx.SQL_KEY_TIERS], """
SELECT c.key_id, c.period, t.name AS tier, c.monthly_calls, t.monthly_call_quota,
  CASE WHEN t.monthly_call_quota > 0 THEN c.monthly_calls * 100.0 / t.monthly_call_quota END AS quota_used_pct,
  t.monthly_call_quota > 0 AND c.monthly_calls > t.monthly_call_quota AS over_quota,
  t.can_use_optimize, t.can_use_webhooks,
  t.price_eur_month + c.monthly_calls * t.payg_price_eur_cents / 100.0 AS amount_eur
FROM (SELECT key_id, strftime(ts, '%Y-%m') AS period, count(*) AS monthly_calls FROM calls GROUP BY 1, 2) c
LEFT JOIN key_tiers k USING (key_id) JOIN tiers t ON t.name = coalesce(k.tier, 'free')""",
     ["quota_used_pct", "amount_eur"]))
def e17(spark, d):
    m = metrics.monthly_metering(fx.api_calls(spark, d), fx.key_tiers(spark, d), fx.tiers(spark))
    return round_doubles(m)


# D16 (plain rule): trailing one-minute count per key vs the tier rate limit.
@reg("D16_rate_limit_batch", oracle([fx.SQL_CALLS, fx.SQL_TIERS, fx.SQL_KEY_TIERS], """
SELECT c.key_id, c.call_id, c.ts,
  CAST(count(*) OVER (PARTITION BY c.key_id ORDER BY c.ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) - 1
       AS BIGINT) AS n_prev,
  count(*) OVER (PARTITION BY c.key_id ORDER BY c.ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) - 1
    < t.rate_limit AS accepted
FROM calls c LEFT JOIN key_tiers k USING (key_id) JOIN tiers t ON t.name = coalesce(k.tier, 'free')"""))
def d16(spark, d):
    c = fx.api_calls(spark, d).join(fx.key_tiers(spark, d), "key_id", "left") \
        .withColumn("tier", F.coalesce("tier", F.lit("free"))) \
        .join(F.broadcast(fx.tiers(spark).withColumnRenamed("name", "tier")), "tier")
    c = windows.trailing_count(c, "key_id", "ts", 60)
    return c.select("key_id", "call_id", "ts", "n_prev", (F.col("n_prev") < F.col("rate_limit")).alias("accepted"))


# D16 / H3 (accepted-only rule) at a limit that turns a good part of the calls
# away.  The oracle walks each key's calls one by one, carrying the accepted
# times that are still in the window.
LIMIT, LIMIT_SECONDS = 2, 86400
SQL_LIMIT = f"""WITH RECURSIVE {fx.SQL_CALLS},
c AS (SELECT key_id, ts, call_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY key_id ORDER BY ts, call_id) AS n FROM calls),
walk AS (
  SELECT key_id, ts, call_id, us, n, true AS accepted, 0 AS retry_after, [us] AS taken FROM c WHERE n = 1
  UNION ALL
  SELECT key_id, ts, call_id, us, n, len(open) < {LIMIT},
    CASE WHEN len(open) < {LIMIT} THEN 0 ELSE CAST(greatest(1, (open[1] + {LIMIT_SECONDS * 1_000_000} - us) // 1000000) AS INTEGER) END,
    CASE WHEN len(open) < {LIMIT} THEN list_append(open, us) ELSE open END
  FROM (SELECT c.*, list_filter(w.taken, lambda t: t >= c.us - {LIMIT_SECONDS * 1_000_000}) AS open
        FROM walk w JOIN c ON c.key_id = w.key_id AND c.n = w.n + 1) x)
SELECT key_id, ts, call_id, accepted, retry_after FROM walk"""


@reg("D16_rate_limit_exact", SQL_LIMIT)
def d16_exact(spark, d):
    return windows.rate_limit_exact(fx.api_calls(spark, d), LIMIT, LIMIT_SECONDS)


# A1: keep the latest raw row per (series, slot).
@reg("A1_scan_latest", oracle([], """
SELECT series_id, ts, event_id, value FROM (
  SELECT event_type AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, event_id, value,
    row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 15 MINUTE, ts) ORDER BY ts DESC, event_id DESC) AS rk
  FROM events) x WHERE rk = 1""", ["value"]))
def a1(spark, d):
    ev = fx.table(spark, d, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")
    ev = ev.withColumn("slot", F.window("ts", "15 minutes").start)
    out = feeds.keep_latest(ev, ["series_id", "slot"], [F.col("ts").desc(), F.col("event_id").desc()])
    return round_doubles(out.select("series_id", F.col("slot").alias("ts"), "event_id", "value"))


# A1 on real files: three landings of one feed, of which a later one corrects
# some slots of the earlier ones.
@reg("A1_scan_latest_files", oracle([fx.SQL_SLOTS], """
SELECT series_id, ts, CASE WHEN hour(ts) = 7 THEN price + 2 WHEN hour(ts) < 8 THEN price + 1 ELSE price END AS price,
  CASE WHEN hour(ts) = 7 THEN 'c' WHEN hour(ts) < 8 THEN 'b' ELSE 'a' END AS landing FROM slots""", ["price"]))
def a1_files(spark, d):
    path = scratch_path(spark, f"landings/{uuid.uuid4().hex[:12]}")
    s = fx.price_slots(spark, d).select("series_id", "ts", "price")
    landings = {"a": s, "b": s.where(F.hour("ts") < 8).withColumn("price", F.col("price") + 1),
                "c": s.where(F.hour("ts") == 7).withColumns({"price": F.col("price") + 2, "note": F.lit("corrected")})}
    for name, rows in landings.items():
        rows.write.parquet(f"{path}/landing={name}")
    files = feeds.read_many(spark, [f"{path}/landing={n}" for n in landings], basePath=path)
    out = feeds.keep_latest(files, ["series_id", "ts"], [F.col("_file").desc()])
    return round_doubles(out.select("series_id", "ts", "price", "landing"))


# A4: newest version per (date, document type) from report file names.
_SQL_FILES = """files AS (
  SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') || '_'
    || CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'EL-DAM_ResultsSummary' ELSE 'EL-DAM_Results' END
    || '_EN_v0' || CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END || '.xlsx' AS file
  FROM orders)"""


def report_files(spark, d):
    o = fx.table(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "EL-DAM_ResultsSummary") \
        .otherwise("EL-DAM_Results")
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), kind, F.lit("_EN_v0"),
                    F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "2")
                    .otherwise("3"), F.lit(".xlsx"))
    return o.select(name.alias("file")).distinct()


@reg("A4_latest_version", oracle([_SQL_FILES], r"""
SELECT file, strptime(regexp_extract(file, '^(\d{8})_', 1), '%Y%m%d')::DATE AS report_date,
  regexp_extract(file, '^\d{8}_([A-Za-z0-9-]+_[A-Za-z]+)', 1) AS doc_type,
  CAST(regexp_extract(file, '_v(\d+)\.[A-Za-z]+$', 1) AS INTEGER) AS version
FROM files QUALIFY row_number() OVER (PARTITION BY report_date, doc_type ORDER BY version DESC, file DESC) = 1"""))
def a4(spark, d):
    return feeds.latest_version(report_files(spark, d))


# Live -> cache -> demo per nation series.
@reg("A9_source_fallback", oracle([], """
WITH live AS (
  SELECT n.n_name AS series_id, CAST(o.o_orderdate AS DATE) AS day, avg(o.o_totalprice) AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE o.o_orderstatus = 'P' GROUP BY 1, 2),
cache AS (
  SELECT n.n_name AS series_id, CAST(l.l_shipdate AS DATE) AS day, avg(l.l_extendedprice) AS value
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  GROUP BY 1, 2),
u AS (SELECT *, 'live' AS source, 0 AS prio FROM live UNION ALL SELECT *, 'cache', 1 FROM cache)
SELECT series_id, day, round(value, 6) + 0.0 AS value, source FROM u
QUALIFY prio = min(prio) OVER (PARTITION BY series_id)"""))
def a9(spark, d):
    o, c, n = fx.table(spark, d, "orders"), fx.table(spark, d, "customer"), fx.table(spark, d, "nation")
    li, s = fx.table(spark, d, "lineitem"), fx.table(spark, d, "supplier")
    live = (o.filter(F.col("o_orderstatus") == "P").join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .groupBy(F.col("n_name").alias("series_id"), F.to_date("o_orderdate").alias("day"))
            .agg(F.avg("o_totalprice").alias("value")))
    cache = (li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
             .groupBy(F.col("n_name").alias("series_id"), F.to_date("l_shipdate").alias("day"))
             .agg(F.avg("l_extendedprice").alias("value")))
    return round_doubles(feeds.source_fallback([("live", live), ("cache", cache)]))


# A10: total RES forecast derived from the forecast columns.
@reg("A10_ensure_driver_columns", oracle([fx.SQL_MARKET], """
SELECT series_id, ts, CASE WHEN solar_mw IS NULL AND wind_mw IS NULL THEN NULL
  ELSE coalesce(solar_mw, 0) + coalesce(wind_mw, 0) END AS res_total_forecast_mw FROM market""",
     ["res_total_forecast_mw"]))
def a10(spark, d):
    m = fx.market_grid(spark, d).select("series_id", "ts", F.col("solar_mw").alias("forecast_solar_mw"),
                                        F.col("wind_mw").alias("forecast_wind_onshore_mw"))
    out = feeds.ensure_driver_columns(m)
    return round_doubles(out.select("series_id", "ts", "res_total_forecast_mw"))


# Mean of member forecasts (seasonal lags 96 / 192 / 288 as members).
@reg("E19_mean_ensemble", oracle([fx.SQL_MARKET, """mem AS (
  SELECT series_id, ts, lag(price, 96) OVER w AS prediction FROM market WINDOW w AS (PARTITION BY series_id ORDER BY ts)
  UNION ALL
  SELECT series_id, ts, lag(price, 192) OVER w FROM market WINDOW w AS (PARTITION BY series_id ORDER BY ts)
  UNION ALL
  SELECT series_id, ts, lag(price, 288) OVER w FROM market WINDOW w AS (PARTITION BY series_id ORDER BY ts))"""],
     "SELECT series_id, ts, avg(prediction) AS prediction FROM mem GROUP BY 1, 2", ["prediction"]))
def e19(spark, d):
    m = fx.market_grid(spark, d).select("series_id", "ts", "price")
    w = Window.partitionBy("series_id").orderBy("ts")
    members = [m.select("series_id", "ts", F.lag("price", k).over(w).alias("prediction")) for k in (96, 192, 288)]
    return round_doubles(metrics.mean_ensemble(members, ["series_id", "ts"]))
