"""Registered queries: joins, holidays, composites, same-hour baselines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatt.functions import composites as cp
from tidewatt.functions.columns import round_doubles, row_mean, row_std
from tidewatt.operators import align, metrics, windows
from tidewatt.plans import fixtures as fx
from tidewatt.plans.sqlutil import oracle
from tidewatt.sources import feeds

Q, SQL = {}, {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# Coupled zones for the neighbour-price pivot (one per series).
ZONES = ["click", "error", "purchase", "signup", "view"]


# Full outer alignment of two daily feeds.
@reg("B5_align_full", oracle([fx.SQL_DAILY],
     "SELECT coalesce(g.day, c.day) AS day, g.ttf_eur_mwh, c.eua_eur_t "
     "FROM gas g FULL OUTER JOIN carbon c ON g.day = c.day", ["ttf_eur_mwh", "eua_eur_t"]))
def b5(spark, d):
    gas, carbon = fx.daily_feeds(spark, d)
    return round_doubles(align.align_full(gas, carbon, ["day"]))


# A6 + C8: merged daily fuels, forward-filled, with the CCGT cost proxy.
@reg("A6_C8_merge_daily_fuels", oracle([fx.SQL_DAILY, """bothf AS (
  SELECT coalesce(g.day, c.day) AS day, g.ttf_eur_mwh, c.eua_eur_t
  FROM gas g FULL OUTER JOIN carbon c ON g.day = c.day),
filled AS (
  SELECT day,
    last_value(ttf_eur_mwh IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ttf_eur_mwh,
    last_value(eua_eur_t IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eua_eur_t
  FROM bothf)"""],
     "SELECT day, ttf_eur_mwh, eua_eur_t, ttf_eur_mwh * 2.0 + eua_eur_t * 0.37 AS ccgt_srmc_eur_mwh FROM filled",
     ["ttf_eur_mwh", "eua_eur_t", "ccgt_srmc_eur_mwh"]))
def a6(spark, d):
    gas, carbon = fx.daily_feeds(spark, d)
    m = feeds.merge_daily_fuels(gas, carbon)
    return round_doubles(m.withColumn("ccgt_srmc_eur_mwh", cp.ccgt_srmc("ttf_eur_mwh", "eua_eur_t")))


# Holidays as an input dimension: the quietest days (<= 10th pct of daily events).
SQL_HOL = """daycnt AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1),
hol AS (SELECT date FROM daycnt WHERE n <= (SELECT quantile_cont(n, 0.1) FROM daycnt))"""


def holidays(spark, d):
    dc = fx.table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    thr = dc.agg(F.percentile("n", 0.1).alias("thr"))
    return dc.crossJoin(F.broadcast(thr)).filter(F.col("n") <= F.col("thr")).select("date")


@reg("B6_holiday_flags", oracle([fx.SQL_SLOTS, fx.SQL_GRID, SQL_HOL], """
SELECT g.series_id, g.ts, CAST(g.ts AS DATE) AS day,
  CAST(h0.date IS NOT NULL AS INTEGER) AS is_holiday,
  CAST(h1.date IS NOT NULL AS INTEGER) AS is_holiday_eve,
  CAST(h2.date IS NOT NULL AS INTEGER) AS is_holiday_after
FROM grid g
LEFT JOIN hol h0 ON h0.date = CAST(g.ts AS DATE)
LEFT JOIN hol h1 ON h1.date = CAST(g.ts AS DATE) + 1
LEFT JOIN hol h2 ON h2.date = CAST(g.ts AS DATE) - 1"""))
def b6(spark, d):
    grid = align.resample_grid(fx.price_slots(spark, d)).withColumn("day", F.to_date("ts"))
    return align.holiday_flags(grid, holidays(spark, d))


@reg("B7_days_to_holiday", oracle([fx.SQL_SLOTS, SQL_HOL], """
SELECT d.day, CAST(CASE WHEN min(h.date) IS NULL THEN 30
  ELSE least(greatest(datediff('day', d.day, min(h.date)), 0), 30) END AS INTEGER) AS days_to_holiday
FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM slots) d LEFT JOIN hol h ON h.date >= d.day
GROUP BY d.day"""))
def b7(spark, d):
    days = fx.price_slots(spark, d).select(F.to_date("ts").alias("day")).distinct()
    return align.days_to_holiday(days, holidays(spark, d))


# Values re-keyed onto the grid, missing -> 0 observations.
@reg("B8_reindex_values", oracle([fx.SQL_SLOTS, fx.SQL_GRID],
     "SELECT g.series_id, g.ts, coalesce(s.n_obs, 0) AS n_obs FROM grid g LEFT JOIN slots s USING (series_id, ts)"))
def b8(spark, d):
    slots = fx.price_slots(spark, d)
    grid = align.resample_grid(slots)
    return align.reindex_values(grid, slots.select("series_id", "ts", "n_obs"), ["series_id", "ts"],
                                fill={"n_obs": 0})


# Daily spread means onto every MTU; a day without forecasts carries the previous.
@reg("B9_sub_daily_broadcast", oracle([fx.SQL_FORECAST, """sp AS (
  SELECT series_id, day, avg(q95 - q05) AS spread_mean FROM fc GROUP BY 1, 2)"""], """
SELECT m.series_id, m.ts, m.day,
  last_value(sp.spread_mean IGNORE NULLS) OVER (PARTITION BY m.series_id ORDER BY m.ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spread_mean
FROM market m LEFT JOIN sp USING (series_id, day)""", ["spread_mean"]))
def b9(spark, d):
    m = fx.market_grid(spark, d).select("series_id", "ts", "day")
    daily = metrics.daily_spread_mean(fx.forecast_frame(spark, d))
    return round_doubles(align.sub_daily_broadcast(m, daily, ["spread_mean"]))


# Composites of the aligned signals.
_SQL_COMP = """comp AS (
  SELECT series_id, ts, day, price, load_mw, solar_mw, wind_mw, cloud_pct,
    CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
    CASE WHEN load_mw IS NULL AND solar_mw IS NULL AND wind_mw IS NULL THEN NULL
         ELSE coalesce(load_mw, 0) + coalesce(solar_mw, 0) + coalesce(wind_mw, 0) END AS load_total_mw,
    coalesce(solar_mw, 0) + coalesce(wind_mw, 0) AS res_total_forecast_mw,
    load_mw - (coalesce(solar_mw, 0) + coalesce(wind_mw, 0)) AS residual_load_forecast_mw,
    solar_mw - wind_mw AS net_export_mw,
    (coalesce(solar_mw, 0) + coalesce(wind_mw, 0)) / nullif(load_mw, 0) AS res_penetration,
    coalesce(solar_mw, 0) / nullif(load_mw, 0) AS solar_load_ratio,
    coalesce(wind_mw, 0) / nullif(load_mw, 0) AS wind_load_ratio,
    lag(price, 96) OVER (PARTITION BY series_id ORDER BY ts) AS price_lag96
  FROM market)"""


def _composites(spark, d):
    m = fx.market_grid(spark, d)
    w = Window.partitionBy("series_id").orderBy("ts")
    return m.withColumns({
        "hour": F.hour("ts"), "is_weekend": (F.weekday("ts") >= 5).cast("int"),
        "load_total_mw": cp.load_total("load_mw", "solar_mw", "wind_mw"),
        "res_total_forecast_mw": cp.res_total_forecast("solar_mw", "wind_mw"),
        "residual_load_forecast_mw": cp.residual_load("load_mw", "solar_mw", "wind_mw"),
        "net_export_mw": cp.net_export("solar_mw", "wind_mw"),
        **cp.penetration_columns("load_mw", "solar_mw", "wind_mw"),
        "price_lag96": F.lag("price", 96).over(w)})


_COMP_DOUBLES = ["load_total_mw", "res_total_forecast_mw", "residual_load_forecast_mw", "net_export_mw",
                 "res_penetration", "solar_load_ratio", "wind_load_ratio", "collapse_risk",
                 "solar_surplus_midday"]


@reg("C5_C10_composites", oracle([fx.SQL_MARKET, _SQL_COMP], """
SELECT series_id, ts, load_total_mw, res_total_forecast_mw, residual_load_forecast_mw, net_export_mw,
  res_penetration, solar_load_ratio, wind_load_ratio,
  res_penetration * CASE WHEN price_lag96 IS NULL THEN NULL ELSE greatest(price_lag96, 0.0) END AS collapse_risk,
  CASE WHEN hour BETWEEN 10 AND 14 THEN solar_load_ratio ELSE 0.0 END AS solar_surplus_midday
FROM comp""", _COMP_DOUBLES))
def c5_c10(spark, d):
    c = _composites(spark, d)
    c = c.withColumns({"collapse_risk": cp.collapse_risk("res_penetration", "price_lag96"),
                       "solar_surplus_midday": cp.solar_surplus_midday("solar_load_ratio", "hour")})
    return round_doubles(c.select("series_id", "ts", *_COMP_DOUBLES))


# D4 + C12 + D6: same-hour load baseline, spike likelihood and its daily max.
_CLIP = "CASE WHEN ({x}) IS NULL THEN NULL ELSE least(greatest(({x}), {lo}), {hi}) END"


def _clip(x, lo, hi):
    return _CLIP.format(x=x, lo=lo, hi=hi)


_TZ = _clip("coalesce((greatest(coalesce(load_mw,0) - coalesce(solar_mw,0) - coalesce(wind_mw,0), 0.0) - base)"
            " / nullif(base, 0), 0.0)", "-2.0", "5.0")
_SPIKE = _clip(
    "0.2 * " + _clip("coalesce(cloud_pct, 50.0) / 100.0", "0.0", "1.0")
    + " + 0.3 * " + _clip("1.0 - solar_load_ratio", "0.0", "1.0")
    + " + 0.25 * (" + _clip("tz", "0.0", "2.0") + ") / 2.0"
    + " + 0.15 * " + _clip("CAST(hour BETWEEN 17 AND 22 AS DOUBLE) + CAST(hour BETWEEN 6 AND 9 AS DOUBLE) * 0.5",
                           "0.0", "1.0")
    + " + 0.1 * (1.0 - CAST(is_weekend AS DOUBLE))", "0.0", "1.0")


@reg("D4_C12_D6_spike_likelihood", oracle([fx.SQL_MARKET, _SQL_COMP, f"""b AS (
  SELECT *, CASE WHEN count(load_mw) OVER h >= 4 THEN avg(load_mw) OVER h END AS base
  FROM comp
  WINDOW h AS (PARTITION BY series_id, hour ORDER BY ts ROWS BETWEEN 123 PRECEDING AND 4 PRECEDING)),
z AS (SELECT *, {_TZ} AS tz FROM b),
s AS (SELECT *, {_SPIKE} AS spike_likelihood FROM z)"""], """
SELECT series_id, ts, base AS load_samehour_mean, tz AS thermal_z, spike_likelihood,
  max(spike_likelihood) OVER (PARTITION BY series_id, day) AS spike_likelihood_daymax
FROM s""", ["load_samehour_mean", "thermal_z", "spike_likelihood", "spike_likelihood_daymax"]))
def d4_c12(spark, d):
    c = _composites(spark, d)
    c = windows.same_hour_baseline(c, "load_mw", out="load_samehour_mean")
    c = c.withColumn("thermal_z", cp.thermal_z("load_mw", "solar_mw", "wind_mw", "load_samehour_mean"))
    c = c.withColumn("spike_likelihood", cp.spike_likelihood("cloud_pct", "solar_load_ratio", "thermal_z",
                                                             "hour", "is_weekend"))
    c = c.withColumn("spike_likelihood_daymax", windows.daymax("spike_likelihood"))
    return round_doubles(c.select("series_id", "ts", "load_samehour_mean", "thermal_z", "spike_likelihood",
                                  "spike_likelihood_daymax"))


# A8 + C11: hourly neighbour prices pivoted one column per zone; row mean / std.
_PIV_COLS = [f"da_price_{z}_eur_mwh" for z in ZONES]
_SQL_PIV = """hp AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, event_type AS zone, avg(value) AS price
  FROM events GROUP BY 1, 2),
piv AS (
  SELECT ts, """ + ", ".join(f"max(CASE WHEN zone = '{z}' THEN price END) AS da_price_{z}_eur_mwh" for z in ZONES) + """
  FROM hp GROUP BY ts)"""


@reg("A8_C11_neighbor_pivot", oracle([_SQL_PIV], "SELECT ts, " + ", ".join(_PIV_COLS) + """,
  (SELECT avg(v) FROM unnest([""" + ", ".join(_PIV_COLS) + """]) t(v)) AS zone_mean,
  (SELECT stddev_samp(v) FROM unnest([""" + ", ".join(_PIV_COLS) + """]) t(v)) AS zone_std
FROM piv""", _PIV_COLS + ["zone_mean", "zone_std"]))
def a8_c11(spark, d):
    ev = fx.table(spark, d, "events")
    long = (ev.groupBy(F.window("ts", "1 hour").start.alias("ts"), fx.known_series(F.col("event_type"), ZONES).alias("zone"))
            .agg(F.avg("value").alias("price")))
    p = feeds.neighbor_prices(long, ZONES)
    p = p.withColumns({"zone_mean": row_mean(*_PIV_COLS), "zone_std": row_std(*_PIV_COLS)})
    return round_doubles(p)


# Neighbour-zone lags and spread to the home price on the 15-minute grid.
@reg("D5_neighbor_spread", oracle([fx.SQL_MARKET, _SQL_PIV, """j AS (
  SELECT m.series_id, m.ts, m.price, """ + ", ".join(f"p.{c}" for c in _PIV_COLS) + """
  FROM market m LEFT JOIN piv p ON p.ts = date_trunc('hour', m.ts))"""], """
SELECT series_id, ts, lag(price, 96) OVER w AS price_lag96, """ + ",\n  ".join(
    f"lag({c}, 96) OVER w AS {c}_lag96, lag({c}, 672) OVER w AS {c}_lag672, "
    f"lag({c}, 96) OVER w - lag(price, 96) OVER w AS {c}_minus_home_lag96" for c in _PIV_COLS) + """
FROM j WINDOW w AS (PARTITION BY series_id ORDER BY ts)""",
     ["price_lag96"] + [f"{c}_{s}" for c in _PIV_COLS for s in ("lag96", "lag672", "minus_home_lag96")]))
def d5(spark, d):
    m = fx.market_grid(spark, d).select("series_id", "ts", "price")
    ev = fx.table(spark, d, "events")
    long = (ev.groupBy(F.window("ts", "1 hour").start.alias("ts"), fx.known_series(F.col("event_type"), ZONES).alias("zone"))
            .agg(F.avg("value").alias("price")))
    p = feeds.neighbor_prices(long, ZONES).withColumnRenamed("ts", "hour_ts")
    j = m.join(p, F.date_trunc("hour", "ts").cast("timestamp_ntz") == F.col("hour_ts"), "left").drop("hour_ts")
    out = windows.neighbor_spread(j, _PIV_COLS, "price")
    return round_doubles(out.drop("price"))


# Null share per column of the feature frame; > 70 % marks a drop.
_E1_COLS = ["price", "load_mw", "solar_mw", "wind_mw", "cloud_pct", "price_lag672"]


@reg("E1_null_ratio_prune", oracle([fx.SQL_MARKET, """f AS (
  SELECT *, lag(price, 672) OVER (PARTITION BY series_id ORDER BY ts) AS price_lag672 FROM market)"""],
     " UNION ALL ".join(
         f"SELECT '{c}' AS column_name, avg(CAST({c} IS NULL AS DOUBLE)) AS null_ratio, "
         f"avg(CAST({c} IS NULL AS DOUBLE)) > 0.7 AS dropped FROM f" for c in _E1_COLS), ["null_ratio"]))
def e1(spark, d):
    m = fx.market_grid(spark, d)
    m = m.withColumn("price_lag672", F.lag("price", 672).over(Window.partitionBy("series_id").orderBy("ts")))
    r = metrics.null_ratios(m, _E1_COLS)
    return round_doubles(r.withColumn("dropped", F.col("null_ratio") > 0.7))


# C13 + C14 + C15: regime flag, redundant calendar columns dropped, start / target filters.
_C14_START = "2024-01-03"


@reg("C14_C15_drop_and_filter", oracle([fx.SQL_MARKET], f"""
SELECT series_id, ts, price, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
  sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440.0) AS sin_tod,
  cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440.0) AS cos_tod,
  CAST(ts >= TIMESTAMP '2025-10-01 00:00:00' AS INTEGER) AS mtu_15m_active
FROM market WHERE ts >= TIMESTAMP '{_C14_START} 00:00:00' AND price IS NOT NULL""",
     ["price", "sin_tod", "cos_tod"]))
def c14_c15(spark, d):
    from tidewatt.functions import calendar as cal
    m = fx.market_grid(spark, d).select("series_id", "ts", "price")
    m = m.filter((F.col("ts") >= F.lit(_C14_START).cast("timestamp_ntz")) & F.col("price").isNotNull())
    m = m.withColumns({**cal.calendar_columns("ts"), **cal.cyclic_columns("ts"),
                       "mtu_15m_active": cal.regime_flag("ts")})
    # C14: the sin/cos pairs carry the same information as these
    m = m.drop("minute_of_day", "doy", "hour", "month", "sin_doy", "cos_doy")
    return round_doubles(m)
