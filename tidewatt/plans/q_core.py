"""Registered queries: slotting, alignment, calendar, lags (H2 twin, B, C1-C4, D1-D3, M10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatt.functions import calendar as cal
from tidewatt.functions.columns import round_doubles
from tidewatt.operators import align, windows
from tidewatt.plans import fixtures as fx
from tidewatt.plans.sqlutil import oracle

Q, SQL = {}, {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# H2 batch twin: tumbling 15-minute mean / count per series.
@reg("H2_stream_15min_batch", oracle([fx.SQL_SLOTS],
     "SELECT series_id, ts, price, n_obs FROM slots", ["price"]))
def h2_batch(spark, d):
    return round_doubles(fx.price_slots(spark, d).select("series_id", "ts", "price", "n_obs"))


# B1: regular grid, off-grid points drop out.
@reg("B1_resample_grid", oracle([fx.SQL_SLOTS, fx.SQL_GRID],
     "SELECT g.series_id, g.ts, s.price, s.price IS NOT NULL AS present "
     "FROM grid g LEFT JOIN slots s USING (series_id, ts)", ["price"]))
def b1(spark, d):
    slots = fx.price_slots(spark, d)
    g = align.reindex_on_grid(slots.select("series_id", "ts", "price"))
    return round_doubles(g.select("series_id", "ts", "price", F.col("_present").alias("present")))


# B2: as-of forward fill of the latest raw row (off-grid rows count).
_SQL_B2_GRID = """rawgrid AS (
  SELECT event_type AS series_id,
         unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, min(ts)), time_bucket(INTERVAL 15 MINUTE, max(ts)),
                                INTERVAL 15 MINUTE)) AS ts
  FROM events GROUP BY event_type)"""


@reg("B2_asof_ffill", oracle([_SQL_B2_GRID],
     "SELECT g.series_id, g.ts, e.value AS last_value, e.user_id AS last_user "
     "FROM rawgrid g ASOF LEFT JOIN (SELECT event_type AS series_id, ts, value, user_id FROM events) e "
     "ON g.series_id = e.series_id AND g.ts >= e.ts", ["last_value"]))
def b2(spark, d):
    ev = fx.table(spark, d, "events").select(F.col("event_type").alias("series_id"), "ts", "value", "user_id")
    grid = align.resample_grid(ev)
    out = align.asof_ffill(grid, ev, ["value", "user_id"])
    return round_doubles(out.select("series_id", "ts", F.col("value").alias("last_value"),
                                    F.col("user_id").alias("last_user")))


# Bounded linear interpolation (and the full aligned frame).
@reg("B3_interpolate_time", oracle([fx.SQL_MARKET],
     "SELECT series_id, ts, day, price, load_mw, solar_mw, wind_mw, cloud_pct FROM market",
     ["price", "load_mw", "solar_mw", "wind_mw", "cloud_pct"]))
def b3(spark, d):
    m = fx.market_grid(spark, d)
    return round_doubles(m.select("series_id", "ts", "day", "price", "load_mw", "solar_mw", "wind_mw", "cloud_pct"))


# Left-join several sources on the grid (slot price, hourly mean, slot count).
@reg("B4_join_sources", oracle([fx.SQL_SLOTS, fx.SQL_GRID, """hourly AS (
  SELECT event_type AS series_id, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) AS hourly_price
  FROM events GROUP BY 1, 2)"""],
     "SELECT g.series_id, g.ts, s.price, s.n_obs, h.hourly_price FROM grid g "
     "LEFT JOIN slots s USING (series_id, ts) LEFT JOIN hourly h USING (series_id, ts)",
     ["price", "hourly_price"]))
def b4(spark, d):
    slots = fx.price_slots(spark, d)
    grid = align.resample_grid(slots)
    ev = fx.table(spark, d, "events").withColumnRenamed("event_type", "series_id")
    hourly = align.slot_aggregate(ev, {"hourly_price": F.avg("value")}, minutes=60)
    out = align.join_sources(grid, [slots.select("series_id", "ts", "price", "n_obs"), hourly])
    return round_doubles(out)


# Calendar, cyclic, solar geometry, day length, regime flag.
_CAL_SQL = """
SELECT series_id, ts,
  CAST(hour(ts) AS INTEGER) AS hour, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day,
  CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
  CAST(month(ts) AS INTEGER) AS month, CAST(dayofyear(ts) AS INTEGER) AS doy,
  sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440.0) AS sin_tod,
  cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440.0) AS cos_tod,
  sin(2 * pi() * dayofyear(ts) / 365.0) AS sin_doy, cos(2 * pi() * dayofyear(ts) / 365.0) AS cos_doy,
  elev AS solar_elevation_deg, CAST(elev > 0 AS INTEGER) AS solar_is_day, greatest(elev, 0.0) AS solar_clip_pos,
  2.0 * degrees(acos(least(greatest(-tan(radians(38.0)) * tan(radians(23.45 * sin(2 * pi() * (284 + dayofyear(ts)) / 365.0))), -1.0), 1.0))) / 15.0 AS day_length_h,
  CAST(ts >= TIMESTAMP '2025-10-01 00:00:00' AS INTEGER) AS mtu_15m_active
FROM (
  SELECT series_id, ts,
    degrees(asin(least(greatest(
      sin(radians(38.0)) * sin(radians(23.45 * sin(2 * pi() * (284 + dayofyear(u)) / 365.0)))
      + cos(radians(38.0)) * cos(radians(23.45 * sin(2 * pi() * (284 + dayofyear(u)) / 365.0)))
        * cos(radians(15.0 * (hour(u) + minute(u) / 60.0 + second(u) / 3600.0 + 23.7 / 15.0 - 12.0))),
      -1.0), 1.0))) AS elev
  FROM (SELECT series_id, ts, timezone('UTC', timezone('Europe/Athens', ts)) AS u FROM grid) x) y"""


@reg("C1_C4_calendar_solar", oracle([fx.SQL_SLOTS, fx.SQL_GRID], _CAL_SQL,
     ["sin_tod", "cos_tod", "sin_doy", "cos_doy", "solar_elevation_deg", "solar_clip_pos", "day_length_h"]))
def c_calendar(spark, d):
    grid = align.resample_grid(fx.price_slots(spark, d))
    out = cal.add_calendar(grid).withColumn("mtu_15m_active", cal.regime_flag("ts"))
    return round_doubles(out)


# D1 + D2: full lag / roll set on the aligned price.
_LAG_SQL_COLS = ",\n  ".join(
    [f"lag(price, {k}) OVER w AS price_lag{k}" for k in windows.LAGS_FULL]
    + [f"CASE WHEN count(price) OVER w{k} = {k} THEN avg(price) OVER w{k} END AS price_rollmean{k},\n  "
       f"CASE WHEN count(price) OVER w{k} = {k} THEN stddev_samp(price) OVER w{k} END AS price_rollstd{k}"
       for k in windows.ROLLS_FULL])
_LAG_SQL_WIN = ",\n  ".join(["w AS (PARTITION BY series_id ORDER BY ts)"] + [
    f"w{k} AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    for k in windows.ROLLS_FULL])
_LAG_DOUBLES = ([f"price_lag{k}" for k in windows.LAGS_FULL]
                + [f"price_roll{s}{k}" for k in windows.ROLLS_FULL for s in ("mean", "std")])


@reg("D1_D2_lags_rolls", oracle([fx.SQL_MARKET],
     f"SELECT series_id, ts, price,\n  {_LAG_SQL_COLS}\nFROM market\nWINDOW {_LAG_SQL_WIN}",
     ["price"] + _LAG_DOUBLES))
def d1_d2(spark, d):
    m = fx.market_grid(spark, d).select("series_id", "ts", "price")
    return round_doubles(windows.add_lags_rolls(m, "price", gate_close=False))


# D2 gate-close set: lags 96/672 and rolls of 96/672 rows shifted by 96.
@reg("D2_gate_close_rolls", oracle([fx.SQL_MARKET], """
SELECT series_id, ts, price,
  lag(price, 96) OVER w AS price_lag96, lag(price, 672) OVER w AS price_lag672,
  CASE WHEN count(price) OVER a = 96 THEN avg(price) OVER a END AS price_rollmean96,
  CASE WHEN count(price) OVER a = 96 THEN stddev_samp(price) OVER a END AS price_rollstd96,
  CASE WHEN count(price) OVER b = 672 THEN avg(price) OVER b END AS price_rollmean672,
  CASE WHEN count(price) OVER b = 672 THEN stddev_samp(price) OVER b END AS price_rollstd672
FROM market
WINDOW w AS (PARTITION BY series_id ORDER BY ts),
  a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 191 PRECEDING AND 96 PRECEDING),
  b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 767 PRECEDING AND 96 PRECEDING)""",
     ["price", "price_lag96", "price_lag672", "price_rollmean96", "price_rollstd96",
      "price_rollmean672", "price_rollstd672"]))
def d2_gate(spark, d):
    m = fx.market_grid(spark, d).select("series_id", "ts", "price")
    return round_doubles(windows.add_lags_rolls(m, "price", gate_close=True))


# D3: realised columns replaced by their 96-lag.
@reg("D3_lag_realized", oracle([fx.SQL_MARKET], """
SELECT series_id, ts, price, cloud_pct,
  lag(load_mw, 96) OVER w AS load_mw_lag96, lag(solar_mw, 96) OVER w AS solar_mw_lag96,
  lag(wind_mw, 96) OVER w AS wind_mw_lag96
FROM market WINDOW w AS (PARTITION BY series_id ORDER BY ts)""",
     ["price", "cloud_pct", "load_mw_lag96", "solar_mw_lag96", "wind_mw_lag96"]))
def d3(spark, d):
    m = fx.market_grid(spark, d).select("series_id", "ts", "price", "cloud_pct", "load_mw", "solar_mw", "wind_mw")
    return round_doubles(windows.lag_realized(m, ["load_mw", "solar_mw", "wind_mw"], 96))


# Seasonal-naive interval forecast (q50 = lag 96).
@reg("M10_lag_forecast", oracle([fx.SQL_FORECAST],
     "SELECT series_id, ts, day, price, q05, q50, q95 FROM fc",
     ["price", "q05", "q50", "q95"]))
def m10(spark, d):
    return round_doubles(fx.forecast_frame(spark, d))


# A2: market-local wall time <-> UTC.
@reg("A2_localize", oracle([fx.SQL_SLOTS],
     "SELECT series_id, ts AS ts_utc, timezone('Europe/Athens', timezone('UTC', ts)) AS ts_local, "
     "timezone('UTC', timezone('Europe/Athens', ts)) AS ts_local_as_utc, "
     "CAST(timezone('Europe/Athens', timezone('UTC', ts)) AS DATE) AS local_day FROM slots"))
def a2(spark, d):
    s = fx.price_slots(spark, d)
    loc = cal.utc_to_local("ts")
    return s.select("series_id", F.col("ts").alias("ts_utc"), loc.alias("ts_local"),
                    cal.local_to_utc("ts").alias("ts_local_as_utc"), F.to_date(loc).alias("local_day"))


# A2 over the days of both clock changes: the full grid (so that both passes of
# the repeated hour are there) moved to March and October, written as naive
# local times by two files each, and localized again.
SHIFTS = (70, 285)  # days from January 2024 to the changes of 31 March and 27 October


@reg("A2_localize_clock_changes", oracle([fx.SQL_SLOTS, fx.SQL_GRID], " UNION ALL ".join(
    f"SELECT series_id, '{s}-{k}' AS file, ts + INTERVAL {s} DAY AS ts_utc, timezone('Europe/Athens', timezone('UTC', ts + INTERVAL {s} DAY)) AS ts_local FROM grid"
    for s in SHIFTS for k in (1, 2))))
def a2_changes(spark, d):
    s = fx.market_grid(spark, d).select("series_id", "ts")
    files = F.array(*(F.struct(F.lit(f"{n}-{k}").alias("file"), F.lit(n).alias("days")) for n in SHIFTS for k in (1, 2)))
    moved = s.select("series_id", "ts", F.explode(files).alias("f")).select(
        "series_id", F.col("f.file").alias("file"), (F.col("ts") + F.make_dt_interval(F.col("f.days"))).alias("seen"))
    naive = moved.withColumn("ts_local", cal.utc_to_local("seen"))
    out = cal.localize(naive, "ts_local", ("series_id", "file"), order="seen")
    return out.select("series_id", "file", "ts_utc", "ts_local")
