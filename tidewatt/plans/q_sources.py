"""Registered queries: report tidying, JSON flattening, feed renaming and the
writers (A3, A5, A7, A11, A12, F4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatt.functions.columns import round_doubles
from tidewatt.operators import tables
from tidewatt.plans import fixtures as fx
from tidewatt.plans.q_features import ZONES
from tidewatt.plans.sqlutil import oracle
from tidewatt.session import scratch_path
from tidewatt.sources import feeds, reports

Q, SQL = {}, {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# Fixed values of our report fixture: series -> (sheet, section header, row label).
REPORT_ROWS = [
    ("click", "SELL", "Market Clearing Price", "Greece Mainland"),
    ("error", "SELL", "PRODUCTION TECHNOLOGY / MTU", "LIGNITE"),
    ("purchase", "SELL", "PRODUCTION TECHNOLOGY / MTU", "GAS"),
    ("view", "BUY", "Market Clearing Price", "Greece Mainland"),
    ("signup", "BUY", "DEMAND / MTU", "HV LOAD"),
]


def report_cells(spark, d):
    """Daily result reports rebuilt as a cell table from the slot prices:
    per day a SELL and a BUY sheet with a 1..96 header row, section header
    rows and one row of 96 values per series (bounded 96-entry groups)."""
    s = fx.price_slots(spark, d).withColumns({
        "day": F.to_date("ts"), "idx": (F.hour("ts") * 60 + F.minute("ts")) / 15})
    per = s.groupBy("day", "series_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int"), "price"))).alias("m"))
    vals = F.transform(F.sequence(F.lit(0), F.lit(95)), lambda i: F.element_at("m", i).cast("string"))
    layout = spark.createDataFrame(
        [(sid, sh, sec, lab, 2 * k + 3) for k, (sid, sh, sec, lab) in
         enumerate([r for r in REPORT_ROWS if r[1] == "SELL"])]
        + [(sid, sh, sec, lab, 2 * k + 3) for k, (sid, sh, sec, lab) in
           enumerate([r for r in REPORT_ROWS if r[1] == "BUY"])],
        "series_id string, sheet string, section string, label string, row_idx int")
    # one pass: each (day, series) group emits its value row, the section
    # header above it and -- for the first row of a sheet -- the 1..96 row
    per = per.withColumn("series_id", fx.known_series(F.col("series_id"), [r[0] for r in REPORT_ROWS]))
    g = per.join(F.broadcast(layout), "series_id")
    mtu_hdr = F.concat(F.array(F.lit("MTU")), F.transform(F.sequence(F.lit(1), F.lit(96)),
                                                          lambda i: i.cast("string")))
    rows = F.array(F.struct(F.col("row_idx").alias("r"), F.concat(F.array(F.col("label")), vals).alias("c")),
                   F.struct((F.col("row_idx") - 1).alias("r"), F.array(F.col("section")).alias("c")),
                   F.struct(F.lit(1).alias("r"), mtu_hdr.alias("c")))
    rows = F.filter(rows, lambda x: (x["r"] != 1) | (F.col("row_idx") == 3))
    allc = g.select("day", "sheet", F.explode(rows).alias("x")).select(
        "day", "sheet", F.col("x.r").alias("row_idx"), F.col("x.c").alias("cells"))
    fname = F.concat(F.date_format("day", "yyyyMMdd"), F.lit("_EL-DAM_ResultsSummary_EN_v01.xlsx"))
    return allc.select(fname.alias("file"), "sheet", "row_idx", "cells")


_A3_COLS = ["dam_price_eur_mwh", "gen_lignite_mw", "gen_gas_mw", "load_hv_mw"]


@reg("A3_tidy_market_report", oracle([fx.SQL_SLOTS, """days AS (
  SELECT CAST(ts AS DATE) AS day, max(CAST(series_id = 'click' AS INTEGER)) AS has_sell_price,
    max(CAST(series_id IN ('click', 'view') AS INTEGER)) AS has_price
  FROM slots GROUP BY 1),
mtus AS (SELECT day, has_sell_price, has_price, strftime(day, '%Y%m%d') || '_EL-DAM_ResultsSummary_EN_v01.xlsx' AS file,
                CAST(day AS TIMESTAMP) + i * INTERVAL 15 MINUTE AS ts FROM days, range(96) r(i))"""], """
SELECT m.file, m.ts, CASE WHEN m.has_sell_price = 1 THEN c.price ELSE v.price END AS dam_price_eur_mwh,
  e.price AS gen_lignite_mw, p.price AS gen_gas_mw, s.price AS load_hv_mw
FROM mtus m
LEFT JOIN slots c ON c.series_id = 'click' AND c.ts = m.ts
LEFT JOIN slots v ON v.series_id = 'view' AND v.ts = m.ts
LEFT JOIN slots e ON e.series_id = 'error' AND e.ts = m.ts
LEFT JOIN slots p ON p.series_id = 'purchase' AND p.ts = m.ts
LEFT JOIN slots s ON s.series_id = 'signup' AND s.ts = m.ts
WHERE m.has_price = 1""", _A3_COLS))
def a3(spark, d):
    t = reports.tidy_market_report(report_cells(spark, d))
    return round_doubles(t.select("file", "ts", *_A3_COLS))


# A5: hourly JSON payloads per (city, day) flattened back to one column per city.
_A5_COLS = [f"{z}_value_mean" for z in ZONES]


@reg("A5_flatten_hourly_json", oracle(["""hp AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, event_type AS zone, avg(value) AS price
  FROM events GROUP BY 1, 2)"""], "SELECT ts, " + ", ".join(
    f"max(CASE WHEN zone = '{z}' THEN price END) AS {z}_value_mean" for z in ZONES) + " FROM hp GROUP BY ts",
    _A5_COLS))
def a5(spark, d):
    ev = fx.table(spark, d, "events")
    hourly = ev.groupBy(fx.known_series(F.col("event_type"), ZONES).alias("city"), F.to_date("ts").alias("day"),
                        F.window("ts", "1 hour").start.alias("hts")).agg(F.avg("value").alias("v"))
    per = hourly.groupBy("city", "day").agg(F.array_sort(F.collect_list(F.struct("hts", "v"))).alias("a"))
    payload = F.to_json(F.struct(F.struct(
        F.transform("a", lambda x: F.date_format(x["hts"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.transform("a", lambda x: x["v"]).alias("value_mean")).alias("hourly")))
    landed = per.select("city", payload.alias("payload"))
    flat = feeds.flatten_hourly_json(landed, ["value_mean"], cities=ZONES)
    return round_doubles(flat)


@reg("A7_normalize_grid_feed", oracle([fx.SQL_MARKET],
     "SELECT series_id, ts, solar_mw AS forecast_solar_mw, wind_mw AS forecast_wind_onshore_mw, load_mw AS load_forecast_mw, "
     "price AS gen_hydro_river_mw FROM market", ["forecast_solar_mw", "forecast_wind_onshore_mw", "load_forecast_mw", "gen_hydro_river_mw"]))
def a7(spark, d):
    """Every zone's forecast, load and generation feeds with provider-style
    names, renamed."""
    m = fx.market_grid(spark, d)
    keys = ["series_id", "ts"]
    forecast = m.select(*keys, F.col("solar_mw").alias("Solar"), F.col("wind_mw").alias("Wind Onshore"))
    load = m.select(*keys, F.col("load_mw").alias("Forecasted Load"))
    made = m.select(*keys, F.col("price").alias("('Hydro', 'River')"))
    named = [feeds.normalize_grid_feed(x, kind, keys=("series_id",)) for x, kind in ((forecast, "forecast"), (load, "load"), (made, "generation"))]
    return round_doubles(named[0].join(named[1], keys).join(named[2], keys))


@reg("A11_write_snapshots", oracle([fx.SQL_MARKET], """
SELECT series_id, ts, day AS delivery_date, price,
  lag(price, 96) OVER w AS price_lag96, lag(load_mw, 96) OVER w AS load_mw_lag96, cloud_pct
FROM market WINDOW w AS (PARTITION BY series_id ORDER BY ts)""",
     ["price", "price_lag96", "load_mw_lag96", "cloud_pct"]))
def a11(spark, d):
    """Three feature snapshots partitioned by delivery date, written with
    dynamic partition overwrite; the clean one is read back."""
    from tidewatt.operators import windows
    m = fx.market_grid(spark, d).withColumnRenamed("day", "delivery_date")
    full = windows.add_lags_rolls(m, "price", gate_close=False)
    realistic = windows.add_lags_rolls(m, "price", gate_close=True)
    clean = windows.lag_realized(realistic, ["load_mw", "solar_mw", "wind_mw"], 96)
    path = scratch_path(spark, f"snapshots/{uuid.uuid4().hex[:12]}")
    reports.write_snapshots({"features": full, "features_realistic": realistic, "features_clean": clean}, path)
    back = spark.read.parquet(f"{path}/features_clean")
    return round_doubles(back.select("series_id", "ts", "delivery_date", "price", "price_lag96",
                                     "load_mw_lag96", "cloud_pct"))


@reg("A12_write_reports", oracle([], """
SELECT CAST(day AS VARCHAR) AS date, total_perfect, total_realized FROM (
  SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS total_perfect, count(DISTINCT o_custkey) AS total_realized
  FROM orders GROUP BY 1) x"""))
def a12(spark, d):
    """Summary JSON, daily CSV and per-day folders of a daily table (orders
    and ordering customers a day); the per-day folders are read back."""
    daily = fx.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).alias("total_perfect"), F.count_distinct("o_custkey").alias("total_realized"))
    path = scratch_path(spark, f"reports/{uuid.uuid4().hex[:12]}")
    reports.write_reports(daily.agg(F.sum("total_perfect").alias("orders")), daily, path)
    back = spark.read.option("header", True).schema("total_perfect long, total_realized long, date string").csv(f"{path}/by_day")
    return back.select("date", "total_perfect", "total_realized")


@reg("F4_append_audit", oracle([], "SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1"))
def f4(spark, d):
    """Insert-only audit log: append the audit rows to a fresh log, read it back."""
    path = scratch_path(spark, f"audit_log/{uuid.uuid4().hex[:12]}")
    tables.append_audit(fx.audit_rows(spark, d), path)
    return spark.read.parquet(path).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
