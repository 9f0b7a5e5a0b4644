"""Roles of the driver tables (see FIXTURES.md "Mapping to the driver tables").

Each role has a Spark builder and the equivalent DuckDB SQL fragment (a
``WITH`` clause body) so every registered query and its oracle read the same
derived data.  All work grows with the input tables: nothing here is a fixed
literal input except the small declared dimensions (tiers, scenarios).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatt.operators import align

SIGNALS = ["price", "load_mw", "solar_mw", "wind_mw", "cloud_pct"]
INTERP_SIGNALS = ["load_mw", "solar_mw", "wind_mw", "cloud_pct"]


_PLANS: dict = {}


def _landed(spark: SparkSession, d: str, names: tuple[str, ...]) -> tuple:
    """Names, lengths and times of the tables' files, listed anew."""
    files = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    return tuple(files)


def _planned(*names: str):
    """Keep the lazy DataFrame that a role builder returns as long as the files
    of its tables stay the same: a file that lands or changes gives a new plan.
    Only the logical plan is kept, never data, and 256 of them at most; it
    saves building long expression trees over py4j for every query."""
    def wrap(fn):
        def builder(spark, d, *args):
            key = (fn.__name__, spark.sparkContext.applicationId, d, args, _landed(spark, d, names))
            df = _PLANS.get(key)
            if df is None or df.sparkSession is not spark:
                if len(_PLANS) >= 256:
                    _PLANS.pop(next(iter(_PLANS)))
                df = _PLANS[key] = fn(spark, d, *args)
            return df
        builder.__name__, builder.__doc__ = fn.__name__, fn.__doc__
        return builder
    return wrap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The driver table as a DataFrame, its files listed anew at each call."""
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------ price slots --

@_planned("events")
def price_slots(spark: SparkSession, d: str, since=None, until=None) -> DataFrame:
    """H2 batch twin: 15-minute tumbling aggregates of ``events`` per series
    (``event_type``).  price = mean value; the other signals are the sum,
    max, min of the value and the mean of the JSON ``k`` (a 0-99 %).
    ``since`` / ``until`` (timestamps) restrict the scan (pushed to Parquet)."""
    ev = table(spark, d, "events")
    if since is not None:
        ev = ev.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        ev = ev.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    k = F.get_json_object("props", "$.k").cast("double")
    return align.slot_aggregate(
        ev.withColumnRenamed("event_type", "series_id"),
        {"price": F.avg("value"), "load_mw": F.sum("value"), "solar_mw": F.max("value"),
         "wind_mw": F.min("value"), "cloud_pct": F.avg(k), "n_obs": F.count(F.lit(1))})


SQL_SLOTS = """slots AS (
  SELECT event_type AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
         avg(value) AS price, sum(value) AS load_mw, max(value) AS solar_mw,
         min(value) AS wind_mw, avg(CAST(json_extract(props, '$.k') AS DOUBLE)) AS cloud_pct,
         count(*) AS n_obs
  FROM events GROUP BY 1, 2)"""

SQL_GRID = """grid AS (
  SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTE)) AS ts
  FROM slots GROUP BY series_id)"""


@_planned("events")
def market_grid(spark: SparkSession, d: str, since=None, until=None) -> DataFrame:
    """P1 aligned frame: B1 grid, B2 as-of price, B3 interpolated signals."""
    slots = price_slots(spark, d, since, until)
    # one scan, one aggregate shuffle, then windows on the series partitioning
    g = align.grid_from_rows(slots, ["price", *INTERP_SIGNALS])
    g = align.interpolate_time(g, INTERP_SIGNALS, ffill=["price"])
    return g.select("series_id", "ts", "price", *INTERP_SIGNALS, F.to_date("ts").alias("day"))


SQL_MARKET = SQL_SLOTS + ",\n" + SQL_GRID + """,
ff AS (
  SELECT g.series_id, g.ts, s.price
  FROM grid g ASOF LEFT JOIN slots s ON g.series_id = s.series_id AND g.ts >= s.ts),
raw AS (
  SELECT g.series_id, g.ts, s.load_mw, s.solar_mw, s.wind_mw, s.cloud_pct,
         row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) AS rn,
         epoch(g.ts) AS secs
  FROM grid g LEFT JOIN slots s USING (series_id, ts)),
bounds AS (
  SELECT *,
    last_value(CASE WHEN load_mw IS NOT NULL THEN rn END IGNORE NULLS) OVER w1 AS p_rn,
    last_value(CASE WHEN load_mw IS NOT NULL THEN secs END IGNORE NULLS) OVER w1 AS p_t,
    first_value(CASE WHEN load_mw IS NOT NULL THEN secs END IGNORE NULLS) OVER w2 AS n_t,
    last_value(load_mw IGNORE NULLS) OVER w1 AS p_load, first_value(load_mw IGNORE NULLS) OVER w2 AS n_load,
    last_value(solar_mw IGNORE NULLS) OVER w1 AS p_solar, first_value(solar_mw IGNORE NULLS) OVER w2 AS n_solar,
    last_value(wind_mw IGNORE NULLS) OVER w1 AS p_wind, first_value(wind_mw IGNORE NULLS) OVER w2 AS n_wind,
    last_value(cloud_pct IGNORE NULLS) OVER w1 AS p_cloud, first_value(cloud_pct IGNORE NULLS) OVER w2 AS n_cloud
  FROM raw
  WINDOW w1 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         w2 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
market AS (
  SELECT b.series_id, b.ts, CAST(b.ts AS DATE) AS day, f.price,
    CASE WHEN load_mw IS NOT NULL THEN load_mw WHEN p_rn IS NULL OR rn - p_rn > 4 THEN NULL
         WHEN n_t IS NULL THEN p_load ELSE p_load + (n_load - p_load) * (secs - p_t) / (n_t - p_t) END AS load_mw,
    CASE WHEN solar_mw IS NOT NULL THEN solar_mw WHEN p_rn IS NULL OR rn - p_rn > 4 THEN NULL
         WHEN n_t IS NULL THEN p_solar ELSE p_solar + (n_solar - p_solar) * (secs - p_t) / (n_t - p_t) END AS solar_mw,
    CASE WHEN wind_mw IS NOT NULL THEN wind_mw WHEN p_rn IS NULL OR rn - p_rn > 4 THEN NULL
         WHEN n_t IS NULL THEN p_wind ELSE p_wind + (n_wind - p_wind) * (secs - p_t) / (n_t - p_t) END AS wind_mw,
    CASE WHEN cloud_pct IS NOT NULL THEN cloud_pct WHEN p_rn IS NULL OR rn - p_rn > 4 THEN NULL
         WHEN n_t IS NULL THEN p_cloud ELSE p_cloud + (n_cloud - p_cloud) * (secs - p_t) / (n_t - p_t) END AS cloud_pct
  FROM bounds b JOIN ff f USING (series_id, ts))"""


# ------------------------------------------------------------ forecasts ----

@_planned("events")
def forecast_frame(spark: SparkSession, d: str, since=None, until=None) -> DataFrame:
    """M10 seasonal-naive interval forecast on the market grid:
    q50 = price 96 slots ago, q05/q95 = q50 -/+ 1.645 x the gate-close
    rolling std (96 rows ending 96 rows ago).  Rows without a forecast drop."""
    from tidewatt.operators.forecast import seasonal_naive_interval
    return seasonal_naive_interval(market_grid(spark, d, since, until), "price")


SQL_FORECAST = SQL_MARKET + """,
fc0 AS (
  SELECT series_id, ts, day, price,
    lag(price, 96) OVER (PARTITION BY series_id ORDER BY ts) AS q50,
    CASE WHEN count(price) OVER wr = 96 THEN stddev_samp(price) OVER wr END AS sd
  FROM market
  WINDOW wr AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 191 PRECEDING AND 96 PRECEDING)),
fc AS (
  SELECT series_id, ts, day, price, q50 - 1.645 * sd AS q05, q50, q50 + 1.645 * sd AS q95
  FROM fc0 WHERE q50 IS NOT NULL AND sd IS NOT NULL)"""


# --------------------------------------------------------------- assets ----

@_planned("events", "region")
def zones(spark: SparkSession, d: str) -> DataFrame:
    """Zone dimension: region i <-> the i-th series in name order.  A series
    without a region is an error, not a row that goes missing."""
    ev_types = (table(spark, d, "events").select(F.col("event_type").alias("series_id")).distinct()
                .withColumn("zone_rank", F.row_number().over(Window.orderBy("series_id")) - 1))
    reg = table(spark, d, "region").select("r_regionkey", "r_name")
    z = ev_types.join(reg, reg.r_regionkey == ev_types.zone_rank, "left")
    lost = F.raise_error(F.concat(F.lit("no region for series "), F.col("series_id"))).cast("string")
    return z.select(F.col("zone_rank").cast("int").alias("r_regionkey"), F.coalesce("r_name", lost).alias("r_name"), "series_id")


def known_series(col, known: list[str]):
    """The series name; one that a fixed layout has no place for is an error."""
    return F.when(col.isin(*known), col).otherwise(F.raise_error(F.concat(F.lit("no place for series "), col)).cast("string"))


SQL_ZONES = """zones AS (
  SELECT r.r_regionkey, r.r_name, e.series_id
  FROM region r JOIN (SELECT series_id, row_number() OVER (ORDER BY series_id) - 1 AS zone_rank
                      FROM (SELECT DISTINCT event_type AS series_id FROM events)) e
    ON r.r_regionkey = e.zone_rank)"""


@_planned("events", "region", "nation", "supplier")
def assets(spark: SparkSession, d: str) -> DataFrame:
    """One battery per supplier, sited in its nation's region zone.
    power = 10 + 5 x floor(|acctbal| / 1000) MW; two hours of energy, four for
    suppliers in debit; the other fields are the default spec."""
    s = table(spark, d, "supplier")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    z = zones(spark, d)
    power = F.lit(10.0) + F.lit(5.0) * F.floor(F.abs(F.col("s_acctbal")) / 1000.0)
    hours = F.when(F.col("s_acctbal") < 0, 4.0).otherwise(2.0)
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .join(z, F.col("n_regionkey") == z.r_regionkey)
            .select(F.col("s_suppkey").alias("asset_id"), "series_id",
                    power.alias("power_mw"), (power * hours).alias("energy_mwh"),
                    F.lit(0.95).alias("eta_charge"), F.lit(0.95).alias("eta_discharge"),
                    F.lit(0.05).alias("soc_min_frac"), F.lit(0.95).alias("soc_max_frac"),
                    F.lit(0.5).alias("soc_init_frac"), F.lit(1.5).alias("max_cycles_per_day"),
                    F.lit(2.0).alias("degradation_eur_per_mwh")))


SQL_ASSETS = SQL_ZONES + """,
assets AS (
  SELECT s.s_suppkey AS asset_id, z.series_id,
         10.0 + 5.0 * floor(abs(s.s_acctbal) / 1000.0) AS power_mw,
         (10.0 + 5.0 * floor(abs(s.s_acctbal) / 1000.0)) * CASE WHEN s.s_acctbal < 0 THEN 4.0 ELSE 2.0 END AS energy_mwh,
         0.95 AS eta_charge, 0.95 AS eta_discharge, 0.05 AS soc_min_frac, 0.95 AS soc_max_frac,
         0.5 AS soc_init_frac, 1.5 AS max_cycles_per_day, 2.0 AS degradation_eur_per_mwh
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN zones z ON n.n_regionkey = z.r_regionkey)"""


# ----------------------------------------------------------- daily feeds ---

def daily_feeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two daily closes: gas proxy = mean order total per order date, carbon
    proxy = mean line price per ship date."""
    o = (table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
         .agg(F.avg("o_totalprice").alias("ttf_eur_mwh")))
    li = (table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"))
          .agg(F.avg("l_extendedprice").alias("eua_eur_t")))
    return o, li


SQL_DAILY = """gas AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS ttf_eur_mwh
                FROM orders GROUP BY 1),
carbon AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice) AS eua_eur_t
           FROM lineitem GROUP BY 1)"""


# ------------------------------------------------------- operational rows --

def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    """audit_log rows: one per event; ts in epoch seconds, details = props."""
    ev = table(spark, d, "events")
    return ev.select(F.col("event_id").alias("id"),
                     F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
                     F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_id"),
                     F.col("event_type").alias("action"), F.lit("schedule").alias("resource"),
                     F.lit(None).cast("string").alias("ip_address"),
                     F.col("props").alias("details"))


SQL_AUDIT = """audit AS (
  SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, 'user' || CAST(user_id AS VARCHAR) AS user_id,
         event_type AS action, 'schedule' AS resource, CAST(NULL AS VARCHAR) AS ip_address,
         props AS details
  FROM events)"""


def api_calls(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.select(F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("key_id"),
                     F.col("ts"), F.col("event_id").alias("call_id"),
                     F.col("event_type").alias("endpoint"))


SQL_CALLS = """calls AS (
  SELECT 'key-' || CAST(user_id AS VARCHAR) AS key_id, ts, event_id AS call_id, event_type AS endpoint
  FROM events)"""


# Subscription tiers (name, label, rate limit per minute,
# monthly quota (0 = unlimited), optimize allowed, webhooks allowed,
# monthly price EUR, metered price EUR cents per call).
TIERS = [
    ("free", "Free", 10, 500, False, False, 0, 0),
    ("payg", "Pay-as-you-go", 60, 0, True, False, 0, 8),
    ("pro", "Pro", 120, 50000, True, True, 499, 0),
    ("enterprise", "Enterprise", 600, 1000000, True, True, 2499, 0),
]
TIER_SCHEMA = ("name string, label string, rate_limit int, monthly_call_quota int, "
               "can_use_optimize boolean, can_use_webhooks boolean, price_eur_month int, "
               "payg_price_eur_cents int")


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, TIER_SCHEMA)


SQL_TIERS = """tiers AS (
  SELECT * FROM (VALUES
    ('free', 'Free', 10, 500, false, false, 0, 0),
    ('payg', 'Pay-as-you-go', 60, 0, true, false, 0, 8),
    ('pro', 'Pro', 120, 50000, true, true, 499, 0),
    ('enterprise', 'Enterprise', 600, 1000000, true, true, 2499, 0))
  t(name, label, rate_limit, monthly_call_quota, can_use_optimize, can_use_webhooks,
    price_eur_month, payg_price_eur_cents))"""


def key_tiers(spark: SparkSession, d: str) -> DataFrame:
    """API keys: one per customer-side user id, tier by market segment rank."""
    c = table(spark, d, "customer")
    seg = F.when(F.col("c_mktsegment") == "BUILDING", "pro") \
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "payg") \
        .when(F.col("c_mktsegment") == "MACHINERY", "enterprise").otherwise("free")
    return c.select(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("key_id"),
                    seg.alias("tier"))


SQL_KEY_TIERS = """key_tiers AS (
  SELECT 'key-' || CAST(c_custkey AS VARCHAR) AS key_id,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'pro' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'payg'
              WHEN c_mktsegment = 'MACHINERY' THEN 'enterprise' ELSE 'free' END AS tier
  FROM customer)"""


def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    """Webhook subscriptions: one per customer; owner = market segment;
    customers with a positive balance also take forecast events; customers
    in debit are disabled."""
    c = table(spark, d, "customer")
    events = F.when(F.col("c_acctbal") > 0, F.lit("optimize.completed,forecast.refreshed")) \
        .otherwise(F.lit("optimize.completed"))
    return c.select(F.concat(F.lit("wh-"), F.col("c_custkey").cast("string")).alias("id"),
                    F.col("c_mktsegment").alias("owner"), F.col("c_name").alias("label"),
                    F.concat(F.lit("https://hooks.example/"), F.col("c_custkey").cast("string")).alias("url"),
                    events.alias("events"),
                    F.sha2(F.col("c_name"), 256).alias("secret_hash"),
                    (F.col("c_acctbal") < 0).cast("int").alias("disabled"))


SQL_SUBS = """subs AS (
  SELECT 'wh-' || CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS owner, c_name AS label,
         'https://hooks.example/' || CAST(c_custkey AS VARCHAR) AS url,
         CASE WHEN c_acctbal > 0 THEN 'optimize.completed,forecast.refreshed'
              ELSE 'optimize.completed' END AS events,
         sha256(c_name) AS secret_hash,
         CAST(c_acctbal < 0 AS INTEGER) AS disabled
  FROM customer)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
