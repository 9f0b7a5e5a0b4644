"""Registered queries: assets, planning expressions, naive plan and fleet dispatch
(C16-C23, E2-E3, E11-E13, E15, J1-J5, K4-K7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatt.functions import composites as cp
from tidewatt.functions.columns import round_doubles
from tidewatt.operators import dispatch, forecast, metrics, tables
from tidewatt.plans import fixtures as fx
from tidewatt.plans.sqlutil import oracle
from tidewatt.session import materialize

Q, SQL = {}, {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def dispatch_frame(spark, d, since=None, until=None):
    """Forecast frame + C22 dispatch price + C19 idle mask (default spec)."""
    fc = fx.forecast_frame(spark, d, since, until)
    mean_mid = F.avg((F.col("q05") + F.col("q95")) / 2.0).over(Window.partitionBy("series_id"))
    return fc.withColumns({
        "dispatch_price": cp.blend_quantiles("q05", "q50", "q95"),
        "is_idle": cp.low_confidence("q05", "q95", mean_mid, F.lit(0.95), F.lit(0.95), F.lit(2.0))})


SQL_DP = SQL_DP_PART = """dp AS (
  SELECT *, 0.6 * q50 + 0.2 * q05 + 0.2 * q95 AS dispatch_price,
    (q95 - q05) < 2.0 + (1.0 - sqrt(0.95 * 0.95)) * avg((q05 + q95) / 2.0) OVER (PARTITION BY series_id) AS is_idle
  FROM fc)"""


# C22 + C23 + C19: dispatch price, idle mask, confidence label.
@reg("C19_C22_C23_dispatch_inputs", oracle([fx.SQL_FORECAST, SQL_DP],
     "SELECT series_id, ts, dispatch_price, is_idle, CASE WHEN is_idle THEN 'low' ELSE 'high' END AS confidence, "
     "strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time_iso FROM dp", ["dispatch_price"]))
def c22(spark, d):
    f = dispatch_frame(spark, d)
    return round_doubles(f.select("series_id", "ts", "dispatch_price", "is_idle",
                                  cp.confidence_label("is_idle").alias("confidence"),
                                  cp.iso_time("ts").alias("time_iso")))


# Derating scenarios x assets.
@reg("C16_derate_assets", oracle([fx.SQL_ASSETS, """sc AS (
  SELECT * FROM (VALUES ('Base', 1.00, 1.00), ('Mild Degradation', 0.97, 0.97),
                        ('Severe Degradation', 0.92, 0.85)) t(scenario, eta_factor, cap_factor))"""], """
SELECT a.asset_id, sc.scenario, a.power_mw * sc.cap_factor AS power_mw, a.energy_mwh * sc.cap_factor AS energy_mwh,
  a.eta_charge * sc.eta_factor AS eta_charge, a.eta_discharge * sc.eta_factor AS eta_discharge
FROM assets a CROSS JOIN sc""", ["power_mw", "energy_mwh", "eta_charge", "eta_discharge"]))
def c16(spark, d):
    a = cp.derate_assets(fx.assets(spark, d))
    return round_doubles(a.select("asset_id", "scenario", "power_mw", "energy_mwh", "eta_charge", "eta_discharge"))


# C17: asset spec from a request (one per supplier: size and rte from the balance band).
@reg("C17_asset_from_request", oracle([], """
SELECT s_suppkey AS asset_id, CAST(10 + 5 * floor(abs(s_acctbal) / 1000.0) AS DOUBLE) AS power_mw,
  CAST(20 + 10 * floor(abs(s_acctbal) / 1000.0) AS DOUBLE) AS energy_mwh,
  sqrt((80.0 + floor(abs(s_acctbal) / 1000.0)) / 100.0) AS eta_charge,
  sqrt((80.0 + floor(abs(s_acctbal) / 1000.0)) / 100.0) AS eta_discharge,
  0.05 AS soc_min_frac, 0.95 AS soc_max_frac, 0.5 AS soc_init_frac, 1.5 AS max_cycles_per_day,
  2.0 AS degradation_eur_per_mwh FROM supplier""",
     ["power_mw", "energy_mwh", "eta_charge", "eta_discharge", "soc_min_frac", "soc_max_frac", "soc_init_frac",
      "max_cycles_per_day", "degradation_eur_per_mwh"]))
def c17(spark, d):
    s = fx.table(spark, d, "supplier")
    band = F.floor(F.abs("s_acctbal") / 1000.0)
    rte = F.lit(80.0) + band
    cols = cp.asset_from_request(rte, F.lit(10.0) + 5.0 * band, F.lit(20.0) + 10.0 * band, F.lit(50.0), F.lit(2.0))
    return round_doubles(s.select(F.col("s_suppkey").alias("asset_id"), *[v.alias(k) for k, v in cols.items()]))


# Price gates per asset from the zone's mean forecast price.
@reg("C18_price_thresholds", oracle([fx.SQL_FORECAST, fx.SQL_ASSETS], """
SELECT a.asset_id, a.degradation_eur_per_mwh AS min_discharge_price,
  m.mean_price * a.eta_charge * a.eta_discharge - 2 * a.degradation_eur_per_mwh AS max_charge_price
FROM assets a JOIN (SELECT series_id, avg(q50) AS mean_price FROM fc GROUP BY 1) m USING (series_id)""",
     ["min_discharge_price", "max_charge_price"]))
def c18(spark, d):
    m = fx.forecast_frame(spark, d).groupBy("series_id").agg(F.avg("q50").alias("mean_price"))
    a = fx.assets(spark, d).join(m, "series_id")
    cols = cp.price_thresholds("mean_price", "eta_charge", "eta_discharge", "degradation_eur_per_mwh")
    return round_doubles(a.select("asset_id", *[v.alias(k) for k, v in cols.items()]))


# E2 + E3 + C21 + C20: daily spread, 33/66 % thresholds, horizon, discount curve.
_SQL_HZ = """sp AS (SELECT series_id, day, avg(q95 - q05) AS spread_mean FROM fc GROUP BY 1, 2),
thr AS (SELECT series_id, quantile_cont(spread_mean, 0.33) AS thr_low, quantile_cont(spread_mean, 0.66) AS thr_high
        FROM sp GROUP BY 1),
hz AS (SELECT sp.*, thr.thr_low, thr.thr_high,
         CAST(CASE WHEN spread_mean <= thr_low THEN 4 WHEN spread_mean <= thr_high THEN 3 ELSE 2 END AS INTEGER)
           AS horizon_days
       FROM sp JOIN thr USING (series_id))"""


def horizon_choice(spark, d):
    daily = metrics.daily_spread_mean(fx.forecast_frame(spark, d))
    thr = metrics.spread_thresholds(daily)
    return daily.join(thr, "series_id").withColumn(
        "horizon_days", cp.choose_horizon("spread_mean", "thr_low", "thr_high"))


@reg("E2_E3_C21_horizon_choice", oracle([fx.SQL_FORECAST, _SQL_HZ],
     "SELECT series_id, day, spread_mean, thr_low, thr_high, horizon_days FROM hz",
     ["spread_mean", "thr_low", "thr_high"]))
def e2_e3(spark, d):
    return round_doubles(horizon_choice(spark, d))


@reg("C20_discount_curve", oracle([fx.SQL_FORECAST, _SQL_HZ], """
SELECT series_id, day, CAST(o.offset AS INTEGER) AS offset,
  CASE WHEN o.offset = 0 THEN 1.0 ELSE 0.1 * pow(0.6, o.offset - 1) END AS discount
FROM hz, LATERAL (SELECT unnest(range(horizon_days)) AS offset) o""", ["discount"]))
def c20(spark, d):
    h = horizon_choice(spark, d)
    o = h.select("series_id", "day", F.explode(F.sequence(F.lit(0), F.col("horizon_days") - 1)).alias("offset"))
    return round_doubles(o.withColumn("discount", cp.discount_factor("offset")))


# E3 (grid): percentile grid of MTU spreads per series, as used by the idle-threshold search.
@reg("E3_spread_percentile_grid", oracle([fx.SQL_FORECAST], """
SELECT series_id, CAST(pct AS INTEGER) AS pct, CASE WHEN pct = 0 THEN 0.0 ELSE v END AS threshold
FROM (SELECT series_id, unnest([0, 5, 10, 15, 20, 25, 30, 40]) AS pct,
        unnest(quantile_cont(q95 - q05, [0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40])) AS v
      FROM fc GROUP BY series_id) x""", ["threshold"]))
def e3_grid(spark, d):
    return round_doubles(spread_grid(fx.forecast_frame(spark, d)))


def spread_grid(fc):
    """Idle thresholds per series for the percentile grid (0 -> no idling).
    One aggregate returns every percentile at once."""
    pcts = metrics.SPREAD_PCT_GRID
    arr = F.percentile(F.col("q95") - F.col("q05"), F.array(*[F.lit(p / 100.0) for p in pcts]))
    g = fc.groupBy("series_id").agg(arr.alias("_q"))
    z = g.select("series_id", F.posexplode("_q").alias("_i", "_v"))
    pct_arr = F.array(*[F.lit(p) for p in pcts])
    return z.select("series_id", F.element_at(pct_arr, F.col("_i") + 1).alias("pct"),
                    F.when(F.element_at(pct_arr, F.col("_i") + 1) == 0, F.lit(0.0)).otherwise(F.col("_v"))
                    .alias("threshold"))


# E12 + E13 + E15 + J5 on the naive plan (SQL-checkable schedule).
_SQL_NAIVE = """nv0 AS (
  SELECT a.asset_id, f.series_id, f.ts, f.day, f.price, f.q50, a.power_mw, a.energy_mwh,
    CASE WHEN hour(f.ts) >= 2 AND hour(f.ts) < 6 THEN a.power_mw ELSE 0.0 END AS n_charge_mw,
    CASE WHEN hour(f.ts) >= 18 AND hour(f.ts) < 22 THEN a.power_mw ELSE 0.0 END AS n_discharge_mw
  FROM fc f JOIN assets a USING (series_id)),
nvs AS (
  SELECT asset_id, day, sum((n_charge_mw + n_discharge_mw) * 0.25) AS thr,
    first(energy_mwh) * 0.9 * 1.5 AS cap
  FROM nv0 GROUP BY 1, 2),
nv AS (
  SELECT nv0.*, CASE WHEN nvs.thr > nvs.cap AND nvs.thr > 0 THEN nvs.cap / nvs.thr ELSE 1.0 END AS scale
  FROM nv0 JOIN nvs USING (asset_id, day))"""


@reg("E12_naive_baseline", oracle([fx.SQL_FORECAST, fx.SQL_ASSETS, _SQL_NAIVE], """
SELECT asset_id, day, CASE WHEN rev > 0 THEN rev * 0.9025 ELSE rev END - deg AS naive_net_eur,
  CASE WHEN rev > 0 THEN rev * 0.9025 ELSE rev END AS naive_gross_eur, deg AS naive_degradation_eur,
  dis / e AS naive_cycles
FROM (SELECT asset_id, day, sum((n_discharge_mw - n_charge_mw) * q50 * 0.25) * first(scale) AS rev,
        2.0 * sum((n_charge_mw + n_discharge_mw) * 0.25) * first(scale) AS deg,
        sum(n_discharge_mw * 0.25) * first(scale) AS dis, first(energy_mwh) AS e
      FROM nv GROUP BY 1, 2) x""", ["naive_net_eur", "naive_gross_eur", "naive_degradation_eur", "naive_cycles"]))
def e12(spark, d):
    """Solved per (zone, normalised spec, day) -- the plan and its money are
    proportional to power at a fixed duration -- then scaled to each asset."""
    a = dispatch.normalise_specs(fx.assets(spark, d)).withColumn("spec_id", dispatch.spec_key())
    specs = a.select("series_id", "spec_id", *dispatch.SPEC_COLS).distinct() \
        .withColumns({"power_mw": F.lit(1.0), "energy_mwh": F.col("duration_h")})
    f = fx.forecast_frame(spark, d).join(specs, "series_id")
    nv = metrics.naive_baseline(f, "q50", ["series_id", "spec_id", "day"])
    j = nv.join(a.select("asset_id", "series_id", "spec_id", "power_mw"), ["series_id", "spec_id"])
    p = F.col("power_mw")
    return round_doubles(j.select("asset_id", "day", (F.col("naive_net_eur") * p).alias("naive_net_eur"),
                                  (F.col("naive_gross_eur") * p).alias("naive_gross_eur"),
                                  (F.col("naive_degradation_eur") * p).alias("naive_degradation_eur"),
                                  "naive_cycles"))


def naive_rows(spark, d):
    """Naive plan rows with the per asset-day budget scale applied (the
    realised ``price`` rides along, so no second forecast frame is built).
    Assets are dealt to tasks by their id; the window's order is that of
    ``soc_trace``, so that rows are sorted once."""
    f = tables.deal(materialize(fx.assets(spark, d)), materialize(fx.forecast_frame(spark, d)), ["series_id"], "asset_id").withColumn("hour", F.hour("ts"))
    s = metrics.naive_schedule(f)
    wd = Window.partitionBy(*dispatch.dealt_keys(s), "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    thr = F.sum((F.col("n_charge_mw") + F.col("n_discharge_mw")) * 0.25).over(wd)
    cap = F.col("energy_mwh") * (F.col("soc_max_frac") - F.col("soc_min_frac")) * F.col("max_cycles_per_day")
    scale = F.when((thr > cap) & (thr > 0), cap / thr).otherwise(F.lit(1.0))
    return s.withColumn("_scale", scale).withColumns({
        "charge_mw": F.col("n_charge_mw") * F.col("_scale"),
        "discharge_mw": F.col("n_discharge_mw") * F.col("_scale")})


# Money of a day on the naive plan, per MW of each normalised spec: legs are
# -1, 0 or 1 MW, so sums are taken once per (zone, spec, day), in time order,
# and the budget scale and the asset's power multiply last.
_SQL_NAIVE_DAY = """leg AS (
  SELECT series_id, day, ts, price, q50,
    CASE WHEN hour(ts) >= 18 AND hour(ts) < 22 THEN 1.0 WHEN hour(ts) >= 2 AND hour(ts) < 6 THEN -1.0 ELSE 0.0 END::DOUBLE AS net
  FROM fc),
legs AS (
  SELECT series_id, day, list(price * net * 0.25 ORDER BY ts) AS gross, list(q50 * net * 0.25 ORDER BY ts) AS planned,
    count(*) FILTER (WHERE net <> 0) * 0.25 AS traded
  FROM leg GROUP BY 1, 2),
unit AS (
  SELECT series_id, day, traded, list_reduce(list_prepend(0.0::DOUBLE, gross), lambda a, b: a + b) AS gross,
    list_reduce(list_prepend(0.0::DOUBLE, planned), lambda a, b: a + b) AS planned
  FROM legs)"""


def naive_day(spark, d):
    """Unit money of the naive plan per (zone, normalised spec, day), with the
    scale that keeps it inside the cycle budget."""
    a = dispatch.normalise_specs(fx.assets(spark, d)).withColumn("spec_id", dispatch.spec_key())
    h = F.hour("ts")
    net = F.when((h >= 18) & (h < 22), 1.0).when((h >= 2) & (h < 6), -1.0).otherwise(0.0)
    rows = fx.forecast_frame(spark, d).withColumn("net", net)
    row = F.struct("ts", (F.col("price") * F.col("net") * 0.25).alias("gross"), (F.col("q50") * F.col("net") * 0.25).alias("planned"))
    days = rows.groupBy("series_id", "day").agg(F.array_sort(F.collect_list(row)).alias("rows"),  # 96 slots at most
                                                (F.count_if(F.col("net") != 0) * 0.25).alias("traded"))
    total = lambda part: F.aggregate("rows", F.lit(0.0), lambda t, x: t + x[part])
    unit = days.select("series_id", "day", "traded", total("gross").alias("gross"), total("planned").alias("planned"))
    specs = a.select("series_id", "spec_id", *dispatch.SPEC_COLS).distinct()
    budget = F.col("duration_h") * (F.col("soc_max_frac") - F.col("soc_min_frac")) * F.col("max_cycles_per_day")
    scale = F.when((F.col("traded") > budget) & (F.col("traded") > 0), budget / F.col("traded")).otherwise(F.lit(1.0))
    return unit.join(specs, "series_id").withColumn("scale", scale), a.select("asset_id", "series_id", "spec_id", "power_mw")


_E13_COLS = ["realized_gross_eur", "realized_degradation_eur", "realized_eur", "abs_net_mwh", "revenue_per_mwh"]


@reg("E13_E15_realized_revenue", oracle([fx.SQL_FORECAST, fx.SQL_ASSETS, _SQL_NAIVE_DAY], """
SELECT asset_id, day, gross * scale * power_mw AS realized_gross_eur,
  degradation_eur_per_mwh * traded * scale * power_mw AS realized_degradation_eur,
  gross * scale * power_mw - degradation_eur_per_mwh * traded * scale * power_mw AS realized_eur,
  traded * scale * power_mw AS abs_net_mwh, planned / nullif(traded, 0) AS revenue_per_mwh
FROM (SELECT u.*, a.asset_id, a.power_mw, a.degradation_eur_per_mwh,
        CASE WHEN traded > a.energy_mwh / a.power_mw * (a.soc_max_frac - a.soc_min_frac) * a.max_cycles_per_day AND traded > 0
             THEN a.energy_mwh / a.power_mw * (a.soc_max_frac - a.soc_min_frac) * a.max_cycles_per_day / traded ELSE 1.0 END AS scale
      FROM unit u JOIN assets a USING (series_id)) x""", money=_E13_COLS, money_places=9))
def e13(spark, d):
    """E13 + E15 on the naive plan: one row of money per (zone, spec, day),
    scaled to each asset by a join."""
    unit, assets = naive_day(spark, d)
    j = unit.join(assets, ["series_id", "spec_id"])
    gross = F.col("gross") * F.col("scale") * F.col("power_mw")
    worn = F.col("degradation_eur_per_mwh") * F.col("traded") * F.col("scale") * F.col("power_mw")
    return round_doubles(j.select("asset_id", "day", gross.alias("realized_gross_eur"), worn.alias("realized_degradation_eur"),
                                  (gross - worn).alias("realized_eur"), (F.col("traded") * F.col("scale") * F.col("power_mw")).alias("abs_net_mwh"),
                                  (F.col("planned") / F.nullif(F.col("traded"), F.lit(0.0))).alias("revenue_per_mwh")), money=_E13_COLS, money_places=9)


@reg("J5_soc_trace", oracle([fx.SQL_FORECAST, fx.SQL_ASSETS, _SQL_NAIVE], """
SELECT asset_id, ts, n_charge_mw * scale AS charge_mw, n_discharge_mw * scale AS discharge_mw,
  0.5 * energy_mwh + sum((0.95 * n_charge_mw * scale - n_discharge_mw * scale / 0.95) * 0.25)
    OVER (PARTITION BY asset_id, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS soc_trace_mwh
FROM nv""", ["charge_mw", "discharge_mw", "soc_trace_mwh"]))
def j5(spark, d):
    s = dispatch.soc_trace(naive_rows(spark, d))
    return round_doubles(s.select("asset_id", "ts", "charge_mw", "discharge_mw", "soc_trace_mwh"))


# ------------------------------------------------------------ DP dispatch --

@reg("J1_fleet_dispatch")
def j1(spark, d):
    f = dispatch_frame(spark, d)
    s = dispatch.fleet_dispatch(f, fx.assets(spark, d), price_col="dispatch_price", idle_col="is_idle")
    return round_doubles(s.select("asset_id", "series_id", "day", "ts", "price", "charge_mw", "discharge_mw",
                                  "net_mw", "soc_mwh", "is_idle"))


@reg("J1_duality_gap")
def j1_gap(spark, d):
    """J1's objective per asset and day beside the bound that no schedule passes."""
    s = dispatch.fleet_dispatch(dispatch_frame(spark, d), fx.assets(spark, d), price_col="dispatch_price", idle_col="is_idle")
    return round_doubles(dispatch.duality_gap(s))


def limited_assets(spark, d):
    """The fleet with ramp, minimum power and price gates as asset columns:
    per supplier either of two ramps and minimum powers, or none."""
    k = F.col("asset_id") % 3
    none = F.lit(None).cast("double")
    return fx.assets(spark, d).withColumns({
        "ramp_mw": F.when(k == 0, none).otherwise(F.col("power_mw") * 0.2 * k),
        "min_power_mw": F.when(k == 1, F.col("power_mw") * 0.1).otherwise(F.lit(0.0)),
        "min_discharge_price": F.when(k == 2, F.col("degradation_eur_per_mwh")).otherwise(none),
        "max_charge_price": none})


@reg("J4_check_schedule_limits")
def j4_limits(spark, d):
    """J1 under asset limits, checked slot by slot, with the distance to the bound."""
    s = dispatch.fleet_dispatch(dispatch_frame(spark, d), limited_assets(spark, d), price_col="dispatch_price", idle_col="is_idle")
    gap = dispatch.duality_gap(s).groupBy("asset_id").agg(F.sum("objective_eur").alias("objective_eur"), F.sum("dual_bound_eur").alias("dual_bound_eur"))
    return round_doubles(dispatch.check_schedule(s).join(gap, "asset_id"))


@reg("J4_check_schedule")
def j4(spark, d):
    f = dispatch_frame(spark, d)
    s = dispatch.fleet_dispatch(f, fx.assets(spark, d), price_col="dispatch_price", idle_col="is_idle")
    return round_doubles(dispatch.check_schedule(s))


# J4 on the naive plan, whose stated SoC is held inside the bounds: the plan
# ignores the battery's level, so the check has something to find.
@reg("J4_check_schedule_naive_plan", oracle([fx.SQL_FORECAST, fx.SQL_ASSETS, _SQL_NAIVE, """tr AS (
  SELECT asset_id, day, ts, power_mw, energy_mwh AS e, n_charge_mw * scale AS c, n_discharge_mw * scale AS x,
    0.5 * energy_mwh + sum((0.95 * n_charge_mw * scale - n_discharge_mw * scale / 0.95) * 0.25)
      OVER (PARTITION BY asset_id, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS trace
  FROM nv),
pd AS (
  SELECT asset_id, day, count(*) FILTER (WHERE c > power_mw + 1e-6 OR x > power_mw + 1e-6) AS power_v,
    count(*) FILTER (WHERE abs(least(greatest(trace, 0.05 * e), 0.95 * e) - trace) > 1e-6 * greatest(e, 1.0)) AS bal_v,
    count(*) FILTER (WHERE c > 1e-6 AND x > 1e-6) AS mode_v, sum((c + x) * 0.25) AS thr, first(2.0 * 1.5 * e) AS cap
  FROM tr GROUP BY 1, 2)"""], """
SELECT asset_id, CAST(sum(power_v) AS BIGINT) AS power_violations, CAST(0 AS BIGINT) AS soc_violations,
  CAST(sum(bal_v) AS BIGINT) AS balance_violations, CAST(sum(mode_v) AS BIGINT) AS mode_violations,
  count(*) FILTER (WHERE thr > cap + 1e-6) AS throughput_violations, sum(thr) AS throughput_mwh, count(*) AS days
FROM pd GROUP BY 1""", ["throughput_mwh"]))
def j4_naive(spark, d):
    s = dispatch.soc_trace(naive_rows(spark, d))
    held = F.least(F.greatest("soc_trace_mwh", F.col("soc_min_frac") * F.col("energy_mwh")), F.col("soc_max_frac") * F.col("energy_mwh"))
    return round_doubles(dispatch.check_schedule(s.withColumn("soc_mwh", held).drop("soc_trace_mwh")))


@reg("E11_dispatch_kpis")
def e11(spark, d):
    return round_doubles(kpis_with_uplift(spark, d, fx.assets(spark, d)))


@reg("E11_dispatch_kpis_scenarios")
def e11_scenarios(spark, d):
    """The same for every derating scenario of C16."""
    return round_doubles(kpis_with_uplift(spark, d, cp.derate_assets(fx.assets(spark, d))))


@reg("J4_check_schedule_scenarios")
def j4_scenarios(spark, d):
    s = dispatch.fleet_dispatch(dispatch_frame(spark, d), cp.derate_assets(fx.assets(spark, d)), price_col="dispatch_price", idle_col="is_idle")
    return round_doubles(dispatch.check_schedule(s))


def kpis_with_uplift(spark, d, assets):
    """E11 per asset[, scenario] and the uplift over the naive plan, both
    summed per (zone, spec) and scaled to the assets."""
    f = dispatch_frame(spark, d)
    a = dispatch.normalise_specs(assets)
    s = dispatch.spec_dispatch(f, a, price_col="dispatch_price", idle_col="is_idle")
    k = dispatch.fleet_kpis(s.join(f.select("series_id", "ts", "q50"), ["series_id", "ts"]), a, price="q50")
    specs = a.withColumn("spec_id", dispatch.spec_key())
    units = specs.select("series_id", "spec_id", *dispatch.SPEC_COLS).distinct() \
        .withColumns({"power_mw": F.lit(1.0), "energy_mwh": F.col("duration_h")})
    naive = metrics.naive_baseline(f.join(units, "series_id"), "q50", ["series_id", "spec_id"])
    keys = dispatch.asset_keys(a)
    scaled = naive.join(specs.select(*keys, "series_id", "spec_id", "power_mw"), ["series_id", "spec_id"])
    money = [c for c in naive.columns if c.endswith("_eur")]
    scaled = scaled.withColumns({c: F.col(c) * F.col("power_mw") for c in money}).select(*keys, *money, "naive_cycles")
    return metrics.uplift(k.drop("spec_id", "series_id"), scaled, keys)


@reg("J3_backtest_daily")
def j3(spark, d):
    f = dispatch_frame(spark, d)
    return round_doubles(dispatch.backtest_daily(f, fx.assets(spark, d), idle_col="is_idle"))


@reg("J2_dispatch_horizon")
def j2(spark, d):
    f = dispatch_frame(spark, d).withColumn("h", F.lit(2))
    bt = dispatch.backtest_daily(f, fx.assets(spark, d), idle_col="is_idle", horizon_col="h",
                                 discount=(0.1, 0.6))
    return round_doubles(bt)


# ----------------------------------------------------------------- sweeps --

@reg("K4_tune_threshold")
def k4(spark, d):
    return round_doubles(tuned_threshold(dispatch_frame(spark, d), fx.assets(spark, d)))


def tuned_threshold(frame, assets, valid_days=7, test_days=7):
    """Idle-threshold search.  The percentile grid and each point's revenue come
    from the validation days alone; the best point per (zone, spec), ties to the
    lowest percentile, is then scored on the test days after them."""
    f = materialize(forecast.time_split(frame, valid_days, test_days))   # read by grid, trial and test
    valid, test = f.where("split = 'valid'"), f.where("split = 'test'")
    # the grid has 8 rows per series (grows with the series count): AQE
    # decides the join strategy from its real size
    grid = spread_grid(valid)
    idle = {"idle_k": (F.col("q95") - F.col("q05")) < F.col("threshold")}
    zone = ["series_id", "spec_id"]
    total = lambda bt: bt.groupBy(*zone, "pct").agg(*(F.sum(c).alias(c) for c in ("realized_eur", "perfect_eur")))
    tried = total(dispatch.backtest_daily(valid.join(grid, "series_id").withColumns(idle), assets, extra_keys=["pct"], idle_col="idle_k"))
    best = metrics.best_by(tried, "realized_eur", zone, ["pct"]).withColumnsRenamed({"realized_eur": "valid_realized_eur", "perfect_eur": "valid_perfect_eur"})
    # specs of a zone may choose different points: each chosen point is scored once
    points = best.select("series_id", "pct").distinct().join(grid, ["series_id", "pct"])
    scored = total(dispatch.backtest_daily(test.join(points, "series_id").withColumns(idle), assets, extra_keys=["pct"], idle_col="idle_k"))
    return best.join(scored, [*zone, "pct"], "left").join(grid, ["series_id", "pct"])


def sweep_conclusion(summary, point):
    """Marks each zone's best point by mean capture and by EUR (ties: the
    lowest) and adds the EUR gained over the lowest point.  A zone has as many
    rows as the sweep has points."""
    zone = Window.partitionBy("series_id")
    best = lambda metric: F.max_by(point, F.struct(metric, -F.col(point))).over(zone)
    return summary.withColumns({
        "best_by_capture": F.col(point) == best("mean_capture"), "best_by_eur": F.col(point) == best("total_realized_eur"),
        "delta_eur": F.col("total_realized_eur") - F.min_by("total_realized_eur", point).over(zone)})


ALPHAS = [round(0.1 * i, 1) for i in range(11)]


@reg("K5_alpha_sweep")
def k5(spark, d):
    """D1 discount sweep on 2-day horizons, summarised per (zone, alpha)."""
    f = dispatch_frame(spark, d).withColumn("h", F.lit(2))
    fa = f.withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in ALPHAS])))   # 11-point grid
    bt = dispatch.backtest_daily(fa, fx.assets(spark, d), extra_keys=["alpha"], idle_col="is_idle",
                                 horizon_col="h", discount=("alpha", 1.0))
    return round_doubles(sweep_conclusion(metrics.capture_summary(bt, ["series_id", "alpha"]), "alpha"))


@reg("K6_horizon_sweep")
def k6(spark, d):
    """Horizons 2..7 with a flat 0.1 discount; single-day fallback near the end."""
    f = dispatch_frame(spark, d)
    fh = f.withColumn("h", F.explode(F.sequence(F.lit(2), F.lit(7))))   # horizons 2..7
    bt = dispatch.backtest_daily(fh, fx.assets(spark, d), extra_keys=["h"], idle_col="is_idle",
                                 horizon_col="h", discount=(0.1, 1.0))
    return round_doubles(sweep_conclusion(metrics.capture_summary(bt, ["series_id", "h"]), "h"))


@reg("K7_dynamic_backtest")
def k7(spark, d):
    """Horizon per day from the spread regime (E2 -> E3 -> C21), then J2 with
    the 0.1 x 0.6^(i-1) discount curve; summary (E7) and horizon counts (E9)."""
    f = dispatch_frame(spark, d)
    h = horizon_choice(spark, d).select("series_id", "day", "horizon_days")
    fh = f.join(h, ["series_id", "day"])
    bt = dispatch.backtest_daily(fh, fx.assets(spark, d), idle_col="is_idle", horizon_col="horizon_days",
                                 discount=(0.1, 0.6))
    s = metrics.capture_summary(bt, ["series_id"])
    hc = metrics.horizon_counts(bt.withColumn("horizon_days", F.col("horizon_days")))
    return round_doubles(s.join(hc.select("series_id", F.to_json("horizon_counts").alias("horizon_counts")),
                                "series_id"))


# E11 on the naive plan (SQL-checkable schedule): fleet KPIs per asset.
_E11_COLS = ["gross_revenue_eur", "degradation_eur", "cycles_used", "energy_traded_mwh", "abs_net_mwh",
             "net_profit_eur", "daily_profit_eur", "annualized_revenue_eur", "revenue_per_mwh"]


@reg("E11_dispatch_kpis_naive_plan", oracle([fx.SQL_FORECAST, fx.SQL_ASSETS, _SQL_NAIVE], """
SELECT asset_id, gross_revenue_eur, degradation_eur, cycles_used, energy_traded_mwh, abs_net_mwh, idle_count,
  total_mtus, gross_revenue_eur - degradation_eur AS net_profit_eur,
  (gross_revenue_eur - degradation_eur) / (total_mtus * 0.25 / 24.0) AS daily_profit_eur,
  (gross_revenue_eur - degradation_eur) / (total_mtus * 0.25 / 24.0) * 365.0 AS annualized_revenue_eur,
  gross_revenue_eur / nullif(abs_net_mwh, 0) AS revenue_per_mwh
FROM (
  SELECT asset_id, sum(q50 * (n_discharge_mw - n_charge_mw) * scale * 0.25) AS gross_revenue_eur,
    sum(2.0 * (n_charge_mw + n_discharge_mw) * scale * 0.25) AS degradation_eur,
    sum(n_discharge_mw * scale * 0.25 / energy_mwh) AS cycles_used,
    sum((n_charge_mw + n_discharge_mw) * scale * 0.25) AS energy_traded_mwh,
    sum(abs(n_discharge_mw - n_charge_mw) * scale * 0.25) AS abs_net_mwh,
    CAST(0 AS BIGINT) AS idle_count, count(*) AS total_mtus
  FROM nv GROUP BY asset_id) x""", _E11_COLS))
def e11_naive(spark, d):
    s = naive_rows(spark, d).withColumn("is_idle", F.lit(False))
    k = metrics.dispatch_kpis(s, ["asset_id"], price="q50")
    return round_doubles(k.select("asset_id", *_E11_COLS, "idle_count", "total_mtus"))
