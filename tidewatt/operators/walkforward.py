"""Walk-forward evaluation over the K2 folds, one job over fold keys.

Per (series, fold): the interval forecast is shifted by the validation
residuals (all three quantiles), the idle threshold is chosen on the
validation days, and the following week is scored with it.  Only model fits
loop over folds; everything else is grouped by (series, fold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt.operators import forecast, metrics
from tidewatt.session import materialize

KEY = "series_id"
FOLD = [KEY, "fold"]
QUANTILES = {"q05": 0.05, "q50": 0.50, "q95": 0.95}
#: Hours of the naive plan's legs, its daily cycle budget (MWh a MW) and wear
#: (EUR a MWh) for the default two-hour battery.
BUDGET, WEAR = 2.0 * 0.9 * 1.5, 2.0


def fold_rows(frame: DataFrame, folds: DataFrame, valid_days: int = 7, ts: str = "ts") -> DataFrame:
    """The frame's rows of each fold's validation days and week, by ``role``."""
    j = frame.join(folds.select(*FOLD, "fold_start", "fold_end"), KEY)
    role = (F.when((F.col(ts) >= F.col("fold_start") - F.make_interval(days=F.lit(valid_days))) & (F.col(ts) < F.col("fold_start")), "valid")
            .when((F.col(ts) >= F.col("fold_start")) & (F.col(ts) < F.col("fold_end")), "week"))
    return j.withColumn("role", role).where("role is not null").drop("fold_start", "fold_end")


def calibrated(rows: DataFrame, actual: str = "price") -> DataFrame:
    """All quantiles shifted by their fold's validation residuals, and the
    dispatch price and spread they give."""
    shifts = forecast.conformal_shift(rows.where("role = 'valid'"), QUANTILES, actual, FOLD)
    out = forecast.conformal_calibrate(rows, shifts, list(QUANTILES), FOLD)
    return out.withColumns({"dispatch_price": 0.6 * F.col("q50") + 0.2 * F.col("q05") + 0.2 * F.col("q95"), "spread": F.col("q95") - F.col("q05")})


def idle_grid(valid: DataFrame) -> DataFrame:
    """Thresholds per (series, fold): percentiles of the validation spreads,
    0 for none."""
    pcts = metrics.SPREAD_PCT_GRID
    g = valid.groupBy(*FOLD).agg(F.percentile("spread", F.array(*(F.lit(p / 100.0) for p in pcts))).alias("q"))
    g = g.select(*FOLD, F.posexplode("q").alias("i", "v"))
    pct = F.element_at(F.array(*map(F.lit, pcts)), F.col("i") + 1)
    return g.select(*FOLD, pct.alias("pct"), F.when(pct == 0, 0.0).otherwise(F.col("v")).alias("threshold"))


def naive_days(rows: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    """EUR a MW and day of the naive plan with idle slots left out, held to
    the cycle budget; ``perfect_eur`` takes only the legs that pay."""
    h = F.hour("ts")
    net = F.when((h >= 18) & (h < 22), 1.0).when((h >= 2) & (h < 6), -1.0).otherwise(0.0)
    legs = rows.withColumn("net", net).withColumn("gain", F.col(price) * F.col("net") * 0.25)
    runs = (F.col("net") != 0) & ~(F.col("spread") < F.col("threshold"))
    pays = (F.col("net") != 0) & (F.col("gain") > WEAR * 0.25)
    held = lambda money, mwh: money * F.least(F.lit(1.0), F.coalesce(F.lit(BUDGET) / F.nullif(mwh, F.lit(0.0)), F.lit(1.0)))
    g = legs.groupBy(*keys, "day").agg(
        F.sum(F.when(runs, F.col("gain")).otherwise(0.0)).alias("_gross"), (F.count_if(runs) * 0.25).alias("_mwh"),
        F.sum(F.when(pays, F.col("gain") - WEAR * 0.25).otherwise(0.0)).alias("_best"), (F.count_if(pays) * 0.25).alias("_best_mwh"),
        F.count_if(F.col("spread") < F.col("threshold")).alias("idle_mtus"))
    return g.select(*keys, "day", held(F.col("_gross") - WEAR * F.col("_mwh"), F.col("_mwh")).alias("realized_eur"),
                    held(F.col("_best"), F.col("_best_mwh")).alias("perfect_eur"), "idle_mtus")


def chosen_threshold(days: DataFrame, grid: DataFrame) -> DataFrame:
    """The grid point with the largest realised total of the validation days
    (to 1e-6 EUR); ties go to the lowest percentile."""
    total = days.groupBy(*FOLD, "pct").agg(F.round(F.sum("realized_eur"), 6).alias("total"))
    best = total.groupBy(*FOLD).agg(F.max_by("pct", F.struct("total", -F.col("pct"))).alias("pct"))
    return best.join(grid, [*FOLD, "pct"])


def fold_summary(days: DataFrame, best: DataFrame) -> DataFrame:
    """E7 per (series, fold), with the threshold that was used."""
    s = days.groupBy(*FOLD).agg(F.count(F.lit(1)).alias("n_days"), F.sum("realized_eur").alias("realized_eur"), F.sum("perfect_eur").alias("perfect_eur"),
                                F.sum("idle_mtus").alias("idle_mtus"))
    capture = F.when(F.col("perfect_eur") > 0, F.col("realized_eur") / F.col("perfect_eur")).otherwise(0.0)
    return s.withColumn("capture_ratio", capture).join(best.select(*FOLD, "pct", "threshold"), FOLD)


def naive_walkforward(frame: DataFrame, folds: DataFrame) -> DataFrame:
    """The whole evaluation with the naive plan as scheduler."""
    rows = materialize(calibrated(fold_rows(frame, folds)))  # read by grid, trial and week
    valid, week = rows.where("role = 'valid'"), rows.where("role = 'week'")
    grid = idle_grid(valid)
    best = chosen_threshold(naive_days(valid.join(grid, FOLD), [*FOLD, "pct"]), grid)
    return fold_summary(naive_days(week.join(best, FOLD), FOLD), best)


def dispatch_walkforward(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """The same with the dispatch solver, on calibrated rows of all folds."""
    from tidewatt.operators import dispatch
    valid, week = rows.where("role = 'valid'"), rows.where("role = 'week'")
    grid = idle_grid(valid)
    idle = {"is_idle": F.col("spread") < F.col("threshold")}
    per_day = lambda bt, keys: bt.groupBy(*keys, "day").agg(*(F.sum(c).alias(c) for c in ("realized_eur", "perfect_eur")), F.max("idle_mtus").alias("idle_mtus"))
    tried = dispatch.backtest_daily(valid.join(grid, FOLD).withColumns(idle), assets, extra_keys=["fold", "pct"], idle_col="is_idle")
    best = chosen_threshold(per_day(tried, [*FOLD, "pct"]), grid)
    scored = dispatch.backtest_daily(week.join(best, FOLD).withColumns(idle), assets, extra_keys=["fold"], idle_col="is_idle")
    return fold_summary(per_day(scored, FOLD), best)
