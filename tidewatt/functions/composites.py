"""Composite market features and asset / planning expressions.

Pure column expressions: they compile into the surrounding projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt.functions.columns import clip, col_, nullable_sum, safe_div, zero_filled_sum

# Fuel-cost proxy, spike-score weights and hour bands.
CCGT_GAS_FACTOR = 2.0
CCGT_CARBON_FACTOR = 0.37
MIDDAY_HOURS = (10, 14)
EVENING_HOURS = (17, 22)
MORNING_HOURS = (6, 9)
SPIKE_WEIGHTS = {"cloud": 0.20, "solar_deficit": 0.30, "thermal": 0.25,
                 "evening": 0.15, "weekday": 0.10}
BLEND_WEIGHTS = {"q50": 0.6, "q05": 0.2, "q95": 0.2}
HORIZON_MIN, HORIZON_MID, HORIZON_MAX = 2, 3, 4
FUTURE_BASE_DISCOUNT = 0.1
FUTURE_DECAY = 0.6


def load_total(hv, mv, lv) -> Column:
    """Sum of three load columns, NULL only when all are NULL."""
    return nullable_sum(hv, mv, lv)


def res_total_forecast(solar, wind) -> Column:
    """Solar + wind forecast with NULL read as 0."""
    return zero_filled_sum(solar, wind)


def net_export(production, demand) -> Column:
    return col_(production) - col_(demand)


def residual_load(load, solar, wind) -> Column:
    return col_(load) - res_total_forecast(solar, wind)


def ccgt_srmc(gas, carbon) -> Column:
    """Short-run marginal cost proxy of a gas plant."""
    return col_(gas) * CCGT_GAS_FACTOR + col_(carbon) * CCGT_CARBON_FACTOR


def penetration_columns(load, solar, wind) -> dict[str, Column]:
    """RES penetration and solar / wind load ratios, NULL on zero load."""
    return {
        "res_penetration": safe_div(res_total_forecast(solar, wind), load),
        "solar_load_ratio": safe_div(F.coalesce(col_(solar), F.lit(0.0)), load),
        "wind_load_ratio": safe_div(F.coalesce(col_(wind), F.lit(0.0)), load),
    }


def collapse_risk(res_penetration, lagged_price) -> Column:
    """Penetration x max(lagged price, 0).  The lag is chosen by the caller
    (D1); 96 slots keeps it gate-close safe."""
    return col_(res_penetration) * clip(lagged_price, 0)


def solar_surplus_midday(solar_load_ratio, hour) -> Column:
    """The ratio inside 10..14 h, else 0."""
    lo, hi = MIDDAY_HOURS
    return F.when(col_(hour).between(lo, hi), col_(solar_load_ratio)).otherwise(F.lit(0.0))


def spike_likelihood(cloud, solar_load_ratio, thermal_z, hour, is_weekend,
                     cloud_in_percent: bool = True) -> Column:
    """Weighted spike score clipped to 0..1.

    ``cloud`` NULL -> 0.5 (no weather feed); its unit is declared, not guessed.
    ``thermal_z`` NULL reads as 0 and is clipped to -2..5 first."""
    c = F.coalesce(col_(cloud), F.lit(50.0 if cloud_in_percent else 0.5))
    cloud_term = clip(c / 100.0 if cloud_in_percent else c, 0, 1)
    solar_def = clip(F.lit(1.0) - col_(solar_load_ratio), 0, 1)
    tz = clip(F.coalesce(col_(thermal_z), F.lit(0.0)), -2, 5)
    thermal_term = clip(tz, 0, 2) / 2.0
    eve = col_(hour).between(*EVENING_HOURS).cast("double")
    morn = col_(hour).between(*MORNING_HOURS).cast("double") * 0.5
    weekday = F.lit(1.0) - col_(is_weekend).cast("double")
    w = SPIKE_WEIGHTS
    raw = (w["cloud"] * cloud_term + w["solar_deficit"] * solar_def + w["thermal"] * thermal_term
           + w["evening"] * clip(eve + morn, 0, 1) + w["weekday"] * weekday)
    return clip(raw, 0, 1)


def thermal_z(load, solar, wind, baseline) -> Column:
    """Residual-load stress against a same-hour load baseline (from D4)."""
    thermal = F.greatest(zero_filled_sum(load) - zero_filled_sum(solar) - zero_filled_sum(wind),
                         F.lit(0.0))
    return clip(F.coalesce(safe_div(thermal - col_(baseline), baseline), F.lit(0.0)), -2, 5)


# ---------------------------------------------------------------- assets ---

# Derating scenarios (name, efficiency factor, capacity factor).
DERATING_SCENARIOS = [
    ("Base", 1.00, 1.00),
    ("Mild Degradation", 0.97, 0.97),
    ("Severe Degradation", 0.92, 0.85),
]


def scenarios_df(spark) -> DataFrame:
    return spark.createDataFrame(DERATING_SCENARIOS, "name string, eta_factor double, cap_factor double")


def derate_assets(assets: DataFrame, scenarios=DERATING_SCENARIOS) -> DataFrame:
    """One row per (asset, scenario) with scaled power, energy and
    efficiencies.  The scenarios are a fixed 3-entry list, expanded with an
    ``explode`` of literals (a bounded 3x fan-out, no join)."""
    arr = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(e)).alias("eta_factor"),
                             F.lit(float(c)).alias("cap_factor")) for n, e, c in scenarios])
    return (assets.withColumn("_s", F.explode(arr)).select("*", "_s.*").drop("_s")
            .withColumn("power_mw", F.col("power_mw") * F.col("cap_factor"))
            .withColumn("energy_mwh", F.col("energy_mwh") * F.col("cap_factor"))
            .withColumn("eta_charge", F.col("eta_charge") * F.col("eta_factor"))
            .withColumn("eta_discharge", F.col("eta_discharge") * F.col("eta_factor"))
            .drop("eta_factor", "cap_factor"))


def asset_from_request(rte_pct, power_mw, capacity_mwh, initial_soc_pct, degradation) -> dict[str, Column]:
    """C17: symmetric efficiency sqrt(rte) and a 5-95 % SoC window."""
    eta = F.sqrt(col_(rte_pct) / 100.0)
    return {
        "power_mw": col_(power_mw).cast("double"),
        "energy_mwh": col_(capacity_mwh).cast("double"),
        "eta_charge": eta,
        "eta_discharge": eta,
        "soc_min_frac": F.lit(0.05),
        "soc_max_frac": F.lit(0.95),
        "soc_init_frac": col_(initial_soc_pct) / 100.0,
        "max_cycles_per_day": F.lit(1.5),
        "degradation_eur_per_mwh": col_(degradation).cast("double"),
    }


def price_thresholds(mean_price, eta_charge, eta_discharge, degradation) -> dict[str, Column]:
    """Discharge floor = degradation; charge ceiling = mean*rte - 2*deg."""
    rte = col_(eta_charge) * col_(eta_discharge)
    return {
        "min_discharge_price": col_(degradation),
        "max_charge_price": col_(mean_price) * rte - 2 * col_(degradation),
    }


def low_confidence(q_lo, q_hi, mean_mid, eta_charge, eta_discharge, degradation) -> Column:
    """Spread below degradation + (1-sqrt(rte)) * mean mid price.
    ``mean_mid`` is the per-series mean of (q_lo+q_hi)/2 (a window avg)."""
    rte = col_(eta_charge) * col_(eta_discharge)
    thr = col_(degradation) + (F.lit(1.0) - F.sqrt(rte)) * col_(mean_mid)
    return (col_(q_hi) - col_(q_lo)) < thr


def discount_factor(day_offset, base=FUTURE_BASE_DISCOUNT, decay=FUTURE_DECAY) -> Column:
    """C20: 1 for D0, base * decay^(i-1) for Di."""
    i = col_(day_offset)
    return F.when(i == 0, F.lit(1.0)).otherwise(F.lit(base) * F.pow(F.lit(decay), i - 1))


def choose_horizon(spread_mean, thr_low, thr_high, max_horizon=HORIZON_MAX) -> Column:
    """Calm days look further ahead."""
    mh = F.lit(max_horizon) if not isinstance(max_horizon, Column) else max_horizon
    return (F.when(col_(spread_mean) <= col_(thr_low), F.least(F.lit(HORIZON_MAX), mh))
            .when(col_(spread_mean) <= col_(thr_high), F.least(F.lit(HORIZON_MID), mh))
            .otherwise(F.lit(HORIZON_MIN)))


def blend_quantiles(q05, q50, q95) -> Column:
    """Dispatch price = 0.6 q50 + 0.2 q05 + 0.2 q95."""
    w = BLEND_WEIGHTS
    return w["q50"] * col_(q50) + w["q05"] * col_(q05) + w["q95"] * col_(q95)


def confidence_label(is_idle) -> Column:
    """C23."""
    return F.when(F.coalesce(col_(is_idle), F.lit(False)), F.lit("low")).otherwise(F.lit("high"))


def iso_time(ts) -> Column:
    """ISO-8601 text of a wall-clock timestamp."""
    return F.date_format(col_(ts), "yyyy-MM-dd'T'HH:mm:ss")
