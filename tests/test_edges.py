"""Edge cases listed in FIXTURES.md."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidewatt.functions import composites as cp
from tidewatt.functions.columns import safe_div
from tidewatt.operators import dispatch, forecast, metrics, windows

T0 = dt.datetime(2024, 1, 31, 23, 0)


def test_zero_load_ratio_is_null(spark):
    df = spark.createDataFrame([(0.0, 5.0, 1.0), (10.0, 5.0, 1.0)], "load double, solar double, wind double")
    r = [x.res_penetration for x in df.select(cp.penetration_columns("load", "solar", "wind")["res_penetration"]
                                              .alias("res_penetration")).collect()]
    assert r == [None, 0.6]
    assert df.select(safe_div("solar", F.lit(0.0)).alias("x")).first().x is None


def test_all_equal_prices_skip_variance_correction(spark):
    rows = [("a", T0 + dt.timedelta(minutes=15 * i), dt.date(2024, 2, 1), 42.0) for i in range(8)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, day date, q50 double")
    out = {r.v for r in df.select(windows.variance_correction("q50", 10.0).alias("v")).collect()}
    assert out == {42.0}


def test_empty_validation_leaves_forecast_unchanged(spark):
    test = spark.createDataFrame([("a", 1.0, 2.0)], "series_id string, q05 double, q95 double")
    valid = spark.createDataFrame([], "series_id string, price double, q05 double, q95 double")
    shifts = forecast.conformal_shift(valid, {"q05": 0.05, "q95": 0.95}, "price")
    r = forecast.conformal_calibrate(test, shifts, ["q05", "q95"]).first()
    assert (r.q05, r.q95) == (1.0, 2.0)


def test_month_boundary_metering(spark):
    calls = spark.createDataFrame([("k1", T0), ("k1", T0 + dt.timedelta(hours=2))], "key_id string, ts timestamp_ntz")
    tiers = spark.createDataFrame([("free", "Free", 10, 500, False, False, 0, 0)],
                                  "name string, label string, rate_limit int, monthly_call_quota int, "
                                  "can_use_optimize boolean, can_use_webhooks boolean, price_eur_month int, "
                                  "payg_price_eur_cents int")
    kt = spark.createDataFrame([], "key_id string, tier string")
    out = sorted((r.period, r.monthly_calls) for r in metrics.monthly_metering(calls, kt, tiers).collect())
    assert out == [("2024-01", 1), ("2024-02", 1)]


def test_first_672_rows_have_no_weekly_lag(spark):
    rows = [("a", T0 + dt.timedelta(minutes=15 * i), float(i)) for i in range(700)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, price double")
    out = df.withColumns(windows.lag_columns("price", [672])).orderBy("ts").collect()
    assert all(r.price_lag672 is None for r in out[:672]) and out[672].price_lag672 == 0.0


def test_short_day_is_skipped_by_backtest(spark):
    rows = []
    for day, n in ((dt.date(2024, 1, 1), 96), (dt.date(2024, 1, 2), 60)):
        for i in range(n):
            ts = dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=15 * i)
            p = 50 + 30 * np.sin(i / 96 * 2 * np.pi)
            rows.append(("a", ts, day, float(p), float(p) + 1.0))
    frame = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, day date, price double, "
                                        "dispatch_price double")
    assets = spark.createDataFrame([(1, "a", 50.0, 100.0, 0.95, 0.95, 0.05, 0.95, 0.5, 1.5, 2.0)],
                                   "asset_id int, series_id string, power_mw double, energy_mwh double, "
                                   "eta_charge double, eta_discharge double, soc_min_frac double, "
                                   "soc_max_frac double, soc_init_frac double, max_cycles_per_day double, "
                                   "degradation_eur_per_mwh double")
    bt = dispatch.backtest_daily(frame, assets).collect()
    assert [r.day for r in bt] == [dt.date(2024, 1, 1)]
    assert 0.0 < bt[0].capture_ratio <= 1.0 + 1e-9
