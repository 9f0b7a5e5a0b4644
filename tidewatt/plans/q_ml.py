"""Registered queries: Spark ML forecasters (M1-M4, M6-M9, E18).  Rows-only
checks (model fits are not SQL); invariants live in tests/test_forecast.py."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatt.functions import calendar as cal
from tidewatt.functions.columns import round_doubles
from tidewatt.operators import forecast as fc_ops
from tidewatt.operators import metrics, tables, walkforward, windows
from tidewatt.plans import fixtures as fx
from tidewatt.session import materialize, scratch_path

Q, SQL = {}, {}

FEATURES = ["hour", "dow", "is_weekend", "sin_tod", "cos_tod", "zone_idx", "price_lag96", "price_lag672",
            "price_rollmean96", "price_rollstd96", "load_mw_lag96", "cloud_pct_lag96"]
#: Boosting rounds at most; the fits stop earlier on their validation rows.
MAX_ITER = 20


def reg(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def feature_frame(spark, d):
    """Gate-close-safe feature matrix (P1 clean snapshot) with the K1 split
    and D7-D10 weights; series attributes enter as features (one global model)."""
    m = fx.market_grid(spark, d)
    m = windows.add_lags_rolls(m, "price", gate_close=True)
    m = windows.lag_realized(m, ["load_mw", "cloud_pct"], 96)
    m = m.withColumns({k: v for k, v in cal.calendar_columns("ts").items() if k in ("hour", "dow", "is_weekend")})
    m = m.withColumns({k: v for k, v in cal.cyclic_columns("ts").items() if k in ("sin_tod", "cos_tod")})
    # series attribute as a feature: index of the zone in the (small) zone list
    zones = m.select("series_id").distinct()
    zones = zones.withColumn("zone_idx", F.row_number().over(Window.orderBy("series_id")).cast("double") - 1.0)
    m = m.join(zones, "series_id")   # one row per series; AQE broadcasts it when small
    m = m.filter(F.col("price").isNotNull() & F.col("price_lag96").isNotNull())
    m = fc_ops.time_split(m, valid_days=7, test_days=7)
    return weighted(m, F.max("ts").over(Window.partitionBy("series_id")))


def weighted(m, reference):
    """Rows with the D7 x D8 weights as seen from ``reference``; their mean is 1
    over the rows given."""
    m = m.withColumn("ref_ts", reference)
    m = m.withColumns({"w_rs": windows.recency_seasonal_weight("ts", "ref_ts"),
                       "w_econ": windows.economic_weight("price")})
    return m.withColumn("weight", windows.normalize_weights(["w_rs", "w_econ"])).drop("ref_ts")


def _for_fit(m):
    """Double-typed features, lineage cut before the iterative fits."""
    m = m.withColumns({c: F.col(c).cast("double") for c in FEATURES})
    return materialize(m)


@reg("M1_fit_point")
def m1(spark, d):
    m = _for_fit(feature_frame(spark, d)).withColumn("is_valid", F.col("split") == "valid")
    train = m.filter("split != 'test'")
    model = fc_ops.fit_point(train, FEATURES, weight="weight", max_iter=MAX_ITER, valid_flag="is_valid")
    test = model.transform(m.filter("split = 'test'"))
    err = F.col("price") - F.col("prediction")
    return round_doubles(test.groupBy("series_id").agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.count(F.lit(1)).alias("n")))


@reg("M2_M4_quantile_interval")
def m2(spark, d):
    m = _for_fit(feature_frame(spark, d))
    model, tails = fc_ops.fit_quantiles(m.filter("split = 'train'"), m.filter("split = 'valid'"), FEATURES,
                                        weight="weight", max_iter=MAX_ITER)
    p = fc_ops.predict_interval(model, tails, m.filter("split = 'test'"))
    im = metrics.interval_metrics(p, "price", ["series_id"])
    return round_doubles(im)


@reg("M3_E19_seed_ensemble")
def m3(spark, d):
    m = _for_fit(feature_frame(spark, d))
    m = m.withColumn("is_valid", F.col("split") == "valid")
    models = fc_ops.fit_ensemble(m.filter("split != 'test'"), FEATURES, max_iter=MAX_ITER, weight="weight", valid_flag="is_valid")
    test = m.filter("split = 'test'")
    scored = [mod.transform(test).select("series_id", "ts", "prediction") for mod in models]
    ens = metrics.mean_ensemble(scored, ["series_id", "ts"])
    return round_doubles(ens.join(test.select("series_id", "ts", "price"), ["series_id", "ts"]))


@reg("M6_fit_ridge")
def m6(spark, d):
    m = _for_fit(feature_frame(spark, d))
    model = fc_ops.fit_ridge(m.filter("split != 'test'"), FEATURES, alpha=1.0)
    p = model.transform(m.filter("split = 'test'"))
    return round_doubles(metrics.point_metrics(p, "price", "prediction", ["series_id"]))


@reg("M7_rank_blend")
def m7(spark, d):
    m = _for_fit(feature_frame(spark, d)).withColumn("rank_label", windows.rank_label("price").cast("double"))
    rank = fc_ops.rank_model(m.filter("split != 'test'"), FEATURES, max_iter=MAX_ITER)
    test = rank.transform(m.filter("split = 'test'")).withColumnRenamed("prediction", "rank_score")
    test = test.withColumn("q50", F.col("price_lag96"))
    out = windows.blend_rank_with_q50(test, "q50", "rank_score", weight=0.4)
    return round_doubles(out.select("series_id", "ts", "q50", "rank_score", "q50_blend"))


@reg("M8_save_load_models")
def m8(spark, d):
    m = _for_fit(feature_frame(spark, d))
    train, test = m.filter("split != 'test'"), m.filter("split = 'test'")
    model = fc_ops.fit_point(train, FEATURES, max_iter=5)
    path = scratch_path(spark, f"models/{uuid.uuid4().hex[:12]}")
    fc_ops.save_model(spark, model, path, "q50", FEATURES, fc_ops.evaluate(model.transform(test)))
    loaded = fc_ops.load_models(spark, path, ["q50_ensemble", "q50"])
    name = next(iter(loaded))
    mod, feats = loaded[name]
    return round_doubles(mod.transform(test).select("series_id", "ts", "prediction")
                         .withColumn("model", F.lit(name)))


@reg("M9_backfill_missing")
def m9(spark, d):
    m = _for_fit(feature_frame(spark, d))
    m, feats = fc_ops.missing_indicators(m, FEATURES)
    model = fc_ops.fit_point(m.filter("split != 'test'"), feats, max_iter=5)
    p = model.transform(m.filter("split = 'test'"))
    return round_doubles(p.select("series_id", "ts", "prediction", *[f for f in feats if f.endswith("_isna")]))


@reg("E18_importance_table")
def e18(spark, d):
    m = _for_fit(feature_frame(spark, d))
    model = fc_ops.fit_point(m.filter("split != 'test'"), FEATURES, max_iter=MAX_ITER)
    return round_doubles(fc_ops.importance_table(spark, model, FEATURES))


@reg("P2_walkforward_dispatch")
def p2(spark, d):
    """Walk-forward with fitted quantiles: per K2 fold a fit on the days before
    its validation days (weighted as seen from its last moment, stopped early on the validation days), then one job over all folds:
    calibration, idle threshold, dispatch of the week, summary."""
    m = _for_fit(feature_frame(spark, d).drop("split"))
    folds = materialize(tables.walkforward_folds(m))
    parts = []
    for (fold,) in folds.select("fold").distinct().orderBy("fold").collect():  # one fit per fold
        rows = m.join(folds.where(F.col("fold") == fold).select("series_id", "fold", "fold_start", "fold_end"), "series_id")
        begin = F.col("fold_start") - F.expr("INTERVAL 7 DAYS")
        valid = rows.where((F.col("ts") >= begin) & (F.col("ts") < F.col("fold_start")))
        later = rows.where((F.col("ts") >= begin) & (F.col("ts") < F.col("fold_end")))
        past = weighted(rows.where(F.col("ts") < begin), begin)
        model, tails = fc_ops.fit_quantiles(past, valid, FEATURES, weight="weight", max_iter=MAX_ITER)
        scored = fc_ops.predict_interval(model, tails, later)
        role = F.when(F.col("ts") < F.col("fold_start"), "valid").otherwise("week")
        parts.append(scored.select("series_id", "fold", role.alias("role"), "ts", "day", "price", "q05", "q50", "q95"))
    rows = walkforward.calibrated(materialize(reduce(lambda a, b: a.unionByName(b), parts)))
    return round_doubles(walkforward.dispatch_walkforward(rows, fx.assets(spark, d)))
