import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatt.operators import forecast, metrics, tables, walkforward

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(600):
        x, z = float(rng.normal()), float(rng.normal())
        rows.append(("a" if k % 2 else "b", T0 + dt.timedelta(minutes=15 * k), k % 24, x, None if k % 10 == 0 else z, 3 * x - 2 * z + 5 + 0.1 * float(rng.normal()), 10.0 if x > 0 else 0.01, k % 5 == 0))
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, hour int, x double, z double, price double, w double, is_valid boolean").repartition(2).cache()


def test_ridge_is_the_normal_equations(data):
    model = forecast.fit_ridge(data, ["x", "z"], alpha=7.0)
    rows = data.collect()
    x = np.array([[r.x, np.nan if r.z is None else r.z] for r in rows])
    y = np.array([r.price for r in rows])
    fill = model.stages[0].surrogateDF.first()["z"]  # the imputer's median is approximate
    assert abs(fill - np.nanmedian(x[:, 1])) < 0.05
    x[:, 1] = np.where(np.isnan(x[:, 1]), fill, x[:, 1])
    s = (x - x.mean(0)) / x.std(0, ddof=1)
    beta = np.linalg.solve(s.T @ s + 7.0 * np.eye(2), s.T @ (y - y.mean()))
    got = {(r.x, r.price): r.prediction for r in model.transform(data).collect()}
    want = s @ beta + y.mean()
    assert max(abs(got[r.x, r.price] - w) for r, w in zip(rows, want)) < 1e-3


def test_weights_change_the_fit(data):
    plain = forecast.fit_point(data, ["x"], max_iter=3)
    weighted = forecast.fit_point(data, ["x"], weight="w", max_iter=3)
    err = lambda m: m.transform(data.where("x > 0")).agg(F.avg(F.abs(F.col("price") - F.col("prediction")))).first()[0]
    assert err(weighted) != err(plain)


def test_stopping_honours_the_flag(data):
    noise = data.withColumn("price", F.when(F.col("is_valid"), F.rand(3) * 100).otherwise(F.col("price")))
    stopped = forecast.fit_point(noise, ["x", "z"], max_iter=15, valid_flag="is_valid")
    full = forecast.fit_point(noise, ["x", "z"], max_iter=15)
    assert stopped.stages[-1].getNumTrees < full.stages[-1].getNumTrees == 15


def test_tails_are_the_residual_quantiles(data):
    train, valid = data.where("not is_valid"), data.where("is_valid")
    model, tails = forecast.fit_quantiles(train, valid, ["x", "z"], max_iter=3)
    res = {}
    for r in model.transform(valid).collect():
        res.setdefault((r.series_id, r.hour), []).append(r.price - r.prediction)
    for t in tails.collect():
        assert np.isclose(t.lo_shift, np.quantile(res[t.series_id, t.hour], 0.05)) and np.isclose(t.hi_shift, np.quantile(res[t.series_id, t.hour], 0.95))
    p = forecast.predict_interval(model, tails, valid).collect()
    assert all(r.q05 <= r.q95 for r in p)


def test_ensemble_is_the_mean_of_its_members(data):
    models = forecast.fit_ensemble(data, ["x", "z"], seeds=(1, 2), max_iter=2)
    scored = [m.transform(data).select("series_id", "ts", "prediction") for m in models]
    mean = {(r.series_id, r.ts): r.prediction for r in metrics.mean_ensemble(scored, ["series_id", "ts"]).collect()}
    one, two = ({(r.series_id, r.ts): r.prediction for r in s.collect()} for s in scored)
    assert one != two and all(np.isclose(mean[k], (one[k] + two[k]) / 2) for k in mean)


def test_models_come_back_as_saved(spark, data, tmpdir_path):
    assert forecast.load_models(spark, tmpdir_path + "/none", ["q50"]) == {}
    model = forecast.fit_point(data, ["x", "z"], max_iter=2)
    forecast.save_model(spark, model, tmpdir_path, "q50", ["x", "z"], {"mae": 1.0})
    loaded, features = forecast.load_models(spark, tmpdir_path, ["q50_ensemble", "q50"])["q50"]
    score = lambda m: sorted(r.prediction for r in m.transform(data).collect())
    assert features == ["x", "z"] and score(loaded) == score(model)


def test_missing_values_are_flagged_and_scored(data):
    m, features = forecast.missing_indicators(data, ["x", "z"])
    assert features == ["x", "z", "x_isna", "z_isna"]
    assert m.where("z is null and z_isna <> 1 or z is not null and z_isna <> 0").count() == 0
    p = forecast.fit_point(m, features, max_iter=2).transform(m)
    assert p.where("prediction is null or isnan(prediction)").count() == 0


def test_importance_counts_splits(spark, data):
    model = forecast.fit_point(data, ["x", "z"], max_iter=3)
    rows = {r.feature: r for r in forecast.importance_table(spark, model, ["x", "z"]).collect()}
    nodes = sum((t.numNodes - 1) // 2 for t in model.stages[-1].trees)
    assert rows["x"].split + rows["z"].split == nodes and abs(sum(r.gain_pct for r in rows.values()) - 100) < 1e-9


def test_walkforward_threshold_is_the_best_of_the_validation_days(spark):
    from tidewatt.plans import fixtures as fx
    f = fx.forecast_frame(spark, "/root/testdata/sf0.001")
    rows = walkforward.calibrated(walkforward.fold_rows(f, tables.walkforward_folds(f))).cache()
    valid = rows.where("role = 'valid'")
    grid = walkforward.idle_grid(valid)
    tried = walkforward.naive_days(valid.join(grid, ["series_id", "fold"]), ["series_id", "fold", "pct"])
    best = {(r.series_id, r.fold): r.pct for r in walkforward.chosen_threshold(tried, grid).collect()}
    totals = {}
    for r in tried.groupBy("series_id", "fold", "pct").agg(F.round(F.sum("realized_eur"), 6).alias("t")).collect():
        totals.setdefault((r.series_id, r.fold), []).append((-r.t, r.pct))
    assert best == {k: min(v)[1] for k, v in totals.items()}
    # no week is scored with rows of its own
    assert rows.where("role = 'valid'").join(rows.where("role = 'week'").select("series_id", "fold", "ts"), ["series_id", "fold", "ts"]).count() == 0


def test_fold_weights_see_no_later_rows(spark):
    from tidewatt.plans.q_ml import weighted
    start = dt.datetime(2024, 1, 1)
    rows = [("z", start + dt.timedelta(hours=6 * k), (start + dt.timedelta(hours=6 * k)).date(), float(k % 7)) for k in range(200)]
    frame = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, day date, price double")
    begin = F.lit("2024-02-01").cast("timestamp_ntz")
    read = lambda f: {r.ts: r.weight for r in weighted(f.where(F.col("ts") < begin), begin).collect()}
    alone, beside = read(frame.where("ts < '2024-02-01'")), read(frame.withColumn("price", F.when(F.col("ts") >= begin, 1e6).otherwise(F.col("price"))))
    assert alone == beside and abs(sum(alone.values()) / len(alone) - 1.0) < 1e-9
    assert max(alone, key=lambda t: alone[t] if t.hour == 0 else 0) > start + dt.timedelta(days=20)
