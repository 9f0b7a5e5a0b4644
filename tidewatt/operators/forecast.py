"""Forecast operators (M1-M10) on Spark ML.

One *global* model per target with series attributes as features, fitted
distributed by Spark ML -- never one driver loop per series.  Spark ML has
no pinball loss, so the tails are q50 plus per-hour residual quantiles
(M2): same outputs as the reference's quantile boosters, different estimator.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "series_id"
TARGET = "price"
QUANTILES = (0.05, 0.50, 0.95)
Z_90 = 1.645


def seasonal_naive_interval(df: DataFrame, target: str = TARGET, lag: int = 96,
                            key=KEY, ts="ts") -> DataFrame:
    """q50 = target ``lag`` slots ago; q05/q95 = q50 -/+ 1.645 x the
    sample std of the 96 values ending ``lag`` slots ago (D2 gate-close roll).
    Rows without a forecast are dropped."""
    w = Window.partitionBy(key).orderBy(ts)
    fr = w.rowsBetween(-(96 - 1 + lag), -lag)
    sd = F.when(F.count(target).over(fr) == 96, F.stddev_samp(target).over(fr))
    out = df.select(key, ts, "day", target, F.lag(target, lag).over(w).alias("q50"), sd.alias("_sd"))
    out = out.filter(F.col("q50").isNotNull() & F.col("_sd").isNotNull())
    return out.select(key, ts, "day", target, (F.col("q50") - Z_90 * F.col("_sd")).alias("q05"),
                      "q50", (F.col("q50") + Z_90 * F.col("_sd")).alias("q95"))


def time_split(df: DataFrame, valid_days: int = 30, test_days: int = 30, key=KEY, ts="ts") -> DataFrame:
    """K1: label rows train / valid / test by days back from the series' max ts."""
    end = F.max(ts).over(Window.partitionBy(key))
    test_start = end - F.make_interval(days=F.lit(test_days))
    valid_start = test_start - F.make_interval(days=F.lit(valid_days))
    return df.withColumn("split", F.when(F.col(ts) >= test_start, "test")
                         .when(F.col(ts) >= valid_start, "valid").otherwise("train"))


def conformal_shift(valid: DataFrame, alpha_cols: dict[str, float], actual: str = TARGET,
                    by: list[str] = (KEY,)) -> DataFrame:
    """M5 (step 1): alpha-quantile (linear) of validation residuals
    ``actual - pred`` per group and quantile column."""
    return valid.groupBy(*by).agg(*[
        F.percentile(F.col(actual) - F.col(c), a).alias(f"{c}_shift") for c, a in alpha_cols.items()])


def conformal_calibrate(test: DataFrame, shifts: DataFrame, cols: list[str], by: list[str] = (KEY,)) -> DataFrame:
    """M5 (step 2): add the shift; a group with no validation rows is unchanged."""
    j = test.join(shifts, list(by), "left")
    return j.withColumns({c: F.col(c) + F.coalesce(F.col(f"{c}_shift"), F.lit(0.0)) for c in cols}) \
            .drop(*[f"{c}_shift" for c in cols])


# ------------------------------------------------------------- Spark ML ----

def _assembler(features: list[str]) -> VectorAssembler:
    """Assembles the imputed copies of the features."""
    return VectorAssembler(inputCols=[f"{c}_imp" for c in features], outputCol="features", handleInvalid="keep")


def missing_indicators(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """M9: NaN-tolerant scoring.  Spark trees do not route NULL like
    LightGBM, so every feature gets an ``_isna`` flag and is median-imputed
    in the pipeline."""
    flags = {f"{c}_isna": F.col(c).isNull().cast("double") for c in features}
    return df.withColumns(flags), features + list(flags)


def imputer(features: list[str]) -> Imputer:
    return Imputer(inputCols=features, outputCols=[f"{c}_imp" for c in features], strategy="median")


def fit_point(train: DataFrame, features: list[str], target: str = TARGET, weight: str | None = None,
              max_iter: int = 20, seed: int = 42, loss: str = "squared",
              valid_flag: str | None = None) -> PipelineModel:
    """M1 / M2 (q50 with ``loss='absolute'``): boosted trees with row weights
    and optional early stopping on a validation indicator column."""
    gbt = GBTRegressor(featuresCol="features", labelCol=target, maxIter=max_iter, maxDepth=5,
                       stepSize=0.1, subsamplingRate=0.85, seed=seed, lossType=loss)
    if weight:
        gbt.setWeightCol(weight)
    if valid_flag:
        gbt.setValidationIndicatorCol(valid_flag)
    return Pipeline(stages=[imputer(features), _assembler(features), gbt]).fit(train)


def fit_quantiles(train: DataFrame, valid: DataFrame, features: list[str], target: str = TARGET,
                  weight: str | None = None, max_iter: int = 20, seed: int = 42,
                  key=KEY, hour: str = "hour") -> tuple[PipelineModel, DataFrame]:
    """M2: q50 model (absolute loss, stopped early on the validation rows) +
    per (series, hour) residual quantiles of these for the 5 % / 95 % tails."""
    both = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
    model = fit_point(both, features, target, weight, max_iter, seed, loss="absolute", valid_flag="_valid")
    res = model.transform(valid).withColumn("_r", F.col(target) - F.col("prediction"))
    tails = res.groupBy(key, hour).agg(F.percentile("_r", 0.05).alias("lo_shift"),
                                       F.percentile("_r", 0.95).alias("hi_shift"))
    return model, tails


def predict_interval(model: PipelineModel, tails: DataFrame, df: DataFrame, key=KEY,
                     hour: str = "hour") -> DataFrame:
    """M4: score and add the tails -> q05 / q50 / q95 columns."""
    p = model.transform(df).drop("features")
    p = p.join(tails, [key, hour], "left")
    return (p.withColumn("q50", F.col("prediction"))
            .withColumn("q05", F.col("prediction") + F.coalesce("lo_shift", F.lit(0.0)))
            .withColumn("q95", F.col("prediction") + F.coalesce("hi_shift", F.lit(0.0)))
            .drop("lo_shift", "hi_shift", "prediction"))


def fit_ensemble(train: DataFrame, features: list[str], seeds=(42, 7, 1337), **kw) -> list[PipelineModel]:
    """M3: one model per seed; average their scores with ``metrics.mean_ensemble``."""
    return [fit_point(train, features, seed=s, **kw) for s in seeds]


def fit_ridge(train: DataFrame, features: list[str], target: str = TARGET, alpha: float = 1.0) -> PipelineModel:
    """M6: median impute -> standardise -> ridge (L2 only).  Spark scales the
    loss by 1/n and divides the penalty by the label's deviation, so
    ``alpha * std / n`` matches sum-of-squares ridge; both come from one
    aggregate."""
    n, std = train.agg(F.count(target), F.coalesce(F.stddev_samp(target), F.lit(0.0))).first()
    lr = LinearRegression(featuresCol="scaled", labelCol=target, regParam=alpha * (std or 1.0) / max(n, 1), elasticNetParam=0.0)
    return Pipeline(stages=[imputer(features), _assembler(features),
                            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
                            lr]).fit(train)


def evaluate(pred: DataFrame, target: str = TARGET) -> dict:
    """M1 metrics: MAE / RMSE on a scored frame (two small aggregates)."""
    ev = RegressionEvaluator(labelCol=target, predictionCol="prediction")
    return {"mae": ev.setMetricName("mae").evaluate(pred), "rmse": ev.setMetricName("rmse").evaluate(pred)}


def importance_table(spark: SparkSession, model: PipelineModel, features: list[str], top: int = 20) -> DataFrame:
    """Gain importance, split count, gain share and rank; top 20."""
    gbt = model.stages[-1]
    imp = gbt.featureImportances.toArray().tolist()
    splits = Counter(int(k) for k in re.findall(r"If \(feature (\d+) ", "".join(t.toDebugString for t in gbt.trees)))
    rows = [(f, float(g), splits[k]) for k, (f, g) in enumerate(zip(features, imp))]
    df = spark.createDataFrame(rows, "feature string, gain double, split int")
    w = Window.orderBy(F.col("gain").desc(), F.col("feature"))
    tot = F.sum("gain").over(Window.partitionBy(F.lit(1)))
    return (df.withColumn("gain_pct", F.col("gain") * 100.0 / F.nullif(tot, F.lit(0.0)))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top))


def save_model(spark: SparkSession, model: PipelineModel, path: str, name: str, features: list[str],
               metrics: dict) -> DataFrame:
    """M8: model artefact + a registry row (feature list, metrics)."""
    model.write().overwrite().save(f"{path}/{name}")
    reg = spark.createDataFrame([(name, features, {k: float(v) for k, v in metrics.items()},
                                  f"{path}/{name}")],
                                "name string, feature_cols array<string>, metrics map<string,double>, uri string")
    reg.write.mode("append").parquet(f"{path}/_registry")
    return reg


def load_models(spark: SparkSession, path: str, prefer: list[str]) -> dict:
    """M8: load by preference (ensemble first, then single); missing -> absent."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_registry")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return {}
    reg = spark.read.parquet(f"{path}/_registry").collect()
    by_name = {r["name"]: r for r in reg}
    out = {}
    for name in prefer:
        if name in by_name:
            out[name] = (PipelineModel.load(by_name[name]["uri"]), list(by_name[name]["feature_cols"]))
    return out


def rank_model(train: DataFrame, features: list[str], label: str = "rank_label", max_iter: int = 20,
               seed: int = 42) -> PipelineModel:
    """M7: pointwise ranking head -- GBT on the within-day rank label.
    (A listwise LambdaRank learner is not part of Spark ML.)"""
    return fit_point(train, features, target=label, max_iter=max_iter, seed=seed)
