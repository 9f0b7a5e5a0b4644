"""Landing of market feeds (A1, A4-A10).

Readers are plain ``spark.read`` calls (Parquet / JSON / CSV); everything
after the read is DataFrame algebra, so filters and column pruning reach the
scan.  The HTTP fetchers of the studied system are not rebuilt: we start
from landed files.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType, StructField, StructType

from tidewatt.functions.columns import col_

KEY = "series_id"

# Report file-name patterns (date, document type, version).
REPORT_DATE_RE = r"^(\d{8})_"
REPORT_TYPE_RE = r"^\d{8}_([A-Za-z0-9-]+_[A-Za-z]+)"
REPORT_VERSION_RE = r"_v(\d+)\.[A-Za-z]+$"


def read_many(spark: SparkSession, paths: list[str] | str, fmt: str = "parquet", **opts) -> DataFrame:
    """A1 (read): many files of one feed as one DataFrame, tagged with the
    file they came from (``_metadata.file_path``), schemas unioned by name."""
    reader = spark.read.format(fmt).options(**opts)
    if fmt == "parquet":
        reader = reader.option("mergeSchema", "true")
    df = reader.load(paths)
    return df.withColumn("_file", F.col("_metadata.file_path"))


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A1: one row per key, the one ranked first by ``order`` (e.g. the highest
    file name, then the latest ingest id).  A keyed ``row_number``: the key is
    (series, ts), so no single series lands on one task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk")


def scan_latest(spark: SparkSession, paths, keys=(KEY, "ts"), fmt: str = "parquet") -> DataFrame:
    """A1: glob, union, keep the row of the highest file name per key."""
    df = read_many(spark, paths, fmt)
    return keep_latest(df, list(keys), [F.col("_file").desc()]).drop("_file")


def latest_version(files: DataFrame, name: str = "file") -> DataFrame:
    """A4: newest ``_vN`` per (report date, document type) from file names;
    names of any other form, or without a real date, are left out."""
    f = files.where(F.col(name).rlike(REPORT_TYPE_RE) & F.col(name).rlike(REPORT_VERSION_RE)).withColumns({
        "report_date": F.try_to_date(F.regexp_extract(name, REPORT_DATE_RE, 1), "yyyyMMdd"),
        "doc_type": F.regexp_extract(name, REPORT_TYPE_RE, 1),
        "version": F.regexp_extract(name, REPORT_VERSION_RE, 1).try_cast("int")}).where("report_date is not null")
    w = Window.partitionBy("report_date", "doc_type").orderBy(F.col("version").desc(), F.col(name).desc())
    return f.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk")


def flatten_hourly_json(df: DataFrame, variables: list[str], city: str = "city",
                        payload: str = "payload", cities: list[str] | None = None) -> DataFrame:
    """A5: JSON of parallel hourly arrays per location -> rows -> one column
    per (city, variable), locations side by side (pivot on a declared list)."""
    schema = StructType([StructField("hourly", StructType(
        [StructField("time", ArrayType(StringType()))]
        + [StructField(v, ArrayType(DoubleType())) for v in variables]))])
    parsed = df.withColumn("_j", F.from_json(payload, schema))
    zipped = parsed.select(city, F.explode(F.arrays_zip(
        F.col("_j.hourly.time").alias("time"),
        *[F.col(f"_j.hourly.{v}").alias(v) for v in variables])).alias("r"))
    long = zipped.select(city, F.to_timestamp("r.time", "yyyy-MM-dd'T'HH:mm").cast("timestamp_ntz").alias("ts"),
                         *[F.col(f"r.{v}").alias(v) for v in variables])
    piv = long.groupBy("ts").pivot(city, cities).agg(*[F.first(v).alias(v) for v in variables])
    if len(variables) == 1:   # Spark names single-agg pivots by value only
        piv = piv.select("ts", *[F.col(c).alias(f"{c}_{variables[0]}") for c in piv.columns if c != "ts"])
    return piv


def merge_daily_fuels(gas: DataFrame, carbon: DataFrame, day: str = "day") -> DataFrame:
    """Outer-merge two daily closes and forward-fill each; survives one
    feed being empty.  The day axis is a calendar dimension (thousands of
    rows), so the fill window runs on that small frame."""
    both = gas.join(carbon, day, "full")
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    vals = [c for c in both.columns if c != day]
    return both.select(day, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in vals])


def normalize_grid_feed(df: DataFrame, kind: str, ts: str = "ts", keys: tuple = ()) -> DataFrame:
    """Rename generation / forecast columns to ``gen_*_mw`` /
    ``forecast_*_mw``; the first value column of a load frame is the load;
    multi-level names ``a.b`` / ``(a, b)`` are flattened.  ``keys`` (the zone,
    say) stay as they are."""
    out = []
    value_cols = [c for c in df.columns if c != ts and c not in keys]
    for i, c in enumerate(value_cols):
        flat = re.sub(r"[^0-9a-z]+", "_", c.lower()).strip("_")
        if kind == "load":
            name = "load_forecast_mw" if i == 0 else f"{flat}_mw"
        elif kind == "generation":
            name = f"gen_{flat}_mw"
        else:
            name = f"forecast_{flat}_mw"
        out.append(F.col(f"`{c}`").alias(name))
    return df.select(*keys, F.col(ts), *out)


def neighbor_prices(long: DataFrame, zones: list[str], zone: str = "zone", ts: str = "ts",
                    price: str = "price") -> DataFrame:
    """Long (zone, ts, price) -> one ``da_price_{zone}_eur_mwh`` column per
    zone; a zone with no rows is simply a NULL column (failed zone skipped)."""
    piv = long.groupBy(ts).pivot(zone, zones).agg(F.first(price))
    return piv.select(ts, *[F.col(z).alias(f"da_price_{z}_eur_mwh") for z in zones])


def source_fallback(tiers: list[tuple[str, DataFrame]], key: str = KEY) -> DataFrame:
    """Live -> cache -> demo.  All tiers are unioned with their priority;
    per series the first tier that has any row wins, tagged with ``source``."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
               [df.withColumn("source", F.lit(name)).withColumn("_prio", F.lit(i))
                for i, (name, df) in enumerate(tiers)])
    # best tier per series by a partial aggregate (one row per series), not a
    # window over all of a series' rows
    best = u.groupBy(key).agg(F.min("_prio").alias("_prio"))
    return u.join(best, [key, "_prio"]).drop("_prio")


def ensure_driver_columns(df: DataFrame, forecast_like: str = r"^forecast_.*(solar|wind).*_mw$",
                          out: str = "res_total_forecast_mw") -> DataFrame:
    """A10: derive the total RES forecast as the sum of the solar / wind
    forecast columns (NULL when all are NULL); keep it if already present,
    filling its gaps from the derived sum."""
    parts = [c for c in df.columns if re.match(forecast_like, c)]
    if not parts:
        return df if out in df.columns else df.withColumn(out, F.lit(None).cast("double"))
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in parts])
    derived = F.when(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in parts]), total)
    if out in df.columns:
        return df.withColumn(out, F.coalesce(F.col(out), derived))
    return df.withColumn(out, derived)


def json_details(details) -> Column:
    """Audit ``details`` JSON text -> MAP<STRING, STRING>."""
    return F.from_json(col_(details), MapType(StringType(), StringType()))
