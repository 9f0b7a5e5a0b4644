"""Market result reports (A3) and snapshot / report writers.

A report arrives as a long cell table ``(file, sheet, row_idx, cells)``
(``cells[0]`` is the row label, then 24 or 96 MTU values) -- the XLSX byte
parsing itself is not rebuilt.  Tidying is pure DataFrame algebra: a
carried-down section header (window ``last(ignorenulls)`` per file/sheet), a
broadcast join on the fixed label map, ``posexplode`` of the values and one
pivot on a declared column list.  Every group is one file, so the work is
bounded per file and parallel across files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Section header text -> section key.
SECTION_HEADERS = [
    ("Total SELL Trades", "volume_sell"),
    ("Total BUY Trades", "volume_buy"),
    ("Market Clearing Price", "price"),
    ("PRODUCTION TECHNOLOGY / MTU", "production"),
    ("DEMAND / MTU", "demand"),
]

# Fixed values: (section key, row label, output column).
LABELS = [
    ("price", "Greece Mainland  (15min MCP)", "dam_price_eur_mwh"),
    ("price", "Greece Mainland (60min Index)", "dam_price_60min_idx_eur_mwh"),
    ("price", "Greece Mainland", "dam_price_eur_mwh"),
    ("volume_sell", "Greece Mainland", "volume_mainland_mwh"),
    ("production", "LIGNITE", "gen_lignite_mw"),
    ("production", "GAS", "gen_gas_mw"),
    ("production", "HYDRO", "gen_hydro_mw"),
    ("production", "RENEWABLES", "gen_renewables_mw"),
    ("production", "CRETE RENEWABLES", "gen_crete_renewables_mw"),
    ("production", "CRETE CONVENTIONAL", "gen_crete_conventional_mw"),
    ("production", "BESS", "gen_bess_mw"),
    ("production", "PRODUCTION", "production_total_mw"),
    ("demand", "HV LOAD", "load_hv_mw"),
    ("demand", "MV LOAD", "load_mv_mw"),
    ("demand", "LV LOAD", "load_lv_mw"),
    ("demand", "PUMP", "load_pump_mw"),
    ("demand", "SYSTEM LOSSES", "system_losses_mw"),
    ("demand", "CRETE LOAD", "load_crete_mw"),
    ("demand", "D/R LOAD", "load_demand_response_mw"),
    ("demand", "DEMAND", "demand_total_mw"),
    ("demand", "BESS", "load_bess_mw"),
    ("demand", "RENEWABLES", "renewables_buy_mw"),
]

# Sections harvested from each sheet kind (sell sheet first).
SHEET_SECTIONS = [("sell", "volume_sell"), ("sell", "price"), ("sell", "production"),
                  ("buy", "price"), ("buy", "demand")]

OUTPUT_COLUMNS = list(dict.fromkeys(c for _, _, c in LABELS))


def _dims(spark: SparkSession):
    headers = spark.createDataFrame(SECTION_HEADERS, "label string, sec_here string")
    labels = spark.createDataFrame(LABELS, "section string, label string, column string")
    allowed = spark.createDataFrame(SHEET_SECTIONS, "sheet_kind string, section string")
    return headers, labels.join(allowed, "section")


def tidy_market_report(cells: DataFrame, date_re: str = r"^(\d{8})_") -> DataFrame:
    """A3: report cells -> one row per (file, MTU timestamp) with one column
    per known label; first sheet (sell, then buy) and first row win, all-NULL
    rows are skipped, the MTU count (24 / 96, from the 1..n header row) sets a
    60 / 15-minute step, values are ``try_cast`` to double."""
    spark = cells.sparkSession
    headers, label_map = _dims(spark)
    c = cells.withColumns({
        "label": F.trim(F.element_at("cells", 1)),
        "sheet_kind": F.when(F.upper("sheet").contains("SELL"), "sell")
                       .when(F.upper("sheet").contains("BUY"), "buy"),
        "sheet_rank": F.when(F.upper("sheet").contains("SELL"), 0).otherwise(1)})
    c = c.join(F.broadcast(headers), "label", "left")
    w = Window.partitionBy("file", "sheet").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("section", F.last("sec_here", ignorenulls=True).over(w))

    # MTU count: a header row among the first five whose values start 1..5
    vals = F.slice("cells", 2, F.size("cells"))
    ints = F.transform(vals, lambda v: F.trim(v).try_cast("int"))
    is_hdr = (F.col("row_idx") <= 5) & (F.slice(ints, 1, 5) == F.array(*[F.lit(i) for i in range(1, 6)]))
    mx = F.array_max(ints)
    mtu = c.filter(is_hdr & mx.isin(24, 96)).groupBy("file").agg(F.max(mx).alias("mtu_count"))

    rows = c.filter(F.col("sec_here").isNull()).join(F.broadcast(label_map), ["sheet_kind", "section", "label"])
    rows = rows.join(mtu, "file", "left").withColumn("mtu_count", F.coalesce("mtu_count", F.lit(96)))
    rows = rows.withColumn("values", F.slice("cells", 2, F.col("mtu_count")))
    nonempty = F.exists("values", lambda v: v.isNotNull() & (F.trim(v) != ""))
    rows = rows.filter(nonempty)
    first = Window.partitionBy("file", "column").orderBy("sheet_rank", "row_idx")
    rows = rows.withColumn("_rk", F.row_number().over(first)).filter("_rk = 1")

    # a file without a date in its name, or without any price row, is skipped
    date = F.try_to_date(F.regexp_extract("file", date_re, 1), "yyyyMMdd")
    priced = F.max((F.col("column") == LABELS[0][2]).cast("int")).over(Window.partitionBy("file"))
    rows = rows.withColumn("_priced", priced).where((F.col("_priced") == 1) & date.isNotNull())
    step = F.when(F.col("mtu_count") == 96, 15).otherwise(60)
    long = rows.select("file", "column", date.alias("date"), step.alias("step"),
                       F.posexplode("values").alias("pos", "raw"))
    long = long.withColumn("ts", (F.col("date").cast("timestamp_ntz")
                                  + F.make_dt_interval(mins=F.col("pos") * F.col("step"))))
    long = long.withColumn("value", F.trim("raw").try_cast("double"))
    return long.groupBy("file", "ts").pivot("column", OUTPUT_COLUMNS).agg(F.first("value"))


def write_snapshots(frames: dict[str, DataFrame], path: str, date_col: str = "delivery_date") -> None:
    """Feature snapshots as Parquet partitioned by delivery date with
    dynamic partition overwrite (re-running a day replaces only that day)."""
    for name, df in frames.items():
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(date_col).parquet(f"{path}/{name}"))


def write_reports(summary: DataFrame, daily: DataFrame, path: str, date_col: str = "date") -> None:
    """One summary JSON document, the daily CSV and one folder per day."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")   # one summary row
    daily.write.mode("overwrite").option("header", True).csv(f"{path}/daily")
    daily.repartition(date_col).write.mode("overwrite").partitionBy(date_col).csv(f"{path}/by_day", header=True)
