import datetime as dt

from pyspark.sql import functions as F

from tidewatt.operators import tables
from tidewatt.sources import feeds, reports


def test_scan_latest_highest_file_wins(spark, tmpdir_path):
    t = dt.datetime(2026, 1, 1)
    spark.createDataFrame([("a", t, 1.0), ("a", t + dt.timedelta(minutes=15), 2.0)],
                          "series_id string, ts timestamp_ntz, v double").write.parquet(f"{tmpdir_path}/f1")
    spark.createDataFrame([("a", t, 9.0)], "series_id string, ts timestamp_ntz, v double") \
        .write.parquet(f"{tmpdir_path}/f2")
    out = {r.ts: r.v for r in feeds.scan_latest(spark, [f"{tmpdir_path}/f1", f"{tmpdir_path}/f2"]).collect()}
    assert out == {t: 9.0, t + dt.timedelta(minutes=15): 2.0}


def test_latest_version(spark):
    names = ["20260401_EL-DAM_ResultsSummary_EN_v01.xlsx", "20260401_EL-DAM_ResultsSummary_EN_v02.xlsx",
             "20260401_EL-DAM_Results_EN_v01.xlsx", "20260402_EL-DAM_ResultsSummary_EN_v01.xlsx"]
    df = spark.createDataFrame([(n,) for n in [*names, "notes.txt", "99999999_EL-DAM_Results_EN_v01.xlsx", "20260401_EL-DAM_Results_EN.xlsx"]], "file string")
    out = sorted(r.file for r in feeds.latest_version(df).collect())
    assert out == sorted([names[1], names[2], names[3]])


def _cells(spark, mtus, sheets):
    rows = []
    for sheet, body in sheets.items():
        rows.append(("20260329_EL-DAM_ResultsSummary_EN_v01.xlsx", sheet, 1,
                     ["MTU"] + [str(i) for i in range(1, mtus + 1)]))
        for i, r in enumerate(body):
            rows.append(("20260329_EL-DAM_ResultsSummary_EN_v01.xlsx", sheet, i + 2, r))
    return spark.createDataFrame(rows, "file string, sheet string, row_idx int, cells array<string>")


def test_tidy_report_hourly_first_sheet_wins(spark):
    sell = [["Market Clearing Price"], ["Greece Mainland"] + [str(10 + i) for i in range(24)],
            ["PRODUCTION TECHNOLOGY / MTU"], ["GAS"] + [None] * 24, ["LIGNITE"] + ["x"] + ["5"] * 23]
    buy = [["Market Clearing Price"], ["Greece Mainland"] + ["999"] * 24,
           ["DEMAND / MTU"], ["HV LOAD"] + ["1.5"] * 24]
    out = reports.tidy_market_report(_cells(spark, 24, {"SELL": sell, "BUY": buy})).orderBy("ts").collect()
    assert len(out) == 24
    assert out[1].ts == dt.datetime(2026, 3, 29, 1, 0)                 # 24 MTUs -> hourly step
    assert [r.dam_price_eur_mwh for r in out[:3]] == [10.0, 11.0, 12.0]  # sell sheet wins
    assert out[0].gen_lignite_mw is None and out[1].gen_lignite_mw == 5.0  # coerced
    assert out[0].gen_gas_mw is None                                       # all-NULL row skipped
    assert out[0].load_hv_mw == 1.5


def test_source_fallback_and_merge(spark):
    live = spark.createDataFrame([("a", 1.0)], "series_id string, v double")
    cache = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "series_id string, v double")
    out = {(r.series_id, r.source) for r in feeds.source_fallback([("live", live), ("cache", cache)]).collect()}
    assert out == {("a", "live"), ("b", "cache")}
    gas = spark.createDataFrame([(dt.date(2026, 1, 1), 30.0), (dt.date(2026, 1, 3), 31.0)], "day date, gas double")
    empty = spark.createDataFrame([], "day date, co2 double")
    m = feeds.merge_daily_fuels(gas, empty).orderBy("day").collect()
    assert [r.gas for r in m] == [30.0, 31.0] and all(r.co2 is None for r in m)


def test_fanout_and_append_once(spark):
    ev = spark.createDataFrame([("optimize.completed", "o1"), ("forecast.refreshed", "o1")], "event string, owner string")
    subs = spark.createDataFrame([
        ("w1", "o1", "l", "u1", "optimize.completed,forecast.refreshed", "h1", 0),
        ("w2", "o1", "l", "u2", "optimize.completed", "h2", 0),
        ("w3", "o1", "l", "u3", "optimize.completed", "h3", 1),
        ("w4", "o2", "l", "u4", "optimize.completed", "h4", 0)],
        "id string, owner string, label string, url string, events string, secret_hash string, disabled int")
    out = sorted((r.event, r.subscription_id) for r in tables.fanout_subscriptions(ev, subs).collect())
    assert out == [("forecast.refreshed", "w1"), ("optimize.completed", "w1"), ("optimize.completed", "w2")]
    every = spark.createDataFrame([("optimize.completed", None), ("forecast.refreshed", None)], "event string, owner string")
    out = sorted((r.event, r.subscription_id) for r in tables.fanout_subscriptions(every, subs).collect())
    assert out == [("forecast.refreshed", "w1"), ("optimize.completed", "w1"), ("optimize.completed", "w2"), ("optimize.completed", "w4")]
    log = spark.createDataFrame([("2026-01-01", 1.0)], "date string, c double")
    inc = spark.createDataFrame([("2026-01-01", 9.0), ("2026-01-02", 2.0)], "date string, c double")
    assert sorted(tuple(r) for r in tables.append_once(log, inc, ["date"]).collect()) == \
        [("2026-01-01", 1.0), ("2026-01-02", 2.0)]


def test_audit_query_clamps_limit(spark):
    rows = [(i, 100 + i // 2, "u", "a", "r", None, "{}") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, ts long, user_id string, action string, resource string, "
                                     "ip_address string, details string")
    out = tables.audit_query(df, limit=0).collect()
    assert len(out) == 1 and out[0].id == 9
    assert [r.id for r in tables.audit_query(df, since=103, limit=5000).collect()] == [9, 8, 7, 6]


def test_a_table_sees_files_that_land_later(spark, tmpdir_path):
    from tidewatt.plans import fixtures as fx
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    rows.write.parquet(f"{tmpdir_path}/events.parquet")
    assert fx.table(spark, tmpdir_path, "events").count() == 1
    rows.write.mode("append").parquet(f"{tmpdir_path}/events.parquet")
    assert fx.table(spark, tmpdir_path, "events").count() == 2


def test_a_kept_plan_sees_files_that_land_later(spark, tmpdir_path):
    from tidewatt.plans import fixtures as fx
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    day = F.to_date("ts") < F.lit("2024-01-10")
    events.where(day).write.parquet(f"{tmpdir_path}/events.parquet")
    first = fx.price_slots(spark, tmpdir_path)
    assert fx.price_slots(spark, tmpdir_path) is first
    before = first.count()
    events.where(~day).write.mode("append").parquet(f"{tmpdir_path}/events.parquet")
    assert fx.price_slots(spark, tmpdir_path).count() > before


def test_report_without_price_or_date_is_skipped(spark):
    buy = {"BUY": [["DEMAND / MTU"], ["HV LOAD"] + ["1.5"] * 24]}
    assert reports.tidy_market_report(_cells(spark, 24, buy)).count() == 0
    sell = {"SELL": [["Market Clearing Price"], ["Greece Mainland"] + ["10"] * 24]}
    cells = _cells(spark, 24, sell)
    assert reports.tidy_market_report(cells.withColumn("file", F.lit("summary.xlsx"))).count() == 0
    assert reports.tidy_market_report(cells).count() == 24


def test_unknown_series_is_an_error(spark):
    from tidewatt.plans import fixtures as fx
    import pytest
    df = spark.createDataFrame([("a",), ("b",)], "s string").select(fx.known_series(F.col("s"), ["a"]))
    with pytest.raises(Exception, match="no place for series b"):
        df.collect()
