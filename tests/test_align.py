import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewatt.operators import align

T0 = dt.datetime(2026, 3, 28, 0, 0)


def slot(i, extra_s=0):
    return T0 + dt.timedelta(minutes=15 * i, seconds=extra_s)


def test_grid_drops_off_grid_points(spark):
    rows = [("a", slot(0), 1.0), ("a", slot(2, 30), 2.0), ("a", slot(4), 3.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, v double")
    g = align.reindex_on_grid(df).orderBy("ts").collect()
    assert [r.ts for r in g] == [slot(i) for i in range(5)]
    assert [r.v for r in g] == [1.0, None, None, None, 3.0]   # the off-grid row drops out


def test_asof_keeps_null_row_and_uses_off_grid_rows(spark):
    rows = [("a", slot(0), 1.0), ("a", slot(1), None), ("a", slot(2, 30), 5.0), ("a", slot(4), 7.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, v double")
    grid = align.resample_grid(df)
    out = {r.ts: r.v for r in align.asof_ffill(grid, df, ["v"]).collect()}
    assert out[slot(1)] is None           # the latest row has NULL: stays NULL
    assert out[slot(2)] is None           # 02:30 not yet seen at slot 2
    assert out[slot(3)] == 5.0            # off-grid row counts for later slots
    assert out[slot(4)] == 7.0


def test_interpolate_limits_and_edges(spark):
    vals = [None, 0.0, None, None, None, None, None, None, 70.0, None, None, None, None, None, None]
    rows = [("a", slot(i), v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, v double")
    out = [r.v for r in align.interpolate_time(df, ["v"]).orderBy("ts").collect()]
    assert out[0] is None                                      # leading gap stays empty
    assert out[1:6] == [0.0, 10.0, 20.0, 30.0, 40.0]           # first 4 of a 7-slot gap, on the line
    assert out[6] is None and out[7] is None
    assert out[8] == 70.0
    assert out[9:13] == [70.0] * 4 and out[13] is None         # trailing gap repeats <= 4 times


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=1, max_size=40))
def test_interpolation_never_fills_more_than_limit(spark, vals):
    rows = [("a", slot(i), v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, v double")
    out = [r.v for r in align.interpolate_time(df, ["v"], limit=4).orderBy("ts").collect()]
    run = 0
    for src, got in zip(vals, out):
        if src is None and got is not None:
            run += 1
            assert run <= 4
        else:
            run = 0
        if src is not None:
            assert got == src


def test_dst_day_grid_lengths(spark):
    # market-local days with a DST change have 92 / 100 slots when the grid is
    # built in UTC and viewed in local time
    from tidewatt.functions.calendar import utc_to_local
    spring = spark.createDataFrame([("a", dt.datetime(2026, 3, 28, 22, 0)), ("a", dt.datetime(2026, 3, 29, 20, 45))],
                                   "series_id string, ts timestamp_ntz")
    g = align.resample_grid(spring).select(F.to_date(utc_to_local("ts")).alias("d"))
    assert g.filter("d = '2026-03-29'").count() == 92
    autumn = spark.createDataFrame([("a", dt.datetime(2025, 10, 25, 21, 0)), ("a", dt.datetime(2025, 10, 26, 21, 45))],
                                   "series_id string, ts timestamp_ntz")
    g = align.resample_grid(autumn).select(F.to_date(utc_to_local("ts")).alias("d"))
    assert g.filter("d = '2025-10-26'").count() == 100


def test_holidays(spark):
    days = spark.createDataFrame([(dt.date(2026, 1, d),) for d in range(1, 8)], "day date")
    hol = spark.createDataFrame([(dt.date(2026, 1, 1),), (dt.date(2026, 1, 6),)], "date date")
    f = {r.day.day: r for r in align.holiday_flags(days, hol).collect()}
    assert f[1].is_holiday == 1 and f[5].is_holiday_eve == 1 and f[7].is_holiday_after == 1
    assert f[3].is_holiday == 0 and f[3].is_holiday_eve == 0
    dth = {r.day.day: r.days_to_holiday for r in align.days_to_holiday(days, hol).collect()}
    assert dth == {1: 0, 2: 4, 3: 3, 4: 2, 5: 1, 6: 0, 7: 30}


def test_localize_dst_repeat_and_gap(spark):
    from tidewatt.functions.calendar import localize
    rows = [("a", dt.datetime(2025, 10, 26, 3, 30), 1), ("a", dt.datetime(2025, 10, 26, 3, 30), 2),
            ("a", dt.datetime(2026, 3, 29, 3, 15), 3), ("a", dt.datetime(2026, 1, 5, 12, 0), 4)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, rid int")
    out = {r.rid: r.ts_utc for r in localize(df, order="rid").collect()}
    assert out[1] == dt.datetime(2025, 10, 26, 0, 30)      # first pass: summer time (+3)
    assert out[2] == dt.datetime(2025, 10, 26, 1, 30)      # second pass: winter time (+2)
    assert out[3] == dt.datetime(2026, 3, 29, 1, 0)        # gap -> 04:00 local
    assert out[4] == dt.datetime(2026, 1, 5, 10, 0)
