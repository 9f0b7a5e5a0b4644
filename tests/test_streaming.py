from pyspark.sql import functions as F

from tidewatt.operators import windows
from tidewatt.plans import fixtures as fx
from tidewatt.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_stream_windows_equal_batch_twin(spark):
    s = jobs.stream_windows(spark, SMALL)
    b = fx.price_slots(spark, SMALL)
    assert _rows(s, ["series_id", "ts", "price", "n_obs"]) == _rows(b, ["series_id", "ts", "price", "n_obs"])


def test_stream_rate_limit_equals_batch(spark):
    s = jobs.stream_rate_limit(spark, SMALL, max_requests=3, window_seconds=3600)
    b = windows.rate_limit_exact(fx.api_calls(spark, SMALL), 3, 3600)
    assert _rows(s, ["call_id", "accepted"]) == _rows(b, ["call_id", "accepted"])


def test_stream_metering_equals_batch(spark):
    s = jobs.stream_metering(spark, SMALL)
    b = fx.api_calls(spark, SMALL).groupBy("key_id", F.date_format("ts", "yyyy-MM").alias("period")) \
        .agg(F.count(F.lit(1)).alias("monthly_calls"))
    assert _rows(s, ["key_id", "period", "monthly_calls"]) == _rows(b, ["key_id", "period", "monthly_calls"])
