"""Registered queries: streaming twins (H1-H5).  Only the dispatch KPI (H4)
has no SQL form; its gate has.  tests/test_streaming.py asserts stream =
batch."""

from __future__ import annotations

from tidewatt.functions.columns import round_doubles
from tidewatt.plans import fixtures as fx
from tidewatt.plans.q_metrics import LIMIT, LIMIT_SECONDS, SQL_LIMIT
from tidewatt.plans.sqlutil import oracle
from tidewatt.streaming import jobs

Q, SQL = {}, {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# (series, ts) is unique in the landed events, so the deduplicated stream
# equals the table.
@reg("H1_stream_ingest", oracle([], "SELECT event_type AS series_id, ts, value, event_id, user_id, props FROM events",
                                ["value"]))
def h1(spark, d):
    return round_doubles(jobs.stream_ingest(spark, d))


@reg("H2_stream_15min", oracle([fx.SQL_SLOTS], "SELECT series_id, ts, price, n_obs FROM slots", ["price"]))
def h2(spark, d):
    return round_doubles(jobs.stream_windows(spark, d))


@reg("H2_stream_24h_sliding", oracle([], """
SELECT series_id, ts, avg(value) AS price, count(*) AS n_obs FROM (
  SELECT event_type AS series_id, value,
         time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS ts
  FROM events, range(96) r(k)) x GROUP BY 1, 2""", ["price"]))
def h2s(spark, d):
    return round_doubles(jobs.stream_windows(spark, d, "24 hours", "15 minutes", watermark="1 day"))


@reg("H3_stream_rate_limit", SQL_LIMIT)
def h3(spark, d):
    return jobs.stream_rate_limit(spark, d, LIMIT, LIMIT_SECONDS)


@reg("H4_complete_days", oracle([fx.SQL_SLOTS], """
SELECT series_id, CAST(ts AS DATE) AS day, count(price) AS n_slots FROM slots GROUP BY 1, 2
HAVING count(price) >= 48 AND count(price) >= 0.5 * 96"""))
def h4_gate(spark, d):
    """The gate of H4 at a level that the sparse test feed reaches."""
    return jobs.complete_days(fx.price_slots(spark, d), 48, 0.5)


@reg("H4_stream_kpi")
def h4(spark, d):
    """At the gate that the sparse test feed reaches (see H4_complete_days)."""
    return round_doubles(jobs.stream_kpi(spark, d, 48, 0.5))


@reg("H5_stream_metering", oracle([], """
SELECT 'key-' || CAST(user_id AS VARCHAR) AS key_id, strftime(ts, '%Y-%m') AS period, count(*) AS monthly_calls
FROM events GROUP BY 1, 2"""))
def h5(spark, d):
    return jobs.stream_metering(spark, d)
