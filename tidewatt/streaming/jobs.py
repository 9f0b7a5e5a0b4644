"""Structured Streaming twins (H1-H5).

The studied system polls every 15 minutes and keeps an in-memory limiter;
here each continuous part is a streaming query over the landed files:

* H1 ingest: file source -> watermark -> ``dropDuplicatesWithinWatermark``.
* H2 15-minute / 24-hour windows: ``window()`` aggregates in update mode,
  upserted per micro-batch by ``foreachBatch`` (idempotent by batch id).
* H3 rate limit: ``transformWithStateInPandas`` with a bounded list state
  per key (RocksDB state store).
* H4 KPI: ``foreachBatch`` runs the batch backtest for complete days and
  appends once (anti-join on the date).
* H5 metering: calls per key and month, update mode upsert.

All sinks and checkpoints live under the shared ``spark.checkpoint.dir``;
queries use ``trigger(availableNow=True)`` so a scheduled run drains what
landed and stops (restartable from the checkpoint after a failure).
"""

from __future__ import annotations

import collections
import datetime
import uuid
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

from tidewatt.operators.windows import limit_call
from tidewatt.session import scratch_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    run = uuid.uuid4().hex[:12]
    return scratch_path(spark, f"streams/{name}/{run}/out"), scratch_path(spark, f"streams/{name}/{run}/ckpt")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The ``events`` table as a file stream (schema declared, no inference)."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
         .option("maxFilesPerTrigger", 1).parquet(d))
    # event time must be TIMESTAMP for watermarks; the session zone is UTC so
    # the wall-clock value is unchanged (cast back to NTZ on output)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(writer):
    """Drain everything that has landed: waits until the query ends by itself
    and raises its error, so a result is never partial."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))


def _upsert_sink(out: str):
    """foreachBatch writer: each micro-batch lands under its batch id
    (overwrite of that id only), so a retried batch replaces itself."""
    def write(df: DataFrame, batch_id: int):
        df.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite") \
          .parquet(f"{out}/_batch={batch_id}")
    return write


def read_upserts(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Latest version of each key across the upserted micro-batches."""
    df = spark.read.option("basePath", out).parquet(f"{out}/_batch=*")
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return df.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk", "_batch")


def stream_ingest(spark: SparkSession, d: str, watermark: str = "1 hour") -> DataFrame:
    """H1: land new observations, deduplicated on (series, ts) within the
    watermark; rows later than the watermark are dropped."""
    out, ck = _paths(spark, "ingest")
    s = (event_stream(spark, d)
         .select(F.col("event_type").alias("series_id"), "ts", "value", "event_id", "user_id", "props")
         .withWatermark("ts", watermark)
         .dropDuplicatesWithinWatermark(["series_id", "ts"])
         .withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    _run(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append"))
    return spark.read.parquet(out)


def stream_windows(spark: SparkSession, d: str, width: str = "15 minutes", slide: str | None = None,
                   watermark: str = "1 hour") -> DataFrame:
    """H2: tumbling (or sliding) window mean / count per series.  A sliding
    window adds up the sums of its steps, so an event is never copied once per
    window it lies in."""
    out, ck = _paths(spark, "windows")
    step = slide or width
    slots = (event_stream(spark, d).withWatermark("ts", watermark)
             .groupBy(F.col("event_type").alias("series_id"), F.window("ts", step).alias("w"))
             .agg(F.sum("value").alias("total"), F.count("value").alias("n_values"), F.count(F.lit(1)).alias("n_obs"))
             .select("series_id", F.col("w.start").alias("ts"), "total", "n_values", "n_obs"))
    _run(slots.writeStream.outputMode("update").foreachBatch(_upsert_sink(out)).option("checkpointLocation", ck))
    landed = read_upserts(spark, out, ["series_id", "ts"])
    if slide:
        landed = (landed.groupBy("series_id", F.window("ts", width, slide).alias("w"))
                  .agg(*(F.sum(c).alias(c) for c in ("total", "n_values", "n_obs")))
                  .withColumn("ts", F.col("w.start")).drop("w"))
    price = F.col("total") / F.nullif(F.col("n_values"), F.lit(0))
    return landed.select("series_id", F.col("ts").cast("timestamp_ntz").alias("ts"), price.alias("price"), "n_obs")


def stream_metering(spark: SparkSession, d: str) -> DataFrame:
    """H5: calls per key and calendar month, update mode."""
    out, ck = _paths(spark, "metering")
    s = (event_stream(spark, d).withWatermark("ts", "1 day")
         .groupBy(F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("key_id"),
                  F.date_format("ts", "yyyy-MM").alias("period"))
         .agg(F.count(F.lit(1)).alias("monthly_calls")))
    _run(s.writeStream.outputMode("update").foreachBatch(_upsert_sink(out)).option("checkpointLocation", ck))
    return read_upserts(spark, out, ["key_id", "period"])


# ------------------------------------------------------------ rate limit --

def stream_rate_limit(spark: SparkSession, d: str, max_requests: int = 3, window_seconds: int = 3600) -> DataFrame:
    """H3: accepted-only sliding log per key.  The state per key is the list
    of accepted timestamps inside the window (<= max_requests entries), so
    it stays bounded however hot the key is."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    log_schema = StructType([StructField("t", LongType())])

    class Limiter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            # the last max_requests accepted times per key.  (State TTL needs
            # processing-time mode, which keeps an availableNow query alive.)
            self.log = handle.getListState("log", log_schema)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            # a micro-batch's rows of a key come in any order: only their
            # times and ids are held to sort them
            parts = [(pd.to_datetime(p["ts"]).to_numpy().astype("datetime64[us]"), p["call_id"].to_numpy()) for p in rows]
            ts, ids = (np.concatenate([p[k] for p in parts]) for k in range(2))
            order = np.lexsort((ids, ts))
            ts, ids = ts[order], ids[order]
            accepted = collections.deque((int(r[0]) for r in self.log.get()) if self.log.exists() else (), max_requests)
            verdicts = [limit_call(accepted, us, max_requests, window_seconds * 1_000_000) for us in ts.astype("int64").tolist()]
            self.log.clear()
            if accepted:
                self.log.put(pd.DataFrame({"t": list(accepted)}))
            yield pd.DataFrame({"key_id": key[0], "call_id": ids, "ts": ts.astype("datetime64[ns]"),
                                "accepted": [w == 0 for w in verdicts], "retry_after": verdicts})

        def close(self) -> None:
            pass

    out, ck = _paths(spark, "ratelimit")
    calls = event_stream(spark, d).select(
        F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("key_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("call_id"))
    schema = "key_id string, call_id long, ts timestamp_ntz, accepted boolean, retry_after int"
    s = calls.groupBy("key_id").transformWithStateInPandas(
        statefulProcessor=Limiter(), outputStructType=schema, outputMode="Append", timeMode="None")
    # the state API needs RocksDB; the session's own provider is put back
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        _run(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append"))
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.parquet(out)


# ------------------------------------------------------------------ KPI ----

def complete_days(slots: DataFrame, min_mtus: int = 90, max_missing: float = 0.10) -> DataFrame:
    """H4 gate: days with ``min_mtus`` observed slots and at most
    ``max_missing`` of the 96 without one."""
    seen = slots.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.count("price").alias("n_slots"))
    return seen.filter((F.col("n_slots") >= min_mtus) & (F.col("n_slots") >= (1 - max_missing) * 96))


def stream_kpi(spark: SparkSession, d: str, min_mtus: int = 90, max_missing: float = 0.10) -> DataFrame:
    """H4: for each micro-batch, evaluate the days it touched once they hold
    >= 90 MTUs with <= 10 % missing slots, and append each date once."""
    from tidewatt.operators import dispatch, tables
    from tidewatt.plans import fixtures as fx
    from tidewatt.plans.q_dispatch import dispatch_frame

    log_path, ck = _paths(spark, "kpi")
    empty = spark.createDataFrame([], "series_id string, day date, perfect_eur double, realized_eur double, "
                                      "capture_ratio double, n_mtus int")
    empty.write.mode("overwrite").parquet(log_path + "/log")

    def evaluate(batch: DataFrame, batch_id: int):
        days = batch.select(F.col("event_type").alias("series_id"), F.to_date("ts").alias("day")).distinct()
        lo, hi = days.agg(F.min("day"), F.max("day")).first()
        if lo is None:
            return
        # only the touched days plus three days of history (the forecast
        # needs two) are read; the filter is pushed to the landed files
        since = datetime.datetime.combine(lo - datetime.timedelta(days=3), datetime.time())
        until = datetime.datetime.combine(hi + datetime.timedelta(days=1), datetime.time())
        frame = dispatch_frame(spark, d, since, until).join(days, ["series_id", "day"], "left_semi")
        # slots that were observed, before any filling: an outage counts
        ok = complete_days(fx.price_slots(spark, d, since, until), min_mtus, max_missing).join(days, ["series_id", "day"], "left_semi")
        bt = dispatch.backtest_daily(frame.join(ok.select("series_id", "day"), ["series_id", "day"], "left_semi"),
                                     fx.assets(spark, d))
        # one row per series and day over all its specs
        rec = bt.groupBy("series_id", "day").agg(F.sum("perfect_eur").alias("perfect_eur"), F.sum("realized_eur").alias("realized_eur"),
                                                 F.max("n_mtus").alias("n_mtus"))
        rec = rec.select("series_id", "day", "perfect_eur", "realized_eur",
                         F.when(F.col("perfect_eur") > 0, F.col("realized_eur") / F.col("perfect_eur")).otherwise(F.lit(0.0)).alias("capture_ratio"), "n_mtus")
        log = spark.read.parquet(log_path + "/log")
        new = rec.join(log.select("series_id", "day"), ["series_id", "day"], "left_anti")
        new.write.mode("append").parquet(log_path + "/log")

    _run(event_stream(spark, d).writeStream.foreachBatch(evaluate).option("checkpointLocation", ck))
    return spark.read.parquet(log_path + "/log")
