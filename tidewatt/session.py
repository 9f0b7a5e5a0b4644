"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Fixed defaults of the market model (not tuning knobs).
MTU_MINUTES = 15
SLOTS_PER_DAY = 96
MARKET_ZONE = "Europe/Athens"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tidewatt") -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes.

    * session time zone UTC: parquet timestamps in the inputs are zone-less
      (TIMESTAMP_NTZ); calendar work is done on market-local wall time.
    * AQE with skew-join splitting and partition coalescing: shuffles are
      sized at runtime, so one plan serves sf0.001 and 100 TB.
    * Arrow for the grouped-map dispatch solver.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
         .config("spark.ui.enabled", "false"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised tables.

    On a cluster this is what ``spark.checkpoint.dir`` names (a shared
    filesystem), and it is an error not to name one: executors do not see the
    driver's folders.  Only a local session makes its own."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tidewatt-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint dir for a named artefact."""
    base = checkpoint_dir(spark)
    if "://" in base:
        return f"{base.rstrip('/')}/{name}"
    return os.path.join(base, name)


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder
    (survives executor loss; never a local checkpoint).  Used before
    iterative consumers such as the boosted-tree fits."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
