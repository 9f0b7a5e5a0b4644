"""Helpers shared by the training-data operators.

Every operator takes DataFrames, selects only the columns it names (so extra
columns with clashing names are harmless) and keeps rows with null ids.
Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks of the word rules: space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: A-Z to a-z for UTF-8 bytes.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; its own folder only where that
    is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewatt-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/tidewatt-llm/{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage with replicated storage instead of executor memory."""
    path = new_path(df.sparkSession, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidewatt_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``store`` once nothing reads it any more."""
    spark, path = df.sparkSession, df._tidewatt_path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small driver-made file, through Hadoop's file system API."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts(batches, rows: int = 500):
    """Batches cut to ``rows``, so that a task holds few texts at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; equal words hash once."""
    seen: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    table = np.fromiter((digest(w) for w in seen), np.uint64, len(seen))
    return table[ids] if len(words) else np.empty(0, np.uint64)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; a shorter, non-empty text is one
    run.  ``words`` are 64-bit word hashes."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(n, size)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k:n - width + 1 + k] + np.uint64(width))
    return out


def crc_mod(col, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


#: Bits of a BitTable, at most 2 ** MOST_BITS (16 MB).
MOST_BITS = 27


class BitTable:
    """A bounded sieve of hashes to broadcast: one bit per hash, 32 bits for
    each distinct one until MOST_BITS.  What it lets through is always checked
    exactly later, so a full table only sifts less and changes no result."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.mask = packed, np.int64(8 * len(packed) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & self.mask
        return (self.packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, table: DataFrame, column: str) -> "BitTable":
        """Built by Spark; the driver gets the table's 4 KB pieces."""
        count = table.agg(F.approx_count_distinct(column)).first()[0]
        size = 1 << min(MOST_BITS, max(17, int(32 * count).bit_length()))
        place = F.pmod(F.col(column), F.lit(size)) + 1
        pieces = table.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        packed = np.zeros(size // 8, np.uint8)
        for piece in pieces.collect():
            at = (piece.bucket - 1) * 4096
            packed[at:at + 4096] = np.frombuffer(bytes(piece.bits), np.uint8)
        return cls(packed)
