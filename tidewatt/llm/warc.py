"""Operator 9: WARC archives, and capture histories by external index merge.

``write_archives`` writes one WARC record per page with Spark's text writer:
a record is a row, and the blank lines that end it are the line separator, so
files are committed, retried and stored like any Spark output.  A payload met
before (smallest page_id first) becomes a revisit record without its body.
``read_captures`` parses the archives by Content-Length; every file gives a
run of captures sorted by URL key and time.  ``merge_runs`` deals the runs
out by key range and merges each range's k runs with a loser tree, so the
output is one global order over all partitions.

Defined results: null html is an empty payload; null urls have an empty key;
rows with a null page_id count as larger than all others; rows that share the
smallest page_id and a payload are all responses; an empty table gives empty
archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Records of one archive file: bounds what a reading task holds.
FILE_RECORDS = 4000


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five of them are four letters."""
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def with_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, payload_bytes and, for revisits, refers_to.

    Which payloads repeat is found on ids and digests alone; the bodies are
    then dealt out by id and digest, so a payload that a third of all pages
    share does not meet in one task."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"),
                        F.sha1(html.cast("binary")).alias("hexed"), F.octet_length(html).cast("long").alias("payload_bytes"))
    light = rows.where(F.col("payload_bytes") >= least_bytes).select("page_id", "hexed")
    first = light.groupBy("hexed").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 and first_id is not null").drop("copies")
    again = light.join(first, "hexed").where(F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))).distinct()
    again = again.select(F.col("page_id").alias("again_id"), F.col("hexed").alias("again_hexed"), F.col("first_id").alias("refers_to"))
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("hexed") == F.col("again_hexed")), "left")
    return joined.select("page_id", "url", "html", base32(F.col("hexed")).alias("digest"), "payload_bytes", "refers_to")


def record(began: str) -> Column:
    """The record's text, without the blank lines that end it.  Captures are
    dated page_id seconds after ``began``."""
    clean = lambda c: F.regexp_replace(c, r"[\x00-\x20\x7f]", "%20")
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(began)) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.col("payload_bytes"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    uid = F.md5(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest").cast("binary"))
    uuid = F.regexp_replace(uid, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    lines = [F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
             F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")), F.concat(F.lit("WARC-Date: "), date),
             F.concat(F.lit("WARC-Target-URI: "), clean("url")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
             F.concat(F.lit("X-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
             F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" + CRLF + "X-Refers-To-Page-Id: "), F.col("refers_to"))),
             F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, began: str = "2024-01-01 00:00:00") -> None:
    """One gzip WARC file or more per task, FILE_RECORDS records at most each."""
    rows = with_records(pages, least_bytes).select(record(began).alias("value"))
    rows.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        top = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:top].decode().split(CRLF)
        if version != "WARC/1.0":
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        end = top + 4 + int(headers["Content-Length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} doesn't end where its length says")
        yield at, end + 4 - at, headers, data[top + 4:end]
        at = end + 4


def url_key(url: str) -> str:
    """Sort-friendly key: reversed host, path, sorted query."""
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{query}" if query else "")


CAPTURES = "url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"
NAMES = [c.split()[0] for c in CAPTURES.split(", ")]


def captures_of(data: bytes, file: str) -> list[tuple]:
    """The archive's run: its captures sorted by key, time and id."""
    out = []
    for offset, length, headers, block in parse(data):
        top, _, body = block.partition(b"\r\n\r\n")
        size = int(top.rpartition(b"Content-Length: ")[2])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = headers["WARC-Type"]
        if kind == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
            raise ValueError(f"{file}, record at {offset}: payload and digest differ")
        number = lambda name: int(headers[name]) if headers.get(name) else None
        url = headers["WARC-Target-URI"]
        out.append((url_key(url), headers["WARC-Date"], number("X-Page-Id"), url, kind, size, digest, number("X-Refers-To-Page-Id"), file, offset, length))
    return sorted(out, key=order)


def order(row: tuple) -> tuple:
    return row[0].encode(), row[1], -1 if row[2] is None else row[2], row[8], row[9]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    columns = list(zip(*rows)) or [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, CAPTURES.split(", "))], NAMES)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under ``path``, a sorted run per file."""
    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows = captures_of(zlib.decompress(content.as_py(), 31), file.as_py())
                yield from (batch_of(rows[k:k + 10_000]) for k in range(0, len(rows), 10_000))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).where("length > 0")
    # one file a batch: a task never holds more than one archive's bytes twice
    return files.select("path", "content").mapInArrow(run, CAPTURES)


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs: every inner node keeps the loser of its match, and
    the winner replays only its own path to the root."""
    k = len(runs)
    if k == 0:
        return
    heads = [0] * k
    key = [order(r[0]) if r else None for r in runs]

    def beats(a: int, b: int) -> bool:
        """An exhausted run loses to all; equal keys go by run number."""
        if key[a] is None or key[b] is None:
            return key[a] is not None or (key[b] is None and a < b)
        return (key[a], a) < (key[b], b)

    losers, winners = [0] * k, [0] * (2 * k)
    for leaf in range(k):
        winners[k + leaf] = leaf
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    champion = winners[1] if k > 1 else 0
    while key[champion] is not None:
        run = runs[champion]
        yield run[heads[champion]]
        heads[champion] += 1
        key[champion] = order(run[heads[champion]]) if heads[champion] < len(run) else None
        node = (k + champion) // 2
        while node:
            if beats(losers[node], champion):
                losers[node], champion = champion, losers[node]
            node //= 2


def merge_runs(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """Captures in one global order by URL key, time and id: partition k's
    rows all come before partition k + 1's.  Ranges are cut on the whole sort
    key, so one URL's long history is split as well."""
    def run(batches):
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(row[8], []).append(row)
        pieces = []
        for file in sorted(runs):
            piece = runs.pop(file)
            keys = [order(r) for r in piece]
            if any(a > b for a, b in zip(keys, keys[1:])):  # shuffled blocks of one run may arrive in any order
                piece.sort(key=order)
            pieces.append(piece)
        out = []
        for row in loser_tree(pieces):
            out.append(row)
            if len(out) == 10_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    count = partitions or common.partitions_of(captures.sparkSession)
    ranged = captures.repartitionByRange(count, "url_key", "captured", "page_id", "file", "offset")
    return ranged.mapInArrow(run, CAPTURES)


def histories(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back, and
    return the merged index."""
    spark = pages.sparkSession
    path = common.new_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    return merge_runs(common.store(read_captures(spark, path), "runs"))
