import base64
import hashlib
import random

from tidewatt.llm import common, warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, digest string, offset int")


def rows():
    out = [(k, f"http://www.Host{k % 3}.example.com:80/p/{k % 5}?b=2&a={k}", f"<p>é\r\n\r\nWARC/1.0\r\n\r\n{k % 6}</p>" if k % 4 else "") for k in range(40)]
    return [*out, (100, None, None), (101, "http://x/\r\nInjected: 1", "😀" * 5000), (102, "not a url", "<p>é\r\n\r\nWARC/1.0\r\n\r\n1</p>"), (None, "http://n/", "alone"), (None, "http://n/", "")]


def test_round_trip(spark):
    data = rows()
    first = {}
    for page, _, html in data:
        if page is not None:
            first[digest(html)] = min(page, first.get(digest(html), page))
    found = warc.histories(pages(spark, data)).collect()
    expected = sorted(((p, len((h or "").encode()), digest(h), "response" if first.get(digest(h), p) == p else "revisit", None if first.get(digest(h), p) == p else first[digest(h)]) for p, _, h in data), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == expected
    # collect keeps the partitions' order: the index is globally sorted
    keys = [warc.order(tuple(r)) for r in found]
    assert keys == sorted(keys)


def test_short_payloads_are_all_responses(spark):
    found = warc.histories(pages(spark, rows()), least_bytes=10).collect()
    assert all(r.record_type == "response" for r in found if r.payload_bytes < 10) and any(r.record_type == "revisit" for r in found)


def test_empty_table(spark):
    assert warc.histories(pages(spark, [])).collect() == []


def test_loser_tree():
    rng = random.Random(3)
    row = lambda: (f"k{rng.randint(0, 9)}", f"t{rng.randint(0, 9)}", rng.choice([None, rng.randint(0, 9)]), "", "", 0, "", None, f"f{rng.randint(0, 3)}", rng.randint(0, 99), 1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((row() for _ in range(rng.randint(0, 12))), key=warc.order) for _ in range(k)]
        assert [warc.order(r) for r in warc.loser_tree(runs)] == sorted(warc.order(r) for run in runs for r in run)


def test_several_files_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    path = common.new_path(spark, "warc-test")
    warc.write_archives(pages(spark, rows()).repartition(4), path)
    captures = warc.read_captures(spark, path)
    assert captures.select("file").distinct().count() > 10
    merged = [warc.order(tuple(r)) for r in warc.merge_runs(captures, 5).collect()]
    assert len(merged) == len(rows()) and merged == sorted(merged)
