import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tidewatt.llm import suffix_dedup


def plain(rows, threshold):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[k:k + threshold] for _, b in texts for k in range(len(b) - threshold + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - threshold + 1):
            if seen[b[k:k + threshold]] > 1:
                gone[k:k + threshold] = b"\1" * threshold
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs, threshold):
    rows = suffix_dedup.dedupe(docs, threshold).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    return sorted(((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), r.kept_sha256) for r in rows), key=str)


@pytest.mark.parametrize("threshold", [60, 100])
def test_against_brute_force(frame, odd, prose, threshold):
    passage, other = prose(50, 60), prose(51, 30)
    rows = [*odd, *((100 + k, prose(200 + k, 30) + passage[k:] + prose(300 + k, 20)) for k in range(12)),
            (200, other + prose(52, 40) + other), (201, "ab" * 400), (202, "a" * 99), (203, "a" * 100), (204, "a" * 101), (205, passage[:threshold]), (206, passage[3:threshold + 2]),
            (207, "é" * 40 + passage), (208, passage[:300] + "X" + passage[301:])]
    assert found(frame(rows), threshold) == plain(rows, threshold)


def sharing(rows, words=51):
    """Documents (id and text) with a passage of so many words that another has as well."""
    holders = {}
    for row in {(d, t or "") for d, t in rows}:
        found = re.findall(r"[^\x20\x09-\x0D]+", row[1])
        for k in range(len(found) - words + 1):
            holders.setdefault(tuple(found[k:k + words]), set()).add(row)
    return {row for rows in holders.values() if len(rows) > 1 for row in rows}


def test_passages_under_the_threshold(frame, odd, prose):
    short = " ".join(prose(60, 60).split()[k][:4] for k in range(51))
    cut, other = " ".join(short.split()[1:]), prose(61, 51)
    assert len(short.encode()) < 400
    rows = [*odd, (300, prose(62, 70) + "\n" + short + " " + prose(63, 40)), (301, prose(64, 20) + " " + short.replace(" ", "\t ")), (302, prose(65, 90) + " x " + cut + " y " + prose(66, 9)),
            (303, prose(67, 30) + " " + other + " z " + other), (304, "se " * 300), (305, "se " * 50), (306, prose(68, 200)), (307, " ".join(prose(68, 200).split()[70:122]) + "q"),
            *((310 + k, f"{prose(70 + k, 25)} {prose(69, 80)} {prose(90 + k, 25 + k)}") for k in range(9)), (320, "to be " * 200), (321, "be to " * 27)]
    found = suffix_dedup.dedupe(frame(rows)).collect()
    texts = sharing(rows)
    assert sorted((r.doc_id or 0, r.has_passage) for r in found) == sorted((d or 0, (d, t or "") in texts) for d, t in rows)
    assert {300, 301, 320, 321} <= {r.doc_id for r in found if r.has_passage} and not {302, 303, 304, 305} & {r.doc_id for r in found if r.has_passage}
    assert not any(r.spans for r in found if r.doc_id in (300, 301))


def test_small_chunks_and_empty_table(frame, monkeypatch, prose):
    assert suffix_dedup.dedupe(frame([]), 400).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.dedupe(frame([]), 20)


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 1000, 257).astype(np.uint64)
    for width in (1, 2, 7, 64, 257):
        assert suffix_dedup.sliding_min(x, width).tolist() == [x[k:k + width].min() for k in range(len(x) - width + 1)]
