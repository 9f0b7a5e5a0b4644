import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatt.llm import common, katz


def plain(rows, most=5):
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)})) + [None], zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2) for d, t in rows]
    one, two = Counter(), defaultdict(Counter)
    for _, w, held in texts:
        if not held:
            one.update(w)
            for a, b in zip([0, *w], w):
                two[a][b] += 1
    total, known = sum(one.values()), len(one)
    of = lambda counts: [sum(c == r for c in counts) for r in range(1, most + 2)]
    d1 = katz.discounts(of(one.values()), most)
    d2 = katz.discounts(of([c for f in two.values() for c in f.values()]), most)
    d = lambda table, c: table[c - 1] if c <= len(table) else 1.0
    share = {w: d(d1, c) * c / total for w, c in one.items()}
    rest = 1 - sum(share.values())
    if rest < 1e-12:
        scale = total / (total + 1) if total else 1.0
        share, rest = {w: s * scale for w, s in share.items()}, 1 / (total + 1) if total else 1.0

    def p(a, b):
        if a not in two:
            return share.get(b, rest)
        f = two[a]
        n = sum(f.values())
        left, scale = 1 - sum(d(d2, c) * c / n for c in f.values()), 1.0
        if left < 1e-12:
            left, scale = 1 / (n + 1), n / (n + 1)
        return scale * d(d2, f[b]) * f[b] / n if f.get(b) else left / (1 - sum(share[w] for w in f)) * share.get(b, rest)

    # every context's shares add up to one
    for a in [*two][:50]:
        assert abs(sum(p(a, b) for b in share) + p(a, "never seen at all") - 1) < 1e-9
    return sorted(((x, held, len(w), sum(one[b] > 0 for b in w), total, round(sum(math.log10((one[b] + 1) / (total + known + 1)) for b in w), 7),
                    round(sum(math.log10(p(a, b)) for a, b in zip([0, *w], w)), 7)) for x, w, held in texts), key=str)


def found(docs):
    rows = katz.score(docs, common.crc_mod(F.col("doc_id"), 7) == 2).collect()
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7), round(r.score, 7)) for r in rows), key=str)


@pytest.mark.parametrize("chunk,bucket", [(2_000_000, 10_000_000), (300, 900)])
def test_against_brute_force(frame, odd, prose, monkeypatch, chunk, bucket):
    monkeypatch.setattr(katz, "CHUNK", chunk)
    monkeypatch.setattr(katz, "BUCKET", bucket)
    monkeypatch.setattr(katz, "LEAST_HOT", 20)
    rows = [*odd, *((100 + k, prose(k, 30 + k) + f" rare{k} Rare{k % 7}") for k in range(60))]
    assert found(frame(rows)) == plain(rows)


def test_few_or_no_training_rows(frame):
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    rows = [(d, "some words here") for d in held]
    assert found(frame(rows)) == plain(rows)
    assert found(frame([])) == []
    rows.append((next(d for d in range(200) if d not in held and zlib.crc32(str(d).encode()) % 7 != 2), "some other words some"))
    assert found(frame(rows)) == plain(rows)


def test_discounts_fall_back():
    assert katz.discounts([10, 4, 2, 1, 1, 1], 5) != katz.discounts([0] * 6, 5) == [(r - 0.5) / r for r in range(1, 6)]
    assert all(0 < x < 1 for x in katz.discounts([100, 30, 12, 6, 4, 2], 5))
