import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatt.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {x: x + 32 for x in range(65, 91)}


def plain(rows, least_docs, ranks):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= least_docs]
        counts = defaultdict(Counter)
        for one, source, words in docs:
            if one == lang:
                counts[source].update(w for w in words if seen[w] >= least_docs)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q = p(sum(counts.values(), Counter()))
        shares = {s: p(c) for s, c in counts.items()}
        for s in shares:
            for part, items in (("pair", [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in shares if o != s]),
                                ("term", [(shares[s][t] - q[t], t) for t in kept if counts[s][t] and shares[s][t] > q[t]])):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < ranks]
    return sorted(out)


def found(frame, least_docs, ranks):
    return sorted(tuple(r) for r in divergence.audit(frame, least_docs, ranks).collect())


def corpus(odd, prose):
    rows = [(d, t, "en", "s") for d, t in odd]
    for k in range(240):
        lang = ("en", "de", None, "")[k % 4]
        source = ("hot", "hot", "b", None, "c", "É")[k % 6] if k % 4 < 2 else "one"
        rows.append((k, prose(k, 5 + k % 60) + " É é" * (k % 3) + " Rare" * (k % 7 == 0), lang, source))
    return rows + [(900, "x", "fr", "a"), (901, None, "fr", "b"), (901, None, "fr", "b"), (902, "", "it", None)]


@pytest.mark.parametrize("piece,tile,merged", [(8192, 64, 16), (4, 2, 2)])
def test_against_brute_force(frame, odd, prose, monkeypatch, piece, tile, merged):
    for name, value in (("PIECE", piece), ("TILE", tile), ("MERGED", merged), ("HELD", 20)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(odd, prose)
    got = found(frame(rows), 8, 5)
    assert got == plain(rows, 8, 5)
    assert {r[0] for r in got} == {"en", "de", "fr"}  # a language of one source has no rows


def test_empty_table(frame):
    assert found(frame([]), 30, 50) == []


def test_skyband_is_exact_and_decides(frame, odd, prose, monkeypatch):
    rng = np.random.default_rng(3)
    for k in (1, 3, 50):
        high, low = rng.integers(0, 30, 900), rng.integers(0, 30, 900)
        dominators = [int(((high[:i] >= high[i]) & (low[:i] <= low[i])).sum()) for i in range(900)]
        assert divergence.skyband(high, low, k, 64).tolist() == [i for i, n in enumerate(dominators) if n < k]
    # the ranks come from the retained terms: with none retained there are none
    monkeypatch.setattr(divergence, "skyband", lambda high, low, k, step=512: np.empty(0, np.int64))
    assert {r[2] for r in found(frame(corpus(odd, prose)), 8, 5)} == {"pair"}
