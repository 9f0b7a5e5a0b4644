import re

import pytest

from tidewatt.llm import graph, jaccard_join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    smallest = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            smallest[top(k)] = min(d, smallest.get(top(k), d))
    return sorted(((d, len(sets[k]), smallest.get(top(k))) for k, (d, _) in enumerate(rows)), key=str)


def near(text, seed, changes):
    words = text.split()
    for k in range(changes):
        words[(seed * 31 + k * 17) % len(words)] = f"new{seed}x{k}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows(odd, prose):
    base, passage = prose(70, 200), prose(71, 60)
    out = list(odd)
    out += [(100 + k, near(base, k, k % 6)) for k in range(25)]  # links and near misses, in chains
    out += [(200 + k, prose(400 + k, 70) + " " + passage) for k in range(25)]  # one passage, no links
    out += [(300 + k, passage + " " + " ".join(prose(500, 30).split()[:k])) for k in range(20)]  # sizes at the bound
    out += [(400, "a b c"), (401, "A B c"), (402, "a b"), (403, "a b c d e"), (404, "A b c d E")]
    return out


@pytest.mark.parametrize("slice_rows", [1024, 3])
def test_against_brute_force(frame, rows, slice_rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SLICE", slice_rows)
    found = jaccard_join.linked(frame(rows))
    assert sorted(((r.doc_id, r.n, r.component_id) for r in found.collect()), key=str) == plain(rows)


def test_one_stays_of_each_component(frame, rows):
    docs = frame(rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    components = {}
    for d, n, c in plain(rows):
        if n and c is not None:
            components.setdefault(c, []).append(d)
    assert all(ids.count(c) == 1 for c in components)
    assert not any(d in ids for c, members in components.items() for d in members if d is not None and d != c)


def test_bit_bound_never_loses_a_pair(prose):
    import numpy as np
    texts = [near(prose(70, 200), k, k % 9) for k in range(30)] + [prose(600 + k, 190) for k in range(10)]
    sets = [jaccard_join.shingle_set(t) for t in texts]
    rows = [(k, k, len(s), True, 0, jaccard_join.bitmap(s)) for k, s in enumerate(sets)]
    for work in (jaccard_join.possible, jaccard_join.certain):
        told = sorted(rows if work is jaccard_join.possible else [(*r[:5], x.tobytes()) for r, x in zip(rows, sets)], key=lambda r: r[2])
        group = {r[0]: r[0] for r in told}
        for x, y in work(told, 0, 0):
            old, new = group[told[x][0]], group[told[y][0]]
            group = {k: new if g == old else g for k, g in group.items()}
        for a in range(len(texts)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    assert group[a] == group[b]


def test_empty_table(frame):
    assert jaccard_join.linked(frame([])).collect() == [] and jaccard_join.keep_one(frame([])).collect() == []


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(0, 90)] + [(200, 300), (300, 250)]
    found = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(91)) and found[300] == found[250] == 200
