import re

from tidewatt.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    met |= windows[tuple(w[k:k + size])]
        out.append((doc_id, len(w), len(hit), sorted(str(i) for i in met if i is not None), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_against_brute_force(spark, frame, odd, prose):
    items = [(1, prose(100, 40)), (2, prose(101, 13)), (3, "Moon-table QUIET"), (4, "lamp"), (5, ""), (6, None), (None, prose(102, 30)), (7, prose(100, 40)), (10, "a b c d")]
    docs = [*odd, (20, prose(5, 60) + " " + prose(100, 40) + " " + prose(6, 30)), (21, prose(100, 40)[40:]), (22, "x " * 30 + "moon.TABLE quiet x"),
            (23, " ".join(prose(101, 13).split()[:12])), (24, prose(101, 13).upper().replace("É", "é").replace("Ü", "ü")), (25, "A, b; c d! " * 20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(frame(docs), benchmark)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found.collect()), key=str)
    assert got == plain(docs, items)
    clean = decontaminate.keep_clean(frame(docs), benchmark)
    bad = {t for (d, t) in docs if plain([(d, t)], items)[0][4]}
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(str(x) for x in docs if x[1] not in bad)


def test_empty_tables(spark, frame, odd):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.contamination(frame(odd), nothing).collect())
    one = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontaminate.contamination(frame([]), one).collect() == []
