import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewatt.llm import common, toxicity

BAD = ["grukk", "zlop", "ÉKELHAFT"]


def held():
    return common.crc_mod(F.col("doc_id"), 4) == 2


def bags_of_prose(prose, n):
    """Documents of several sentences; every fifth has one sentence with a bad word."""
    rng, rows, bad = random.Random(5), [], {}
    for k in range(n):
        parts = [prose(50 * k + j, 4 + (k + j) % 9) for j in range(1 + k % 8)]
        if k % 5 == 0:
            j = rng.randrange(len(parts))
            parts[j] += " " + rng.choice(BAD) + ", " + prose(k, 2)
            bad[1000 + k] = ". ".join(parts[:j + 1]) + "."
        rows.append((1000 + k, ". ".join(parts) + "."))
    return rows, bad


def test_held_out_rows_and_their_sentences(spark, frame, odd, prose):
    made, bad = bags_of_prose(prose, 700)
    rows = [*odd, *made]
    labels = [(d, 1, int(d in bad)) for d, _ in made if d % 3 or d in bad] + [(1, None, None), (None, 1, 0), (77777, 1, 1), (1001, 1, 0), (1001, 1, 0)]
    docs, table = frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.score(docs, table, held(), least_docs=3).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in found)
    test = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id >= 1000]
    assert np.mean([(r.score >= 0.3) == (r.doc_id in bad) for r in test]) > 0.97
    for r in found:
        text = dict(made).get(r.doc_id)
        if r.doc_id in bad and r.score >= 0.3:  # exactly the sentence with the bad word
            assert [any(w in text[x.start:x.end] for w in BAD) for x in r.offending] == [True]
            assert bad[r.doc_id].endswith(text[r.offending[0].start:r.offending[0].end].strip())
    # labels of held-out rows, languages and sources change nothing
    turned = table.withColumn("toxic", F.when(held(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q")}), turned, held(), least_docs=3).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in found)


def test_no_labels_no_rows_and_the_bound_on_words(spark, frame, odd, prose):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(frame(odd), none, held()).collect()} == {0.0}
    assert toxicity.score(frame([]), none, held()).collect() == []
    clean = spark.createDataFrame([(d, 1, 0) for d in range(1, 11)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(frame(odd), clean, held()).collect()} == {0.0}
    made, bad = bags_of_prose(prose, 60)
    table = spark.createDataFrame([(d, 1, int(d in bad)) for d, _ in made], "doc_id long, quality int, toxic int")
    assert toxicity.train(frame(made), table, held(), 30, 0, 1) == 0.0  # no row fits into no words
    assert isinstance(toxicity.train(frame(made), table, held(), 30, 10**6, 1), toxicity.Model)


def test_sentences():
    spans, words = toxicity.sentences("Ab c!? É1d\n\n. -- x")
    assert words == [[b"ab", b"c"], ["É".encode(), b"d"], [b"x"]] and spans[0] == (0, 6)
    text = "w " * 150
    spans, words = toxicity.sentences(text)
    assert [len(w) for w in words] == [60, 60, 30] and [text[a:b].split() for a, b in spans] == [["w"] * 60, ["w"] * 60, ["w"] * 30]
    assert toxicity.sentences("") == ([], []) and toxicity.sentences("\n.!") == ([], [])


def test_gradient_descends_and_noisy_or_is_the_product():
    rng = np.random.default_rng(1)
    scores, owner = rng.uniform(0, 0.9, 30), np.sort(rng.integers(0, 6, 30))
    plain = [1 - 0.9 * np.prod(1 - scores[owner == k]) for k in range(6)]
    assert np.allclose(toxicity.noisy_or(scores, owner, 6, 0.1), plain)
    # two texts of two sentences: word 0 stands in the toxic one alone, word 1 in all
    word, of, owner = np.array([0, 1, 1, 1, 1]), np.array([0, 0, 1, 2, 3]), np.array([0, 0, 1, 1])
    w, bias, leak = toxicity.fit(word, of, owner, np.array([True, False]), 2)
    assert w[0] > 3 and w[1] < 1 and bias < 0 and leak < 0.5
