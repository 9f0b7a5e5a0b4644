import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewatt.llm import common, pu_quality


def held():
    return common.crc_mod(F.col("doc_id"), 4) == 2


def test_held_out_rows(spark, frame, odd, prose):
    rows, labels = list(odd), []
    for k in range(400):
        good = k % 4 != 0
        text = prose(k, 40 + k % 50)
        rows.append((1000 + k, text if good else " ".join(w + "###" for w in text.split())))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((1000 + k, int(good), 0))
    labels += [(1, None, None), (None, 1, 0), (77777, 1, 0), (1001, 1, 0), (1001, 1, 0)]
    docs, table = frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = pu_quality.score(docs, table, held()).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in found)
    test = [(r.score >= 0.7, (r.doc_id - 1000) % 4 != 0) for r in found if r.held_out and r.doc_id is not None and r.doc_id >= 1000]
    assert np.mean([a == b for a, b in test]) > 0.97
    # labels of held-out rows, ids and languages change nothing
    turned = table.withColumn("quality", F.when(held(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = pu_quality.score(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q")}), turned, held()).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in found)


def test_no_labels_and_no_rows(spark, frame, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in pu_quality.score(frame(odd), none, held()).collect()} == {0.5}
    assert pu_quality.score(frame([]), none, held()).collect() == []


def test_risk_is_non_negative_and_separates():
    rng = np.random.default_rng(0)
    p = rng.normal(1, 0.5, (200, 3)).astype(np.float32)
    u = np.vstack([rng.normal(1, 0.5, (300, 3)), rng.normal(-1, 0.5, (300, 3))]).astype(np.float32)
    w = pu_quality.fit(p, u, 0.5)
    scores = u @ w[:-1] + w[-1]
    assert (scores[:300] > 0).mean() > 0.95 and (scores[300:] < 0).mean() > 0.95
