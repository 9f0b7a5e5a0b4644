import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.IntegerType()),
                     # names that clash with the operators' own columns
                     T.StructField("key", T.StringType()), T.StructField("row", T.LongType()), T.StructField("n_words", T.StringType())])


def docs_frame(spark, rows):
    """documents with clashing extra columns; rows are (doc_id, text[, lang, source])."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, "en", "s")[:4] if len(r) == 2 else r
        full.append((doc_id, text, lang, source, None if text is None else len(text), "x", 7, "y"))
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="session")
def frame(spark):
    return lambda rows: docs_frame(spark, rows)


@pytest.fixture(scope="session")
def prose():
    """Made-up text: prose(seed, words)."""
    def make(seed, n):
        rng = random.Random(seed)
        vocabulary = ["the", "of", "and", "tion", "stone", "river", "Éclair", "über", "lamp", "green", "walk", "seven", "paper", "moon", "table", "quiet"]
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "a", "er", "ing", "s"]) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Rows with every awkward case: nulls, empty and long texts, ties, repeats."""
    long = prose(1, 4000)
    return [(1, prose(2, 80)), (2, None), (3, ""), (4, "  \n\t "), (5, long), (6, long), (6, long), (None, prose(3, 50)), (None, None),
            (7, "one two"), (8, "one two"), (9, prose(2, 80) + " tail"), (10, "Ünïcödé \x00 ١٢٣ 😀 ﬁ " * 30)]
