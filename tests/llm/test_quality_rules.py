import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatt.llm import quality_rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = set()
    for k in range(len(words) - 4):
        if windows[tuple(words[k:k + 5])] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aab \n\t#|é\x85\x0b", max_size=80))
def test_counts_against_plain(text):
    assert quality_rules.measure(text)[:5] == plain(text)


def test_verdicts(frame, odd, prose):
    rows = [(100 + k, prose(k, 40 + k % 60) + "\n" + prose(k + 500, 20), "en", f"s{k % 2}") for k in range(200)]
    junk = [(900, " ".join(w + "###" for w in prose(1, 60).split()), "en", "s0"), (901, " | ".join(prose(2, 60).split()), "en", "s1"),
            (902, prose(3, 60).upper(), "en", "s0"), (903, "short text", "en", "s0"), (904, "walk " * 80, "en", "s1")]
    full = [*rows, *junk, *((d, t, None, None) for d, t in odd)]
    judged = quality_rules.judge(frame(full)).collect()
    assert len(judged) == len(full)
    kept = {r.doc_id: r.kept for r in judged if r.doc_id is not None and r.doc_id >= 100}
    assert all(kept[100 + k] for k in range(200)) and not any(kept[d] for d, *_ in junk)
    by_text = {d: t for d, t, *_ in full if d is not None}
    for r in judged:
        if r.doc_id is not None:
            counts = plain(by_text[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
            assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
            assert not (r.base_failed and r.kept)
    docs = frame(full)
    stay = quality_rules.keep(docs)
    assert stay.columns == docs.columns and stay.count() == sum(r.kept for r in judged)


def test_merged_sketches_equal_one_sketch(spark):
    from pyspark.sql import functions as F
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 3001).cast("double").alias("x"))
    one = df.agg(F.kll_sketch_agg_double("x", F.lit(4096)).alias("s"))
    parts = df.groupBy("g").agg(F.kll_sketch_agg_double("x", F.lit(4096)).alias("s")).agg(F.kll_merge_agg_double("s", F.lit(4096)).alias("s"))
    quantile = lambda d: d.select(F.kll_sketch_get_quantile_double("s", F.lit(0.5))).first()[0]
    assert abs(quantile(one) - quantile(parts)) <= 5 and abs(quantile(parts) - 1500) <= 5


def test_empty_table(frame):
    assert quality_rules.judge(frame([])).collect() == [] and quality_rules.keep(frame([])).collect() == []
