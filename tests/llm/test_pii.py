import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatt.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.-+ ()0123456789_%é\n", max_size=60))
def test_base_spans_as_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_of_long_runs_are_quick():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "@a.b" * 50_000):
        pii.base_spans(text)


@pytest.mark.parametrize("text", ["漢" * 1_000_000 + " 1", "漢" * 1_000_000 + "1", "@a.b " * 200_000, "x@a.b" * 200_000, "a" * 1_000_000 + "@b.c"])
def test_scans_are_linear_in_the_text(text):
    start = time.monotonic()
    pii.tokens_of(text, pii.base_spans(text))
    assert time.monotonic() - start < 2


def test_digits_of_other_scripts_are_no_digits():
    assert pii.base_spans("+٤٨٧ 555 7209 111") == plain("+٤٨٧ 555 7209 111")


def test_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(1)
    unary, pot = rng.normal(size=(4, 3)), rng.normal(size=(3, 3, 3))
    edges = np.array([[0, 1], [1, 2], [2, 3]])
    joint = np.zeros((3,) * 4)
    for index in np.ndindex(*joint.shape):
        joint[index] = np.exp(sum(unary[k, y] for k, y in enumerate(index)) + sum(pot[e][index[a], index[b]] for e, (a, b) in enumerate(edges)))
    joint /= joint.sum()
    belief = pii.messages(unary, edges, pot, rounds=60)
    for k in range(4):
        assert np.allclose(belief[k], joint.sum(axis=tuple(j for j in range(4) if j != k)), atol=1e-6)


def test_skip_edges_tie_distant_tokens():
    text = "+1 (487) 555-7209 " + "word " * 50 + "555-7209 or A.B@c.de " + "word " * 9 + "a.b@c.de"
    tokens = pii.tokens_of(text, pii.base_spans(text))
    _, skip = pii.edges_of(text, tokens)
    named = {tuple(text[tokens[k][0]:tokens[k][1]] for k in e) for e in skip}
    assert ("555-7209", "555-7209") in named and ("A.B@c.de", "a.b@c.de") in named


def test_field_finds_shortened_repeats_and_leaves_others(frame, prose):
    rows = [(k, f"{prose(k, 20)} +1 ({100 + k}) 555-{7000 + k} {prose(k, 9)}") for k in range(80)]
    rows += [(1000 + k, f"{prose(k, 20)} room {k} of 20{k:02d} {prose(k, 9)}") for k in range(80)]
    rows.append((2000, f"{prose(1, 9)} +1 (487) 555-7209 {prose(4, 30)} 555-7209 {prose(5, 9)} in 2024"))
    found = {r.doc_id: r for r in pii.spans(frame(rows)).collect()}
    text = rows[-1][1]
    assert [text[x.start:x.end] for x in found[2000].added] == ["555-7209"]
    assert not any(found[1000 + k].added for k in range(80))
    assert all(list(found[d].starts) == [s[0] for s in plain(t)] for d, t in rows)


def test_odd_rows_and_masking(frame, odd):
    rows = [*odd, (50, "mail a.b@c.example.com now, 10.0.0.1"), (50, "mail a.b@c.example.com now, 10.0.0.1")]
    docs = frame(rows)
    assert pii.spans(docs).count() == len(rows)
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in masked.collect()]
    assert texts.count((50, "mail [email] now, [ip]")) == 2
    assert sorted(map(str, texts)) == sorted(map(str, [*odd, *[(50, "mail [email] now, [ip]")] * 2]))
    assert all(r.n_chars == len(r.text) for r in masked.where("text is not null").collect())


def test_empty_table(frame):
    assert pii.spans(frame([])).collect() == [] and pii.mask(frame([])).collect() == []


def test_repeats_are_found_however_many(frame, prose):
    # a third of the tokens of this shape are parts of phone numbers
    rows = [(k, f"{prose(k, 20)} +1 ({100 + k % 800}) 555-{1000 + k} {prose(k, 9)}") for k in range(900)]
    rows += [(2000 + k, f"{prose(k, 20)} part 444-{1000 + k} {prose(k, 9)}") for k in range(1800)]
    rows += [(9000 + n, " ".join([f"+1 (487) 333-{n:04d}", *(f"{prose(j, 9)} 333-{n:04d}" for j in range(n)), prose(n, 9)])) for n in (1, 3, 12, 100)]
    rows += [(9500 + n, " ".join([*(f"{prose(j, 9)} 222{n:04d}" for j in range(n)), prose(n, 9), f"+1 (487) 222-{n:04d}"])) for n in (1, 3, 12, 100)]
    found = {r.doc_id: r for r in pii.spans(frame(rows)).collect()}
    texts = dict(rows)
    for n in (1, 3, 12, 100):
        assert [texts[9000 + n][x.start:x.end] for x in found[9000 + n].added] == [f"333-{n:04d}"] * n
        assert [texts[9500 + n][x.start:x.end] for x in found[9500 + n].added] == [f"222{n:04d}"] * n
        assert all(x.kind == 3 for d in (9000 + n, 9500 + n) for x in found[d].added)
    assert not any(found[2000 + k].added for k in range(1800))


def test_tied_tokens_are_no_negatives():
    batch = pii.found_in(pii.pa.array([1]), ["+1 (487) 555-7209 so 5557209 and 7654321 or x1234567@a.de then 1234567"])
    ties = dict(zip((batch.column(4).to_pylist()[0]), batch.column(10).to_pylist()[0]))
    assert list(ties.values()) == [4, 4, 4, 4, 0, 1, 0]
