import hashlib
import random
import time

import numpy as np
import public_tokenizers
import tokenizers

from tidewatt.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)


def test_any_text_as_the_library():
    encoder, rng = bpe.Encoder(bpe.Merger(PATH), None), random.Random(5)
    parts = ["a", "B", "'s", "'ll", "é", "É", "Σ", "İ", "ß", "1", "２", "½", "\x1c", "\x85", "\xa0", "　", " ", "\n", "<|endoftext|>", "<|", "|>", "!",
             "日本", "한", "́", "😀", "​", "ǅ", "<|startoftext|>", "word", "ing"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        own = encoder.encode(text)
        assert np.frombuffer(own, "<u4").tolist() == ids, repr(text)


def test_long_words_as_the_library():
    merger, rng = bpe.Merger(PATH), random.Random(6)
    for text in ("a" * 5000, "ab" * 3000, "漢字" * 2000, "thethere" * 700, "".join(rng.choice("aeinrst") for _ in range(6000)), "!" * 4001):
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe.Encoder(merger, None).encode(text), "<u4").tolist() == ids
    start = time.monotonic()
    bpe.Encoder(merger, None).encode("ab漢" * 100_000)
    assert time.monotonic() - start < 20


def test_memo_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10_000)
    monkeypatch.setattr(bpe.Memo, "room", 10_000)
    memo = bpe.Memo()
    for k in range(1000):
        memo.keep(f"w{k}", b"1234")
        assert len(memo) * bpe.ENTRY <= 10_000 and memo[f"w{k}"] == b"1234"
    memo.keep("x" * bpe.LONG, b"1")
    assert "x" * bpe.LONG not in memo


def test_frequent_pieces_outlast_a_full_memo(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10_000)
    monkeypatch.setattr(bpe.Memo, "room", 10_000)
    encoder, asked = bpe.Encoder(bpe.Merger(PATH), None), []
    ids = encoder.ids
    encoder.ids = lambda word: asked.append(word) or ids(word)
    for k in range(500):
        encoder.encode(f"often, zq{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]} often")
        assert (len(encoder.memo) + len(encoder.memo.old)) * bpe.ENTRY <= 20_000
    assert asked.count("often") == asked.count(",") == 1


def test_joined_tokens_are_those_of_each_text():
    merger = bpe.Merger(PATH)
    ids = [bpe.Encoder(merger, None).encode(t) for t in ("", "one two", "é日本", "", "<|endoftext|> x", "")]
    plain = [" ".join(merger.tokens[k].decode() for k in np.frombuffer(x, "<u4")) for x in ids]
    assert bpe.texts_of(merger.spaced, ids).to_pylist() == plain
    assert bpe.texts_of(merger.spaced, [b"", b""]).to_pylist() == ["", ""] and bpe.texts_of(merger.spaced, []).to_pylist() == []


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["walking", "talking", "walk", "talk", "a", "walked", "talked", "é"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words.items()))
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    assert [lexicon.get(w) for w in (b"", b"wal", b"walkin", b"walkings", b"zz")] == [None] * 5
    # walk and talk share every state behind their first letter
    assert len(lexicon.final) < sum(map(len, words)) / 2
    assert bpe.Lexicon(bpe.compile_lexicon([])).get(b"a") is None


def test_query_over_odd_rows(spark, frame, odd):
    docs = frame(odd)
    lexicon = bpe.build_lexicon(docs, PATH, limit=10)
    rows = bpe.decode(bpe.encode(docs, PATH, lexicon), PATH).collect()
    assert len(rows) == len(odd)
    expected = sorted(((d, LIBRARY.encode(t or "", add_special_tokens=False).ids) for d, t in odd), key=str)
    assert sorted(((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in rows), key=str) == expected
    assert all(r.decoded == LIBRARY.decode(np.frombuffer(bytes(r.ids), "<u4").tolist(), skip_special_tokens=False) for r in rows)
    assert all(r.n_tokens == len(r.ids) // 4 for r in rows)


def test_empty_table(frame):
    docs = frame([])
    assert bpe.decode(bpe.encode(docs, PATH, bpe.build_lexicon(docs, PATH)), PATH).collect() == []


def test_the_word_bound_keeps_results(frame, prose):
    docs = frame([(k, prose(k, 60)) for k in range(20)])
    got = [sorted((r.doc_id, hashlib.sha256(bytes(r.ids)).hexdigest()) for r in bpe.encode(docs, PATH, bpe.build_lexicon(docs, PATH, limit)).collect()) for limit in (1, 1000)]
    assert got[0] == got[1]
    assert len(bpe.frequent_words(docs, PATH, 7)) <= 7
