"""Operator 7: BPE encoding and decoding over a transducer lexicon.

The frequent words of a corpus are merged once and compiled into a minimal
acyclic transducer: suffixes are shared, and the outputs met on a path add up
to the word's number, which points at its ids.  Executors memory-map that one
file.  Words outside the lexicon are merged exactly, by rank.

Defined results: null and empty texts have no tokens; special-token strings in
a text are their special ids, as the tokenizers library has it; null ids and
repeated rows give one result row each.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import struct
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# White space and the word pattern of the tokenizer file.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
NONE = 1 << 62
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Bytes of the pieces, and of the words with marks around them, whose ids a
#: worker remembers from task to task: as much of recent and of older ones at most.
MEMO = 40_000_000
#: Bytes of a remembered entry beside its characters and ids: two objects'
#: heads (49 and 33), rounding (16) and a share of the dict (16 and an index, a third to two thirds full).
ENTRY = 140
#: Characters from which a piece is not remembered, and its pairs are merged from a heap.
LONG = 1000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is a visible
    Latin-1 character, else the next code point from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in visible}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(visible))
    return [letters[b] for b in range(256)]


class Merger:
    """Ids of single words by exact rank-ordered merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + end] for x in letters]
        # two ids, as one number: the merge's rank and the id that it makes
        self.pairs = {self.vocab[x] << 20 | self.vocab[y]: k << 20 | self.vocab[x + y] for k, (x, y) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.tokens = [b""] * size
        for token, k in [*self.vocab.items(), *self.special.items()]:
            self.tokens[k] = token.encode()
        # the tokens, each behind a space, for joining many at once
        self.spaced = pa.array([b" " + t for t in self.tokens], pa.large_binary())
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def chunks(self, text: str) -> list[str]:
        """Normalised pieces between white space, and special tokens marked by
        a leading zero byte, in order.  No word spans two pieces."""
        if "<|" not in text:
            return self._blank_split(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self._blank_split(text[at:m.start()])
            out.append("\0" + m.group())
            at = m.end()
        return out + self._blank_split(text[at:])

    def _blank_split(self, text: str) -> list[str]:
        text = self.normal(text)
        # str.split also parts at U+001C to U+001F and drops them; they are words here
        return text.split() if not SEPARATORS.search(text) else WORD.findall(text)

    def words(self, chunk: str) -> list[str]:
        if chunk.isalpha():  # one run of letters
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return [chunk] if chunk[0] == "\0" and chunk[1:] in self.special else WORD.findall(chunk)

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower case letter by letter: no final form
            text = text.replace("Σ", "σ")
        return text.lower()

    def merge(self, word: str) -> list[int]:
        if word[0] == "\0" and word[1:] in self.special:
            return [self.special[word[1:]]]
        raw, pairs = word.encode(), self.pairs
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        ranks = [pairs.get(x << 20 | y, NONE) for x, y in zip(ids, ids[1:])]
        if len(ranks) >= LONG:
            return self.merge_long(ids, ranks)
        while ranks:
            best = min(ranks)  # lowest rank, leftmost place
            if best == NONE:
                break
            k = ranks.index(best)
            made = best & 0xFFFFF
            ids[k:k + 2] = [made]
            del ranks[k]
            if k:
                ranks[k - 1] = pairs.get(ids[k - 1] << 20 | made, NONE)
            if k < len(ranks):
                ranks[k] = pairs.get(made << 20 | ids[k + 1], NONE)
        return ids


    def merge_long(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The same merges from a heap of (rank and id made, place), in time
        n log n; an entry that its neighbours' merges outdated is passed over."""
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, k) for k, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        ranks = [*ranks, NONE]
        while heap:
            best, k = heapq.heappop(heap)
            if ranks[k] != best:
                continue
            gone = after[k]
            ids[k], ids[gone], ranks[gone] = best & 0xFFFFF, -1, NONE
            after[k] = after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0:
                    right = after[left]
                    ranks[left] = pairs.get(ids[left] << 20 | ids[right], NONE) if right >= 0 else NONE
                    if ranks[left] != NONE:
                        heapq.heappush(heap, (ranks[left], left))
        return [x for x in ids if x >= 0]


# --- transducer -----------------------------------------------------------------
# File: counts, then arrays.  State s owns edges first[s] to first[s + 1]; an
# edge has a label byte, a target state and an output.  The outputs on a path,
# plus one for each final state passed on the way, are the word's number.

def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Minimal automaton of the sorted, distinct words, built incrementally:
    when a word leaves a branch, its finished states are replaced by equal
    ones met before."""
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # open states of the last word: [final, [(label, target)]]
    last, ids, offsets = b"", [], [0]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in known:
                known[key] = len(states)
                states.append(key)
            path[-1][1].append((last[len(path) - 1], known[key]))

    for word, out in sorted(entries):
        if word == last and offsets != [0]:
            continue
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same)
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
        ids.extend(out)
        offsets.append(len(ids))
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    size = [0] * len(states)  # words below each state; targets come first
    first, labels, targets, outputs = [0], [], [], []
    for s, (final, edges) in enumerate(states):
        below = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            outputs.append(below)
            below += size[target]
        size[s] = below
        first.append(len(labels))
    head = struct.pack("<4I", len(states), len(labels), len(offsets), len(ids))
    arrays = [np.array(first, "<u4"), np.array(targets, "<u4"), np.array(outputs, "<u4"), np.array(offsets, "<u4"),
              np.array(ids, "<u4"), np.array(labels, "u1"), np.array([f for f, _ in states], "u1")]
    return head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, read through a memory map."""

    def __init__(self, buffer):
        states, edges, offsets, ids = struct.unpack_from("<4I", buffer)
        view, at = memoryview(buffer), 16
        self.parts = []
        for count, kind in ((states + 1, "I"), (edges, "I"), (edges, "I"), (offsets, "I"), (ids, "I"), (edges, "B"), (states, "B")):
            width = 4 if kind == "I" else 1
            self.parts.append(view[at:at + count * width].cast(kind))
            at += count * width
        self.first, self.targets, self.outputs, self.offsets, self.ids, self.labels, self.final = self.parts
        self.root = states - 1
        self.steps: dict[int, int] = {}   # edges walked: no more than the lexicon has

    @classmethod
    def open(cls, path: str) -> "Lexicon":
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def step(self, state: int, byte: int) -> int:
        """Target and output of an edge as one number, -1 without one."""
        labels, low, end = self.labels, self.first[state], self.first[state + 1]
        k = bisect_left(labels, byte, low, end)
        if k == end or labels[k] != byte:
            return -1
        self.steps[state << 8 | byte] = found = self.targets[k] << 32 | self.outputs[k]
        return found

    def number(self, word: bytes) -> int:
        """The word's place in the sorted lexicon, -1 if it isn't there."""
        state, out, steps = self.root, 0, self.steps
        for byte in word:
            step = steps.get(state << 8 | byte)
            if step is None and (step := self.step(state, byte)) < 0:
                return -1
            out += step & 0xFFFFFFFF
            state = step >> 32
        return out if self.final[state] else -1

    def packed(self, word: bytes) -> bytes | None:
        """Its ids, as the file has them."""
        k = self.number(word)
        return None if k < 0 else bytes(self.ids[self.offsets[k]:self.offsets[k + 1]])

    def get(self, word: bytes) -> list[int] | None:
        ids = self.packed(word)
        return None if ids is None else list(memoryview(ids).cast("I"))


def frequent_words(docs: DataFrame, tokenizer: str, limit: int) -> list[str]:
    """The commonest words of all texts: those with the smallest count of
    which no more than ``limit`` words have it or a larger one."""
    def count(batches):
        merger = Merger(tokenizer)
        for batch in common.parts(batches, 2000):
            pieces: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    pieces.update(merger.chunks(text))
            seen: dict[str, int] = {}
            for piece, n in pieces.items():
                for word in merger.words(piece):
                    seen[word] = seen.get(word, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = common.store(counted.where("n > 1"), "words")
    least, total = 2, 0
    # powers of two bound what the driver reads: at most 64 rows
    sizes = {r.scale: r["count"] for r in counted.groupBy(F.floor(F.log2("n")).alias("scale")).count().collect()}
    for scale in sorted(sizes, reverse=True):
        if total + sizes[scale] > limit:
            inside = counted.where((F.col("n") >= 2**scale) & (F.col("n") < 2**(scale + 1))).groupBy("n").count().orderBy(F.desc("n")).limit(limit).collect()
            least = 2**(scale + 1)
            for r in inside:
                if total + r["count"] > limit:
                    break
                total += r["count"]
                least = r.n
            break
        total += sizes[scale]
    words = [r.word for r in counted.where(F.col("n") >= least).select("word").collect()]
    common.discard(counted)
    return words


def build_lexicon(docs: DataFrame, tokenizer: str, limit: int = 100_000) -> str:
    """Compile the corpus' frequent words and hand the file to all executors;
    returns its name for ``SparkFiles``.  ``limit`` bounds words, file and
    driver memory (about 4 MB at 100,000); it never changes a result."""
    spark, merger = docs.sparkSession, Merger(tokenizer)
    data = compile_lexicon((w.encode(), merger.merge(w)) for w in frequent_words(docs, tokenizer, limit))
    path = common.new_path(spark, "lexicon") + ".fst"
    common.write_bytes(spark, path, data)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


class Memo(dict):
    """Ids by piece.  Once they fill MEMO bytes they become ``old`` and give
    way to the next: a piece met again moves over, so that frequent ones stay."""

    room = MEMO

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def keep(self, piece: str, ids: bytes) -> None:
        if len(piece) >= LONG:
            return
        size = ENTRY + (1 if piece.isascii() else 4) * len(piece) + len(ids)
        if size > self.room:
            self.old, self.room = dict(self), MEMO
            self.clear()
        self.room -= size
        self[piece] = ids


class Encoder:
    """Text to ids: lexicon first, exact merging for the rest; ids of recent
    pieces and of the words in them are remembered, at most 2 * MEMO bytes."""

    def __init__(self, merger: Merger, lexicon: Lexicon | None):
        self.merger, self.lexicon = merger, lexicon
        self.memo = Memo()

    def ids(self, word: str) -> bytes:
        known = self.lexicon.packed(word.encode()) if self.lexicon else None
        if known is not None:
            return known
        ids = self.merger.merge(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        memo = self.memo
        out = memo.get(word)
        if out is None:
            out = memo.old.get(word) or self.ids(word)
            memo.keep(word, out)
        return out

    def piece(self, piece: str) -> bytes:
        out = self.memo.old.get(piece)
        if out is None:
            words = self.merger.words(piece)
            if len(words) == 1 and words[0] == piece:
                return self.word(piece)
            out = b"".join([self.word(w) for w in words])
        self.memo.keep(piece, out)
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        memo, slow = self.memo, self.piece
        return b"".join([memo.get(p) or slow(p) for p in self.merger.chunks(text)])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_of(tokenizer: str, lexicon: str) -> Encoder:
    """A worker's one encoder, kept from task to task."""
    if (tokenizer, lexicon) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer, lexicon] = Encoder(Merger(tokenizer), Lexicon.open(SparkFiles.get(lexicon)))
    return _ENCODERS[tokenizer, lexicon]


def texts_of(spaced: pa.Array, ids: list[bytes]) -> pa.Array:
    """The tokens' strings joined by spaces, specials kept."""
    sizes = np.cumsum([0, *(len(x) // 4 for x in ids)])
    joined = spaced.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
    ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, 8 * joined.offset)[sizes].tolist()
    data = memoryview(joined.buffers()[2] or b"")
    return pa.array([bytes(data[a + 1:b]) for a, b in zip(ends, ends[1:])], pa.string())


def encode(docs: DataFrame, tokenizer: str, lexicon: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ``ids``: little-endian unsigned 32-bit integers;
    with ``decoded`` also the text that ``decode`` makes of them, in the same
    worker."""
    names = ["doc_id", "n_tokens", "ids", "decoded"][:4 if decoded else 3]

    def run(batches):
        encoder = encoder_of(tokenizer, lexicon)
        for batch in common.parts(batches):
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, texts_of(encoder.merger.spaced, ids)] if decoded else columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``decoded``, made of the ids alone."""
    def run(batches):
        spaced = Merger(tokenizer).spaced
        for batch in common.parts(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, texts_of(spaced, batch.column(2).to_pylist())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
