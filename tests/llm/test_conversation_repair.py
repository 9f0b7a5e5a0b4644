import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from tidewatt.llm import conversation_repair as repair

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                     T.StructField("pos", T.StringType()), T.StructField("block", T.LongType())])
BLANKS = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], ROWS)


def cheapest(initials, codes, entry=0):
    """Every state's least (cost, audit) after each row, without any pruning."""
    best = {entry: (0, "")}

    def inserted(found):
        for _ in range(3):
            for state, (cost, audit) in list(found.items()):
                way = (cost + 5, audit + "I")
                to = repair.NEXT[state]
                found[to] = min(found.get(to, way), way)
        return found

    for x, code in zip(initials, codes):
        found = {}
        for state, (cost, audit) in inserted(dict(best)).items():
            ways = [(state, 2, "D")]
            if code in (0, 3):
                more, to = (5 if code == 3 else 0), repair.NEXT[state]
                ways.append((to, 1 + more, "R"))
                if x == ("u" if to == 2 else "a"):
                    ways.append((to, more, "K"))
                if x == "s" and state == 0:
                    ways.append((1, more, "K"))
            for to, c, letter in ways:
                way = (cost + c, audit + letter)
                found[to] = min(found.get(to, way), way)
        best = found
    return best


def finished(best):
    tails = {0: "", 1: "II", 2: "I", 3: ""}
    return min((cost + 5 * len(tails[s]), audit + tails[s]) for s, (cost, audit) in best.items())


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            deal = zlib.crc32(key.encode()) % 20
            row = (turn is not None, turn or 0, "user" if deal == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(deal, text))
            mine += [row] * {0: 0, 3: 2}.get(deal, 1)
        mine.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        codes, seen = [], set()
        for _, _, role, text in mine:
            bare = text.rstrip(BLANKS)
            codes.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        cost, audit = finished(cheapest(initials, codes))
        lines, at, state = [], 0, 0
        for edit in audit:
            if edit == "I":
                state = repair.NEXT[state]
                lines.append(("user" if state == 2 else "assistant") + ":")
                continue
            role, text = mine[at][2:]
            at += 1
            if edit == "K":
                state = 1 if initials[at - 1] == "s" else repair.NEXT[state]
                lines.append(f"{role}:{text}")
            elif edit == "R":
                state = repair.NEXT[state]
                lines.append(("user" if state == 2 else "assistant") + f":{text}")
        turns = {r[1] for r in mine if r[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, codes.count(1), codes.count(2), codes.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(conversations=60, longest=9):
    rng = random.Random(7)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", ("user", "assistant")[turn % 2], "system", "tool", "", None][: 7 if conv % 5 == 0 else 3])
            text = rng.choice(["Hello there.", "É ok!", "cut off", " ", "", None, f"one {rng.random()}?", f"two {rng.random()}.\n", "end. \t"])
            rows.append((conv, turn if rng.random() < 0.9 else rng.choice([None, 3, turn]), role, text))
    rows += [(None, 1, "user", "a."), (None, None, None, None), (500, None, "user", "x."), (500, None, "user", "x."), (501, -5, "system", "s."), (501, 7, "user", "x" * 300_000)]
    dropped = next(t for t in range(200) if zlib.crc32(f"502:{t}".encode()) % 20 == 0)
    return rows + [(502, dropped, "user", "gone.")]


def found(spark, rows):
    return sorted((tuple(r) for r in repair.repair_damaged(table(spark, rows)).collect()), key=str)


@pytest.mark.parametrize("bits", [8, 1])
def test_against_every_edit(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = made()
    got = found(spark, rows)
    assert got == plain(rows)
    assert (502, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got


def test_long_conversation_is_chained(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 4)
    rng = random.Random(1)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["a.", f"b{k}.", f"c{k}", " "])) for k in range(700)]
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_search_equals_all_edits_and_bounds_hold():
    rng = random.Random(3)
    for trial in range(400):
        n = rng.randrange(1, 30)
        initials, codes = [rng.choice("uuaas ") for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        least = repair.bounds(initials, codes)
        for entry in range(4):
            every = cheapest(initials, codes, entry)
            assert repair.search(initials, codes, entry, False, least) == every
            assert repair.search(initials, codes, entry, True, least) == {3: finished(every)}
            assert least[0] <= min(c for c, _ in every.values())


def test_pruning_keeps_the_search_small(monkeypatch):
    """Nodes that pass the bound and the dominance tables, against the number there is."""
    passed = 0

    class Counted(dict):
        def __getitem__(self, state):
            nonlocal passed
            passed += 1
            return super().__getitem__(state)

    monkeypatch.setattr(repair, "NEXT", Counted(repair.NEXT))
    for initials in ("ua" * 100, "u" * 200, "uuas" * 50, "".join(random.Random(4).choice("uas") for _ in range(200))):
        codes, passed = [(0, 0, 0, 3, 1)[k % 5] for k in range(200)], 0
        result = repair.search(list(initials), codes, 0, True, repair.bounds(list(initials), codes))
        searched = passed
        assert result == {3: finished(cheapest(list(initials), codes))}
        assert searched < 20 * 4 * 200


def test_brute_force_itself_on_tiny_runs():
    """All strings of edits of up to 3 rows and 3 inserts, read by the rule."""
    legal = re.compile("(s?(ua)+)?$")
    for initials in itertools.product("uas", repeat=3):
        for codes in ((0, 0, 0), (0, 3, 0), (1, 0, 0), (3, 0, 2)):
            best = None
            for inserts in itertools.product(range(3), repeat=4):
                for edits in itertools.product("KRD", repeat=3):
                    if any(e != "D" and c in (1, 2) for e, c in zip(edits, codes)):
                        continue
                    audit = "".join("I" * k + e for k, e in zip(inserts, edits)) + "I" * inserts[3]
                    options = [[""] if a == "D" else ["u", "a"] for a in audit]
                    at = [k for k, a in enumerate(audit) if a != "I"]
                    for k, x in zip(at, initials):
                        if audit[k] == "K":
                            options[k] = [x]
                    cost = 5 * sum(inserts) + sum({"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and c == 3) for e, c in zip(edits, codes))
                    if (best is None or (cost, audit) < best) and any(legal.match("".join(o)) for o in itertools.product(*options)):
                        best = cost, audit
            assert finished(cheapest(initials, codes)) == best
