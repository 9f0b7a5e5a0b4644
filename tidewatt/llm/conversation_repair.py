"""Operator 13: conversation structure repair by depth-first branch-and-bound.

Rows of a conversation are taken by turn (nulls first; ties by role, then text,
in UTF-8 order).  The first fault of a row counts: ``blank`` (no character but
ASCII blanks), ``duplicate`` (role and text seen earlier) or ``truncated`` (the
last such character is not one of ``.!?``).  Edits are Keep (0), Rerole to user
or assistant (1), Delete (2, the only edit of blank and duplicate rows) and
Insert of an empty text of user or assistant (5); a truncated row that stays adds
5.  The cheapest edits that give role initials ``(s?(ua)+)?`` are wanted, of
equals those whose initials are ASCII-least.

The search goes depth first over (row, last role) with an explicit stack, the
edit of the least bound first, for each role that can come last.  A prefix is left when its cost and a lower bound of the
remaining rows (the larger of two: their forced deletes with one edit for every
disjoint pair of neighbours that can't follow each other; and the cost of an
easier problem, see ``relaxed``) exceed the incumbent's cost, or equal it with
later initials, or when the node's dominance table holds a prefix at least
as good.  An empty stack proves the incumbent optimal.

A long conversation is no group: rows are sorted by range, runs of at most
2 ** ``BLOCK_BITS`` of them are searched from every role that can come before to
every role that can come last, and these few (cost, initials) are then chained,
a block at a time.  Two different prefixes that end after the same row are never
prefixes of each other, so ties keep their order when chained.  Only the SHA-256
of a repaired conversation is sequential by nature; its rows stream through one
task, one at a time.

Defined results: null role and text read as one space, and so does a null id or
turn in the key of ``damage``; null ids are one conversation; repeated rows are
duplicates of each other; an empty table gives no rows; a conversation of which
no row is left has zeros, no edits and the hash of nothing.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_BITS = 8
#: Roles that can come last: none, system, user, assistant; and what may follow each.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32 of
    ``conv_id:turn`` deals: 0 drops a row, 1 empties its text, 2 removes its
    sentence ends, 3 repeats it, 4 makes it the user's (of 20)."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    deal = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), deal.alias("deal"))
    rows = rows.where("deal <> 0").withColumns({"role": F.when(F.col("deal") == 4, "user").otherwise(F.col("role")),
                                                "text": F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))})
    return rows.withColumn("copy", F.explode(F.expr("CASE WHEN deal = 3 THEN array(0, 1) ELSE array(0) END"))).select("conv_id", "turn", "role", "text")


def bounds(initials: list[str], codes: list[int]) -> list[int]:
    """Least cost of the rows from each place on: the deletes of faulty rows, and
    one edit for each of the disjoint pairs of clean rows, adjacent but for faulty
    rows, that can't follow each other (a truncated row that stays between them
    costs 3 more than its delete, which covers that edit)."""
    n = len(codes)
    forced, pairs, out = 0, [0] * (n + 2), [0] * (n + 1)
    clean_next = None  # the next clean row
    for i in range(n - 1, -1, -1):
        pairs[i] = pairs[i + 1]
        if codes[i] == CLEAN:
            if clean_next is not None and initials[i] + initials[clean_next] not in LEGAL:
                pairs[i] = max(pairs[i], 1 + pairs[clean_next + 1])
            clean_next = i
        else:
            forced += 2
        out[i] = forced + pairs[i]
    return out


def relaxed(initials: list[str], codes: list[int], ends: list[int]) -> list[list[int]]:
    """Least cost of the rows from each place on, by the role that came last, of
    an easier problem: every faulty row goes for 2, and with truncated rows about
    a role may be passed over for 3 instead of an insert's 5 (a truncated row that
    stays costs 5, of which 2 are counted as its delete).  ``ends``: what each role
    costs at the end."""
    skip = 3 if TRUNCATED in codes else 5
    out = [ends]
    for initial, code in zip(reversed(initials), reversed(codes)):
        after = out[-1]
        if code != CLEAN:
            step = [2 + x for x in after]
        else:
            is_user, is_assistant = initial == "u", initial == "a"
            to_user = after[USER] + (not is_user)
            step = [min(to_user, after[NONE] + 2), min(to_user, after[SYSTEM] + 2), min(after[ASSISTANT] + (not is_assistant), after[USER] + 2), min(to_user, after[ASSISTANT] + 2)]
            if initial == "s":
                step[NONE] = min(step[NONE], after[SYSTEM])
        user, assistant = min(step[USER], step[ASSISTANT] + skip), min(step[ASSISTANT], step[USER] + skip)
        system = min(step[SYSTEM], user + skip)
        none = min(step[NONE], user + skip, system + 3 if initial == "s" and code == TRUNCATED else FAR)
        out.append([none, system, user, assistant])
    return out[::-1]


def search(initials: list[str], codes: list[int], entry: int, last: bool, least: list[int]) -> dict[int, tuple[int, str]]:
    """Cheapest edits of a run of rows after ``entry``, by the role that comes
    last; with ``last`` only whole conversations, under ASSISTANT."""
    inserts = [0, 2, 1, 0]
    if last:
        return {ASSISTANT: branch_and_bound(initials, codes, entry, inserts, least)}
    ends = {leave: [None if state != leave else 0 for state in range(4)] for leave in range(4)}
    found = {leave: branch_and_bound(initials, codes, entry, end, least) for leave, end in ends.items()}
    return {leave: best for leave, best in found.items() if best[0] < FAR}


def branch_and_bound(initials: list[str], codes: list[int], entry: int, inserts: list, least: list[int]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits; ``inserts``: how many inserts let each
    role come last, None where it can't."""
    n = len(codes)
    skip = 3 if TRUNCATED in codes else 5
    ahead = relaxed(initials, codes, [FAR if k is None else skip * k for k in inserts])
    table: dict[tuple[int, int], tuple[int, str]] = {}
    incumbent = (FAR, "")
    stack = [(ahead[0][entry], "", 0, 0, entry)]
    while stack:
        lower, audit, cost, i, state = stack.pop()
        if lower >= FAR or lower > incumbent[0] or (lower == incumbent[0] and audit > incumbent[1][:len(audit)]):
            continue
        if (cost, audit) >= table.get((i, state), (FAR, "")):
            continue
        table[i, state] = cost, audit
        if i == n:
            if inserts[state] is not None:
                incumbent = min(incumbent, (cost + 5 * inserts[state], audit + "I" * inserts[state]))
            continue
        follows, code, initial = NEXT[state], codes[i], initials[i]
        children = [(cost + 2, "D", i + 1, state), (cost + 5, "I", i, follows)]
        if code in (CLEAN, TRUNCATED):
            more = 5 if code == TRUNCATED else 0
            children.append((cost + 1 + more, "R", i + 1, follows))
            if initial == ("u" if follows == USER else "a"):
                children.append((cost + more, "K", i + 1, follows))
            elif initial == "s" and state == NONE:
                children.append((cost + more, "K", i + 1, SYSTEM))
        # the least bound is taken first, of equals the ASCII-least edit
        stack += sorted(((c + max(least[j], ahead[j][to]), audit + edit, c, j, to) for c, edit, j, to in children), reverse=True)
    return incumbent


def block_tables(blocks: DataFrame) -> DataFrame:
    """Each block's counts, its first and last initial, and ``ways``: entry,
    exit, cost and audit."""
    schema = "conv_id long, block long, blank long, duplicate long, truncated long, illegal long, head string, tail string, ways array<struct<entry:int,leave:int,cost:long,audit:string>>"
    ways_type = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    kinds = [*[pa.int64()] * 6, pa.string(), pa.string(), ways_type]

    def scan(batches):
        for batch in batches:
            out = []
            for conv, block, rows, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                initials, codes = [r["initial"] for r in rows], [r["code"] for r in rows]
                least = bounds(initials, codes)
                ways = [{"entry": entry, "leave": leave, "cost": cost, "audit": audit}
                        for entry in ((NONE,) if first else range(4)) for leave, (cost, audit) in search(initials, codes, entry, last, least).items()]
                illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
                out.append((conv, block, codes.count(BLANK), codes.count(DUPLICATE), codes.count(TRUNCATED), illegal, initials[0], initials[-1], ways))
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in schema.split(", ")])

    return blocks.mapInArrow(scan, schema)


class Chain:
    """The blocks of one conversation, chained in order."""

    def __init__(self, conv):
        self.conv, self.best, self.steps, self.tail = conv, {NONE: (0, 0)}, [], None
        self.counts = [0, 0, 0, 0]

    def add(self, block, counts, head, tail, ways) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        if self.tail is not None:
            self.counts[3] += self.tail + head not in LEGAL
        self.tail = tail
        found: dict[int, tuple] = {}
        for w in ways:
            if w["entry"] in self.best:
                cost, rank = self.best[w["entry"]]
                way = (cost + w["cost"], rank, w["audit"], w["entry"])
                if w["leave"] not in found or way < found[w["leave"]]:
                    found[w["leave"]] = way
        ranked = sorted((rank, audit, leave) for leave, (_, rank, audit, _) in found.items())
        self.steps.append((block, {leave: (entry, audit) for leave, (_, _, audit, entry) in found.items()}))
        self.best = {leave: (found[leave][0], k) for k, (_, _, leave) in enumerate(ranked)}

    def result(self) -> tuple:
        state, pieces = ASSISTANT, []
        for block, ways in reversed(self.steps):
            entry, audit = ways[state]
            pieces.append({"block": block, "entry": entry, "audit": audit})
            state = entry
        return (self.conv, *self.counts, self.best[ASSISTANT][0], pieces[::-1])


def chained(tables: DataFrame) -> DataFrame:
    """Counts, cost and the pieces (block, entry, audit) of each conversation."""
    schema = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, pieces array<struct<block:long,entry:int,audit:string>>"
    pieces_type = pa.list_(pa.struct([("block", pa.int64()), ("entry", pa.int32()), ("audit", pa.string())]))

    def record(done: list[Chain]) -> pa.RecordBatch:
        columns = list(zip(*(c.result() for c in done))) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 6, pieces_type])], [c.split()[0] for c in schema.split(", ")])

    def scan(batches):
        chain = None
        for batch in common.parts(batches, 2000):
            done = []
            for conv, block, blank, duplicate, truncated, illegal, head, tail, ways in zip(*(c.to_pylist() for c in batch.columns)):
                if chain is None or chain.conv != conv:
                    done += [chain] if chain else []
                    chain = Chain(conv)
                chain.add(block, (blank, duplicate, truncated, illegal), head, tail, ways)
            yield record(done)
        if chain:
            yield record([chain])

    return tables.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(scan, schema)


def repaired(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: every conversation's rows stream past its
    edits in order."""
    def scan(batches):
        conv, digest, lines, edits, at, state = None, None, 0, "", 0, NONE

        def line(role, text):
            nonlocal lines
            digest.update(("\n" if lines else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            lines += 1

        def insert():
            nonlocal at, state
            while at < len(edits) and edits[at] == "I":
                state = NEXT[state]
                line("user" if state == USER else "assistant", "")
                at += 1

        for batch in common.parts(batches):
            done = []
            for key, entry, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "entry", "audit", "role", "text"))):
                if audit is not None:  # a block begins
                    if digest is not None:
                        insert()
                    if digest is None or key != conv:
                        done += [(conv, digest.hexdigest())] if digest is not None else []
                        conv, digest, lines = key, hashlib.sha256(), 0
                    edits, at, state = audit, 0, entry
                    continue
                insert()
                edit = edits[at]
                at += 1
                if edit == "K":
                    state = SYSTEM if role[0] == "s" else NEXT[state]
                    line(role, text)
                elif edit == "R":
                    state = NEXT[state]
                    line("user" if state == USER else "assistant", text)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])
        if digest is not None:
            insert()
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    begins = pieces.select("conv_id", F.inline("pieces")).withColumns({"pos": F.lit(-1).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    texts = rows.select("conv_id", "block", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("string").alias("audit"), "pos", "role", "text")
    both = begins.select(texts.columns).unionByName(texts)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos").mapInArrow(scan, "conv_id long, repaired_sha256 string")


def ordered(rows: DataFrame) -> DataFrame:
    """The rows in order (``pos``, ``block``), with their initial, their own
    faults and a digest of role and text; stored, so that places stay."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    made = rows.withColumns({"initial": F.substring("role", 1, 1), "fault": F.when(blank, BLANK).when(~ended, TRUNCATED).otherwise(CLEAN),
                             "digest": F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))})
    dealt = made.repartitionByRange(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", F.substring("text", 1, 64))
    placed = dealt.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text").withColumn("pos", F.monotonically_increasing_id())
    return common.store(placed.withColumn("block", F.shiftright("pos", BLOCK_BITS)), "repair-rows")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of every conversation that has rows (conv_id, turn, role,
    text; no nulls in the last two)."""
    placed = ordered(rows)
    light = placed.select("conv_id", "block", "pos", "initial", "fault", "digest")
    again = light.groupBy(F.col("conv_id").alias("same_conv"), F.col("digest").alias("same_digest")).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = light.join(again, F.expr("conv_id <=> same_conv AND digest = same_digest"), "left")
    code = F.when((F.col("fault") != BLANK) & (F.col("pos") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    runs = joined.select("conv_id", "block", F.struct("pos", "initial", code.alias("code")).alias("row")).groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    extents = placed.groupBy(F.col("conv_id").alias("own")).agg(F.min("block").alias("low"), F.max("block").alias("high"))
    blocks = runs.join(extents, F.expr("conv_id <=> own")).select("conv_id", "block", "rows", F.expr("block = low").alias("first"), F.expr("block = high").alias("last"))
    found = common.store(chained(block_tables(blocks)), "repair-edits")
    turns = placed.where("turn is not null").groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    whole = found.select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", F.array_join("pieces.audit", "").alias("audit"))
    return gathered([whole, turns, repaired(placed, found)])


def gathered(tables: list[DataFrame]) -> DataFrame:
    """One row for every conv_id of the tables, with the defaults of an empty conversation."""
    together = tables[0]
    for t in tables[1:]:
        together = together.unionByName(t, allowMissingColumns=True)
    number = lambda c: F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c)
    numbers = [number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    word = lambda c, empty: F.coalesce(F.max(c), F.lit(empty)).alias(c)
    return together.groupBy("conv_id").agg(*numbers, word("audit", ""), word("repaired_sha256", hashlib.sha256().hexdigest()))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every original conversation."""
    return gathered([repair(damage(conversations)), conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()])
