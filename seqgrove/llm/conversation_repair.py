r"""Operator 12: conversation structure repair. The cheapest edits that give a conversation a lawful order of roles.

Role initials must read ``(s?(ua)+)?``: an optional system turn, then user and assistant in turns, or nothing. Edits are Keep,
Delete (required for blank rows and repeats), Insert (an empty user or assistant turn, anywhere) and Rerole (to user or
assistant), with costs of 0, 2, 5 and 1; a truncated row that stays costs 5 more.

Costs are looked into in layers, as approximate matching by bit vectors does with errors: layer c has for each turn the
set of grammar states (four bits) from which the rest of the conversation can be accepted at cost c. A layer follows from those of cost
c, c - 1, c - 2, c - 5 (and with 5 more) by tables of 16 sets; only bits that no lower layer had are followed, so the
work is linear in the turns. The first layer that holds the start state at the first turn tells the cost, and a walk
through the layers takes the least edit in ASCII order that stays on a cheapest way: the least audit.

Rows are shuffled once, by conversation, and sorted. Each row is sent as a short mark (flags, a digest of role and text) and as
its text; a conversation's marks come before its texts, so a task holds only a few bytes a turn and streams the texts, even where one
conversation has a very large part of all rows. (A single order of edits makes its turns depend on each other, so a conversation is one task's.)

Output rows, those of a conversation together in one partition, its turns in order, then its report:
``kind`` 'turn': ``position`` (from 1), ``edit`` (K, R or I), ``role``, ``text``; ``kind`` 'report': counts of faults, cost, audit.

Defined cases: rows are ordered by turn (nulls first), then role, the text's first 256 characters and a digest of it; null role or text is one space; a
null conversation id is a conversation; roles with other initials than s, u and a can't be kept; repeated rows are repeats (and
deleted); a conversation whose every row is ``dropped`` has a report of zeros with an empty audit; an empty table gives no rows; texts of any
length pass through as they are; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, lean, schema_of

#: Characters that are no text, and those that end a sentence.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5

#: Grammar states: at the start, after system, after user, after assistant; where the initial s, u or a leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
TO = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ACCEPTED = 1 << START | 1 << ASSISTANT
#: A new role of a row, or an inserted one: the one that the state asks for.
ASKED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}


def _before(step: dict[int, int]) -> list[int]:
    """For each set of states the set of those from which ``step`` leads into it."""
    return [sum(1 << a for a, z in step.items() if states >> z & 1) for states in range(16)]


BEFORE = {c: _before(step) for c, step in TO.items()} | {"": _before({})}
BEFORE_ASKED = _before(ASKED)


def layers(initials: list[str], must_go: list[bool], cut: list[bool]) -> tuple[int, list[list[int]]]:
    """The cost, and for each place (before turn i, and the end) and state the layer that first held it.

    A layer's new bits are taken from the last place to the first, as Keep without cost adds bits before a place."""
    n = len(initials)
    first = [[-1] * 4 for _ in range(n + 1)]
    seen = [0] * (n + 1)
    ahead: dict[int, dict[int, int]] = defaultdict(dict)
    ahead[0][n] = ACCEPTED

    def put(cost: int, place: int, states: int) -> None:
        if states & ~seen[place]:
            ahead[cost][place] = ahead[cost].get(place, 0) | states

    c = -1
    while not seen[0] >> START & 1:
        c += 1
        layer = ahead.pop(c, None)
        if layer is None:
            continue
        places, at = sorted(layer), n + 1
        while places or layer:
            at = at - 1 if at - 1 in layer else places.pop()
            states = layer.pop(at, 0) & ~seen[at]
            if not states:
                continue
            seen[at] |= states
            for z in range(4):
                if states >> z & 1:
                    first[at][z] = c
            put(c + INSERT, at, BEFORE_ASKED[states])
            if at:
                i = at - 1
                put(c + DELETE, i, states)
                if not must_go[i]:
                    more = c + CUT * cut[i]
                    put(more + REROLE, i, BEFORE_ASKED[states])
                    kept = BEFORE[initials[i]][states]
                    if more > c:
                        put(more, i, kept)
                    elif kept & ~seen[i]:
                        layer[i] = layer.get(i, 0) | kept
    return c, first


def cheapest(initials: list[str], must_go: list[bool], cut: list[bool]) -> tuple[int, str, list[int]]:
    """(cost, least audit, the states that the audit's edits lead to)."""
    cost, first = layers(initials, must_go, cut)
    n, i, state, left = len(initials), 0, START, cost
    audit, states = [], []
    while i < n or left:
        here = [("I", INSERT, i, ASKED[state])]
        if i < n:
            here.append(("D", DELETE, i + 1, state))
            if not must_go[i]:
                if (to := TO.get(initials[i], {}).get(state)) is not None:
                    here.append(("K", KEEP + CUT * cut[i], i + 1, to))
                here.append(("R", REROLE + CUT * cut[i], i + 1, ASKED[state]))
        edit, spent, i, state = min(x for x in here if first[x[2]][x[3]] == left - x[1] >= 0)
        left -= spent
        audit.append(edit)
        states.append(state)
    return cost, "".join(audit), states


OUT = "conv {key}, kind string, position bigint, edit string, role string, text string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
LAWFUL = {"su", "ua", "au"}


class _Conversation:
    """What a task holds of the conversation that passes."""

    def __init__(self, conv):
        self.conv = conv
        self.initials, self.must_go, self.cut = [], [], []
        self.turns: set[int] = set()
        self.known: set[bytes] = set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.last = None
        self.edits = None

    def mark(self, turn, role: str, digest: bytes, blank: bool, open_end: bool) -> None:
        again = digest in self.known
        self.known.add(digest)
        fault = "blank" if blank else "duplicate" if again else "truncated" if open_end else None
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            self.turns.add(turn)
        initial = role[:1]
        if self.last is not None and self.last + initial not in LAWFUL:
            self.counts["illegal"] += 1
        self.last = initial
        self.initials.append(initial if initial in TO else "")
        self.must_go.append(blank or again)
        self.cut.append(fault == "truncated")

    def solve(self) -> None:
        self.known.clear()
        self.cost, self.audit, states = cheapest(self.initials, self.must_go, self.cut)
        self.edits, self.at, self.position = list(zip(self.audit, states)), 0, 0

    def inserted(self):
        """Inserted turns before the next row."""
        while self.at < len(self.edits) and self.edits[self.at][0] == "I":
            yield self.turn("I", NAMES[self.edits[self.at][1]], b"")
            self.at += 1

    def row(self, role: str, text: bytes):
        yield from self.inserted()
        edit, state = self.edits[self.at]
        self.at += 1
        if edit != "D":
            yield self.turn(edit, NAMES[state] if edit == "R" else role, text)

    def turn(self, edit: str, role: str, text: bytes) -> dict:
        self.position += 1
        return {"conv": self.conv, "kind": "turn", "position": self.position, "edit": edit, "role": role, "text": text}

    def end(self):
        if self.edits is None:
            self.solve()
        yield from self.inserted()
        gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        yield {"conv": self.conv, "kind": "report", "gaps": gaps, **self.counts, "cost": self.cost, "audit": self.audit}


DROPPED, MARK, TEXT = 0, 1, 2


def _repaired(key: pa.DataType):
    big, s = pa.int64(), pa.string()
    schema = schema_of(conv=key, kind=s, position=big, edit=s, role=s, text=pa.binary(), gaps=big, blank=big, duplicate=big, truncated=big, illegal=big, cost=big, audit=s)

    def run(batches):
        now, out, size = None, [], 0
        for b in batches:
            for r in b.to_pylist():
                made = []
                if now is None or r["conv"] != now.conv:
                    if now is not None:
                        made += now.end()
                    now = _Conversation(r["conv"])
                if r["kind"] == MARK:
                    now.mark(r["turn"], r["role"], r["digest"], r["blank"], r["open_end"])
                elif r["kind"] == TEXT:
                    if now.edits is None:
                        now.solve()
                    made += now.row(r["role"], r["text"])
                out += made
                size += sum(len(x.get("text") or x.get("audit") or "") + 64 for x in made)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if now is not None:
            out += now.end()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _digests(schema: pa.Schema):
    """SHA-256 of each conversation's turns, as they pass."""

    def run(batches):
        seen, digest = 0, sha256()
        for b in batches:
            kinds, roles, texts = (b.column(c) for c in ("kind", "role", "text"))
            reports, digests = [], []
            for i, kind in enumerate(kinds.to_pylist()):
                if kind == "turn":
                    digest.update((b"\n" if seen else b"") + roles[i].as_py().encode() + b":" + (texts[i].as_py() or "").encode())
                    seen += 1
                else:
                    reports.append(i)
                    digests.append(digest.hexdigest())
                    seen, digest = 0, sha256()
            if reports:
                out = pa.RecordBatch.from_arrays([b.column(n) for n in schema.names[:-1]], names=schema.names[:-1]).take(pa.array(reports))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(digests)], schema=schema)

    return run


REPORT = ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def with_digest(repaired: DataFrame) -> DataFrame:
    """The reports of ``repair`` with the digest of each conversation's ``role:text`` turns, joined by line feeds. Turns stand before
    their report in the same partition, so they are hashed as they pass, without another shuffle."""
    fields = [(n, to_arrow_type(repaired.schema[n].dataType)) for n in REPORT] + [("repaired_sha256", pa.string())]
    types = ", ".join(f"{n} {repaired.schema[n].dataType.simpleString()}" for n in REPORT)
    return repaired.mapInArrow(lean(_digests(pa.schema(fields))), f"{types}, repaired_sha256 string")


def repair(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped: Column | None = None) -> DataFrame:
    """Repaired turns and a report for each conversation of ``rows``; rows that are ``dropped`` only name theirs."""
    bounded_batches(rows.sparkSession)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), gone.alias("gone"))
    shown = F.rtrim("text", F.lit(BLANKS))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    flags = [(shown == "").alias("blank"), (~F.substring(shown, -1, 1).isin(*ENDS)).alias("open_end"), digest.alias("digest"), F.substring("text", 1, 256).alias("head")]
    rows = rows.select("*", *flags)
    none = lambda t: F.lit(None).cast(t)
    what = F.when(F.col("gone"), F.array(F.struct(F.lit(DROPPED).alias("kind"), none("binary").alias("text")))).otherwise(F.array(F.struct(F.lit(MARK).alias("kind"), none("binary").alias("text")), F.struct(F.lit(TEXT).alias("kind"), F.col("text").cast("binary").alias("text"))))
    marks = ("conv", "turn", "role", "head", "digest", "blank", "open_end")
    sent = rows.select(*marks, F.explode(what).alias("x")).select(*marks, "x.kind", "x.text")
    sent = sent.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "head", "digest").drop("head")
    key = rows.schema["conv"].dataType
    out = sent.mapInArrow(lean(_repaired(to_arrow_type(key))), OUT.format(key=key.simpleString()).replace("text string", "text binary"))
    return out.withColumn("text", F.col("text").cast("string"))


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The test harness of the operator: rows of ``conversations`` with faults by a checksum of ``conv_id:turn``, and which are dropped.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it and 4 makes its role user. Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(said("text"), "".join(ENDS), "")).otherwise(said("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), "kind", F.explode(copies).alias("copy"))
    return rows, F.col("kind") == 0
