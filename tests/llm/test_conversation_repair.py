import hashlib
import random
import re
import time
from functools import lru_cache

from pyspark.sql import functions as F

from seqgrove.llm import conversation_repair as repair

COLS = "conv_id bigint, turn bigint, role string, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


def brute(rows):
    """The least (cost, audit) over all edits, by trying each at each place; rows in order."""
    seen, told = set(), []
    for role, text in rows:
        blank, again = bool(BLANK.match(text)), (role, text) in seen
        cut = not blank and not again and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
        seen.add((role, text))
        told.append((role, text, blank, again, cut))
    goes = lambda state, c: {"s": "s" if state == "" else None, "u": "u" if state in ("", "s", "a") else None, "a": "a" if state == "u" else None}.get(c)

    @lru_cache(None)
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(told) and state in ("", "a") else []
        if inserts < 2:
            for c, name in (("u", "user"), ("a", "assistant")):
                if goes(state, c) and (w := best(i, c, inserts + 1)):
                    ways.append((w[0] + 5, "I" + w[1], ((name, ""), *w[2])))
        if i < len(told):
            role, text, blank, again, cut = told[i]
            if w := best(i + 1, state, 0):
                ways.append((w[0] + 2, "D" + w[1], w[2]))
            if not blank and not again:
                if goes(state, role[:1]) and (w := best(i + 1, role[:1], 0)):
                    ways.append((w[0] + 5 * cut, "K" + w[1], ((role, text), *w[2])))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if goes(state, c) and (w := best(i + 1, c, 0)):
                        ways.append((w[0] + 1 + 5 * cut, "R" + w[1], ((name, text), *w[2])))
        return min(ways) if ways else None

    two = [a[0][:1] + b[0][:1] for a, b in zip(told, told[1:])]
    counts = (sum(t[2] for t in told), sum(t[3] and not t[2] for t in told), sum(t[4] for t in told), sum(x not in ("su", "ua", "au") for x in two))
    return (*counts, *best(0, "", 0))


def as_digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def test_repair_equals_brute_force(spark):
    rng = random.Random(12)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "agent", None, "User"]
    texts = ["Hi.", "Yes!", "no", "", " \n", "What?", "x. ", "Hi.\t", None, "né", "." * 3]
    rows = [(c if c != 7 else None, rng.choice([None, 0, t, t, t]), rng.choice(roles[: rng.choice([3, 10])]), rng.choice(texts)) for c in range(400) for t in range(rng.randint(1, 8))]
    rows += [(900, t, r, f"{t}.") for t, r in enumerate(["user", "assistant"] * 3)] + [(901, 0, "assistant", "long " * 50_000 + ".")]
    d = spark.createDataFrame(rows, COLS).withColumn("kind", F.lit(9)).withColumn("head", F.lit("h")).withColumn("audit", F.lit(1)).repartition(6)
    out = repair.repair(d)
    got = {r.conv: r for r in repair.with_digest(out).collect()}
    turns = {}
    for r in out.where("kind = 'turn'").collect():
        turns.setdefault(r.conv, []).append((r.position, r.role, r.text or ""))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    for c in {r[0] for r in rows}:
        mine = sorted(((t, " " if ro is None else ro, " " if tx is None else tx) for k, t, ro, tx in rows if k == c), key=key)
        blank, again, cut, illegal, cost, audit, fixed = brute([x[1:] for x in mine])
        r, known = got[c], {x[0] for x in mine} - {None}
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (blank, again, cut, illegal, cost, audit), (c, mine)
        assert r.gaps == (max(known) - min(known) + 1 - len(known) if known else 0)
        assert [x[1:] for x in sorted(turns.get(c, []))] == list(fixed) and r.repaired_sha256 == as_digest(fixed)


def test_dropped_and_empty(spark):
    d = spark.createDataFrame([(1, 0, "user", "a."), (2, 0, "user", "a."), (2, 1, "assistant", "b.")], COLS)
    got = {r.conv: r for r in repair.with_digest(repair.repair(d, dropped=F.col("conv_id") == 1)).collect()}
    assert (got[1].cost, got[1].audit, got[1].repaired_sha256) == (0, "", as_digest([])) and got[2].audit == "KK"
    assert repair.with_digest(repair.repair(d.limit(0))).collect() == []


def test_one_long_conversation(spark):
    """Work is linear in the turns, whatever they cost."""
    n = 60_000
    rng = random.Random(13)
    initials = [rng.choice("uuuas") for _ in range(n)]
    start = time.time()
    cost, audit, states = repair.cheapest(initials, [False] * n, [False] * n)
    assert time.time() - start < 20 and len(states) == len(audit) and cost == sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in audit)
    d = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    assert repair.repair(d.repartition(8)).where("kind = 'report'").first().audit == "K" * n


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "a. b!") for c in range(60) for t in range(3)] + [(None, None, None, None), (5, None, "user", None)]
    d, dropped = repair.damaged(spark.createDataFrame(rows, COLS))
    got = sorted((r.conv_id or -1, -1 if r.turn is None else r.turn, r.role, r.text, r.gone) for r in d.withColumn("gone", dropped).collect())
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(k, text)
        want += [(c or -1, -1 if t is None else t, "user" if k == 4 else role, text, k == 0)] * (2 if k == 3 else 1)
    assert got == sorted(want)
