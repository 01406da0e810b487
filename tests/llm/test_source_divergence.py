import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqgrove.llm import source_divergence as audit

COLS = "text string, lang string, source string"


def brute(rows, s):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), la or "", so or "") for t, la, so in rows]
    out = []
    for lang in {d[1] for d in docs}:
        df = Counter(w for ts, la, _ in docs if la == lang for w in set(ts))
        kept = {w for w, n in df.items() if n >= s.least}
        n = defaultdict(Counter)
        for ts, la, so in docs:
            if la == lang:
                n[so].update(w for w in ts if w in kept)
        every = sum(n.values(), Counter())
        share = lambda c, w: 1 + s.scale * (c[w] + s.added) // (sum(c.values()) + s.added * len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for so in n:
            pair = [(sum(f(share(n[so], w), share(n[o], w)) for w in kept), o) for o in n if o != so]
            term = [(f(share(n[so], w), share(every, w)), w) for w in n[so] if share(n[so], w) > share(every, w)]
            for part, found, top in (("pair", pair, len(pair)), ("term", term, s.top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, so, part, item, v, i + 1) for i, (v, item) in enumerate(found[:top])]
    return sorted(out)


def rows_of(rng, n):
    words = ["Alpha", "beta", "gámma", "文", "délta", "x" * 300, "É", "\U0001f600ab", "zeta", *(f"w{chr(97 + i)}" for i in range(20))]
    apart = [" ", "\n", "1", "-", "_", "@", "\0", "  "]
    one = lambda: "".join(rng.choice(words) + rng.choice(apart) for _ in range(rng.randint(0, 30)))
    rows = [(one(), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None])) for _ in range(n)]
    return rows + rows[:20] + [(None, "en", "bare"), ("", "fr", "a"), ("1 2", "fr", "b"), ("once", "fr", None), ("alone alone", "it", "a"), ("alone", "it", "a"), ("Alone", "it", "a"), ("beta " * 20_000, "en", "a")]


# a sketch of 16 cells a row lets nearly everything through; lots of one batch
@pytest.mark.parametrize("settings", [audit.Settings(), audit.Settings(sketch_bits=4, lot=10, top=3), audit.Settings(least=1, scale=10**6, added=2)])
def test_divergence_equals_brute_force(spark, settings):
    rows = rows_of(random.Random(5), 200)
    d = spark.createDataFrame(rows, COLS).withColumn("term", F.lit(1)).withColumn("value", F.lit("v")).withColumn("n", F.lit(2)).repartition(5)
    assert sorted(map(tuple, audit.divergence(d, settings).collect())) == brute(rows, settings)


def test_empty_tables(spark):
    d = spark.createDataFrame([], COLS)
    assert audit.divergence(d).collect() == []


def test_sketch_never_underestimates(spark):
    rng = random.Random(6)
    rows = rows_of(rng, 300)
    s = audit.Settings(sketch_bits=6)
    d = spark.createDataFrame(rows, COLS).select(F.coalesce("lang", F.lit("")).cast("binary").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).repartition(7)
    bits = audit.sketch(d, s)
    for lang in ("en", "de", "", "fr", "it"):
        df = Counter(w for t, la, _ in rows if (la or "") == lang for w in {x.lower() for x in audit.TERM.findall((t or "").encode())})
        terms = list(df)
        assert all(ok or df[w] < s.least for w, ok in zip(terms, audit.may_reach(bits, lang.encode(), terms, s)))
    wide = audit.sketch(d, audit.Settings())
    rare = [w for w, n in df.items() if n < s.least]
    assert not audit.may_reach(wide, b"it", rare, audit.Settings()).any()
