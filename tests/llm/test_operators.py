import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqgrove.llm import chat_format, decontaminate, jaccard_join, license_scan, lm_scoring, mixing, queries, token_output, topk_search, toxicity, warc
from seqgrove.llm.common import word_hashes

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("th", "er", "on", "qui", "zu") for b in ("ing", "at", "el", "os", "", "um")]


def documents(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOC)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- op1 -------------------------------------------------------------------------------------------------


def test_license_canonical_forms(spark):
    mit = license_scan._MIT
    other = "Copyright (c) 2020 Someone\n" + mit.upper().replace("COPYRIGHT HOLDERS", "copyright holders").replace('"', "“").replace("SUBLICENSE", "sub-licence")
    texts = [mit, other, "MIT License\n\n(C) 1999 X\n\n" + mit, mit + " more", "", None, "x\nReleased under the MIT licence.\ny", license_scan._BSD_HEAD]
    rows = {r.doc_id: (r.license_id, r.notices) for r in license_scan.licenses(documents(spark, texts)).collect()}
    assert [rows[i][0] for i in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, None]
    assert rows[6][1] == "MIT" and rows[0][1] is None


def test_long_licenses_and_more_notices(spark):
    from pathlib import Path

    have = Path("/usr/share/common-licenses")
    if not (have / "Apache-2.0").exists():
        pytest.skip("no licence texts")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl"}
    whole = [(have / f).read_text() for f in files]
    apache = whole[0].split("   APPENDIX")[0]
    others = [apache, whole[2].upper(), "The BSD 3-Clause License\n\nCopyright (c) 2020, X\n\n" + license_scan.KNOWN_TEXTS[-1][1], whole[2] + " more"]
    rows = {r.doc_id: r.license_id for r in license_scan.licenses(documents(spark, whole + others)).collect()}
    assert [rows[i] for i in range(len(rows))] == [*files.values(), "Apache-2.0", "GPL-3.0", "BSD-3-Clause", None]
    lines = ["x\n# SPDX-License-Identifier: MPL-2.0\ny", "Distributed under the GNU GPL v2.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]
    assert [r.notices for r in license_scan.licenses(documents(spark, lines)).orderBy("doc_id").collect()] == ["MPL-2.0", "GPL-2.0", "CC-BY-SA-4.0"]


def test_license_empty_and_clashing(spark):
    d = documents(spark, [license_scan._ISC]).withColumn("digest", F.lit("x")).withColumn("license_id", F.lit(1))
    assert license_scan.licenses(d).first().license_id == "ISC"
    assert license_scan.licenses(documents(spark, []).limit(0)).count() == 0
    rows = spark.createDataFrame([(1, "a\nMIT License"), (1, "b\nSPDX: Foo-1.0\n" * 20_000), (None, "Use of Foo is\nquite free."), (None, "MIT\n" * 2)] * 2, "doc_id bigint, text string")
    asked = spark.createDataFrame([("Foo-1.0", "SPDX: Foo-1.0"), ("Foo-2.0", "Use of foo is quite free"), ("MIT", "MIT License")], "license_id string, text string")
    got = Counter((r.doc_id, r.notices) for r in license_scan.licenses(rows, known_notices=asked).collect())
    assert got == {(1, "MIT"): 2, (1, "Foo-1.0"): 2, (None, "Foo-2.0"): 2, (None, None): 2}
    header = documents(spark, ["#!/bin/sh\n#\n# Copyright (C) 2001 X\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# more"])
    r = license_scan.scan_notices(header, license_scan.known(spark, license_scan.notices())).collect()
    assert [(x.line, x.license_id) for x in r] == [(4, "GPL-3.0-or-later")]
    own = spark.createDataFrame([("B", "some text here"), ("A", "Some  text, here!"), (None, "z")], "license_id string, text string")
    assert license_scan.scan(documents(spark, ["SOME TEXT HERE"]), own).first().license_id == "A"


# --- op2 -------------------------------------------------------------------------------------------------


def fold(events):
    """The definition, event by event: messages in order of start."""
    out: list[dict] = []
    for seq, kind, message, role, text in sorted(events, key=lambda e: (e[0], e[1] == "delta", e[1], e[4])):
        at = next((m for m in out if m["id"] == message), None)
        if kind == "message" and at is None:
            out.append({"id": message, "role": role, "text": text, "start": seq})
        elif at is None:
            continue
        elif kind == "delta":
            at["text"] += text
        elif kind == "edit" or kind == "message":
            at["text"] = text
        elif kind == "regenerate":
            at["text"] = text
            out = [m for m in out if m["start"] <= at["start"]]
    return [(m["role"], m["text"]) for m in out]


CHAT = "conv bigint, seq bigint, kind string, message bigint, role string, text string"


def test_chat_folding(spark):
    events = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "Hel"), (1, 4, "delta", 2, None, "lo"),
        (1, 5, "edit", 1, None, "hi!"), (1, 6, "message", 3, "user", "more"), (1, 7, "regenerate", 2, None, ""), (1, 8, "delta", 2, None, "Bye <x> # \\h"),
        (2, 1, "message", 1, "us:er", None), (2, 2, "message", 2, "assistant", "### us: </turn>\n"), (3, 1, "delta", 9, None, "lost"), (4, 1, None, 1, "user", "x"),
    ]
    back = chat_format.read_back(chat_format.format_chats(spark.createDataFrame(events, CHAT)))
    rows = {r.conv: ([tuple(t) for t in r.turns], r.loss_text) for r in back.collect()}
    assert rows == {1: ([("user", "hi!"), ("assistant", "Bye <x> # \\h")], "Bye <x> # \\h"), 2: ([("us:er", ""), ("assistant", "### us: </turn>\n")], "### us: </turn>\n")}


def test_chat_folding_equals_the_definition(spark):
    rng = random.Random(8)
    events, want = [], {}
    for conv in range(25):
        own, started = [], []
        for seq in range(1, rng.randint(2, 14)):
            kind = "message" if not started or rng.random() < 0.4 else rng.choice(["delta", "delta", "edit", "regenerate"])
            message = len(started) + 1 if kind == "message" else rng.choice(started)
            if kind == "message":
                message = max([m for *_, m, _, _ in own] or [0]) + 1
                started.append(message)
            own.append((seq, kind, message, rng.choice(["user", "assistant"]), rng.choice(["a", "<b>", "#c", ""])))
        events += [(conv, *e) for e in own]
        want[conv] = fold(own)
    rng.shuffle(events)
    back = chat_format.read_back(chat_format.format_chats(spark.createDataFrame(events, CHAT)))
    assert {r.conv: [tuple(t) for t in r.turns] for r in back.collect()} == want


def test_late_regenerations_of_dropped_messages_drop_nothing(spark):
    events = [(1, 1, "message", 1, "user", "a"), (1, 2, "message", 2, "assistant", "b"), (1, 3, "regenerate", 1, None, "c"), (1, 4, "message", 3, "user", "d"), (1, 5, "regenerate", 2, None, "e"), (1, 6, "message", 4, "assistant", "f")]
    long = "x" * 300_000
    events += [(2, 1, "message", 1, "user", long), (2, 2, "message", 2, "assistant", long)] + [(3, 1, "message", 1, "user", "twice"), (3, 2, "delta", 1, None, "!"), (3, 2, "delta", 1, None, "!")]
    df = spark.createDataFrame(events, CHAT).withColumn("start", F.lit(1)).withColumn("formatted", F.lit("x"))
    rows = {r.conv: [tuple(t) for t in r.turns] for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert rows == {1: [("user", "c"), ("user", "d"), ("assistant", "f")], 2: [("user", long), ("assistant", long)], 3: [("user", "twice!!")]}
    assert chat_format.read_back(chat_format.format_chats(df.limit(0))).count() == 0


def test_chat_query(spark, sf):
    rows = {r.conv_id: r for r in queries.op2_chat_formatting(spark, sf).collect()}
    r = rows[-7]
    said = queries.TRICKY
    assert r.n_turns == 2 and r.loss_chars == len(said)
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


# --- op3 -------------------------------------------------------------------------------------------------


def levenshtein_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert decontaminate.myers(decontaminate.masks(p), len(p), t)[0] == levenshtein_in(p, t)


def test_short_items_match_exactly_at_word_boundaries(spark):
    bench = spark.createDataFrame([(1, "Who wrote it?"), (2, "日本の首都はどこですか"), (3, "?!")], "item_id bigint, text string")
    texts = ["He asked: who  wrote it, then?", "who wrote items", "who wrote is", "問題。次の日本の首都はどこですか答え", "?!", "xwho wrote it. Who wrote it"]
    docs = documents(spark, texts)
    got = {(r.doc_id, r.item_id): (r.distance, r.allowed, texts[r.doc_id][r.start : r.end]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 1): (0, 0, "who  wrote it"), (3, 2): (0, 0, "日本の首都はどこですか"), (5, 1): (0, 0, "Who wrote it")}
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} == {1, 2, 4}


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(8, 25)).capitalize() + ".") for i in range(8)] + [(90, None), (91, "short"), (92, "")]
    items.append((8, items[0][1]))
    texts = []
    for i in range(40):
        base = prose(rng, rng.randint(0, 60))
        if i % 2:
            leak = list(items[i % 8][1])
            for _ in range(rng.randint(0, len(leak) // 9)):
                leak[rng.randrange(len(leak))] = rng.choice("abcdefxyz, ")
            base = base + "\n" + "".join(leak).upper() + "! " + prose(rng, 20)
        texts.append(base)
    docs = documents(spark, texts + [None, ""])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    cfg = decontaminate.Settings(block_chars=300)  # several blocks
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench, cfg).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, x in items:
            f = decontaminate.fold(x or "")
            if len(f) >= cfg.least and (k := levenshtein_in(f, decontaminate.fold(t))) <= decontaminate.budget(len(f), cfg):
                want[d, i] = k
    assert {k: r.distance for k, r in got.items()} == want and len(want) > 10
    for (d, i), r in got.items():
        part = decontaminate.fold(texts[d][r.start : r.end])
        assert levenshtein_in(decontaminate.fold(dict(items)[i]), part) <= r.distance
    clean = {r.doc_id for r in decontaminate.clean_documents(docs, bench, cfg).collect()}
    assert clean == set(range(42)) - {d for d, _ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.clean_documents(docs, bench.limit(0)).count() == 42


# --- op4 -------------------------------------------------------------------------------------------------


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (2 ** (rng.random(n) * 32)).astype(np.uint64).clip(0, 2**32 - 1).astype(np.uint32)
        control, data = token_output.pack(x)
        assert len(control) == -(-n // 4) and (token_output.unpack(control, data, n) == x).all()


ODD = ["a  b", " x", "x ", "", "\n", " \n a\n\nb c", "a\tb c  d e f", "x\u0085y z", "it's a b c's 'll d", "<|endoftext|> a", "\x1c a b\x1dc d", "a.b, c. d.", "é. x.\ny, z.", "a\0b c", "日本 語。 　x", "🙂 🙂.\n🙂", None]


def test_tokens(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = ODD + [prose(rng, rng.randint(1, 400)).replace(" q", ". Q").replace(" z", ",\nZ") for _ in range(60)] + ["word " * 20_000, "x <|endoftext|><|endoftext|>y", "<|endoftext|>"]
    docs = documents(spark, texts).withColumn("start", F.lit(1)).withColumn("ids", F.lit("x"))
    t = Tokenizer.from_file(queries.tokenizer_path())
    at = 0
    digests = {r.doc_id: r for r in token_output.tokens_of(docs, queries.tokenizer_path()).collect()}
    whole = {r.doc_id: r.ids for r in token_output.tokens_of(docs, queries.tokenizer_path(), digest=False).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        r = digests[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(x)
        assert whole[i] == ids
        at += len(ids)


def test_tokens_of_repeated_rows_and_of_none(spark):
    d = documents(spark, ["b c", "a"])
    rows = token_output.tokens_of(d.union(d), queries.tokenizer_path()).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [0, 0, 1, 1] and rows[-1].start + rows[-1].n_tokens == sum(r.n_tokens for r in rows)
    assert token_output.tokens_of(d.limit(0), queries.tokenizer_path()).count() == 0
    assert token_output.tokens_of(d.withColumn("doc_id", F.lit(None).cast("bigint")), queries.tokenizer_path()).count() == 2


# --- op5 -------------------------------------------------------------------------------------------------


def naive_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, left, out = set(names), sum(sizes.values()), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= most * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        free -= over
    return out


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 40)), "en", rng.choices(["a", "B", "é", None, "empty", "tiny"], (60, 3, 9, 20, 0, 1))[0], 0) for i in range(900)]
    rows += [(9000, None, "en", "empty", 0), (9001, " \t", "en", "empty", 0)]
    docs = spark.createDataFrame(rows, DOC)
    got = mixing.mix(docs, bucket_bits=5).collect()
    sizes = Counter()
    for i, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = naive_targets(dict(sizes))
    taken, longest = Counter(), max(len((t or "").split()) for _, t, *_ in rows)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(tuple, mixing.mix(docs, bucket_bits=9).collect()), key=str) == sorted(map(tuple, got), key=str)  # buckets don't matter
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    for r in got:
        assert mixed[r.doc_id] == (r.epochs if r["size"] else 1)
    assert mixing.mix(docs.limit(0)).count() == 0


# --- op6 -------------------------------------------------------------------------------------------------


def lower_words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()


def test_base_scores_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 60)) + rng.choice(["", "\n", " É x y", "  "]) for _ in range(120)] + [None, "", "THE the tHe", "new words only"]
    docs = documents(spark, texts + texts[:3]).withColumn("key", F.lit("x")).withColumn("id", F.lit(1)).withColumn("learn", F.lit(0))
    docs = docs.union(docs.where("doc_id = 5"))
    held = lm_scoring.held_out_rows(F.col("doc_id"))
    everything = [(i, lower_words(t)) for i, t in enumerate(texts + texts[:3])]
    train = Counter()
    for i, w in everything + [everything[5]]:
        if zlib.crc32(str(i).encode()) % 10:
            train.update(w)
            train[b""] += 1
    n, v = sum(train.values()), len(train)
    rows = lm_scoring.score_texts(docs, ~held).collect()
    assert Counter(r.doc_id for r in rows) == Counter([i for i, _ in everything] + [5])
    for r in rows:
        w = everything[r.doc_id][1] + [b""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in train for x in w), n)
        assert r.base_score == pytest.approx(math.fsum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), abs=1e-9)
        assert r.score < 0


class BruteTree:
    """Every context of every length of the ladder, counted in dictionaries and tested: growth has no rule here."""

    def __init__(self, train, cfg):
        self.cfg, self.after, self.words = cfg, {}, Counter()
        for t in train:
            for ctxs, x in self.places(t):
                self.words[x] += 1
                for c in ctxs:
                    self.after.setdefault(c, Counter())[x] += 1
        self.n, self.v, self.rest = sum(self.words.values()), len(self.words), {}
        for c in sorted(self.after, key=len):
            n, seen = sum(self.after[c].values()), {x: m for x, m in self.after[c].items() if m > 1}
            if seen:
                below = {x: self.prob(self.shorter(c), x) for x in seen}
                alone = n - sum(seen.values())
                rest = (cfg.discount * len(seen) + alone) / n / (1 - sum(below.values()))
                if sum(m * math.log((m - cfg.discount) / n / below[x]) for x, m in seen.items()) + alone * math.log(rest) >= cfg.gain:
                    self.rest[c] = rest

    def lengths(self, n):
        out = []
        for k in lm_scoring.ladder():
            out.append(min(k, n))
            if k >= n:
                return out

    def shorter(self, c):
        return [c[len(c) - k :] for k in self.lengths(len(c)) if k < len(c)]

    def places(self, t):
        raw = ("<", *lower_words(t), ">")
        return [([raw[i - k : i] for k in self.lengths(i)], raw[i]) for i in range(1, len(raw))]

    def prob(self, ctxs, x):
        p = (self.words[x] + 0.1) / (self.n + 0.1 * (self.v + 1))
        for c in ctxs:
            if c in self.rest:
                m, n = self.after[c][x], sum(self.after[c].values())
                p = (m - self.cfg.discount) / n if m > 1 else self.rest[c] * p
        return p

    def score(self, t):
        return sum(math.log10(self.prob(*at)) for at in self.places(t))


def lm_texts(rng):
    line = prose(rng, 70)
    texts = [prose(rng, rng.randint(0, 12)) for _ in range(60)] + [f"{rng.choice(['this', 'that'])} {line} " + ("yes" if i % 2 else "no") for i in range(12)]
    # only what stands far before the common line tells the words after it
    texts += [f"red {line} and so we stop" for _ in range(12)] + [f"blue {line} but then go on" for _ in range(12)]
    return texts + ["", None, "x", line, "red " + line, "green and so we go on"], line


def test_suffix_tree_equals_brute_force(spark):
    texts, line = lm_texts(random.Random(8))
    docs = documents(spark, texts)
    for cfg in (lm_scoring.Settings(gain=4.0), lm_scoring.Settings(gain=2.0, discount=0.5, turns=1, chunk=40)):
        tree = BruteTree(texts[:-6], cfg)
        assert max(map(len, tree.rest)) > len(line.split())
        got = {r.doc_id: r.score for r in lm_scoring.score_texts(docs, F.col("doc_id") < len(texts) - 6, cfg=cfg).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx([tree.score(t) for t in texts], abs=1e-6)


def test_words_before_very_many_tokens_are_split_without_a_change(spark):
    """Small limits stand for large inputs: more lots than parts of the session, words whose tokens go to several lots."""
    texts, _ = lm_texts(random.Random(11))
    docs, learn = documents(spark, texts), F.col("doc_id") < len(texts) - 6
    plain = lm_scoring.score_texts(docs, learn, cfg=lm_scoring.Settings(gain=2.0)).orderBy("doc_id").collect()
    tree = BruteTree(texts[:-6], lm_scoring.Settings(gain=2.0))
    assert [r.score for r in plain] == pytest.approx([tree.score(t) for t in texts], abs=1e-6)
    cfg = lm_scoring.Settings(gain=2.0, part_bytes=1_000, crowded=12, chunk=300)
    split = lm_scoring.score_texts(docs, learn, cfg=cfg).orderBy("doc_id").collect()
    for a, b in zip(plain, split, strict=True):
        assert (a.doc_id, a.n_tokens, a.n_known, a.train_tokens) == (b.doc_id, b.n_tokens, b.n_known, b.train_tokens)
        assert (b.base_score, b.score) == pytest.approx((a.base_score, a.score), abs=1e-9)


def test_a_lot_is_counted_in_pieces_within_bounded_memory(monkeypatch):
    """One lot with a word before a third of its tokens; numpy's and Python's memory is traced."""
    import gc
    import tracemalloc

    rng, cfg = random.Random(12), lm_scoring.Settings()
    texts = [" ".join(w for _ in range(700) for w in (rng.choice(("the", WORDS[i % 7])), f"{rng.choice(WORDS)}{rng.randint(0, 99)}")).encode() for i in range(700)]
    rows = pa.RecordBatch.from_pydict({"text": texts, "key": list(range(len(texts))), "id": list(range(len(texts))), "learn": [True] * len(texts)})
    sent = [list(lm_scoring._sent(n, 1, (0, 1), 300_000)(rows.slice(i, 70) for i in range(0, 700, 70))) for n in (0, 1)]
    words = Counter(lm_scoring.Tokens(texts).symbol.tolist())
    total = sum(words.values())
    names = lm_scoring.squeeze(np.array([*words], np.uint64), 7)
    table = lm_scoring._batch(lm_scoring.SENT, [(0, lm_scoring.TABLE, b"", b"", names, lm_scoring.squeeze(np.array([*words.values()]), 5), *[b""] * 4)])

    def run(number, batches):
        out = [r for b in lm_scoring._scored(number, 1, total, len(words), cfg)(None, iter(batches)) for r in b.to_pylist()]
        sums = [np.frombuffer(r["d"], float) for r in out if r["kind"] == lm_scoring.SUMS]
        return sums[0], sorted((a, b, c) for r in out if r["kind"] == lm_scoring.OPEN for a, b, c in zip(lm_scoring.widen(r["a"], 6), lm_scoring.widen(r["b"], 7), np.frombuffer(r["c"], float)))

    monkeypatch.setattr(lm_scoring, "STEP", 1 << 14)
    monkeypatch.setattr(lm_scoring, "PIECE", 1 << 30)
    whole, opened = run(0, [*sent[0], table])
    keys, symbols, p = (np.array(x) for x in zip(*opened))
    open_table = lm_scoring._batch(lm_scoring.SENT, [(0, lm_scoring.TABLE, lm_scoring.squeeze(keys, 6), b"", lm_scoring.squeeze(symbols, 7), p.tobytes(), *[b""] * 4)])
    longer = run(1, [*sent[1], open_table])
    monkeypatch.setattr(lm_scoring, "PIECE", 1 << 16)
    gc.collect()
    tracemalloc.start()
    parts, found = run(0, [*sent[0], table])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts == pytest.approx(whole, abs=1e-6) and found == opened
    again = run(1, [*sent[1], open_table])
    assert again[0] == pytest.approx(longer[0], abs=1e-6) and again[1] == longer[1]
    assert peak < 70 * total


def test_probabilities_of_the_tree_sum_to_one():
    texts, _ = lm_texts(random.Random(9))
    tree = BruteTree(texts[:-6], lm_scoring.Settings(gain=2.0))
    for t in texts[60:]:
        for ctxs, _ in tree.places(t)[-4:]:
            assert sum(tree.prob(ctxs, x) for x in tree.words) + tree.prob(ctxs, "unseen") == pytest.approx(1)


def test_the_tree_tells_unseen_texts_from_noise(spark):
    rng = random.Random(14)
    texts = ["red one two. " * rng.randint(1, 9) if i % 2 else "blue three four. " * rng.randint(1, 9) for i in range(60)] + ["red one two.", "red four one three."]
    rows = {r.doc_id: r for r in lm_scoring.score_texts(documents(spark, texts), F.col("doc_id") < 60).collect()}
    assert rows[60].score > rows[60].base_score and rows[60].score / rows[60].n_tokens > rows[61].score / rows[61].n_tokens


def test_lm_without_training_or_rows(spark):
    d = documents(spark, ["a b", None, "w " * 300_000]).withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id")))
    rows = lm_scoring.score_texts(d, F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [(1, 0, 0), (3, 0, 0), (300_001, 0, 0)] and all(r.base_score == pytest.approx(0) and r.score == pytest.approx(0) for r in rows)
    assert sorted((r.doc_id is None) for r in rows) == [False, False, True]
    assert lm_scoring.score_texts(d.limit(0), F.lit(True)).count() == 0


# --- op7 -------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_ignores_groups(spark):
    rng = random.Random(7)
    bad, texts, labels = ["idiot", "scum", "trash"], [], []
    for i in range(600):
        toxic = i % 5 == 0
        t = prose(rng, rng.randint(5, 60)).split()
        if toxic:
            t.insert(rng.randrange(len(t)), rng.choice(bad) + rng.choice(["", ".", "!"]))
        if rng.random() < (0.7 if toxic else 0.05):  # groups are named mostly in toxic texts
            t.insert(0, rng.choice(["muslim", "women", "gay"]))
        texts.append(" ".join(t))
        labels.append((i, 1, int(toxic)))
    y = spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, None), (0, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, texts + ["muslim", "women " + prose(rng, 9), "", None])
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, y).collect()}
    held = [i for i in range(600) if rows[i].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600))
    assert sum(rows[i].predicted == labels[i][2] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert rows[600].predicted == 0 and rows[601].predicted == 0
    # the penalty is what keeps neutral mentions low
    free = toxicity.fit(docs, y, toxicity.held_out_rows(F.col("doc_id")), toxicity.Settings(swap_weight=0.0))
    tied = toxicity.fit(docs, y, toxicity.held_out_rows(F.col("doc_id")))
    gap = lambda m: max(abs(m.score(b"muslim " + x) - m.score(b"christian " + x)) for x in (b"", b"idiot", b"therel"))
    assert gap(tied) < gap(free)


def test_toxicity_gradient_equals_differences():
    rng = np.random.default_rng(1)
    own = [sorted(rng.choice(9, rng.integers(0, 6), replace=False).tolist()) for _ in range(30)]
    other = [[sorted(rng.choice(9, 3, replace=False).tolist()) for _ in range(rng.integers(0, 4))] for _ in range(30)]
    o = toxicity.Objective((rng.random(30) < 0.4).astype(float), own, other, rng.normal(size=9), toxicity.Settings(ridge=0.1))
    v, b, h = rng.normal(size=9), 0.3, 1e-6
    g, gb = o.gradient(v, b)
    steps = [(o.loss(v + h * e, b) - o.loss(v - h * e, b)) / (2 * h) for e in np.eye(9)]
    assert g == pytest.approx(steps, abs=1e-6) and gb == pytest.approx((o.loss(v, b + h) - o.loss(v, b - h)) / (2 * h), abs=1e-6)


def test_toxicity_cases(spark):
    docs = documents(spark, ["you idiot " * 50_000, "fine text", "you idiot", "fine words"] * 20).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(3)).withColumn("_text", F.lit(""))
    docs = docs.union(docs.where("doc_id < 4"))
    y = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(80)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity(docs, y).collect()
    assert len(rows) == 84 and all(r.predicted == int(r.doc_id % 2 == 0) for r in rows)
    assert len(toxicity.swapped({b"muslim", b"x"})) == 7 and toxicity.swapped({b"x"}) == []


def test_toxicity_without_labels(spark):
    y = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity(documents(spark, ["a", None]), y).collect()
    assert {r.score for r in rows} == {0.5} and toxicity.toxicity(documents(spark, ["a"]).limit(0), y).count() == 0


# --- op8 -------------------------------------------------------------------------------------------------


def naive_components(texts):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    sets = []
    for t in texts:
        w = low(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root)]


def near_copies(rng, n):
    texts = []
    for _ in range(n):
        base = prose(rng, rng.choice([1, 3, 5, 6, 20, 80, 200])).split()
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randrange(9))
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    return texts + ["", None, " \n", "only", "Only"]


def test_jaccard_equals_brute_force(spark):
    texts = near_copies(random.Random(11), 60)
    docs = documents(spark, texts).withColumn("node", F.lit("x")).withColumn("component_id", F.lit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == naive_components(texts)


def test_jaccard_with_few_stars_and_small_blocks_is_the_same(spark, monkeypatch):
    texts = near_copies(random.Random(12), 30)
    monkeypatch.setattr(jaccard_join, "STARS", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "SMALL", 0)  # joins by shuffle
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == naive_components(texts)


def near_a_large_group(rng, copies, near):
    """Near copies of a text, each with a few words changed, and texts at many distances from it."""
    base = prose(rng, 60).split()
    base = [w + str(i) for i, w in enumerate(base)]
    texts = []
    for i in range(copies + near):
        w = list(base)
        for k in rng.sample(range(60), rng.randint(0, 1) if i < copies else rng.randint(1, 12)):
            w[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w[: rng.choice([60, 60, 45, 30])] if i >= copies else w))
    return texts


def test_jaccard_near_a_large_group(spark, monkeypatch):
    texts = near_a_large_group(random.Random(15), 150, 60)
    want = naive_components(texts)
    assert 5 < len({c for _, c in want}) < 60
    monkeypatch.setattr(jaccard_join, "STARS", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_a_large_group_gives_few_rows():
    """Nodes beside a group of thousands meet its component once each, not each of its nodes."""
    rng = np.random.default_rng(3)
    names = sorted({rng.bytes(16) for _ in range(3040)})
    root, beside = names[0], set(names[-40:])
    blob = jaccard_join._pack(0, names, np.full(3040, 50), np.zeros(3040, np.uint32), np.arange(3040), np.zeros(3040, np.int64))
    import pyarrow as pa

    labels = pa.table({"node": [x for x in names if x not in beside], "label": [root] * 3000})
    out = jaccard_join._meetings(jaccard_join.Threshold(75, 100), 8)((0,), pa.table({"blob": [blob]}), labels)
    pairs = jaccard_join._distinct_pairs(None, out)
    assert sum(v == root for v in pairs["v"].to_pylist()) == 40 and len(pairs) == 40 + 40 * 39 // 2


def test_one_of_each(spark):
    rng = random.Random(13)
    a = prose(rng, 50)
    d = documents(spark, [a, a + " x", prose(rng, 40), a, None, ""])
    kept = jaccard_join.one_of_each(d.union(d.where("doc_id = 2")))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 5] and kept.columns == d.columns
    assert jaccard_join.jaccard_components(d.limit(0)).count() == 0


def test_shingle_hashes_tell_words_apart():
    h, n = word_hashes([b"a b", b"", b"b  A\tb\x0bc", b"a"])
    assert n.tolist() == [2, 0, 4, 1] and h[0] == h[3] == h[6] and h[1] == h[2] == h[4] and len(set(h.tolist())) == 3


def test_jaccard_join_leaves_no_broadcasts_on_the_driver(spark, monkeypatch):
    made, gone, sc = [], [], type(spark.sparkContext)
    from pyspark.core.broadcast import Broadcast

    put, end = sc.broadcast, Broadcast.destroy
    monkeypatch.setattr(sc, "broadcast", lambda self, value: made.append(put(self, value)) or made[-1])
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: gone.append(self) or end(self, *a))
    line = prose(random.Random(3), 60)
    rows = jaccard_join.jaccard_components(documents(spark, [line, line + " more", prose(random.Random(4), 60)])).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 0, 2: 2}
    assert made and {id(b) for b in made} == {id(b) for b in gone}


def test_sketches_are_told_in_as_few_bytes_as_hold_them():
    for most, width in ((65_535, 2), (65_536, 4), (1 << 32, 8)):
        counts = np.zeros(2 << jaccard_join.SKETCH_BITS, np.int64)
        counts[5] = most
        first = next(jaccard_join._sketch_rows(counts, bare=True)).column("counts")[0].as_py()
        assert len(first) == width * len(counts) // jaccard_join.PIECES and jaccard_join._piece_counts(first)[5] == most


# --- op9 -------------------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 8))
    rows = [(i, (centres[i % 4] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(9)]  # ties
    rows += [(2000, None, 0), (2001, [1.0, None] + [0.0] * 6, 0), (2002, [float("nan")] * 8, 0), (2050, [float("inf")] + [0.0] * 7, 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    valid = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v, _ in rows if i is not None and i not in (2000, 2001, 2002, 2050)}
    want = {}
    for q in valid:
        if q % 50 == 0:
            order = sorted(((-int(valid[q] @ x), i) for i, x in valid.items() if i != q))[:5]
            want |= {(q, k): (i, -s) for k, (s, i) in enumerate(order, 1)}
    df = df.withColumn("cell", F.lit(1)).withColumn("dist", F.lit("x")).withColumn("part", F.lit(0))
    for kw in ({}, {"block_rows": 20, "query_rows": 2, "pivots": 7}, {"pivots": 1}):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.top_k(df, F.col("id") % 50 == 0, **kw).collect()}
        assert got == want


def test_topk_small_tables(spark):
    kind = "vec_id bigint, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0])], kind)
    got = [tuple(r) for r in topk_search.top_k(two, F.col("id") % 50 == 0).orderBy("query_id").collect()]
    assert got == [(0, 1, 50, 65536), (50, 1, 0, 65536)]
    assert topk_search.top_k(two.limit(0), F.lit(True)).count() == 0
    again = two.union(two)
    both = [tuple(r) for r in topk_search.top_k(again, F.lit(True)).orderBy("query_id", "rank").collect()]
    assert both == [(0, 1, 50, 65536), (0, 2, 50, 65536), (50, 1, 0, 65536), (50, 2, 0, 65536)]


def test_topk_compares_only_what_is_necessary(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16)) * 3
    x = (centres[np.arange(3000) % 30] + 0.05 * rng.normal(size=(3000, 16))).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    search = topk_search.Search(df, F.col("id") % 50 == 0, 5, "vec_id", "embedding", 256, None, 8192, 4096)
    ints = np.floor(256 * x).astype(np.int64)
    want = {(q, k): -s for q in range(0, 3000, 50) for k, (s, _) in enumerate(sorted((-int(ints[q] @ v), i) for i, v in enumerate(ints) if i != q)[:5], 1)}
    assert {(r.query_id, r["rank"]): r.score for r in search.result.collect()} == want
    shares = search.shares()
    assert shares["rows"] < 0.25 and shares["rings"] < 0.25


# --- op10 ------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(6)
    html = [f"<p>{prose(rng, rng.randint(0, 300))}é\r\n\r\n</p>" for _ in range(40)]
    rows = [(i, f"http://h/{i}\n" if i % 7 else None, html[i % 30] if i % 11 else None) for i in range(80)] + [(500, "u", "x" * 200_000), (500, "u", "x" * 200_000), (501, "", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    path = f"file://{tmp_path}/w"
    index = warc.write_archives(pages, path)
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    import base64

    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    for ranged in (True, False):
        got = warc.read_records(spark, path, index, ranged=ranged).collect()
        want = Counter()
        for i, _, h in rows:
            last = max(groups[h or ""])
            want[i, len((h or "").encode()), sha(h or ""), "response" if i == last else "revisit", None if i == last else last] += 1
        want[500, 200_000, sha("x" * 200_000), "response", None] = 1
        want[500, 200_000, sha("x" * 200_000), "revisit", 500] = 1
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
        assert all(bytes(r.payload).decode() in groups for r in got if r.record_type == "response")
    some = warc.read_records(spark, path, index.where("page_id in (3, 70)"), gap=0, most=1000).collect()
    assert {r.page_id for r in some} == {3, 70}


def test_warc_ranges_and_empty(spark, tmp_path):
    assert list(warc.coalesce_ranges([(0, 10), (10, 5), (30, 5), (1000, 5)], 20, 100)) == [(0, 35, 0, 3), (1000, 1005, 3, 4)]
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archived(pages).count() == 0
    one = spark.createDataFrame([(None, "u", "x"), (4, "u", "x"), (5, "u", "long enough to revisit"), (6, "u", "long enough to revisit")], "page_id bigint, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archived(one, least=5).collect()}
    assert got == {(None, "response", None), (4, "response", None), (5, "revisit", 6), (6, "response", None)}
    none = spark.createDataFrame([(None, f"u{i}", "same payload") for i in range(6)] + [(7, "u", "x")] * 3 + [(8, "v", "x"), (8, "w", "x")], "page_id bigint, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archived(none).collect())
    assert got == {(None, "response", None): 1, (None, "revisit", None): 5, (7, "revisit", 8): 3, (8, "response", None): 1, (8, "revisit", 8): 1}
