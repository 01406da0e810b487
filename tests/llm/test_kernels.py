import random
import re
import tracemalloc

import numpy as np

from seqgrove.llm import common, lm_scoring


def test_ranked_is_a_stable_argsort():
    rng = np.random.default_rng(1)
    for keys, width in ((rng.integers(0, 1 << 63, 5000), 64), (rng.integers(0, 50, 5000), 32), (np.repeat(rng.integers(0, 1 << 48, 300), 20), 48), (np.arange(3000)[::-1] + (1 << 60), 64), (np.zeros(0, np.int64), 64), (np.ones(1, np.int64), 64)):
        keys = keys.astype(np.uint64)  # of the fourth, the upper bits are all the same
        assert (common.ranked(keys, width) == np.argsort(keys, kind="stable")).all()
        assert (common.distinct(keys) == np.unique(keys)).all()


def test_words_of_all_lengths_have_hashes_of_their_own():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab\0é") for _ in range(n)) for n in [*range(1, 40), 1000, 5000] for _ in range(30)})
    texts = [" ".join(rng.choice(words) + rng.choice(["", "\n", "\t ", "\x0b"]) for _ in range(rng.randrange(60))).encode() for _ in range(200)]
    h, n = common.word_hashes(texts)
    found = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t.lower())]
    assert n.tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in texts] and len(h) == len(found)
    assert len({*zip(h.tolist(), found)}) == len({*h.tolist()}) == len({*found})


def test_hashing_words_takes_little_memory():
    text = b"some words of a text, which are short as words are; " * 4000
    common.word_hashes([text])
    tracemalloc.start()
    common.word_hashes([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * len(text), peak


def test_only_contexts_that_tokens_have_are_hashed(monkeypatch):
    import pyarrow as pa

    made, contexts = [], lm_scoring.Tokens.contexts
    monkeypatch.setattr(lm_scoring.Tokens, "contexts", lambda self, length, at=None: made.append((length, len(self.pos if at is None else at))) or contexts(self, length, at))
    texts = [b"a b c d e f g h i j k l m n o p"] * 3 + [b"q " * 30]
    rows = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary()), "key": [1, 2, 3, 4], "id": [1, 2, 3, 4], "learn": [True] * 4})

    class Full:
        value = np.full((1 << common.BLOOM_BITS) // 8, 255, np.uint8)

    list(lm_scoring._sent(2, 4, (0, 4), 1000, Full)(iter([rows])))
    before, steps = lm_scoring.lengths_of(2)
    offs = [i for n in (17, 17, 17, 31) for i in range(1, n + 1)]
    # a length has the tokens before which more symbols stand than the length before it
    assert made[1:] == [(n, sum(o > last for o in offs)) for last, n in zip([before, *steps], steps) if any(o > last for o in offs)]
    assert len(made) - 1 < len(steps)
