"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words of a text (A-Z in small letters) and one end; a context is what stands before a symbol,
and a text's start is a symbol of contexts. Lengths of contexts have no limit: 1, 2, 3, 4, 6, 8, 12, 16, 24 and
so on (``ladder``), a context that meets the start of its text being the whole of what precedes. A context is a
state of the tree if its distribution diverges from the one of its longest retained suffix: n * KL, over the
smoothed distribution of its n training symbols, is at least ``Settings.gain`` nats. Smoothing backs off: symbols
seen twice or more keep their count less ``Settings.discount``, and what that and the symbols seen once leave is
shared out by the suffix's distribution over all other symbols. The root is the unigram model with 0.1 added that
also gives the base score, so both scores are probabilities of the same tokens. A token is scored by the longest
suffix of its context that is a state.

Counting and scoring meet in one place, so the tree itself is never gathered, broadcast or written:

1. A pass over the texts sends the distinct (lot, word) of each chunk to the words' partitions, where they are
   counted, and each lot gets the counts of its own words back. A lot is a range of hashes of the last word.
2. Every token goes to the lot of its context's last word with hashes of its context's lengths. There the contexts of
   length 1 and 2 are counted over the training part, tested, smoothed and used for all tokens, training and held
   out. Back come sums by text. Lots are taken in ``Settings.turns`` turns, which bounds the disk.
3. A context is *open* while a longer one could still pass the test. After a longer context no symbol is seen more
   often, a state needs one seen twice, and only K - 1 of the K symbols can then be seen once, each gaining at most the whole
   back-off, -log(1 - M), where M is what the symbols seen twice have. So a longer context gains at most the sum of count * -log p
   of the symbols seen twice and (K - 1) * -log(1 - M). Below ``gain`` nothing longer is a state: the growth
   is decided by the test alone. Longer contexts are made of open ones only; their tokens are sent with hashes of further lengths to the
   lots of their contexts, until no context is open. A filter of fixed size tells senders which are; a full one
   only lets more through.

The number of lots grows with the bytes of the texts. A lot is read batch by batch and counted in pieces by a hash of the
context, so a task holds about 25 bytes a token and the work arrays of a piece, or of one word that isn't crowded. A word that stands before more tokens than a lot may hold (``crowded``) is met
in two steps: its distinct (word, symbol) with counts meet where the context of length 1 is tested; its tokens then
go to lots of the last *two* words, with what was found for each (word, symbol). Which words are treated so changes no result.

Words are known by 56 bits of a hash, contexts by 48 bits inside a lot, whose size doesn't grow with the input.

Defined cases: null text is the empty text, which has the end only; a null id belongs to the training part; repeated
rows are scored each; very long texts are hashed in slices; without training texts all scores are 0; an empty table gives no rows;
further columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, bloom_has, bloom_of, bounded_batches, crc_bucket, discard, distinct, eights, lean, lean_stream, lean_table, materialise, mix, powers, ranked, shuffle_parts, sweep, utf8, word_hashes

U = np.uint64
START, END = 0, 1
INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Lengths of contexts that are taken in the first rounds, and in each round after these.
ROUNDS, MORE = (2, 2), 27


@dataclass(frozen=True)
class Settings:
    gain: float = 6.0
    discount: float = 0.8
    turns: int = 2
    chunk: int = 1_000_000
    #: Bytes of text for each part (of words, and of lots in a turn) at most, on average.
    part_bytes: int = 24_000_000
    #: Training tokens after one word that a lot takes; a word with more is met in two steps.
    crowded: int = 5_000_000


def ladder():
    """1, 2, 3, 4, 6, 8, 12, 16, 24, 32 and so on: two lengths an octave."""
    yield 1
    n = 2
    while True:
        yield n
        yield n + n // 2
        n *= 2


def lengths_of(number: int) -> tuple[int, list[int]]:
    """The length before a round's first one, and the lengths of the round."""
    before = sum(ROUNDS[:number]) + MORE * max(0, number - len(ROUNDS))
    here = ROUNDS[number] if number < len(ROUNDS) else MORE
    steps = [0, *islice(ladder(), before + here)]
    return steps[before], steps[before + 1 :]


def squeeze(x: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of each number."""
    x = np.ascontiguousarray(x, dtype="<u8")
    return np.ndarray((len(x),), f"V{width}", x, 0, (8,)).tobytes() if len(x) else b""


def _wide(raw: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """Numbers of ``eights``, of which each has as many bytes as lie between them."""
    return raw[at] & U((1 << 8 * raw.strides[0]) - 1)


def widen(raw: bytes, width: int) -> np.ndarray:
    return _wide(eights(raw + b"\0" * 8, width), slice(None))


class Tokens:
    """The tokens of some texts: symbol, row of the text, number of symbols before (the start included)."""

    def __init__(self, texts: list[bytes]):
        h, n = word_hashes(texts)
        starts = np.cumsum(n + 2) - (n + 2)
        self.raw = np.empty(len(h) + 2 * len(n), U)
        inner = np.ones(len(self.raw), bool)
        inner[starts] = inner[starts + n + 1] = False
        self.raw[inner] = np.maximum(h >> U(8), U(2))
        self.raw[starts], self.raw[starts + n + 1] = U(START), U(END)
        inner[starts + n + 1] = True
        self.pos = np.flatnonzero(inner)
        self.row = np.repeat(np.arange(len(n)), n + 1)
        self.off = self.pos - np.repeat(starts, n + 1)
        self.symbol = self.raw[self.pos]
        self._sums: np.ndarray | None = None

    def contexts(self, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """48-bit hashes of the last ``length`` symbols (no more than there are) before the tokens ``at``: the sum of
        (symbol + 1) * BASE ** distance."""
        pos, off = (self.pos, self.off) if at is None else (self.pos[at], self.off[at])
        if length <= 4:
            h = (self.raw[pos - 1] + U(1)) * powers(5)[1]
            for d in range(2, length + 1):
                h += np.where(off >= d, (self.raw[np.maximum(pos - d, 0)] + U(1)) * powers(5)[d], U(0))
        else:
            if self._sums is None:
                self._sums = np.full(len(self.raw) + 1, INVERSE, U)
                self._sums[0] = 1
                back = np.multiply.accumulate(self._sums)[:-1]
                self._sums[0] = 0
                np.cumsum(back * (self.raw + U(1)), out=self._sums[1:])
            h = (self._sums[pos] - self._sums[pos - np.minimum(off, length)]) * powers(len(self.raw))[pos]
        return mix(h) >> U(16)


def lot_of(key: np.ndarray, lots: int) -> np.ndarray:
    return ((key * U(lots)) >> U(48)).astype(np.int64)


def edges_of(lots: int) -> np.ndarray:
    """The first key of each lot, and the end."""
    return np.array([-(-(i << 48) // lots) for i in range(lots + 1)], U)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal neighbours."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(keys)))


def _chunks(batches, most: int):
    """Texts, keys, ids and parts (training or not) of rows, joined up to about ``most`` words."""
    cols: tuple[list, ...] = ([], [], [], [])
    held = 0
    for b in batches:
        for col, name in zip(cols, ("text", "key", "id", "learn")):
            col += b.column(name).to_pylist()
        held += b.column("text").nbytes
        if held >= 6 * most:
            yield cols
            cols, held = ([], [], [], []), 0
    if cols[0]:
        yield cols


# --- words -----------------------------------------------------------------------------------------------

ASKED = "kind int, lot bigint, a binary, b binary, c binary"
WORDS, TEXTS = 0, 1


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _asked(lots: int, parts: int, most: int):
    """The distinct (lot, word) of each chunk with their training counts, by the word's part; keys and ids of the texts."""

    def run(batches):
        for texts, keys, ids, learn in _chunks(batches, most):
            t = Tokens(texts)
            lot = lot_of(t.contexts(1), lots)
            train = np.array(learn, bool)[t.row]
            both = mix(t.symbol * U(lots + 1) + lot.astype(U))
            order = ranked(both)
            at, _ = _runs(both[order])
            n = np.add.reduceat(train[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
            first = order[at]
            s, lot = t.symbol[first], lot[first]
            part = (mix(s) % U(parts)).astype(np.int64)
            order = ranked(part, 32)
            s, lot, n, part = s[order], lot[order], n[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            rows = [(WORDS, p, squeeze(s[a:z], 7), lot[a:z].astype("<u4").tobytes(), n[a:z].astype("<u4").tobytes()) for p, (a, z) in enumerate(zip(cut, cut[1:])) if a < z]
            k = np.array(keys, np.int64).view(U)
            own = (k % U(parts)).astype(np.int64)
            number = np.array([0 if i is None else i for i in ids], np.int64)
            size = np.bincount(t.row, minlength=len(texts)) << 1 | np.array([i is None for i in ids], np.int64)  # and whether the id is null
            rows += [(TEXTS, p, k[m].tobytes(), number[m].tobytes(), size[m].tobytes()) for p in np.unique(own).tolist() for m in [own == p]]
            yield _batch(ASKED, rows)

    return run


COUNTED = "kind int, lot bigint, a binary, b binary, c binary, total bigint, words bigint"


def _counted(crowded: int):
    """Counts of one part's words, by the lots that asked, and the crowded ones; texts pass through."""

    def run(key, rows):
        return _counts(key, rows, crowded)

    return run


def _counts(key, rows, crowded: int):
    kind, part = key[0].as_py(), key[1].as_py()
    a, b, c = (rows[x].to_pylist() for x in "abc")
    if kind == TEXTS:
        return pa.Table.from_batches([_batch(COUNTED, [(TEXTS, part, b"".join(a), b"".join(b), b"".join(c), 0, 0)])])
    s, lot, n = widen(b"".join(a), 7), np.frombuffer(b"".join(b), "<u4"), np.frombuffer(b"".join(c), "<u4").astype(np.int64)
    order = ranked(s, 56)
    s, lot, n = s[order], lot[order], n[order]
    at, size = _runs(s)
    count = np.add.reduceat(n, at)
    of = np.repeat(np.arange(len(at)), size)
    pair = distinct(lot.astype(U) << U(40) | of.astype(U))  # a part has fewer than 2 ** 40 words
    lot, of = (pair >> U(40)).astype(np.int64), (pair & U((1 << 40) - 1)).astype(np.int64)
    first, size = _runs(lot)
    out = [(WORDS, int(lot[i]), squeeze(s[at[of[i : i + k]]], 7), squeeze(count[of[i : i + k]], 5), b"", 0, 0) for i, k in zip(first, size)]
    many = count >= crowded
    out.append((WORDS, -1, squeeze(s[at[many]], 7), squeeze(count[many], 5), b"", int(count.sum()), int((count > 0).sum())))
    return pa.Table.from_batches([_batch(COUNTED, out)])


# --- tokens by context -----------------------------------------------------------------------------------

SENT = "lot bigint, kind int, keys binary, sizes binary, symbols binary, contexts binary, levels binary, texts binary, learn binary, rows binary"
TOKENS, TABLE, PAIRS = 0, 1, 2


class Crowded:
    """Words that stand before very many tokens: keys of their contexts, in order, and the lots (after all others) of each."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, lots: int, most: int):
        key = mix((symbols + U(1)) * powers(5)[1]) >> U(16)
        order = np.argsort(key)
        self.key, self.lots = key[order], lots
        size = -(-counts[order].astype(np.int64) // max(1, most // 2))
        self.first = lots + np.concatenate([[0], np.cumsum(size)]).astype(np.int64)

    def number(self, key: np.ndarray) -> np.ndarray:
        """The place of each context of one word among the crowded ones, or -1."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[i] == key, i, -1)

    def lot(self, number: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The lot of the last two words."""
        size = (self.first[number + 1] - self.first[number]).astype(U)
        return self.first[number] + ((two * size) >> U(48)).astype(np.int64)


def _followers(crowded: Crowded, lots: int, most: int):
    """The distinct (crowded word, symbol) of each chunk with their training counts, to the word's lot."""

    def run(batches):
        for texts, _, _, learn in _chunks(batches, most):
            t = Tokens(texts)
            key = t.contexts(1)
            at = np.flatnonzero(crowded.number(key) >= 0)
            key, symbol, train = key[at], t.symbol[at], np.array(learn, np.int64)[t.row[at]]
            order = np.lexsort((symbol, key))
            key, symbol, train = key[order], symbol[order], train[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (symbol[1:] != symbol[:-1])])) if len(key) else at
            count = np.add.reduceat(train, new) if len(new) else new
            key, symbol = key[new], symbol[new]
            for a, n in zip(*_runs(key)):
                lot = int(lot_of(key[a : a + 1], lots)[0])
                yield _batch(SENT, [(lot, PAIRS, squeeze(key[a : a + 1], 6), count[a : a + n].astype("<u4").tobytes(), squeeze(symbol[a : a + n], 7), *[b""] * 5)])

    return run


def _first_words(crowded: Crowded, total: int, words: int, cfg: Settings):
    """Contexts of one crowded word, tested on counts: for each lot of the word, what each symbol after it has (log p of
    the root, its change, whether it was seen twice) and whether longer contexts are open."""
    norm = np.log(total + 0.1 * (words + 1))

    def run(_, rows):
        kind, table = rows["kind"].to_pylist(), {c: rows[c] for c in ("keys", "sizes", "symbols", "contexts")}
        read = lambda c, which: [table[c][i].as_py() for i, k in enumerate(kind) if k == which]
        names, count = widen(b"".join(read("symbols", TABLE)), 7), widen(b"".join(read("contexts", TABLE)), 5).astype(np.float64)
        order = np.argsort(names)
        names, count = names[order], count[order]
        out = []
        for word in sorted({*read("keys", PAIRS)}):
            at = [i for i, k in enumerate(kind) if k == PAIRS and table["keys"][i].as_py() == word]
            symbol = widen(b"".join(table["symbols"][i].as_py() for i in at), 7)
            seen = np.frombuffer(b"".join(table["sizes"][i].as_py() for i in at), "<u4").astype(np.int64)
            symbol, of = np.unique(symbol, return_inverse=True)
            seen = np.bincount(of, seen, len(symbol)).astype(np.int64)
            base = np.log(count[np.searchsorted(names, symbol)] + 0.1) - norm
            key = np.full(len(symbol), widen(word, 6)[0], U)
            gained = np.zeros(len(symbol))

            def add(at, change, entry, _):
                gained[at] = change[entry]

            going, _, _ = climb(np.arange(len(symbol), dtype=np.int32), 1, lambda _, at: key[at], lambda at: symbol[at], lambda at: seen[at], np.full(len(symbol), 2, np.uint8), lambda at: (base[at], np.ones(len(at), bool)), add, cfg)
            told = ((seen >= 2).astype(np.uint8) | np.uint8(2 * (len(going) > 0))).tobytes()
            i = int(crowded.number(key[:1])[0])
            out += [(lot, TABLE, word, b"", squeeze(symbol, 7), gained.tobytes(), told, base.tobytes(), b"", b"") for lot in range(crowded.first[i], crowded.first[i + 1])]
        return pa.Table.from_batches([_batch(SENT, [x]) for x in out] or [_batch(SENT, [])])

    return run


def _sent(number: int, lots: int, span: tuple[int, int], most: int, opened=None, crowded: Crowded | None = None):
    """Tokens of a round by lot: of all contexts' last words, or of the contexts that are open; in the first round those
    of crowded words are left to the lots after ``lots``."""
    before, steps = lengths_of(number)
    edges = edges_of(lots)
    apart = crowded is not None and span[0] >= lots
    if apart:
        before, steps = steps[0], steps[1:]

    def run(batches):
        bits = opened.value if opened is not None else None
        for texts, keys, _, learn in _chunks(batches, most):
            t = Tokens(texts)
            if bits is None:
                at = None
                key = t.contexts(1)
            else:
                at = np.flatnonzero(t.off > before)
                key = t.contexts(before, at)
                hit = bloom_has(bits, key)
                at, key = at[hit], key[hit]
            if apart:
                word = crowded.number(key)
                own = np.flatnonzero(word >= 0)
                lot = crowded.lot(word[own], t.contexts(2, own))
                order = np.lexsort((key[own], lot))
                own, lot = own[order], lot[order]
                cut = np.searchsorted(lot, np.arange(span[0], span[1] + 1))
            else:
                own = (key >= edges[span[0]]) & (key < edges[span[1]])
                if crowded is not None:
                    own &= crowded.number(key) < 0
                own = np.flatnonzero(own)
                own = own[ranked(key[own], 48)]
                cut = np.searchsorted(key[own], edges[span[0] : span[1] + 1])
            key, at = key[own], own if at is None else at[own]
            off, row, symbol = t.off[at], t.row[at], t.symbol[at]
            # levels that the text has room for, and one more if it goes on
            levels = np.searchsorted(np.array([before, *steps]), off, side="left").astype(np.uint8)
            ctx = []
            for i, n in enumerate(steps):
                if n > 1 and len(have := np.flatnonzero(levels > i)):
                    ctx.append((t.contexts(n, at[have]), np.searchsorted(have, cut)))
            text, train = np.array(keys, np.int64), np.array(learn, np.uint8)
            for j, (a, z) in enumerate(zip(cut, cut[1:])):
                if a == z:
                    continue
                first, size = _runs(key[a:z])
                seen = np.zeros(len(texts), bool)
                seen[row[a:z]] = True
                docs, of = np.flatnonzero(seen), (np.cumsum(seen) - 1)[row[a:z]]
                found = b"".join(squeeze(c[of_lot[j] : of_lot[j + 1]], 6) for c, of_lot in ctx)
                rows = of.astype("<u2" if len(docs) <= 65536 else "<u4").tobytes()
                yield _batch(SENT, [(span[0] + j, TOKENS, squeeze(key[a:z][first], 6), size.astype("<u4").tobytes(), squeeze(symbol[a:z], 7), found, levels[a:z].tobytes(), text[docs].tobytes(), train[docs].tobytes(), rows)])

    return run


class Lot:
    """The tokens of a lot, read batch by batch; hashes and symbols stay in the bytes they came in, 6 for each length that a
    token has and 7 for its symbol."""

    def __init__(self, batches, steps: list[int], first: bool):
        self.table: list[dict] = []
        cols: dict = {c: [] for c in ("keys", "word", "symbols", "levels", "texts", "learn", "rows", *range(len(steps)))}
        words = docs = 0
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == TABLE:
                    self.table.append({c: r[c] for c in ("keys", "symbols", "contexts", "levels", "texts")})
                if r["kind"] != TOKENS:
                    continue
                levels, size = np.frombuffer(r["levels"], np.uint8), np.frombuffer(r["sizes"], "<u4")
                used = 0
                for k in range(int(first), len(steps)):
                    more = 6 * int((levels > k).sum())
                    cols[k].append(r["contexts"][used : used + more])
                    used += more
                more = len(r["texts"]) // 8
                cols["keys"].append(widen(r["keys"], 6))
                cols["word"].append(np.repeat(np.arange(words, words + len(size), dtype=np.int32), size))
                cols["rows"].append(np.frombuffer(r["rows"], "<u2" if more <= 65536 else "<u4").astype(np.int32) + np.int32(docs))
                for c in ("symbols", "levels", "texts", "learn"):
                    cols[c].append(r[c])
                words, docs = words + len(size), docs + more
        raw = lambda c, dtype: np.frombuffer(b"".join(cols.pop(c)), dtype)
        packed = lambda c, width: eights(b"".join([*cols.pop(c), b"\0" * 8]), width)
        whole = lambda c, dtype: np.concatenate([np.zeros(0, dtype), *cols.pop(c)])
        self.keys, self.word, self.row = whole("keys", U), whole("word", np.int32), whole("rows", np.int32)
        self.levels, self.text, self.learn = raw("levels", np.uint8), raw("texts", np.int64), raw("learn", np.uint8)
        self.symbols = packed("symbols", 7)
        self.raw = [None if first and not k else packed(k, 6) for k in range(len(steps))]
        self.place: tuple[int, np.ndarray] | None = None

    def key(self, at: np.ndarray) -> np.ndarray:
        return self.keys[self.word[at]]

    def symbol(self, at: np.ndarray) -> np.ndarray:
        return _wide(self.symbols, at)

    def learnt(self, at: np.ndarray) -> np.ndarray:
        return self.learn[self.row[at]]

    def context(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the k-th length, which the tokens ``at`` must have."""
        raw = self.raw[k]
        if raw is None:
            return self.key(at)
        if len(raw) == len(self.levels):
            return _wide(raw, at)
        if self.place is None or self.place[0] != k:
            self.place = k, np.cumsum(self.levels > k, dtype=np.int32) - np.int32(1)
        return _wide(raw, self.place[1][at])


#: Tokens of a lot that a step takes whose work arrays are several times as large.
STEP = 1 << 18
#: Tokens of a piece of a lot, on average, that are counted at once. A context's tokens are in one piece.
PIECE = 1 << 19


def _entry(ctx: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix(ctx * BASE + symbol)


def _by_step(n: int, of) -> np.ndarray:
    """``of`` (a slice to numbers) for all of n tokens."""
    out = np.empty(n, U)
    for i in range(0, n, STEP):
        out[i : i + STEP] = of(slice(i, i + STEP))
    return out


def _by_text(row: np.ndarray, values: np.ndarray, entry: np.ndarray | None, k: int) -> np.ndarray:
    """Sums of the tokens' values (of their entries' values) by text."""
    out = np.zeros(k)
    for i in range(0, len(row), STEP):
        out += np.bincount(row[i : i + STEP], values[i : i + STEP] if entry is None else values[entry[i : i + STEP]], k)
    return out


def _pieces(context, act: np.ndarray):
    """Places in ``act``, by a hash of the context: of about PIECE tokens, or those of one more frequent context."""
    n = min(255, -(-len(act) // PIECE))
    if n == 1:
        yield np.arange(len(act), dtype=np.int32)
        return
    part = np.empty(len(act), np.uint8)
    for i in range(0, len(act), STEP):
        part[i : i + STEP] = mix(context(act[i : i + STEP])) % U(n)
    for p in range(n):
        at = np.flatnonzero(part == p).astype(np.int32)
        if len(at):
            yield at


def climb(act: np.ndarray, steps: int, context, symbol, learnt, levels: np.ndarray, look, add, cfg: Settings):
    """One round over the tokens ``act``; (context, symbol, log p) of what stays open.

    context (of a length and tokens), symbol, learnt: what the tokens have; levels: how many lengths. look: log p after the
    contexts so far, and whether it is known, of some tokens. It is for symbols that were seen twice there, and no others
    can be seen twice after a longer context. add gets tokens, the change of log p of each entry (context, symbol), each
    token's entry, and in the first step each entry's log p before it."""
    lp, known, opened = None, None, []
    for k in range(steps):
        after: list[list[np.ndarray]] = [[], [], []]
        for place in _pieces(lambda at: context(k, at), act):
            at = act[place]
            order = ranked(key := _by_step(len(at), lambda s: _entry(context(k, at[s]), symbol(at[s])))).astype(np.int32)
            fresh = np.ones(len(at), bool)
            for i in range(1, len(at), STEP):  # no sorted copy of all keys
                own = order[i - 1 : i + STEP]
                fresh[i : i + STEP] = key[own[1:]] != key[own[:-1]]
            del key
            entry = np.empty(len(at), np.int32)  # of each token
            entry[order] = np.cumsum(fresh, dtype=np.int32) - 1
            new = np.flatnonzero(fresh)
            m, first = np.add.reduceat(learnt(at)[order], new, dtype=np.int64), order[new]
            del order, fresh, new
            below, sure = look(at[first]) if lp is None else (lp[place[first]], known[place[first]])
            first = at[first]
            own = context(k, first)
            order = ranked(own, 48)
            start, size = _runs(own[order])
            of = np.empty(len(own), np.int32)  # the context of each entry
            of[order] = np.repeat(np.arange(len(start), dtype=np.int32), size)
            n = np.add.reduceat(m[order], start).astype(float)
            e = np.flatnonzero((m >= 2) & sure)
            o, me, be = of[e], m[e].astype(float), below[e]
            total = lambda x: np.bincount(o, x, len(n))
            kinds, seen, mass = total(np.ones(len(e))), total(me), np.minimum(total(np.exp(be)), 1 - 1e-9)
            alone = n - seen
            with np.errstate(divide="ignore", invalid="ignore"):
                left = (cfg.discount * kinds + alone) / n
                rest = np.log(left) - np.log1p(-mass)
                gain = total(me * (np.log(me - cfg.discount) - be)) - seen * np.log(n) + np.where(alone > 0, alone * rest, 0.0)
            state = (kinds > 0) & (gain >= cfg.gain)
            change = np.where(state, rest, 0.0)[of]
            ins = e[state[o]]
            change[ins] = np.log(m[ins] - cfg.discount) - np.log(n[of[ins]]) - below[ins]
            add(at, change, entry, None if k else below)
            new = below + change
            others = np.bincount(of, minlength=len(n)) - 1  # symbols but one
            go = (kinds > 0) & (total(me * -new[e]) - others * np.log1p(-np.minimum(total(np.exp(new[e])), 1 - 1e-9)) >= cfg.gain)
            more = np.flatnonzero(go[of][entry] & (levels[at] > k + 1))
            going = entry[more]
            if k == steps - 1:
                some = np.zeros(len(n), bool)
                some[of[going]] = True
                f = e[some[o]]
                opened.append((own[f], symbol(first[f]), new[f]))
            else:
                # symbols seen once have no known probability later on, and need none
                told = np.zeros(len(m), bool)
                told[e] = True
                for col, x in zip(after, (at[more], new[going], told[going])):
                    col.append(x)
        if k == steps - 1 or not any(map(len, after[0])):
            break
        del lp, known
        act, lp, known = (np.concatenate(after.pop(0)) for _ in range(3))
    return tuple(np.concatenate([np.zeros(0, d), *(x[i] for x in opened)]) for i, d in enumerate((U, U, float)))


OUT = "kind int, lot bigint, a binary, b binary, c binary, d binary"
SUMS, OPEN = 0, 1


def _scored(number: int, lots: int, total: int, words: int, cfg: Settings, apart: bool = False):
    """apart: tokens of crowded words, whose contexts of one word are tested already."""
    _, steps = lengths_of(number)
    if apart:
        steps = steps[1:]
    norm = np.log(total + 0.1 * (words + 1))

    def run(key, batches):
        lot = Lot(batches, steps, number == 0 and not apart)
        table, every = lot.table, np.arange(len(lot.levels), dtype=np.int32)
        if not len(every) or not table:
            yield _batch(OUT, [])
            return
        names = widen(b"".join(r["symbols"] for r in table), 7)
        k = len(lot.text)
        hits, base, score = np.zeros(k), np.zeros(k), np.zeros(k)
        if apart:
            # the table has every symbol that stands after the lot's words
            keys = np.concatenate([np.full(len(r["symbols"]) // 7, widen(r["keys"], 6)[0], U) for r in table])
            order = ranked(names := _entry(keys, names))
            names = names[order]
            of = order.astype(np.int32)[_by_step(len(every), lambda s: np.searchsorted(names, _entry(lot.key(every[s]), lot.symbol(every[s])))).view(np.int64)]
            root, change = (np.frombuffer(b"".join(r[c] for r in table), np.float64) for c in ("texts", "contexts"))
            told = np.frombuffer(b"".join(r["levels"] for r in table), np.uint8)
            hits, base = _by_text(lot.row, root > np.log(0.15) - norm, of, k), _by_text(lot.row, root, of, k)
            score = base + _by_text(lot.row, change, of, k)
            every = every[(told & 2 > 0)[of] & (lot.levels > 0)]

            def look(at):
                return (root + change)[of[at]], (told & 1 > 0)[of[at]]

        elif number == 0:
            count = widen(b"".join(r["contexts"] for r in table), 5).astype(np.float64)
            order = ranked(names)
            names, count = names[order], count[order]

            def look(at):
                return np.log(count[np.searchsorted(names, lot.symbol(at))] + 0.1) - norm, np.ones(len(at), bool)

        else:
            keys = widen(b"".join(r["keys"] for r in table), 6)
            every = every[np.isin(lot.keys, keys)[lot.word]]  # the filter lets others through as well
            names, value = _entry(keys, names), np.frombuffer(b"".join(r["contexts"] for r in table), np.float64)
            order = ranked(names)
            names, value = names[order], value[order]

            def look(at):
                want = _entry(lot.key(at), lot.symbol(at))
                i = np.minimum(np.searchsorted(names, want), len(names) - 1)
                hit = names[i] == want
                return np.where(hit, value[i], 0.0), hit

        del table
        lot.table = []

        def add(at, change, entry, below):
            nonlocal hits, base, score
            row = lot.row[at]
            if below is not None and number == 0 and not apart:
                hits, base = hits + _by_text(row, below > np.log(0.15) - norm, entry, k), base + _by_text(row, below, entry, k)
                change = change + below
            score = score + _by_text(row, change, entry, k)

        ctx, symbol, p = climb(every, len(steps), lot.context, lot.symbol, lot.learnt, lot.levels, look, add, cfg)
        used = np.flatnonzero((score != 0) | (base != 0))
        out = [(SUMS, 0, lot.text[used].tobytes(), hits[used].astype("<u4").tobytes(), base[used].tobytes(), score[used].tobytes())]
        if len(ctx):
            order = ranked(ctx, 48)
            ctx, symbol, p = ctx[order], symbol[order], p[order]
            cut = np.searchsorted(ctx, edges_of(lots))
            out += [(OPEN, i, squeeze(ctx[a:z], 6), squeeze(symbol[a:z], 7), p[a:z].tobytes(), b"") for i, (a, z) in enumerate(zip(cut, cut[1:])) if a < z]
        yield _batch(OUT, out)

    return run


def _open_keys(batches):
    for b in batches:
        for raw in b.column("a").to_pylist():
            yield widen(raw, 6)


def _combined(parts: int):
    """The sums of a task's rows, by the texts' parts: most texts have tokens in several lots."""

    def run(batches):
        cols: list[list] = [[], [], [], []]
        for b in batches:
            for col, name in zip(cols, "abcd"):
                col += b.column(name).to_pylist()
        keys, hits, base, score = (np.frombuffer(b"".join(x), d) for x, d in zip(cols, (U, "<u4", "<f8", "<f8")))
        order = ranked(keys)
        first, size = _runs(keys[order])
        every, of = keys[order[first]], np.empty(len(keys), np.int64)
        of[order] = np.repeat(np.arange(len(first)), size)
        hits, base, score = (np.bincount(of, x.astype(float), len(every)) for x in (hits, base, score))
        part = (every % U(parts)).astype(np.int64)
        order = ranked(part, 32)
        first, size = _runs(part[order])
        for at in (order[i : i + k] for i, k in zip(first, size)):
            yield _batch(OUT, [(SUMS, int(part[at[0]]), every[at].tobytes(), hits[at].astype("<u4").tobytes(), base[at].tobytes(), score[at].tobytes())])

    return run


SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _summed(key, rows):
    """The rows of one part: sums of each text's key, for every text that has it."""
    kind = rows["kind"].to_pylist()
    cols = {c: rows[c].to_pylist() for c in "abcd"}

    def joined(col, which, dtype):
        return np.frombuffer(b"".join(x for x, k in zip(cols[col], kind) if k == which), dtype)

    names, number, size = joined("a", TEXTS + 2, U), joined("b", TEXTS + 2, np.int64), joined("c", TEXTS + 2, np.int64)
    every, at, again = np.unique(names, return_inverse=True, return_counts=True)
    of = np.searchsorted(every, joined("a", SUMS, U))
    hits, base, score = ((np.bincount(of, joined(c, SUMS, d).astype(float), len(every)) / again)[at] for c, d in (("b", "<u4"), ("c", "<f8"), ("d", "<f8")))
    ids = pa.array(number, pa.int64(), mask=(size & 1) > 0)
    return pa.Table.from_arrays([ids, pa.array(size >> 1), pa.array(np.rint(hits).astype(np.int64)), pa.array(base / np.log(10)), pa.array(score / np.log(10))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def _turn(src: DataFrame, table: DataFrame, sent, scored) -> DataFrame:
    both = src.mapInArrow(lean(sent), SENT).unionByName(table)
    return materialise(both.groupBy("lot").applyInArrow(lean_stream(scored), OUT), "lm-sums")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", cfg: Settings = Settings()) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every text; learnt where ``learn`` holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ident = F.col(id_col).cast("bigint")
    read = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0)).alias("n")).first()["n"]
    parts = max(shuffle_parts(spark), -(-read // cfg.part_bytes))
    lots = parts * cfg.turns
    src = docs.select(utf8(F.col(text_col)).alias("text"), F.xxhash64(ident, F.col(text_col)).alias("key"), ident.alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"))
    asked = src.mapInArrow(lean(_asked(lots, parts, cfg.chunk)), ASKED)
    counted = materialise(asked.groupBy("kind", "lot").applyInArrow(lean_table(_counted(cfg.crowded)), COUNTED), "lm-words")
    del asked
    sweep(spark)
    size = counted.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("v")).first()
    texts = materialise(counted.where(f"kind = {TEXTS}").select(F.lit(TEXTS + 2).alias("kind"), "lot", "a", "b", "c", F.lit(b"").alias("d")), "lm-texts")
    none = [F.lit(b"").alias(c) for c in ("levels", "texts", "learn", "rows")]
    table = counted.where(f"kind = {WORDS} and lot >= 0").select("lot", F.lit(TABLE).alias("kind"), F.lit(b"").alias("keys"), F.lit(b"").alias("sizes"), F.col("a").alias("symbols"), F.col("b").alias("contexts"), *none)
    many = counted.where(f"kind = {WORDS} and lot < 0").select("a", "b").collect()  # fewer than there are tokens in units of ``crowded``
    crowded = Crowded(widen(b"".join(r["a"] for r in many), 7), widen(b"".join(r["b"] for r in many), 5), lots, cfg.crowded)
    outs, kept, number, opened = [], None, 0, None
    while True:
        turns, here = (cfg.turns, lots) if number == 0 else (1, parts)  # contexts that are open are fewer
        made = []
        for turn in range(turns):
            span = (turn * here // turns, (turn + 1) * here // turns)
            made.append(_turn(src, table.where((F.col("lot") >= span[0]) & (F.col("lot") < span[1])), _sent(number, here, span, cfg.chunk, opened, None if number else crowded), _scored(number, parts, size["n"], size["v"], cfg)))
            sweep(spark)
        if not number and len(crowded.key):
            own = table.where(F.col("lot").isin(sorted({*lot_of(crowded.key, lots).tolist()})))
            pairs = src.mapInArrow(lean(_followers(crowded, lots, cfg.chunk)), SENT).unionByName(own)
            first = materialise(pairs.groupBy("lot").applyInArrow(lean_table(_first_words(crowded, size["n"], size["v"], cfg)), SENT), "lm-followers")
            sweep(spark)
            made.append(_turn(src, first, _sent(0, lots, (lots, int(crowded.first[-1])), cfg.chunk, None, crowded), _scored(0, parts, size["n"], size["v"], cfg, True)))
            discard(first)
            sweep(spark)
        # a text has a row of sums in almost every lot: they meet, so that the next round doesn't find all of them on disk
        both = _union(made)
        outs.append(materialise(both.where(f"kind = {SUMS}").mapInArrow(lean(_combined(parts)), OUT), "lm-round"))
        before, kept = kept, materialise(both.where(f"kind = {OPEN}"), "lm-open")
        for m in (*([counted] if number == 0 else [before]), *made):
            discard(m)
        if not kept.take(1):
            break
        opened = spark.sparkContext.broadcast(bloom_of(kept.select("a"), _open_keys))
        table = kept.select("lot", F.lit(TABLE).alias("kind"), F.col("a").alias("keys"), F.lit(b"").alias("sizes"), F.col("b").alias("symbols"), F.col("c").alias("contexts"), *none)
        number += 1
    every = _union([texts, *outs])
    out = materialise(every.groupBy("lot").applyInArrow(lean_table(_summed), SCORES), "lm-scores")
    for m in (texts, kept, *outs):
        discard(m)
    return out.withColumn("train_tokens", F.lit(size["n"]).cast("bigint"))


def held_out_rows(doc_id: Column) -> Column:
    """Ids whose crc32 is divisible by 10."""
    return F.coalesce(crc_bucket(doc_id, 10) == 0, F.lit(False))
