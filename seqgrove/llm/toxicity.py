"""Counterfactual-regularised toxicity classifier.

Logistic regression on the presence of words and word beginnings, with features scaled by their
log-odds. It is fitted on a bounded sample of labelled rows (``Settings.sample_rows``, chosen by a hash of
the id), whose texts are gathered in one scan. Features are those of the sample whose shares in both classes differ
significantly: by ``Settings.significance`` standard errors. For each labelled text that names a group, its identity
terms are swapped for every other of the same kind, and
the squared change of the score is added to the loss, so neutral mentions of a group don't move the score.
Scoring is one pass without a shuffle over whole texts.

Defined cases: null or empty text has the score of the intercept; null labels and labels of unknown ids
are ignored; of several labels of one id the largest counts; without labelled rows of both classes all
scores are the smoothed share of the positive class; rows with one id share its label and are scored each; equal gains of
features make no difference, as all significant ones are kept; texts of any length are scored whole; an empty table gives no rows;
labels, lang, source, ids and further columns are not features, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_batches, discard, give_back, lean, materialise, utf8

#: Neutral names of groups, by kind: only words of one kind are swapped. Fixed values.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual", "queer"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("female", "male", "feminine", "masculine"),
    ("immigrant", "citizen", "refugee", "foreigner", "native"),
    ("immigrants", "citizens", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos"),
)


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000
    significance: float = 3.0
    support: int = 3
    swap_weight: float = 1.0
    ridge: float = 2e-3
    steps: int = 250
    threshold: float = 0.3


_SWAP: dict[bytes, list[bytes]] = {}
for _kind in IDENTITY_TERMS:
    _terms = [t.encode() for t in _kind]
    for _i, _t in enumerate(_terms):
        _SWAP.setdefault(_t, _terms[_i + 1 :] + _terms[:_i])

#: ASCII capitals to small letters, ASCII punctuation and controls to spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256))


def words(text: bytes) -> set[bytes]:
    return set(text.translate(_FOLD).split())


def features(ws: set[bytes]) -> set[bytes]:
    """Words, and their first 4, 5 and 6 bytes where they are longer. Group names give the word only."""
    out = set(ws)
    for n in (4, 5, 6):
        out.update(b"^" + w[:n] for w in ws if len(w) > n and w not in _SWAP)
    return out


def swapped(ws: set[bytes]) -> list[set[bytes]]:
    """The word sets of the text with its group names swapped, so that each has been every other name of its kind."""
    named = [w for w in ws if w in _SWAP]
    most = max((len(_SWAP[w]) for w in named), default=0)
    return [{_SWAP[w][k % len(_SWAP[w])] if w in _SWAP else w for w in ws} for k in range(most)]


def _count(batches):
    n: dict[bytes, list[int]] = {}
    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            for f in features(words(text)):
                n.setdefault(f, [0, 0])[y] += 1
        if len(n) > 500_000:
            yield _counted(n)
            n = {}
    yield _counted(n)


def _counted(n: dict) -> pa.RecordBatch:
    c = np.array(list(n.values()), dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_pydict({"f": pa.array(list(n), pa.binary()), "neg": pa.array(c[:, 0]), "pos": pa.array(c[:, 1])})


def _indexed(index):
    """Feature numbers of a text and of its swapped forms."""

    def run(batches):
        at = index.value
        number = lambda ws: sorted(at[f] for f in features(ws) if f in at)
        for b in batches:
            ys, own, other = [], [], []
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                ws = words(text)
                ys.append(y)
                own.append(number(ws))
                other.append([number(x) for x in swapped(ws)])
            yield pa.RecordBatch.from_pydict({"toxic": pa.array(ys, pa.int32()), "own": pa.array(own, pa.list_(pa.int32())), "other": pa.array(other, pa.list_(pa.list_(pa.int32())))})

    return run


def _sparse(rows: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All items of lists, and the number of the list of each."""
    return pc.list_flatten(rows).to_numpy(), np.repeat(np.arange(len(rows), dtype=np.int32), pc.list_value_length(rows).to_numpy())


class Objective:
    """Logistic loss plus the squared changes under swaps, a mean over the sample, and a ridge on scaled weights."""

    def __init__(self, y: np.ndarray, own: list[list[int]] | pa.ChunkedArray, other: list[list[list[int]]] | pa.ChunkedArray, scale: np.ndarray, cfg: Settings):
        self.y, self.scale, self.cfg, self.m, self.k = y, scale, cfg, len(y), len(scale)
        ints = pa.list_(pa.int32())
        own, other = (x if isinstance(x, pa.ChunkedArray) else pa.chunked_array([x], t) for x, t in ((own, ints), (other, pa.list_(ints))))
        self.col, self.row = _sparse(own)
        swapped_rows = pc.list_flatten(other)
        self.pcol, self.prow = _sparse(swapped_rows)
        self.of = np.repeat(np.arange(len(other)), pc.list_value_length(other).to_numpy())

    def scores(self, v: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        w = v * self.scale
        return np.bincount(self.row, w[self.col], self.m) + b, np.bincount(self.prow, w[self.pcol], len(self.of)) + b

    def loss(self, v: np.ndarray, b: float) -> float:
        z, zs = self.scores(v, b)
        change = z[self.of] - zs
        return float((np.logaddexp(0, z) - self.y * z).sum() / self.m + self.cfg.swap_weight * (change @ change) / self.m + self.cfg.ridge * (v @ v) / 2)

    def gradient(self, v: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z, zs = self.scores(v, b)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.y) / self.m
        change = 2 * self.cfg.swap_weight * (z[self.of] - zs) / self.m
        g = np.bincount(self.col, (err + np.bincount(self.of, change, self.m))[self.row], self.k) - np.bincount(self.pcol, change[self.prow], self.k)
        return g * self.scale + self.cfg.ridge * v, float(err.sum())


def fit_weights(y: np.ndarray, own, other, scale: np.ndarray, cfg: Settings) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the whole sample; deterministic."""
    objective, m, k = Objective(y, own, other, scale, cfg), len(y), len(scale)
    v, b = np.ones(k) * 0.5, float(np.log((y.sum() + 0.5) / (m - y.sum() + 0.5))) - 1.0
    mv, sv, mb, sb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, cfg.steps + 1):
        g, gb = objective.gradient(v, b)
        mv, sv = 0.9 * mv + 0.1 * g, 0.999 * sv + 0.001 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        rate = 0.05 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        v -= rate * mv / (np.sqrt(sv) + 1e-9)
        b -= rate * mb / (np.sqrt(sb) + 1e-9)
    return v * scale, float(b)


@dataclass
class Model:
    weights: dict[bytes, float]
    intercept: float
    threshold: float

    def score(self, text: bytes) -> float:
        w = self.weights
        z = self.intercept + sum(w[f] for f in features(words(text)) if f in w)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, cfg: Settings = Settings()) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic. held_out: condition on doc_id of rows not to learn from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    if held_out is not None:
        y = y.where(~held_out)
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.sample_rows)  # at most sample_rows rows of two numbers
    rows = docs.select("doc_id", utf8(F.col("text")).alias("text")).join(F.broadcast(y), "doc_id").select("text", "toxic")
    rows = materialise(rows, "toxicity-sample")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    neg, pos = n.get(0, 0), n.get(1, 0)
    prior = float(np.log((pos + 0.5) / (neg + 0.5)))
    if not neg or not pos:
        return Model({}, prior, cfg.threshold)
    counts = rows.mapInArrow(lean(_count), "f binary, neg bigint, pos bigint").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    p, q = (F.col("pos") + 0.1) / (pos + 0.2), (F.col("neg") + 0.1) / (neg + 0.2)
    share = (F.col("pos") + F.col("neg")) / (pos + neg)
    error = F.sqrt(share * (1 - share) * (1 / pos + 1 / neg)) + 1e-12
    counts = counts.where(F.col("pos") + F.col("neg") >= cfg.support).withColumn("lift", F.log(p / q))
    chosen = counts.where(F.abs(F.col("pos") / pos - F.col("neg") / neg) >= cfg.significance * error).collect()  # of the bounded sample
    named = counts.where(F.col("f").isin([bytearray(x) for x in _SWAP])).collect()  # the list of terms at most
    lift = {bytes(r["f"]): r["lift"] for r in chosen + named}
    at = {f: i for i, f in enumerate(sorted(lift))}
    index = spark.sparkContext.broadcast(at)
    coded = rows.mapInArrow(lean(_indexed(index)), "toxic int, own array<int>, other array<array<int>>").toArrow()  # the sample, as feature numbers
    scale = np.array([lift[f] for f in at])
    w, b = fit_weights(coded["toxic"].to_numpy().astype(float), coded["own"], coded["other"], scale, cfg)
    del coded
    discard(rows)
    give_back()
    return Model({f: float(w[i]) for f, i in at.items()}, b, cfg.threshold)


def _scored(model):
    def run(batches):
        m: Model = model.value
        for b in batches:
            s = [m.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s, pa.float64())], names=["row", "score"])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """row (a struct of the ``keep`` columns, whatever their names) and score (0 to 1) of every whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.struct(*keep).alias("row"), utf8(F.col(text_col)).alias("text"))
    schema = StructType([rows.schema["row"], StructField("score", DoubleType())])
    return rows.mapInArrow(lean(_scored(spark.sparkContext.broadcast(model))), schema)


def held_out_rows(doc_id: Column) -> Column:
    """Ids whose crc32 leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, held_out_rows(F.col("doc_id")), cfg)
    s = score(docs, model)
    s = s.select("row.doc_id", "score")
    return s.select("doc_id", held_out_rows(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= model.threshold).cast("int").alias("predicted"))
