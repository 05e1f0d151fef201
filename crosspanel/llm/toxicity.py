"""Toxicity: a sparse linear classifier that must not care which group a sentence names."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import stage
from .base import map_records, query, table

# labelled rows the classifier is fitted on, about; statistics that choose its features use all of them
MAX_FIT_ROWS = 20_000
# what a feature must have: so many texts, so large a share of them, a difference of its log odds between the labels, and
# one by so many standard errors. On large tables share and odds decide, so more rows don't bring in ever weaker words; a
# table has at most (features of a mean text) / MIN_SHARE features of that share
MIN_DOCUMENTS = 5
MIN_SHARE = 2e-4
MIN_ODDS = 0.5
MIN_Z = 5.0
L1, COUNTERFACTUAL = 1e-5, 1.0
# a row of the rarer label counts as many rows: the root of the labels' ratio
BALANCE = 0.5
STEPS = 400
HOLD_OUT = 5
# counts a task holds before it hands them on
LOCAL_COUNTS = 150_000
# labels that are broadcast at most (some 20 bytes each); more are joined by a shuffle
BROADCAST_LABELS = 2_000_000

# Words that name a group of people, by group; a counterfactual exchanges words of one line.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("men", "women"),
    ("man", "woman"),
    ("boys", "girls"),
    ("male", "female"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("young", "old", "elderly"),
    ("deaf", "blind", "disabled"),
    ("hommes", "femmes"),
    ("chrétiens", "musulmans", "juifs"),
    ("männer", "frauen"),
    ("christen", "muslime", "juden"),
    ("hombres", "mujeres"),
    ("cristianos", "musulmanes", "judíos"),
)

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(words: Iterable[str]) -> set[str]:
    """Each word as a whole (with a mark), and its first letters, which languages with many endings need."""
    out = set()
    for w in words:
        out.add(f"={w}")
        for n in PREFIXES:
            if len(w) > n:
                out.add(w[:n])
    return out


def swapped(words: set[str], groups: Sequence[Sequence[str]]) -> set[str] | None:
    """The same words with every identity term replaced by the next one of its group, or None without any."""
    ring = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    named = words & ring.keys()
    return (words - named) | {ring[w] for w in named} if named else None


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        total = self.bias + sum(self.weights[f] for f in features_of(words_of(text)) if f in self.weights)
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, total))))


class _Rows:
    """A sparse matrix with entries of +1 and -1."""

    def __init__(self, plus: list[np.ndarray], minus: list[np.ndarray], width: int) -> None:
        parts = [(r, c, v) for side, v in ((plus, 1.0), (minus, -1.0)) for r, c in enumerate(side)]
        self.n, self.width = len(plus), width
        self.row = np.concatenate([np.full(len(c), r, np.int32) for r, c, _ in parts] or [np.zeros(0, np.int32)])
        self.col = np.concatenate([c for _, c, _ in parts] or [np.zeros(0, np.int32)]).astype(np.int32)
        self.val = np.concatenate([np.full(len(c), v) for _, c, v in parts] or [np.zeros(0)])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.width)


def fit(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on: weighted log loss + COUNTERFACTUAL * mean squared score change of pairs + L1."""
    x = _Rows(rows, [], width)
    d = _Rows([p[0] for p in pairs], [p[1] for p in pairs], width) if pairs else None
    rate = min(max(labels.mean(), 1e-6), 1 - 1e-6)
    b = math.log(rate / (1 - rate))
    cost = np.where(labels > 0, ((1 - rate) / rate) ** BALANCE, 1.0)
    cost /= cost.sum()
    w = np.zeros(width)
    # the largest curvature, by power iteration over both terms
    v = np.ones(width + 1)
    bound = 1.0
    for _ in range(20):
        bound = np.linalg.norm(v)
        v /= bound
        z = x.times(v[:-1]) + v[-1]
        z = 0.25 * cost * z
        u = np.append(x.back(z), z.sum())
        if d is not None:
            u[:-1] += d.back(d.times(v[:-1])) * (2 * COUNTERFACTUAL / d.n)
        v = u
    step = 1.0 / max(np.linalg.norm(v) * 1.1, 1e-9)
    yw, yb, t = w, b, 1.0
    for _ in range(STEPS):
        r = (1.0 / (1.0 + np.exp(-np.clip(x.times(yw) + yb, -60, 60))) - labels) * cost
        g = x.back(r)
        if d is not None:
            g += d.back(d.times(yw)) * (2 * COUNTERFACTUAL / d.n)
        nw = yw - step * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * L1, 0.0)
        nb = yb - step * r.sum()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        yw, yb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def _labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text, label of the documents in `known` (doc_id and more)."""
    small = known.count() <= BROADCAST_LABELS
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known) if small else known, "doc_id")


def train(docs: DataFrame, labels: DataFrame, identity_terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Model:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, label 0/1; other rows are left out, a null text is empty).

    A document with several labels takes the larger. Shares of each feature
    among both labels come from all rows, each distinct (text, label) once, so
    copies don't lend their words weight. The fit takes the rows with the
    smallest hashes, about MAX_FIT_ROWS. Texts that name a group are paired with
    a copy that names another one, and the fit pays for any change of score
    between them. Without rows of both labels the score is 0 or 1, that of the
    only label, and 0 without any.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    hashed = _labelled(docs, stage(known)).select("doc_id", "label", F.xxhash64("text", "label").alias("_h"))
    kept = stage(hashed.groupBy("_h", "label").agg(F.min("doc_id").alias("doc_id")))
    rows = _labelled(docs, kept)

    def count(part):
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def drain():
            for f in held[0].keys() | held[1].keys():
                yield f, held[1][f], held[0][f]
            held[0].clear()
            held[1].clear()

        for text, label in part:
            held[label].update(features_of(words_of(text)))
            held[label][""] += 1
            if len(held[0]) + len(held[1]) > LOCAL_COUNTS:
                yield from drain()
        yield from drain()

    counts = map_records(rows.select("text", "label"), count, "feature string, ones bigint, zeros bigint")
    counts = counts.groupBy("feature").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b")).where((F.col("feature") == "") | (F.col("a") + F.col("b") >= MIN_DOCUMENTS))
    counts = counts.persist()
    try:
        totals = counts.where(F.col("feature") == "").collect()
        ones, zeros = (totals[0]["a"], totals[0]["b"]) if totals else (0, 0)
        if not ones or not zeros:
            return Model(math.log(1e-9) if not ones else 20.0)
        share = (F.col("a") + F.col("b")) / (ones + zeros)
        z = (F.col("a") / ones - F.col("b") / zeros) / F.sqrt(share * (1 - share) * (1 / ones + 1 / zeros))
        odds = F.log((F.col("a") + 0.5) / (ones - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (zeros - F.col("b") + 0.5))
        telling = counts.where((F.col("feature") != "") & (share < 1) & (share >= MIN_SHARE) & (F.abs(odds) >= MIN_ODDS) & (F.abs(z) >= MIN_Z))
        chosen = sorted(r["feature"] for r in telling.select("feature").collect())
    finally:
        counts.unpersist()
    index = {f: i for i, f in enumerate(chosen)}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def encode(part):
        index = shared.value
        ids = lambda words: np.array(sorted(index[f] for f in features_of(words) if f in index), np.int32)
        for text, label in part:
            words = words_of(text)
            other = swapped(words, identity_terms)
            yield label, ids(words).tobytes(), ids(other).tobytes() if other is not None else None

    share = min(1.0, MAX_FIT_ROWS / (ones + zeros))
    low = rows.where(F.col("_h") < int(-(1 << 63) + share * ((1 << 64) - 2048)))
    sample = map_records(low.select("text", "label"), encode, "label int, ids binary, other binary").collect()
    ids = [np.frombuffer(r["ids"], np.int32) for r in sample]
    pairs = [(x, np.frombuffer(r["other"], np.int32)) for x, r in zip(ids, sample) if r["other"] is not None]
    bias, w = fit(ids, np.array([r["label"] for r in sample], float), pairs, len(chosen))
    return Model(float(bias), {f: float(w[i]) for f, i in index.items() if w[i]})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and score (0 to 1) of every row's whole text. A null or empty text has the score of no words."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows):
        model = kept.value
        for key, text in rows:
            yield key, model.score(text)

    return map_records(docs.select(id_col, text_col), run, StructType([docs.schema[id_col], StructField("score", DoubleType())]))


def held_out(doc_id):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % HOLD_OUT == 0


def open_labels(labels: DataFrame) -> DataFrame:
    """doc_id, label of the rows to learn from."""
    return labels.where(~held_out("doc_id")).select("doc_id", F.col("toxic").alias("label"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, open_labels(table(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
