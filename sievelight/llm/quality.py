"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that the classifier sees. The class prior comes from first
classifiers that tell the two apart, read on documents that they have not seen: the least ratio of the unlabelled to
the positive share above a score. The classifier itself minimises the non-negative unbiased risk
``prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0))``.
Its inputs are shares of character classes and pairs of them, and counts of repeated words and lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.llm import common

#: Classes of bytes: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 line break, 5 other control, 6 beyond ASCII; every
#: other ASCII character has its own.
_CLASS = np.zeros(256, "u1")
_OTHER = [c for c in range(33, 127) if not chr(c).isalnum()]
for _c in range(256):
    _CLASS[_c] = 6 if _c >= 128 else 0 if 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c in (32, 9) else 4 if _c in (10, 13) else 5
for _i, _c in enumerate(_OTHER):
    _CLASS[_c] = 7 + _i
N_CLASSES = 7 + len(_OTHER)
#: Pairs are taken of coarser classes: all marks but the commonest of prose are one.
_COARSE = np.array([min(k, 7) for k in range(N_CLASSES)], "u1")
for _i, _c in enumerate(b".,!?-'|"):
    _COARSE[7 + _OTHER.index(_c)] = 8 + _i
N_COARSE = 15
N_FEATURES = N_CLASSES + N_COARSE**2 + 8


@dataclass(frozen=True)
class Settings:
    """``positives`` and ``unlabelled``: the documents of each kind that the fit may use, by a hash of doc_id; their
    features, ``N_FEATURES`` numbers each, are all that the driver gets. ``errors``: standard errors that the class
    prior is lowered by: too low a prior costs little, too high a prior lets everything pass."""

    positives: int = 6000
    unlabelled: int = 9000
    hidden: int = 16
    steps: int = 500
    batch: int = 512
    rate: float = 0.01
    #: Added to a feature's spread: smaller differences say little. Most features are shares of a text's characters.
    small: float = 0.001
    #: Weight decay, over the number of texts of the fit: the fewer they are, the smoother the network.
    decay: float = 3.0
    #: Splits into halves on which the first classifiers are fitted and read.
    repeats: int = 6
    errors: float = 0.75
    seed: int = 11


def features(text: bytes | None) -> np.ndarray:
    """``N_FEATURES`` numbers for one whole text; null counts as empty."""
    out = np.zeros(N_FEATURES, "f4")
    text = text or b""
    if not text:
        return out
    kind = _CLASS[np.frombuffer(text, "u1")]
    n = len(kind)
    out[:N_CLASSES] = np.bincount(kind, minlength=N_CLASSES) / n
    coarse = _COARSE[kind]
    if n > 1:
        out[N_CLASSES:-8] = np.bincount(coarse[:-1].astype("u2") * N_COARSE + coarse[1:], minlength=N_COARSE**2) / n
    words, lines = text.split(), text.splitlines()
    distinct = set(words)
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    pairs = set(zip(words, words[1:], strict=False))
    out[-8:] = (
        np.log1p(n) / 10,
        np.log1p(len(words)) / 10,
        n / n_words / 10,
        len(distinct) / n_words,
        (len(words) - len(distinct)) / n_words**0.8 / 10,
        len(pairs) / max(1, len(words) - 1),
        len(set(lines)) / n_lines,
        np.log1p(n_words / n_lines) / 10,
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(_scaled(x, self.mean, self.scale) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        return _sigmoid(self.margin(x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8) / 2


def risk(gp: np.ndarray, gu: np.ndarray, prior: float | None) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of the margins of positives and unlabelled texts under the logistic loss, and the directions
    in which their margins are pushed. Where the part for the negatives falls below 0 it is raised instead of the whole
    risk lowered. Without a prior: cross entropy of positives against unlabelled."""
    n, m = len(gp), len(gu)
    as_one, as_zero, unknown = np.logaddexp(0, -gp).mean(), np.logaddexp(0, gp).mean(), np.logaddexp(0, gu).mean()
    if prior is None:
        return as_one + unknown, -_sigmoid(-gp) / n, _sigmoid(gu) / m
    negative = unknown - prior * as_zero
    if negative >= 0:
        return prior * as_one + negative, -prior * (_sigmoid(-gp) + _sigmoid(gp)) / n, _sigmoid(gu) / m
    return prior * as_one, prior * _sigmoid(gp) / n, -_sigmoid(gu) / m


def gradients(layers: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float | None) -> list[np.ndarray]:
    """Of the risk by each layer, for scaled features."""
    hidden = [np.tanh(x @ layers[0] + layers[1]) for x in (xp, xu)]
    _, *push = risk(*(h @ layers[2] + layers[3] for h in hidden), prior)
    out = [np.zeros_like(x) for x in layers]
    for x, h, g in zip((xp, xu), hidden, push, strict=True):
        back = np.outer(g, layers[2]) * (1 - h * h)
        for k, v in enumerate((x.T @ back, back.sum(axis=0), h.T @ g, g.sum())):
            out[k] = out[k] + v
    return out


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, s: Settings) -> Model:
    """Minimise the risk by Adam's steps."""
    rng = np.random.default_rng(s.seed)
    mean, scale = p.mean(axis=0), np.concatenate([p, u]).std(axis=0) + s.small
    zp, zu = _scaled(p, mean, scale), _scaled(u, mean, scale)
    d = p.shape[1]
    layers = [rng.normal(0, 1 / np.sqrt(d), (d, s.hidden)), np.zeros(s.hidden), rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(())]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    decay = s.decay / (len(p) + len(u))
    some = lambda x: x if len(x) <= s.batch else x[rng.integers(0, len(x), s.batch)]
    for t in range(1, s.steps + 1):
        rate = s.rate * (1 - t / (s.steps + 1))
        for k, g in enumerate(gradients(layers, some(zp), some(zu), prior)):
            if k % 2 == 0:
                g = g + decay * layers[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] = layers[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, layers, prior or 0.5)


def _halves(p: np.ndarray, u: np.ndarray, s: Settings, ids: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For both halves of ``repeats`` splits, the rows of ``p`` and of ``u`` that are in it. Rows of one id, without ids
    rows with the same features, are in one half."""
    if ids is None:
        key = lambda x: np.array([int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest()) for r in x], "u8")
        ids = key(p), key(u)
    own = np.unique(ids[1])
    more = np.setdiff1d(ids[0], own)
    every = np.concatenate([own, more])
    order = np.argsort(every)
    at = [order[np.searchsorted(every, x, sorter=order)] for x in ids]
    rng = np.random.default_rng(s.seed)
    for _ in range(s.repeats):
        side = np.concatenate([rng.permutation(len(x)) % 2 for x in (own, more)])
        for half in (0, 1):
            yield side[at[0]] == half, side[at[1]] == half


def _below(firsts: list[tuple[Model, np.ndarray]], u: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many rows of ``u`` that a classifier has not seen lie below the first cut, from each cut to the next, and from
    the last: the sum over the classifiers."""
    out = np.zeros(len(cuts) + 1, "i8")
    for model, seen in firsts:
        out += np.bincount(np.searchsorted(cuts, model.margin(u[~seen]), "right"), minlength=len(out))
    return out


def _mean(counts: np.ndarray, number: int) -> np.ndarray:
    """Counts over ``number`` classifiers for one, in binary fractions that add up without an error."""
    return np.diff(np.rint(np.cumsum(counts) / number * 2**20) / 2**20, prepend=0)


def class_prior(p: np.ndarray, u: np.ndarray, s: Settings, pool: Callable[[list[tuple[Model, np.ndarray]], np.ndarray], np.ndarray] | None = None, ids: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """The share of positives in ``u``: of all cuts of first classifiers' scores, read on documents that they have not
    seen, the least upper bound of (share of unlabelled above) / (share of positives above), lowered by the ratio's error.

    Each first classifier is learnt on one half of both and read on the other, ``repeats`` times over. ``ids`` tell which
    rows of ``p`` and ``u`` are one document. ``pool`` counts as ``_below`` does for these classifiers, each with the rows
    of ``u`` that it has seen, and ascending cuts, over more unlabelled texts than ``u``, and gives the mean."""
    firsts, sp = [], []
    for hp, hu in _halves(p, u, s, ids):
        if hp.any() and hu.any() and not hp.all():
            firsts.append((_fit(p[hp], u[hu], None, s), hu))
            sp.append(firsts[-1][0].margin(p[~hp]))
    if not firsts:
        return 0.5
    sp = np.sort(np.concatenate(sp))
    cuts = np.unique(sp)
    counts = pool(firsts, cuts) if pool else _mean(_below(firsts, u, cuts), len(firsts))
    if not counts.sum():
        return 0.5
    n, m = len(p), counts.sum() + np.mean([hu.sum() for _, hu in firsts])  # each is read by the classifiers of its other half
    slack = np.sqrt(np.log(40) / 2 / m) + np.sqrt(np.log(40) / 2 / n)
    qp, qu = 1 - np.searchsorted(sp, cuts) / len(sp), 1 - np.cumsum(counts)[:-1] / counts.sum()
    best = np.argmin((qu + slack) / np.maximum(qp, 1e-9))
    error = np.sqrt(max(qu[best] * (1 - qu[best]), 0.01) / m)
    return float(np.clip((qu[best] - s.errors * error) / qp[best], 0.02, 0.98))


def train(p: np.ndarray, u: np.ndarray, s: Settings | None = None, prior: float | None = None, pool: Callable[[list[tuple[Model, np.ndarray]], np.ndarray], np.ndarray] | None = None, ids: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """Fit on the features of positives and unlabelled texts. Without positives every score is 0.5; without unlabelled
    texts every score is 1."""
    s = s or Settings()
    if len(p) < 2 or len(u) < 2:
        flat = [np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.array(0.0 if len(p) < 2 else 50.0)]
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), flat, 0.5)
    if prior is None:
        prior = class_prior(p, u, s, pool) if ids is None else class_prior(p, u, s, pool, ids)
    return _fit(p, u, prior, s)


def _featured(rows: DataFrame, keep: str) -> DataFrame:
    """(keep, features as bytes) of (keep, text)."""
    kind = rows.schema[keep].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin()
        for b in batches:
            x = [features(t).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=[keep, "x"])

    return rows.select(keep, "text").mapInArrow(task, T.StructType([T.StructField(keep, kind), T.StructField("x", T.BinaryType())]))


def _binned(rows: DataFrame, models: list[Model], cuts: np.ndarray) -> DataFrame:
    """(doc_id, bins) of (doc_id, text): how many of the cuts are at most the text's margin, for each model."""
    held = rows.sparkSession.sparkContext.broadcast((models, cuts))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin()
        each, at = held.value
        for b in batches:
            if b.num_rows:
                x = np.stack([features(t) for t in b.column(1).cast(pa.binary()).to_pylist()])
                bins = np.stack([np.searchsorted(at, m.margin(x), "right") for m in each], axis=1).astype("i4")
                starts = np.arange(0, bins.size + 1, len(each), dtype="i4")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(starts), pa.array(bins.ravel()))], names=["doc_id", "bins"])

    return rows.select("doc_id", "text").mapInArrow(task, "doc_id bigint, bins array<int>")


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", allowed=None, settings: Settings | None = None) -> Model:
    """Train on a bounded sample: positives are documents that ``labels.column`` marks 1; unlabelled are documents
    without a row in ``labels``, then, where these are too few, any other, whose labels are not looked at. The class prior
    is read in one way at any size: from the sample and every other document without a row in ``labels``, by first
    classifiers that were not fitted on it. ``allowed``: a condition on doc_id
    that both must meet. Null ids are passed over; an id with different labels is no positive."""
    s = settings or Settings()
    common.ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).filter("doc_id is not null")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    positive = known.groupBy("doc_id").agg(F.min("y").alias("y")).filter("y = 1").select("doc_id")
    free = ids.distinct().join(known.select("doc_id", F.lit(1).alias("known")).distinct(), "doc_id", "left").select("doc_id", F.coalesce("known", F.lit(0)).alias("known"))
    if allowed is not None:
        positive, free = positive.filter(allowed), free.filter(allowed)
    pick = lambda x, most, y, *first: x.orderBy(*first, F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.lit(y).alias("y"))
    chosen = pick(positive, s.positives, 1).unionByName(pick(free, s.unlabelled, 0, "known"))  # 12 bytes a row, bounded by the settings
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = text.join(F.broadcast(chosen), "doc_id").select(F.struct("y", "doc_id").alias("of"), "text")
    got = sorted(((r["of"]["y"], r["of"]["doc_id"], bytes(r["x"])) for r in _featured(rows, "of").collect()))
    x = lambda y: np.array([np.frombuffer(b, "f4") for k, _, b in got if k == y], "f8").reshape(-1, N_FEATURES)
    own = text.filter("doc_id is not null") if allowed is None else text.filter("doc_id is not null").filter(allowed)
    sampled = docs.sparkSession.createDataFrame([(d,) for k, d, _ in got if k == 0], "doc_id bigint").distinct()
    unlabelled = x(0)

    def pool(firsts: list[tuple[Model, np.ndarray]], cuts: np.ndarray) -> np.ndarray:
        rest = _binned(own.join(F.broadcast(sampled), "doc_id", "left_anti"), [m for m, _ in firsts], cuts).join(known.select("doc_id"), "doc_id", "left_anti")
        out = _below(firsts, unlabelled, cuts)
        for r in rest.select(F.explode("bins").alias("bin")).groupBy("bin").count().collect():  # at most one row a cut
            out[r["bin"]] += r["count"]
        return _mean(out, len(firsts))

    model = train(x(1), unlabelled, s, pool=pool)
    common.trim()
    return model


def _judge(docs: DataFrame, model: Model):
    common.ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # N_FEATURES x hidden numbers
    return lambda texts: held.value.score(np.stack([features(t) for t in texts]))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and score: the probability of class 1 of each whole text of ``docs`` (text). Null counts as
    empty; repeated rows stay apart; an empty table gives no rows."""
    return common.with_score(docs, _judge(docs, model), list(keep))


def good(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is ``least`` or more."""
    judge = _judge(docs, model)
    return common.accepted(docs, lambda texts: judge(texts) >= least)
