"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Every character n-gram of a word, blanks at both ends included, has a vector in a hashed table; a document is the mean
of the n-grams of its distinct words, so that no repetition thins out the rest, and a linear softmax over two classes
reads it. Vectors and softmax are trained jointly in numpy, so misspellings and endings never seen share the vectors of
the n-grams they keep. Vectors that few texts pull at shrink to nothing: what is peculiar to one text says nothing of
another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import common

#: Lower case for A-Z; everything in ASCII that is neither letter nor digit becomes a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_P = np.uint32(0x01000193)


@dataclass(frozen=True)
class Settings:
    """``most``: the labelled documents of each class that the fit may use, taken by a hash of doc_id; the bound on the
    sample. ``most_bytes``: of text in all of them together (the whole documents that fit, in the same order)."""

    most: int = 4000
    most_bytes: int = 48 << 20
    orders: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 17
    dim: int = 4
    #: An n-gram has a vector if so many of 1000 or more texts hold it, of fewer texts a share of that.
    texts: int = 8
    #: Vectors shrink by this share of the largest pull of any n-gram, those of n-grams that pull less to nothing.
    sparse: float = 0.004
    epochs: int = 8
    #: Updates at least, however few the rows.
    steps: int = 500
    batch: int = 64
    rate: float = 4.0
    #: Neutral n-grams that every mean includes, so a few words of a short text cannot decide alone.
    neutral: int = 500
    #: Weight of class 1 in training, against 1 - this of class 0.
    prior: float = 0.5
    #: Of the summed squared gradients, by which a vector's step is divided: 0.5 favours rare n-grams, 0 common ones.
    power: float = 0.25
    seed: int = 7


def grams(texts: list[bytes | None], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket and start of every n-gram of the joined texts; see ``joined``."""
    buf, _ = joined(texts)
    blank = buf == 32
    h = np.zeros(len(buf), "u4")
    ok = np.ones(len(buf), bool)
    for n in range(1, max(s.orders) + 1):
        if len(buf) < n:
            return
        h = h[: len(buf) - n + 1] * _P + buf[n - 1 :]
        if n >= 3:  # all but the ends must be inside a word
            ok = ok[: len(h)] & ~blank[n - 2 : n - 2 + len(h)]
        if n in s.orders:
            x = h[ok]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield x >> np.uint32(32 - s.bits), np.flatnonzero(ok)


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each text in one buffer, each text between blanks, and where each starts. No n-gram reaches
    from one text into another."""
    parts = [b" " + b" ".join(dict.fromkeys((t or b"").translate(_FOLD).split())) + b" " for t in texts]
    return np.frombuffer(b"".join(parts), "u1"), np.cumsum([0, *map(len, parts)])[:-1]


@dataclass
class Model:
    """``weight``: each bucket's vector through the softmax, as the difference of the two classes; ``bias`` likewise."""

    settings: Settings
    weight: np.ndarray
    bias: float
    table: np.ndarray | None = None
    softmax: np.ndarray | None = None

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability of class 1 for each text. A text without n-grams is judged by the bias alone."""
        out = np.empty(len(texts))
        for a, b in _chunks(texts):
            _, starts = joined(texts[a:b])
            total, count = np.zeros(b - a), np.zeros(b - a)
            for bucket, at in grams(texts[a:b], self.settings):
                if len(at):
                    w = np.concatenate(([0.0], np.cumsum(self.weight[bucket], dtype="f8")))
                    cut = np.append(np.searchsorted(at, starts), len(at))
                    total += np.diff(w[cut])
                    count += np.diff(cut)
            out[a:b] = 1 / (1 + np.exp(-np.clip(total / (count + self.settings.neutral) + self.bias, -700, 700)))
        return out


def _chunks(texts: list[bytes | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    a = n = 0
    for i, t in enumerate(texts):
        n += len(t or b"")
        if n >= size:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def train(texts: list[bytes | None], labels: np.ndarray, s: Settings) -> Model:
    """Fit table and softmax together by scaled gradient steps on the cross entropy, class 1 weighing ``prior``. Without rows of
    both classes the model says 0 for everything, or 1 where all rows are of class 1."""
    labels = np.asarray(labels)
    n1 = int(labels.sum())
    if n1 in (0, len(labels)):
        return Model(s, np.zeros(1 << s.bits, "f4"), 20.0 if n1 else -20.0)
    bags = []
    for t in texts:
        b = [x for x, _ in grams([t], s)]
        bucket, count = np.unique(np.concatenate(b) if b else np.zeros(0, "u4"), return_counts=True)
        bags.append((bucket.astype("i4"), (count / (count.sum() + s.neutral)).astype("f4")))
    rng = np.random.default_rng(s.seed)
    # n-grams of too few texts could only say which text they are from
    seen = np.zeros(1 << s.bits, "i4")
    for b, _ in bags:
        seen[b] += 1
    kept = np.flatnonzero(seen >= min(s.texts, np.ceil(s.texts * len(bags) / 1000)))
    place = np.full(1 << s.bits, -1, "i4")
    place[kept] = np.arange(len(kept))
    for i, (b, c) in enumerate(bags):  # one by one: they are the most that the driver holds
        own = place[b] >= 0
        bags[i] = place[b[own]], c[own]
    table = rng.uniform(-1 / s.dim, 1 / s.dim, (len(kept), s.dim)).astype("f4")
    soft = rng.uniform(-1, 1, (s.dim, 2)).astype("f4")
    bias = np.zeros(2, "f4")
    g_table, g_soft, g_bias = np.full(len(kept), 1e-8, "f4"), np.full((s.dim, 2), 1e-8, "f4"), np.full(2, 1e-8, "f4")
    weight = np.where(labels == 1, s.prior / n1, (1 - s.prior) / (len(labels) - n1)) * len(labels)
    epochs = max(s.epochs, -(-s.steps * s.batch // len(bags)))
    # how far each n-gram pulls at the start, where every text is as likely to be of either class
    pull = np.zeros(len(kept))
    for (b, c), w, y in zip(bags, weight.tolist(), labels.tolist(), strict=True):
        pull[b] += (0.5 - y) * w * c
    shrink = s.sparse * np.abs(pull).max(initial=0.0) / len(bags)
    for epoch in range(epochs):
        order, rate = rng.permutation(len(bags)), s.rate * (1 - epoch / epochs)
        for k in range(0, len(order), s.batch):
            own = order[k : k + s.batch]
            bucket = np.concatenate([bags[i][0] for i in own])
            share = np.concatenate([bags[i][1] for i in own])
            sizes = [len(bags[i][0]) for i in own]
            doc = np.repeat(np.arange(len(own)), sizes)
            part = table[bucket] * share[:, None]
            hidden = np.stack([np.bincount(doc, part[:, j], len(own)) for j in range(s.dim)], axis=1).astype("f4")
            z = hidden @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = p
            d[np.arange(len(own)), labels[own]] -= 1
            d *= (weight[own] / len(own))[:, None]
            d_soft, d_bias, d_hidden = hidden.T @ d, d.sum(axis=0), (d @ soft.T).astype("f4")
            g = np.stack([np.bincount(bucket, share * d_hidden[doc, j], len(kept)) for j in range(s.dim)], axis=1).astype("f4")
            g_table += (g * g).sum(axis=1)
            step = rate / g_table**s.power
            table -= step[:, None] * g
            # soft thresholds, measured in the softmax's units
            size, apart = np.sqrt((table * table).sum(axis=1)), float(np.sqrt(((soft[:, 1] - soft[:, 0]) ** 2).sum()))
            table *= np.maximum(0, 1 - step * shrink * apart / np.maximum(size, 1e-12))[:, None]
            g_soft += d_soft**2
            soft -= rate * d_soft / np.sqrt(g_soft)
            g_bias += d_bias**2
            bias -= rate * d_bias / np.sqrt(g_bias)
    whole = np.zeros((1 << s.bits, s.dim), "f4")
    whole[kept] = table
    return Model(s, (whole @ (soft[:, 1] - soft[:, 0])).astype("f4"), float(bias[1] - bias[0]) - 1e-3, whole, soft)


def sample(docs: DataFrame, labels: DataFrame, column: str, most: int, allowed=None) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` documents of each class of ``labels.column`` (0 and 1), by a hash of doc_id.

    ``allowed``: a condition on doc_id that says which labels may be learnt from. Null ids and labels are passed over;
    of an id with several labels the largest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    if allowed is not None:
        known = known.filter(allowed)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    pick = lambda y: known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = pick(0).unionByName(pick(1))  # 2 x most rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", allowed=None, settings: Settings | None = None) -> Model:
    """Train on a bounded sample of the labelled documents."""
    s = settings or Settings()
    rows = sample(docs, labels, column, s.most, allowed)
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("text"))
    texts, ys, held = [], [], 0
    for r in rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))).filter(F.col("size") <= s.most_bytes).orderBy(*order).toLocalIterator():
        if held + r["size"] <= s.most_bytes:
            texts.append((r["text"] or "").encode())
            ys.append(r["y"])
            held += r["size"]
    model = train(texts, np.array(ys, "i8"), s)
    del texts
    common.trim()
    return model


def _lean(docs: DataFrame, model: Model):
    """The model without its vectors, in every task: 4 bytes a bucket."""
    common.ship(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(Model(model.settings, model.weight, model.bias))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and score: the probability of class 1 of each whole text of ``docs`` (text). Null and empty
    texts are judged by the bias alone; repeated rows stay apart; an empty table gives no rows."""
    held = _lean(docs, model)
    return common.with_score(docs, lambda texts: held.value.score(texts), list(keep))


def clean(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under ``below``."""
    held = _lean(docs, model)
    return common.accepted(docs, lambda texts: held.value.score(texts) < below)
