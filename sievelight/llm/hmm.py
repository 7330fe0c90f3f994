"""A hidden Markov language model over words.

A word is emitted in two steps: a state emits the word's class, the class emits the word by its smoothed count. The
most frequent words are classes of their own; any other word's class is a hash of its last letters, so a word never
seen has a class too. Baum-Welch runs over all training texts: each task sums expected counts, the sums are added up,
and the driver re-estimates a model of fixed size. Scoring is the scaled forward recursion, exact for whole texts.

What depends on the corpus's vocabulary stays in tables: counts of the most frequent words, ``HEAD`` at most, go to every
task, a bounded table, and the other words of each text find their counts by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm import common

#: Words at most whose counts every task holds.
HEAD = 200_000
#: Models that one task, or the driver, adds up; more are added in several steps.
ADDENDS = 16
#: Count that every word type has besides its own, also the one type that stands for all words never seen.
ADDED = 0.1


@dataclass(frozen=True)
class Settings:
    """``start_docs``: texts, by a hash of doc_id, whose EM gives the starting point, as far as these whole texts have
    ``start_words`` words together; the model itself is trained on all training texts, ``passes`` times over."""

    states: int = 8
    own: int = 2000
    endings: int = 1024
    passes: int = 2
    start_docs: int = 400
    start_words: int = 400_000
    start_passes: int = 20
    prior: float = 20.0
    seed: int = 5

    @property
    def classes(self) -> int:
        """Own words, endings, and the end of a text."""
        return self.own + self.endings + 1


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def ending(word: bytes, s: Settings) -> int:
    return s.own + zlib.crc32(word[-3:]) % s.endings


def ending_sql(word: Column, s: Settings) -> Column:
    """``ending`` of a binary column."""
    return (F.crc32(F.substring(word, -3, 3)) % s.endings + s.own).cast("int")


@dataclass
class Lexicon:
    """Counts of the head, classes, and what the corpus sums to. ``mass``: of each class, its words' smoothed counts."""

    settings: Settings
    words: list[bytes]
    counts: np.ndarray
    mass: np.ndarray
    total: int
    types: int
    ends: int
    at: dict[bytes, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "at": {}}

    def prepare(self) -> Lexicon:
        if not self.at and self.words:
            s = self.settings
            self.at = {w: i for i, w in enumerate(self.words)}
            self.kind = np.array([i if i < s.own else ending(w, s) for i, w in enumerate(self.words)], "i4")
        return self

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Head number (-1: none) of each word, and classes of the words and of the end."""
        get, s = self.at.get, self.settings
        at = np.fromiter((get(w, -1) for w in words), "i4", len(words))
        out = np.empty(len(words) + 1, "i4")
        out[-1] = s.classes - 1
        out[:-1] = self.kind[at] if len(self.words) else -1
        rare = np.flatnonzero(at < 0)
        out[rare] = [ending(words[i], s) for i in rare.tolist()]
        return at, out

    @property
    def below(self) -> float:
        return self.total + ADDED * (self.types + 1)


@dataclass
class Model:
    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (classes, states)


def batches(lengths: list[int], cells: int = 250_000, most: int = 384) -> Iterator[np.ndarray]:
    """Indices in descending length, grouped so that a padded group stays small."""
    order = np.argsort(-np.array(lengths), kind="stable")
    i = 0
    while i < len(order):
        n = int(min(most, max(1, cells // lengths[order[i]])))
        yield order[i : i + n]
        i += n


def _grid(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, texts) classes, longest first, and how many texts are still going at each step."""
    lengths = np.array([len(x) for x in seqs])
    grid = np.zeros((lengths[0], len(seqs)), "i4")
    for k, x in enumerate(seqs):
        grid[: len(x), k] = x
    return grid, np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")


def forward(m: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence of classes, longest first."""
    grid, going = _grid(seqs)
    out = np.zeros(len(seqs))
    a = m.first * m.emit[grid[0]]
    for t in range(len(grid)):
        n = going[t]
        if t:
            a = (a[:n] @ m.move) * m.emit[grid[t, :n]]
        c = a.sum(axis=1)
        out[:n] += np.log10(c)
        a /= c[:, None]
    return out


def expected(m: Model, seqs: list[np.ndarray], first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """Add one group's expected counts; return its log10 probability."""
    grid, going = _grid(seqs)
    steps, s = len(grid), m.move.shape[0]
    alpha, scale = np.zeros((steps, len(seqs), s)), np.ones((steps, len(seqs)))
    for t in range(steps):
        n = going[t]
        a = m.emit[grid[t, :n]]
        a = a * ((alpha[t - 1, :n] @ m.move) if t else m.first)
        c = a.sum(axis=1)
        scale[t, :n] = c
        np.divide(a, c[:, None], out=alpha[t, :n])
    total = float(np.log10(scale).sum())
    beta = np.ones((len(seqs), s))
    for t in range(steps - 1, 0, -1):  # beta: at step t, of the texts that go on
        n = going[t]
        b = m.emit[grid[t, :n]] * beta[:n] / scale[t, :n, None]
        move += alpha[t - 1, :n].T @ b * m.move
        alpha[t, :n] *= beta[:n]  # the state's probability
        beta[:n] = b @ m.move.T
    alpha[0] *= beta
    first += alpha[0].sum(axis=0)
    live = np.arange(len(seqs)) < going[:, None]
    flat, weight = grid[live], alpha[live]
    for k in range(s):
        emit[:, k] += np.bincount(flat, weight[:, k], len(emit))
    return total


def estimated(first: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray, s: Settings) -> Model:
    """A model from expected counts; every class keeps some of its share of the corpus in every state."""
    e = emit + s.prior * share[:, None]
    f, a = first + 1, move + 1
    return Model(f / f.sum(), a / a.sum(axis=1, keepdims=True), e / e.sum(axis=0))


def start(seqs: list[np.ndarray], share: np.ndarray, s: Settings) -> Model:
    """EM on a few sequences from a random assignment of texts to states."""
    rng = np.random.default_rng(s.seed)
    emit = np.zeros((s.classes, s.states))
    if not seqs:
        return estimated(np.zeros(s.states), np.zeros((s.states, s.states)), emit + rng.random(emit.shape), share, s)
    for x in seqs:
        k = rng.integers(s.states)
        emit[:, k] += np.bincount(x, minlength=s.classes)
    m = estimated(np.zeros(s.states), np.eye(s.states) * 50, emit, share, s)
    for _ in range(s.start_passes):
        sums = np.zeros(s.states), np.zeros((s.states, s.states)), np.zeros((s.classes, s.states))
        for own in batches([len(x) for x in seqs]):
            expected(m, [seqs[i] for i in own], *sums)
        m = estimated(*sums, share, s)
    return m


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) of all ``texts`` (text), stored. Tasks count before they send."""
    arrow = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = list(held), list(held.values())
            for i in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000], pa.binary()), pa.array(n[i : i + 50_000], pa.int64())], schema=arrow)
            held.clear()

        for b in rows:
            for i in range(0, b.num_rows, 200):
                for t in b.column(0).slice(i, 200).cast(pa.binary()).to_pylist():
                    held.update(words_of(t))
                if len(held) > 700_000:
                    yield from out()
        yield from out()

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(task, common.schema(word="binary", c="long"))
    return common.stored(counted.groupBy("word").agg(F.sum("c").alias("c")), "words")


def lexicon(words: DataFrame, ends: int, s: Settings, head: int = HEAD) -> Lexicon:
    """The head of a table of word counts and the corpus's sums; ``ends``: training texts."""
    sums = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    # the head: all words above a count that at most ``head`` words reach, by a histogram of a few hundred bins
    size = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    bins = {r["b"]: r["n"] for r in words.groupBy(size.alias("b")).agg(F.count("*").alias("n")).collect()}
    least, n = None, 0
    for b in sorted(bins, reverse=True):
        n += bins[b]
        if n > max(head, s.own):
            break
        least = b
    top = words.filter(size >= least).toArrow() if least is not None else None
    found = sorted(zip(top.column("c").to_pylist(), top.column("word").to_pylist(), strict=True), key=lambda x: (-x[0], x[1])) if top is not None else []
    keys, counts = [w for _, w in found], np.array([c for c, _ in found], "i8")
    own = set(keys[: s.own])
    mass = np.full(s.classes, ADDED)  # of a word of the class that was never seen
    for r in words.groupBy(ending_sql(F.col("word"), s).alias("k")).agg((F.sum("c") + ADDED * F.count("*")).alias("m")).collect():  # a row a class
        mass[r["k"]] += r["m"]
    for w, c in zip(keys[: s.own], counts[: s.own].tolist(), strict=True):
        mass[ending(w, s)] -= c + ADDED
    mass[: s.own] = 0  # a small corpus may have fewer
    mass[: len(own)] = counts[: len(own)] + ADDED
    mass[-1] = ends + ADDED
    return Lexicon(s, keys, counts, mass, sums["n"] + ends, sums["v"] + (ends > 0), ends)


def _gathered(rows: Iterator[pa.RecordBatch], text: int, *others: int, size: int = 16 << 20) -> Iterator[tuple[list, ...]]:
    """Columns of consecutive rows as lists, texts first, about ``size`` bytes of text together: the more texts there
    are, the better their lengths pair up."""
    held: tuple[list, ...] = ([], *([] for _ in others))
    n = 0
    for b in rows:
        texts = b.column(text).cast(pa.binary()).to_pylist()
        for out, values in zip(held, (texts, *(b.column(c).to_pylist() for c in others)), strict=True):
            out.extend(values)
        n += sum(len(t or b"") for t in texts)
        if n >= size:
            yield held
            held, n = ([], *([] for _ in others)), 0
    if held[0]:
        yield held


def train(texts: DataFrame, lex: Lexicon) -> Model:
    """Baum-Welch over all ``texts`` (doc_id, text)."""
    spark, s = texts.sparkSession, lex.settings
    share = lex.mass / lex.mass.sum()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = texts.select("doc_id").orderBy(*order).limit(s.start_docs)  # start_docs rows
    few = texts.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids.distinct()), "doc_id")
    lex.prepare()
    seqs, left = [], s.start_words
    for r in few.orderBy(*order, "text").toLocalIterator():
        w = words_of((r["text"] or "").encode())
        if len(w) <= left:
            seqs.append(lex.classes(w)[1])
            left -= len(w)
    model = start(seqs, share, s)
    held = spark.sparkContext.broadcast(lex)  # HEAD words

    sizes = (s.states, s.states * s.states, s.classes * s.states)
    arrow = pa.schema([("sums", pa.binary())])

    for _ in range(s.passes):
        now = spark.sparkContext.broadcast(model)

        def task(rows: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            own, m = held.value.prepare(), now.value
            sums = np.zeros(s.states), np.zeros((s.states, s.states)), np.zeros((s.classes, s.states))
            for texts in _gathered(rows, 0):
                seqs = [own.classes(words_of(t))[1] for t in texts[0]]
                for pick in batches([len(x) for x in seqs]):
                    expected(m, [seqs[k] for k in pick], *sums)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in sums]).tobytes()], pa.binary())], schema=arrow)

        def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(sizes))
            for b in rows:
                for x in b.column(0).to_pylist():
                    total += np.frombuffer(x)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=arrow)

        kind = common.schema(sums="binary")
        with common.scratch(spark):
            parts = common.stored(texts.select(F.col("text").cast("string").alias("text")).mapInArrow(task, kind), "expected")
            n = parts.count()  # a model of each task
            while n > ADDENDS:
                n = -(-n // ADDENDS)
                parts = common.stored(parts.repartition(n).mapInArrow(add, kind), "expected")
            total = sum(np.frombuffer(bytes(r["sums"])) for r in parts.collect())  # ADDENDS models at most
        first, move, emit = np.split(total, np.cumsum(sizes)[:-1])
        model = estimated(first, move.reshape(s.states, s.states), emit.reshape(s.classes, s.states), share, s)
    return model


_ROWS = common.schema(row="long", doc_id="long", n_tokens="long", n_known="long", base="double", score="double", rare="array<binary>")
_ROWS_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary()))])


def score(docs: DataFrame, words: DataFrame, lex: Lexicon, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of each whole text of ``docs`` (doc_id, text).

    Tokens are the words and one end; null counts as empty. The base is the smoothed unigram over the same types.
    Repeated rows stay apart; null ids are kept; other columns are ignored.
    """
    spark, s = docs.sparkSession, lex.settings
    held, now = spark.sparkContext.broadcast(lex), spark.sparkContext.broadcast(model)

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, m = held.value.prepare(), now.value
        log_count, log_mass, below = np.log10(own.counts + ADDED), np.log10(np.maximum(own.mass, 1e-300)), np.log10(own.below)
        # of a word in its class: nothing for own words and the end, count over mass for the others
        inside = np.append(log_mass[: s.own], [0.0] * (s.classes - s.own))
        row = TaskContext.get().partitionId() << 40
        for texts, ids in _gathered(rows, 1, 0):
            n = len(texts)
            base, extra, known, rare, seqs = np.zeros(n), np.zeros(n), np.zeros(n, "i8"), [], []
            for k, t in enumerate(texts):
                w = words_of(t)
                at, kind = own.classes(w)
                there = at[at >= 0]
                count = log_count[there].sum()
                base[k] = count + np.log10(own.ends + ADDED) - len(kind) * below
                extra[k] = count - inside[kind].sum() - log_mass[kind[:-1]][kind[:-1] >= s.own].sum()
                known[k] = len(there) + (own.ends > 0)
                rare.append([w[j] for j in np.flatnonzero(at < 0).tolist()])
                seqs.append(kind)
            like = np.zeros(n)
            for pick in batches([len(x) for x in seqs]):
                like[pick] = forward(m, [seqs[j] for j in pick])
            lengths = np.array([len(x) for x in seqs], "i8")
            for i in range(0, n, 1000):
                cut = slice(i, i + 1000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)[cut]), pa.array(ids[cut], pa.int64()), pa.array(lengths[cut]), pa.array(known[cut]), pa.array(base[cut]), pa.array((like + extra)[cut]), pa.array(rare[cut], pa.list_(pa.binary()))],
                    schema=_ROWS_ARROW,
                )
            row += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = common.stored(rows.mapInArrow(task, _ROWS), "scored")
    rare = rows.select("row", F.explode("rare").alias("word")).join(words, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADDED))).alias("more"), F.count("c").alias("found"))
    out = rows.drop("rare").join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def language_model(docs: DataFrame, training: Column, settings: Settings | None = None, head: int = HEAD) -> DataFrame:
    """Train on the rows of ``docs`` where ``training`` holds, score all rows; also gives train_tokens.

    Without training texts every token is the one unseen type, and all scores are 0. Empty table: no rows.
    """
    s = settings or Settings()
    common.ship(docs.sparkSession)
    texts = docs.filter(F.coalesce(training, F.lit(False)))
    words = count_words(texts)
    ends = texts.select("doc_id").count()
    lex = lexicon(words, ends, s, head)
    if ends:
        model = train(texts, lex)
        out = score(docs, words, lex, model)
    else:
        n = F.size(F.expr(r"regexp_extract_all(coalesce(cast(text as string), ''), '[^\\x20\\x09-\\x0D]+', 0)")) + 1
        out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    return out.withColumn("train_tokens", F.lit(lex.total).cast("long"))
