"""Benchmark decontamination: find benchmark items in documents up to a bounded edit distance of words.

A CGK embedding walks along a window of words: at step j it writes the word under its pointer, and a random bit that
depends on j and that word says whether the pointer moves on. Two windows that are few edits apart fall into step
again, so their embeddings differ in few places; a key made of a few sampled places is then often the same. Each length
class of items has as many independent walks as reach the target recall on items that were edited to the limit.
Windows that share a key with an item are verified by their exact edit distance.

Windows that cannot match are not embedded: an edit spoils two word pairs at most, so a matching window holds at least
n - 1 - 2k pairs that occur in some item. Where that says nothing, all windows are embedded; where no number of walks
up to the bound reaches the target, the items are compared at every word instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import common

#: A-Z become lower case; ASCII marks are dropped.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


#: Edited items of each kind, at least, on which a length's walks are tried.
TRIALS = 400


@dataclass(frozen=True)
class Settings:
    """``percent``: edit similarity asked for; an item of n words allows n * (100 - percent) // 100 edits. Items under
    ``least_words`` have no walks: they are compared at every word, or looked up where no edit is allowed. So are the items
    of a length for which ``most_walks`` walks do not reach ``recall``.
    ``most_words``: of items in one index, which every task holds (about 100 bytes a word); more items are searched for
    in several rounds."""

    percent: int = 80
    least_words: int = 5
    most_words: int = 2_000_000
    recall: float = 0.999
    places: int = 3
    most_walks: int = 96
    seed: int = 3


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER, _MARKS).split() if text else []


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def keys(windows: np.ndarray, samples: np.ndarray, seed: int) -> np.ndarray:
    """(walks, windows) keys: for each walk the words that the embedding has at the walk's sampled steps.

    ``windows``: (windows, length) word numbers; ``samples``: (walks, places) steps in ascending order.
    """
    n_walks, n = len(samples), len(windows)
    length = windows.shape[1]
    at = np.zeros((n_walks, n), "i8")
    key = np.broadcast_to(np.arange(1, n_walks + 1, dtype="u8")[:, None] * _C, (n_walks, n)).copy()
    salt = (np.arange(n_walks, dtype="u8") + np.uint64(seed * 1000 + 1))[:, None] * _B
    column, past = np.arange(n)[None, :], np.concatenate([windows, np.full((n, 1), -1, windows.dtype)], axis=1)
    chosen = np.zeros((n_walks, int(samples.max()) + 1), bool)
    np.put_along_axis(chosen, samples, True, axis=1)
    for j in range(chosen.shape[1]):
        word = past[column, at].view("u8") if past.dtype == np.int64 else past[column, at].astype("i8").view("u8")
        if (here := np.flatnonzero(chosen[:, j])).size:
            key[here] = _scramble(key[here] * _A + word[here] + np.uint64(1))
        bit = _scramble((word + np.uint64(2)) * _A + salt + np.array([j], "u8") * _C) >> np.uint64(63)
        at = np.minimum(at + bit.astype("i8"), length)
    return key


def distance(pattern: list[int], text: list[int], anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of the text, and where that part ends (exclusive, the first such).

    ``anchored``: the part starts where the text starts. Bit-parallel over the pattern; number 0 equals nothing.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[int, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = equal.get(c, 0) if c else 0
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus)
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) | anchored
        mh <<= 1
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv & full
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class LengthClass:
    """Items of ``low`` to ``high`` words: their windows' length, the pairs a window must hold, walks and sorted keys."""

    low: int
    high: int
    length: int
    pairs: int
    member: np.ndarray  # which of the index's pairs its items have
    samples: np.ndarray
    keys: np.ndarray
    items: np.ndarray


class Index:
    """What a task needs to find a bounded set of items."""

    def __init__(self, items: list[tuple[int, bytes]], s: Settings):
        self.settings = s
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.words = [], []
        for i, t in items:
            w = words_of(t)
            if w:
                self.ids.append(i)
                self.words.append([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w])
        self.edits = [len(w) * (100 - s.percent) // 100 for w in self.words]
        self.base = len(self.vocabulary) + 1
        self.pairs = np.unique(np.array([a * self.base + b for w in self.words if len(w) >= s.least_words for a, b in zip(w, w[1:], strict=False)], "i8"))
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}  # by length: items that have to occur word by word
        self.edited = [k for k, w in enumerate(self.words) if len(w) < s.least_words and self.edits[k]]
        for k, w in enumerate(self.words):
            if len(w) < s.least_words and not self.edits[k]:
                self.short.setdefault(len(w), {}).setdefault(tuple(w), []).append(k)
        self.classes = []
        low = s.least_words
        longest = max(map(len, self.words), default=0)
        while low <= longest:
            high = max(low, low * 5 // 4)
            own = [k for k, w in enumerate(self.words) if low <= len(w) <= high]
            if own:
                found = self._class(own, min(len(self.words[k]) for k in own), max(len(self.words[k]) for k in own))
                if found is None:
                    self.edited += own
                else:
                    self.classes.append(found)
            low = high + 1
        #: Fewer words than this hold no item: each missing word is an edit.
        self.least = min((len(w) - e for w, e in zip(self.words, self.edits, strict=True)), default=1)

    def _class(self, own: list[int], low: int, high: int) -> LengthClass | None:
        """Walks for the items ``own``; none if the target recall is out of reach."""
        s = self.settings
        length = high + max(self.edits[k] for k in own)
        pairs = max(0, min(len(self.words[k]) - 1 - 2 * self.edits[k] for k in own))
        steps = max(2, low * 8 // 5)
        rng = np.random.default_rng(s.seed + low)
        # items edited to the limit, with words that no item has: one half in any way, the other by replacing words
        trial = [own[i] for i in rng.permutation(len(own))[:32]]
        trial *= -(-TRIALS // len(trial))
        edited = [_edited(self.words[k], self.edits[k], rng, kinds) for kinds in (3, 1) for k in trial]
        whole = _grid([self.words[k] for k in trial] * 2, length)
        for places in range(min(s.places, steps), 0, -1):
            samples = np.sort(np.stack([rng.permutation(steps)[:places] for _ in range(s.most_walks)]), axis=1)
            same = keys(whole, samples, s.seed) == keys(_grid(edited, length), samples, s.seed)
            met = np.logical_or.accumulate(same, axis=0).reshape(s.most_walks, 2, -1).mean(axis=2).min(axis=1)
            if met[-1] >= s.recall:
                samples = samples[: int(np.searchsorted(met, s.recall)) + 1]
                break
        else:
            return None
        k = keys(_grid([self.words[i] for i in own], length), samples, s.seed).ravel()
        order = np.argsort(k, kind="stable")
        mine = [a * self.base + b for i in own for a, b in zip(self.words[i], self.words[i][1:], strict=False)]
        return LengthClass(low, high, length, pairs, np.isin(self.pairs, mine), samples, k[order], np.tile(np.array(own), len(samples))[order])

    def find(self, text: bytes | None) -> list[tuple[int, int, int, int, int, int]]:
        """(item, distance, words of the item, start, end, occurrences) of every item that the text holds; places count
        words, and are those of the nearest occurrence, the first of equals."""
        words = words_of(text)
        if not words or len(words) < self.least or not self.ids:
            return []
        get = self.vocabulary.get
        x = np.fromiter(map(get, words, repeat(0)), "i8", len(words))
        near = self._short(x.tolist()) if self.short or self.edited else {}
        self._long(x, near)
        return self._verified(x.tolist(), near) if near else []

    def _short(self, x: list[int]) -> dict[int, set[int]]:
        """Where items without walks may start."""
        near = {item: set(range(len(x))) for item in self.edited}
        for n, own in self.short.items():
            for i in range(len(x) - n + 1):
                for item in own.get(tuple(x[i : i + n]), ()):
                    near.setdefault(item, set()).add(i)
        return near

    def _long(self, x: np.ndarray, near: dict[int, set[int]]) -> None:
        """Adds to ``near`` the windows that share a key with an item."""
        if not self.classes:
            return
        known = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
        if len(known) < min(c.pairs for c in self.classes):
            return
        pair = x[known] * self.base + x[known + 1]
        hit = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        if hit.sum() < min(c.pairs for c in self.classes):
            return
        place, number = known[hit], np.searchsorted(self.pairs, pair[hit])
        for c in self.classes:
            own = place[c.member[number]]  # pairs of this class's items
            if len(own) < c.pairs:
                continue
            so_far = np.zeros(len(x) + 1, "i4")
            so_far[own + 1] = 1
            np.cumsum(so_far, out=so_far)  # pairs that begin before a word
            ends = np.minimum(np.arange(c.length - 1, c.length - 1 + len(x)), len(x))
            starts = np.flatnonzero(so_far[ends] - so_far[:-1] >= c.pairs)
            for i in range(0, len(starts), 256):
                own = starts[i : i + 256]
                at = own[:, None] + np.arange(c.length)
                windows = np.where(at < len(x), x[np.minimum(at, len(x) - 1)], -1)
                k = keys(windows, c.samples, self.settings.seed)
                first, last = np.searchsorted(c.keys, k, "left"), np.searchsorted(c.keys, k, "right")
                for r, w in zip(*np.nonzero(last > first), strict=True):
                    for item in c.items[first[r, w] : last[r, w]].tolist():
                        near.setdefault(item, set()).add(int(own[w]))

    def _verified(self, x: list[int], near: dict[int, set[int]]) -> list[tuple[int, int, int, int, int, int]]:
        out = []
        for item, starts in near.items():
            pattern, k = self.words[item], self.edits[item]
            regions: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - k), min(len(x), s + len(pattern) + k)
                if regions and a <= regions[-1][1] - len(pattern):
                    regions[-1][1] = max(b, regions[-1][1])
                else:
                    regions.append([a, b])
            found = []
            for a, b in regions:
                d, end = distance(pattern, x[a:b])
                if d <= k:
                    _, back = distance(pattern[::-1], x[a : a + end][::-1], anchored=True)
                    found.append((d, a + end - back, a + end))
            if found:
                d, start, end = min(found)
                out.append((self.ids[item], d, len(pattern), start, end, len({e for *_, e in found})))
        return out


def _grid(rows: list[list[int]], length: int) -> np.ndarray:
    out = np.full((len(rows), length), -1, "i8")
    for k, w in enumerate(rows):
        out[k, : min(length, len(w))] = w[:length]
    return out


def _edited(words: list[int], edits: int, rng: np.random.Generator, kinds: int = 3) -> list[int]:
    """``kinds``: 1 only replaces words, each of them once."""
    out = list(words)
    places = rng.permutation(len(words))
    for i in range(edits):
        kind, at = (0, int(places[i])) if kinds == 1 else (rng.integers(3), int(rng.integers(len(out))))
        if kind == 0:
            out[at] = 0
        elif kind == 1:
            out.insert(at, 0)
        elif len(out) > 1:
            del out[at]
    return out


_FOUND = common.schema(doc_id="long", item_id="long", distance="int", item_words="int", start_word="int", end_word="int", occurrences="int")
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *[(n, pa.int32()) for n in _FOUND.names[2:]]])


def find(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row for each document (doc_id, text) and item (item_id, text) that it holds: doc_id, item_id, distance,
    item_words, start_word, end_word (exclusive), occurrences.

    Words are compared with A-Z lower-cased and without ASCII marks. Null and empty texts hold nothing; null items
    and items without words are nowhere; items with equal texts are each reported; repeated documents are each reported;
    a null doc_id is reported as null. Other columns are ignored. Empty tables give no rows.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for part in _slices(benchmark, s):
        held = spark.sparkContext.broadcast(Index(part, s))

        def task(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                got = [(d, *r) for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True) for r in index.find(t)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

        found = rows.mapInArrow(task, _FOUND)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], _FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    s = settings or Settings()
    common.ship(docs.sparkSession)
    for part in _slices(benchmark, s):
        held = docs.sparkSession.sparkContext.broadcast(Index(part, s))
        docs = common.accepted(docs, lambda texts, held=held: np.array([not held.value.find(t) for t in texts], bool))
    return docs


def _slices(benchmark: DataFrame, s: Settings) -> Iterator[list[tuple[int, bytes]]]:
    part, n = [], 0
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    for r in items.orderBy("item_id", "text").toLocalIterator():
        w = len(r["text"].split())
        if part and n + w > s.most_words:
            yield part
            part, n = [], 0
        part.append((r["item_id"], r["text"].encode()))
        n += w
    if part:
        yield part
