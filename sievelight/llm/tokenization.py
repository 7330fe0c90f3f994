"""Fast exact encoding with the ``tokenizers`` library for byte-level BPE vocabularies."""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from functools import lru_cache

#: A run of white space: then only blanks that stand alone are cut at.
_RUN = re.compile(r"\s\s")
#: A blank alone between two other characters. The library's pre-tokenizer always starts a token there.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_path() -> str:
    """The vocabulary that the queries use; every operator takes its own path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Marks after a word are one pre-token; letters up to here have the same class in every Unicode version.
_MARKS, _LETTERS = string.punctuation, "\u0250"


def _byte_letters() -> dict[int, str]:
    """For each character below ``_LETTERS``: how byte-level BPE spells its UTF-8 bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {b: chr(b) for b in printable}
    spelt |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in spelt)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(ord(_LETTERS))}


def _plain(file: dict) -> bool:
    """Whether a tokenizer's file is a byte-level BPE of which pieces can be encoded on their own."""
    model, before = file["model"], file["pre_tokenizer"] or {}
    split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    bare = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback"))
    return split and model["type"] == "BPE" and bare and not any(file.get(k) for k in ("normalizer", "truncation", "padding"))


class _Pieces(dict):
    """Ids by piece; what it lacks is learnt."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, x: str) -> bytes:
        return self.learn(x)


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The pre-tokenizer of a byte-level BPE never joins characters across a blank that stands alone, so the text is cut
    there, and each distinct piece goes through the library once while it stays in the cache: two generations of
    ``limit`` pieces; what was not met again during the last ``limit`` new pieces is forgotten. Pieces over
    ``longest`` characters are never kept. A text that holds the string of an added token, which the library looks for
    before anything else, goes through it whole, as do all texts where the file is no plain byte-level BPE. A null text
    counts as empty.
    """

    def __init__(self, path: str, limit: int = 400_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.plain = _plain(json.loads(self.whole.to_str()))
        self.tokenize, self.spelt = self.whole.model.tokenize, _byte_letters()
        self.marks: dict[str, bytes] = {}
        self.break_ = self._ids(["\n"])[0] if self.plain else b""
        self.limit, self.longest = limit, longest
        self.young: dict[str, bytes] = _Pieces(self._learn)
        self.old: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, x: str) -> bytes:
        """Ids of a piece that ``young`` lacks: it stands for itself after a blank, or after its own line break."""
        young, old = self.young, self.old
        if (ids := old.get(x)) is None:
            if x.isalpha() and x.isascii() and len(x) <= self.longest:  # most are plain words
                ids = young[x] = array("I", [t.id for t in self.tokenize("\u0120" + x)]).tobytes()
                return ids
            w = x.rstrip(_MARKS)
            line = w[:1] == "\n"
            bare = w[1:] if line else w
            if len(x) > self.longest or not (bare.isascii() or (bare and max(bare) < _LETTERS)) or not (bare.isalpha() or bare.isdigit()):
                ids = self._ids([x if x[:1] == "\n" else f" {x}"])[0]
            else:
                tail = x[len(w) :]
                ids = (young.get(w) or old.get(w)) if tail else None
                if ids is None:
                    spelling = bare if bare.isascii() else bare.translate(self.spelt)
                    ids = array("I", [t.id for t in self.tokenize(spelling if line else f"\u0120{spelling}")]).tobytes()
                    ids = young[w] = self.break_ + ids if line else ids
                if tail:
                    if tail not in self.marks:
                        self.marks[tail] = self._ids([tail])[0]
                    ids += self.marks[tail]
        if len(x) <= self.longest:
            young[x] = ids
        return ids

    def _cut(self, text: str | None) -> list[str]:
        if not text:
            return [""]
        return _CUT.split(text) if _RUN.search(text) else text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if t and (not self.plain or (self.added and self.added.search(t)))]
        if not odd:
            return self._pieces(texts)
        whole = dict(zip(odd, self._ids([texts[i] for i in odd]), strict=True))
        out = self._pieces([None if i in whole else t for i, t in enumerate(texts)])
        return [whole.get(i, x) for i, x in enumerate(out)]

    def _pieces(self, texts: list[str | None]) -> list[bytes]:
        if len(self.marks) > 10_000:
            self.marks = {}
        if len(self.young) > self.limit:
            self.old, self.young = self.young, _Pieces(self._learn)
        cut = [self._cut(t) for t in texts]
        get, first = self.young.__getitem__, self._ids([x[0] for x in cut])
        return [a + b"".join(map(get, x[1:])) for a, x in zip(first, cut, strict=True)]


#: Pieces of one generation of a worker's cache; both generations take about 0.5 KB a piece together.
CACHED = 600_000


@lru_cache(maxsize=1)
def encoder(path: str, cached: int = CACHED) -> Encoder:
    """One encoder per worker process, kept between its tasks until another operator's task drops it."""
    return Encoder(path, cached)
