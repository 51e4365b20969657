"""Ids of a byte-level BPE tokenizer for many texts at once.

The tokenizer is an existing file (``tokenizers`` JSON, byte-level, no normalizer) and is never trained. Its words (what its
pattern cuts a text into) are found for whole slices of texts with NumPy; each distinct word is then given to the tokenizer's
own model once and kept, so common words cost a look-up. A text goes to the tokenizer whole if it holds one of its added tokens, or a
code point that has no class since Unicode 3.2 and on which tables of different years may differ. All ids equal those of
``Tokenizer.encode(text, add_special_tokens=False)``.

A text longer than SLICE characters is cut where one space stands between two other characters, which no word spans, so
memory beside the text and its ids depends on the slice only (a text without such a place is one slice).
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np

from .common import mix, seeds

SLICE = 1 << 19  #: characters of texts that are cut into words at once
KEPT_WORDS = 1 << 20  #: distinct words kept; beyond it the store begins anew
KEPT_IDS = 1 << 22  #: ids kept, likewise
LONGEST_KEPT = 64  #: characters of a word that is kept

_LETTER, _NUMBER, _OTHER, _WHITE, _MARK, _DOUBTFUL = range(1, 7)
_BETWEEN = "\ud800"  # stands between two texts: no text can hold a lone surrogate
_GAP = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point as the pattern of byte-level BPE sees it."""
    table, old = np.full(0x110000, _DOUBTFUL, dtype=np.uint8), unicodedata.ucd_3_2_0
    for c in range(0x110000):
        kind, before = unicodedata.category(chr(c)), old.category(chr(c))
        if before == "Cn" or kind[0] != before[0]:
            continue
        table[c] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _WHITE if kind[0] == "Z" else _OTHER
    table[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85]] = _WHITE
    table[0xD800:0xE000] = _DOUBTFUL
    table[ord(_BETWEEN)] = _MARK
    return table


def word_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a word of the pattern begins at each code point; a mark between texts is a word of its own."""
    n = len(points)
    start = np.ones(n, dtype=bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _MARK)
    inked = kind <= _OTHER
    start[1:] &= ~(inked[1:] & (points[:-1] == 0x20))  # one space goes with the word after it
    start[:-1] |= (kind[:-1] == _WHITE) & inked[1:]  # so the last white character before a word stands alone or with it
    p = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (kind[1:] == _LETTER)) if n > 1 else np.zeros(0, dtype=np.int64)
    if len(p):  # 's 't 'm 'd, 'll 've 're
        a, b = points[p + 1], points[np.minimum(p + 2, n - 1)]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = (p + 2 < n) & (((a == ord("l")) & (b == ord("l"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("r")) & (b == ord("e"))))
        cut = p[one | two]
        rest = cut + np.where(one, 2, 3)[one | two]
        start[cut + 1] = False
        rest = rest[rest < n]
        start[rest[kind[rest] == _LETTER]] = True
    return start


class Words2Ids:
    """Ids of words, kept by two independent 64-bit hashes of each word."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(added)) if added else None
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.power = np.zeros(0, dtype=np.uint64)
        self.forget()

    def forget(self) -> None:
        self.key, self.twin = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.at, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.store, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each of some words, from the tokenizer's model, which takes bytes as letters of an alphabet of its own."""
        as_letters = lambda x: x.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        model = self.tokenizer.model
        return [[t.id for t in model.tokenize(w)] for w in as_letters(_BETWEEN.join(words)).split(as_letters(_BETWEEN))]

    def _hashes(self, points: np.ndarray, start: np.ndarray, stop: np.ndarray):
        n = len(points)
        if len(self.power) <= n:
            size = 1 << int(np.ceil(np.log2(max(n + 1, 2 * SLICE))))
            base = 0x9E3779B97F4A7C15
            with np.errstate(over="ignore"):
                make = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b % (1 << 64), dtype=np.uint64)]), dtype=np.uint64)
                self.power, self.back = make(base), make(pow(base, -1, 1 << 64))
        with np.errstate(over="ignore"):
            wide = points.astype(np.uint64)
            for salt in seeds(2, 13):
                sums = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(mix(wide + salt) * self.power[:n], out=sums[1:])
                yield mix((sums[stop] - sums[start]) * self.back[start] + (stop - start).astype(np.uint64))

    def slice(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each of some texts, which together make about a slice."""
        joined = _BETWEEN.join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kind = _classes()[points]
        odd = {int(i) for i in np.searchsorted(np.flatnonzero(kind == _MARK), np.flatnonzero(kind == _DOUBTFUL))}
        odd |= {i for i, t in enumerate(texts) if self.added.search(t)} if self.added and self.added.search(joined) else set()
        if odd:
            rest = iter(self.slice([t for i, t in enumerate(texts) if i not in odd]) if len(odd) < len(texts) else ())
            return [self.whole(t) if i in odd else next(rest) for i, t in enumerate(texts)]
        begin = np.flatnonzero(word_starts(points, kind))
        end = np.append(begin[1:], len(points))
        real = kind[begin] != _MARK
        key, twin = self._hashes(points, begin, end)
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.key, distinct), max(len(self.key) - 1, 0))
        known = (self.key[place] == distinct) & (self.twin[place] == twin[first]) if len(self.key) else np.zeros(len(distinct), dtype=bool)
        at, n = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        at[known], n[known] = self.at[place[known]], self.n[place[known]]
        new = np.flatnonzero(~known & real[first])
        found: list[int] = []
        if len(new):
            ids_of = self.words([joined[a:b] for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            n[new] = [len(x) for x in ids_of]
            at[new] = self.used + np.cumsum(n[new]) - n[new]
            found = list(chain.from_iterable(ids_of))
        if (twin != twin[first][which]).any():  # two words under one hash, which chance does not bring about
            return [self.whole(t) for t in texts]
        if self.used + len(found) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(len(self.store), len(found)), dtype=np.uint32)])
        self.store[self.used : self.used + len(found)] = found
        much = n[which]
        much[~real] = 0
        upto = np.cumsum(much)
        ids = self.store[np.repeat(at[which] - (upto - much), much) + np.arange(upto[-1] if len(upto) else 0)]
        self._keep(distinct[new], twin[first[new]], at[new], n[new], (end - begin)[first[new]], len(found))
        cuts = np.concatenate([[0], upto[~real], [len(ids)]]) if len(texts) > 1 else np.array([0, len(ids)])
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _keep(self, key, twin, at, n, length, ids: int) -> None:
        short = length <= LONGEST_KEPT
        key, twin, at, n = key[short], twin[short], at[short], n[short]
        self.used += ids
        if self.used > KEPT_IDS or len(self.key) + len(key) > KEPT_WORDS:
            self.forget()
            return
        place = np.searchsorted(self.key, key)
        fresh = np.ones(len(key), dtype=bool)
        inside = place < len(self.key)
        fresh[inside] = self.key[place[inside]] != key[inside]
        place = place[fresh]
        self.key, self.twin = np.insert(self.key, place, key[fresh]), np.insert(self.twin, place, twin[fresh])
        self.at, self.n = np.insert(self.at, place, at[fresh]), np.insert(self.n, place, n[fresh])

    def texts(self, texts: Iterator[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        held: list[str] = []
        size = 0
        for text in texts:
            if len(text) > SLICE:
                yield from self.slice(held) if held else ()
                held, size = [], 0
                yield np.concatenate([self.slice([part])[0] for part in _parts(text)])
                continue
            held.append(text)
            size += len(text)
            if size >= SLICE:
                yield from self.slice(held)
                held, size = [], 0
        yield from self.slice(held) if held else ()


def _parts(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to


@functools.lru_cache(maxsize=1)
def loaded(tokenizer_json: str) -> Words2Ids:
    """One store of words in each Python process."""
    return Words2Ids(tokenizer_json)
