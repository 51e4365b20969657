"""Benchmark decontamination: size-partitioned min-hash containment search, verified exactly.

In the manner of LSH Ensemble (Zhu et al. 2016) the domains searched are partitioned by size, so
that a bound on size turns containment of a short item into a Jaccard bound that min-hash can find.
Long documents would drown a short item, so every document is covered by spans: for each size class
m = 8, 16, 32, ... blocks of m shingles, two neighbouring blocks making a span; an item belongs to
the smallest class that holds it, and wherever it stands it lies within one span at most 4 times
its size (2m <= 4q). Tokens are computed once for blocks of 8 and merged upwards by minima. A
span and an item that agree on one of TOKENS min-hash tokens are a candidate. Items under 8
distinct shingles, and those that repeat any of theirs, which a span as long as they are would drown, are
the class of single shingles, which is exact. A candidate counts if the document's
distinct shingles hold at least ``threshold`` of the item's.

At containment 0.8 the Jaccard share is over 0.19, so a copy is missed with chance under
0.81 ** 64 = 1.4e-6; a whole copy with chance under 0.75 ** 64 = 1e-8.

The benchmark is the stated query set: it is sent to the documents in chunks of about CHUNK_WORDS
words, one at a time and as many passes as that takes; what a pass finds is written and its chunk dropped before the next
is read, so neither the driver nor an executor ever holds more than one chunk.

Defined results: null or empty texts and items match nothing; an item of one to four words is one
shingle, matched against runs of as many words; repeated items and rows each give their own result
rows; empty tables give an empty result; ids may be null; whole texts of any length are searched; extra columns are
ignored, and stay in what ``decontaminate`` returns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, Words, column, materialize, seeds, text_slices

TOKENS = 64
LEAST = 8  #: shingles of the smallest block
CHUNK_WORDS = 2_000_000
FILTER_BITS = 16

FOUND = "doc_id long, item_id long, shared long, item_shingles long, containment double"


class Items:
    """A chunk of benchmark items: their shingle sets by size class, with lookup tables of their tokens."""

    def __init__(self, rows: list[tuple[int | None, str | None]], width: int = SHINGLE_WORDS, tokens: int = TOKENS):
        self.width, self.factors = width, seeds(tokens, 17)
        self.ids: list[int | None] = []
        self.sets: list[np.ndarray] = []
        self.short: dict[int, list[int]] = {}  # item numbers by words, for items under ``width`` words
        classes: dict[int, list[int]] = {}
        for a, b, data, offsets in text_slices(pa.array([t for _, t in rows], pa.string())):
            w = Words(data, offsets)
            h, first = w.shingles(width)
            words = np.diff(w.first)
            for i in range(b - a):
                if not words[i]:
                    continue
                number = len(self.ids)
                self.ids.append(rows[a + i][0])
                if words[i] < width:
                    alone, f = w.shingles(int(words[i]))
                    self.sets.append(alone[f[i] : f[i + 1]])
                    self.short.setdefault(int(words[i]), []).append(number)
                    continue
                own = np.unique(h[first[i] : first[i + 1]])
                self.sets.append(own)
                length = int(first[i + 1] - first[i])
                m = 1
                if len(own) >= LEAST and len(own) == length:
                    m = LEAST
                    while m < length:
                        m *= 2
                classes.setdefault(m, []).append(number)
        self.single = self._flat(classes.pop(1, []))
        self.by_words = {n: self._flat(numbers) for n, numbers in self.short.items()}
        self.classes = {m: self._tokens(numbers) for m, numbers in sorted(classes.items())}

    def _flat(self, numbers: list[int]):
        """(sorted shingles, item numbers in step) or None."""
        if not numbers:
            return None
        h = np.concatenate([self.sets[i] for i in numbers])
        o = np.repeat(numbers, [len(self.sets[i]) for i in numbers])
        order = np.argsort(h, kind="stable")
        return h[order], o[order]

    def _tokens(self, numbers: list[int]):
        """(filter of low bits, [(sorted tokens, item numbers) by position])."""
        table, filters = [], np.zeros((len(self.factors), 1 << FILTER_BITS), dtype=bool)
        with np.errstate(over="ignore"):
            for i, f in enumerate(self.factors):
                t = np.array([(self.sets[k] * f).min() >> np.uint64(32) for k in numbers], dtype=np.uint32)
                filters[i, t & np.uint32((1 << FILTER_BITS) - 1)] = True
                order = np.argsort(t, kind="stable")
                table.append((t[order], np.array(numbers)[order]))
        return filters, table

    @staticmethod
    def _matches(keys: np.ndarray, items: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into values, item) wherever a value is a key."""
        lo, hi = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
        n = hi - lo
        at = np.repeat(np.arange(len(values)), n)
        within = np.arange(len(at)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return at, items[np.repeat(lo, n) + within]

    def search(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of every text in the slice that holds enough of an item."""
        w = Words(data, offsets)
        h, first = w.shingles(self.width, short=False)
        n = len(offsets) - 1
        pairs = [self._spans(h, first)] if self.classes and len(h) else []
        if self.single is not None and len(h):
            owner = np.repeat(np.arange(n), np.diff(first))
            at, item = self._matches(*self.single, h)
            pairs.append(owner[at] * len(self.ids) + item)
        out = self._verify(np.unique(np.concatenate(pairs)), h, first, threshold) if pairs else []
        for words, flat in self.by_words.items():
            g, f = w.shingles(words, short=False)
            if len(g):
                at, item = self._matches(*flat, g)
                owner = np.repeat(np.arange(n), np.diff(f))
                out += [(int(c // len(self.ids)), int(c % len(self.ids)), 1) for c in np.unique(owner[at] * len(self.ids) + item)]
        return out

    def _verify(self, codes: np.ndarray, h: np.ndarray, first: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
        out, last, own = [], -1, h[:0]
        for code in codes.tolist():
            text, item = divmod(code, len(self.ids))
            if text != last:
                last, own = text, np.unique(h[first[text] : first[text + 1]])
            want = self.sets[item]
            at = np.minimum(np.searchsorted(own, want), len(own) - 1)
            shared = int((own[at] == want).sum())
            if shared >= threshold * len(want) - 1e-9:
                out.append((text, item, shared))
        return out

    def _spans(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Candidate codes (text * items + item) by min-hash tokens of spans, class by class."""
        count = np.diff(first)
        blocks = -(-count // LEAST)
        at = np.concatenate([np.arange(s, e, LEAST) for s, e in zip(first[:-1], first[1:], strict=True)])
        tokens = np.empty((len(self.factors), len(at)), dtype=np.uint32)
        scratch = np.empty_like(h)
        with np.errstate(over="ignore"):
            for i, f in enumerate(self.factors):
                np.multiply(h, f, out=scratch)
                tokens[i] = np.minimum.reduceat(scratch, at) >> np.uint64(32)
        codes, m, largest = [], LEAST, max(self.classes)
        while True:
            owner = np.repeat(np.arange(len(blocks)), blocks)
            start = np.concatenate([[0], np.cumsum(blocks)])
            if m in self.classes:
                ends = np.zeros(len(owner), dtype=bool)
                ends[start[1:][blocks > 0] - 1] = True  # a text's last block has no right neighbour
                filters, table = self.classes[m]
                for i in range(len(tokens)):
                    span = tokens[i].copy()
                    np.minimum(span[:-1], tokens[i][1:], out=span[:-1], where=~ends[:-1])
                    maybe = np.flatnonzero(filters[i][span & np.uint32((1 << FILTER_BITS) - 1)])
                    if len(maybe):
                        k, item = self._matches(*table[i], span[maybe])
                        codes.append(owner[maybe[k]] * len(self.ids) + item)
            if m >= largest:
                break
            m *= 2
            pairs = -(-blocks // 2)
            index = np.arange(len(owner)) - start[owner]
            left = np.flatnonzero(index % 2 == 0)
            right = np.minimum(left + 1, len(owner) - 1)
            lone = owner[right] != owner[left]
            right[lone] = left[lone]
            tokens = np.minimum(tokens[:, left], tokens[:, right])
            blocks = pairs
        return np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)


def chunks(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", chunk_words: int = CHUNK_WORDS, width: int = SHINGLE_WORDS) -> Iterator[tuple[Broadcast, bool]]:
    """The benchmark in broadcast parts of about ``chunk_words`` words, each with whether it is the only one."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (chunk_words * 6)))
    for c in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == c).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Items([(r[0], r[1]) for r in rows], width)), n == 1


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, chunk_words: int = CHUNK_WORDS, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): every document and item that it holds."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for sent, only in chunks(benchmark, item_col, item_text_col, chunk_words, width):

        def run(batches, sent=sent):
            chunk = sent.value
            for batch in batches:
                ids = column(batch, "doc_id")
                for a, b, data, offsets in text_slices(column(batch, "text")):
                    found = chunk.search(data, offsets, threshold) if chunk.ids else []
                    if found:
                        t, i, shared = zip(*found, strict=True)
                        size = np.array([len(chunk.sets[k]) for k in i])
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(np.array(t) + a)), pa.array([chunk.ids[k] for k in i], pa.int64()), pa.array(np.array(shared, np.int64)), pa.array(size.astype(np.int64)), pa.array(np.array(shared) / size)],
                            names=["doc_id", "item_id", "shared", "item_shingles", "containment"],
                        )

        part = slim.mapInArrow(run, FOUND)
        if not only:
            part = materialize(part, "found")
            sent.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = 0.8, **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; decided row by row, without a join."""
    for sent, only in chunks(benchmark, **options):

        def run(batches, sent=sent):
            chunk = sent.value
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for a, _, data, offsets in text_slices(column(batch, text_col).cast(pa.string())):
                    keep[[a + t for t, _, _ in chunk.search(data, offsets, threshold)] if chunk.ids else []] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if not only:
            docs = materialize(docs, "clean")
            sent.unpersist()
    return docs
