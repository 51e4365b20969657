"""Spelling variants: words one edit apart, grouped under the most frequent form.

Words are counted by plain aggregates. Words frequent enough are put in code-point order and cut into shards of bounded
bytes; each shard becomes a compact trie (nodes in depth-first order, the edges as one sorted list of node and character). Shards are broadcast a bounded
chunk at a time, and each word's Levenshtein automaton of distance one is intersected with every shard depth-first. The automaton is the parametric one of Schulz and Mihov: its
state after a path is a position in the word and one of five shapes, so each trie node is visited once a word at most. Many words go down a trie
together: a stack holds blocks of (word, position, shape, node), and the block on top is taken further, so memory is bounded by the depth.
A word's accepting neighbours in a shard are reduced at once to their number and the best, and these by word over all shards.

What a broadcast holds is at most ``CHUNK_BYTES`` of words, however large the vocabulary (a longer word is a chunk by itself); the number of rounds grows with the vocabulary.

Defined results: a null or empty text has no words; a row without an id is counted with the empty string in place of its id; repeated rows count each;
words of any length take part; an empty table gives an empty result; extra columns are ignored. Ties of the best form go to the smallest in code-point
order. A form has at least twice its word's count, so chains end.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, join_hot, materialize, partitions, running_total

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, MUCH_MORE = 5, 3, 2
SHARD_BYTES = 1 << 20  #: UTF-8 bytes of words in a trie
CHUNK_BYTES = 8 << 20  #: bytes of words whose tries are broadcast at once
BLOCK = 1 << 15  #: states that go down a trie together


# ---------------------------------------------------------------- words


def slipped(doc_id: Column, run: Column) -> Column:
    """``run``, without one code point if the hash of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run).cast("long")).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH code points that occur LEAST_COUNT times."""
    small = F.translate(F.col(text_col).cast("string"), CAPITALS, SMALL)
    runs = docs.select(F.col(id_col).alias("_id"), F.explode(F.regexp_extract_all(small, F.lit(RUN), F.lit(0))).alias("_run"))
    words = runs.where(F.char_length("_run") >= LEAST_LENGTH).select(slipped(F.col("_id"), F.col("_run")).alias("word"))
    return words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- tries


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, where each begins and the last ends)."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64), np.concatenate([[0], np.cumsum(length)])


class Trie:
    """Nodes numbered in depth-first order; edges sorted by (node, character); words, none of them empty, in order at their nodes."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.counts = words, counts
        points, first = code_points(words)
        length = np.diff(first)
        # how many characters a word shares with the one before it; only the others make nodes
        shared = np.zeros(len(words), dtype=np.int64)
        for i in range(1, len(words)):
            shared[i] = _common(words[i - 1], words[i])
        made = length - shared
        base = np.cumsum(made) - made + 1  # the root is 0
        total = int(made.sum()) + 1
        owner = np.repeat(np.arange(len(words)), made)
        depth = np.arange(total - 1) - np.repeat(base - 1, made) + shared[owner]
        char = points[first[owner] + depth] if total > 1 else np.zeros(0, dtype=np.int64)
        parent = np.arange(total - 1)  # of node k + 1: the node before it, unless a word branches off there
        parent[(base - 1)[made > 0]] = self._branches(shared, base, made)[made > 0]
        order = np.lexsort((char, parent))
        self.edge, self.child = (parent[order] << 21) | char[order], np.arange(1, total)[order]
        self.begin = np.searchsorted(self.edge, np.arange(total + 1) << 21)
        self.word_at = np.full(total, -1, dtype=np.int64)
        self.word_at[base + made - 1] = np.arange(len(words))

    @staticmethod
    def _branches(shared: np.ndarray, base: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Node at depth ``shared`` on the path of the word before, for each word."""
        out = np.zeros(len(shared), dtype=np.int64)
        lo, at = [0], [0]  # runs of the present path: from depth lo (exclusive) on, nodes at, at + 1, ...
        for i in range(len(shared)):
            s = int(shared[i])
            while len(lo) > 1 and lo[-1] >= s and s > 0:
                lo.pop()
                at.pop()
            if s == 0:
                lo, at = [0], [0]
            out[i] = 0 if s == 0 else at[-1] + (s - lo[-1] - 1)
            lo.append(s)
            at.append(int(base[i]))
        return out

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the nodes, edge) of all edges that leave ``node``."""
        n = self.begin[node + 1] - self.begin[node]
        which = np.repeat(np.arange(len(node)), n)
        return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[node], n)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Edge from each node by each character, or -1."""
        key = (node << 21) | char
        k = np.searchsorted(self.edge, key)
        k[k == len(self.edge)] = 0
        return np.where(self.edge[k] == key, k, -1) if len(self.edge) else np.full(len(key), -1)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


# Shapes of the automaton at position i of a word, as positions with the edits used: none yet at i; used at i; at i and
# i + 1; at i and i + 2; at i, i + 1 and i + 2.
CLEAN, ONE, TWO, GAP, THREE = range(5)
_USED = {ONE: (0,), TWO: (0, 1), GAP: (0, 2), THREE: (0, 1, 2)}


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """[shape, which of the next three characters match]: next shape (-1: none) and how far the position moves."""
    shape, move = np.full((5, 8), -1, dtype=np.int64), np.zeros((5, 8), dtype=np.int64)
    of = {v: k for k, v in _USED.items()}
    for match in range(8):
        hit = [match >> k & 1 for k in range(3)]
        if hit[0]:
            shape[CLEAN, match], move[CLEAN, match] = CLEAN, 1
        else:  # inserted, replaced, or the word's character deleted and the next one matched
            shape[CLEAN, match] = THREE if hit[1] else TWO
        for s, used in _USED.items():
            after = [k + 1 for k in used if hit[k]]
            if after:
                shape[s, match], move[s, match] = of[tuple(k - after[0] for k in after)], after[0]
    return shape, move


NEXT_SHAPE, NEXT_MOVE = _moves()


def near_words(words: list[str], trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """(which word, which word of the trie) of all pairs exactly one edit apart, each once."""
    points, first = code_points(words)
    points = np.concatenate([points, np.full(3, -1)])
    end = first[1:]
    at = lambda w, i: np.where(first[w] + i < end[w], points[np.minimum(first[w] + i, len(points) - 1)], -1)
    found_a, found_b = [], []
    n = len(words)
    stack = [(w, np.zeros(len(w), np.int64), np.full(len(w), CLEAN), np.zeros(len(w), np.int64)) for w in np.array_split(np.arange(n), max(1, n // (BLOCK // 64)))]
    while stack:
        word, i, shape, node = stack.pop()
        if len(word) > BLOCK:
            half = len(word) // 2
            stack += [tuple(x[half:] for x in (word, i, shape, node)), tuple(x[:half] for x in (word, i, shape, node))]
            continue
        clean = shape == CLEAN
        which, edge = trie.children(node[clean])
        which = np.flatnonzero(clean)[which]
        used = np.flatnonzero(~clean)
        tried: list[np.ndarray] = []
        for k in range(3):  # only characters of the word lead on from a used edit
            on = used[(shape[used] == ONE) * (k == 0) + (shape[used] == TWO) * (k < 2) + (shape[used] == GAP) * (k != 1) + (shape[used] == THREE) > 0]
            c = at(word[on], i[on] + k)
            new = c >= 0
            for j in range(k):  # a character that was tried already
                new &= (c != at(word[on], i[on] + j)) | ((shape[on] == GAP) & (j == 1))
            e = np.full(len(on), -1)
            e[new] = trie.step(node[on[new]], c[new])
            tried.append(on[e >= 0])
            edge = np.concatenate([edge, e[e >= 0]])
        which = np.concatenate([which, *tried])
        char, w, p = trie.edge[edge] & ((1 << 21) - 1), word[which], i[which]
        match = sum((at(w, p + k) == char).astype(np.int64) << k for k in range(3))
        new_shape = NEXT_SHAPE[shape[which], match]
        on = np.flatnonzero(new_shape >= 0)
        if len(on) == 0:
            continue
        w, p, s, node = w[on], p[on] + NEXT_MOVE[shape[which], match][on], new_shape[on], trie.child[edge[on]]
        left = end[w] - first[w] - p
        stay = left >= -1  # positions beyond the end of the word lead nowhere
        w, p, s, node, left = w[stay], p[stay], s[stay], node[stay], left[stay]
        near = (s == CLEAN) & (left == 1) | (s == ONE) & (left == 0) | (s == TWO) & ((left == 0) | (left == 1)) | (s == GAP) & ((left == 0) | (left == 2)) | (s == THREE) & (left >= 0) & (left <= 2)
        hit = near & (trie.word_at[node] >= 0)
        found_a.append(w[hit])
        found_b.append(trie.word_at[node[hit]])
        stack.append((w, p, s, node))
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])


def best_of(words: list[str], trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which word, neighbours in the trie, the best of them) for words that have any."""
    a, b = near_words(words, trie)
    order = np.lexsort((b, -trie.counts[b], a))
    a, b = a[order], b[order]
    head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, dtype=np.int64)
    return a[head], np.diff(np.append(head, len(a))), b[head]


# ---------------------------------------------------------------- the operator


def _chunks(words: DataFrame, shard_bytes: int, chunk_bytes: int) -> tuple[DataFrame, list[int]]:
    """words with ``chunk`` and ``shard`` by place in code-point order, and the chunks there are."""
    placed = running_total(words.withColumn("bytes", F.octet_length("word").cast("long")), ["word"], "bytes")
    placed = placed.select("word", "n", F.expr(f"(upto - bytes) div {chunk_bytes}").alias("chunk"), F.expr(f"(upto - bytes) div {shard_bytes}").alias("shard"))
    placed = materialize(placed, "vocabulary")
    return placed, [r[0] for r in placed.select("chunk").distinct().orderBy("chunk").collect()]


def _sorted_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: the words of a shard in order, each once written after what it shares with the one before (front coding)."""
    words, n = (list(x) for x in zip(*sorted(zip(pdf["word"], pdf["n"], strict=True)), strict=True))
    shared = [0] + [_common(a, b) for a, b in zip(words[:-1], words[1:], strict=True)]
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "shared": [shared], "rest": [[w[k:] for w, k in zip(words, shared, strict=True)]], "n": [n]})


_built: dict[str, list[Trie]] = {}


def _tries(token: str, rows: list) -> list[Trie]:
    """Tries of a chunk, which a Python process builds once and keeps until the next chunk."""
    if token in _built:
        return _built[token]
    _built.clear()
    out = _built[token] = []
    for r in rows:
        words, last = [], ""
        for k, rest in zip(r["shared"], r["rest"], strict=True):
            last = last[:k] + rest
            words.append(last)
        out.append(Trie(words, np.array(r["n"], dtype=np.int64)))
    return out


def nearest_forms(words: DataFrame, shard_bytes: int = SHARD_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(word, n, n_near, best, best_n) from (word, n): number of words one edit apart, the most frequent of them and its count."""
    spark = words.sparkSession
    placed, chunks = _chunks(words, shard_bytes, chunk_bytes)
    parts = []
    for chunk in chunks:
        shards = placed.where(F.col("chunk") == chunk).groupBy("shard").applyInPandas(_sorted_shard, "shard long, shared array<int>, rest array<string>, n array<long>")
        sent = spark.sparkContext.broadcast([r.asDict() for r in shards.orderBy("shard").collect()])  # chunk_bytes of words

        def find(batches, sent=sent, token=uuid.uuid4().hex):
            for batch in batches:
                tries = _tries(token, sent.value)
                mine = column(batch, "word").to_pylist()
                for trie in tries:
                    a, count, b = best_of(mine, trie)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([mine[k] for k in a], pa.string()), pa.array(count, pa.int64()), pa.array([trie.words[k] for k in b], pa.string()), pa.array(trie.counts[b], pa.int64())],
                        names=["word", "n_near", "best", "best_n"],
                    )

        parts.append(materialize(placed.select("word").repartition(partitions(spark), "word").mapInArrow(find, "word string, n_near long, best string, best_n long"), "near"))
        sent.destroy()
    if not parts:
        return placed.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    near = parts[0]
    for other in parts[1:]:
        near = near.unionByName(other)
    least = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))
    return placed.select("word", "n").join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms(word, form). Chains double each round."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        targets = now.groupBy(F.col("root").alias("word")).agg(F.count("*").alias("uses"))
        onward = targets.join(now, "word").select(F.col("word").alias("root"), F.col("root").alias("further"), "uses")
        onward = materialize(onward, "onward")
        if onward.isEmpty():
            return now
        now = materialize(join_hot(now, onward, ["root"], "uses", now.count()).select("word", F.coalesce("further", "root").alias("root")), "chains")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents; see the module."""
    near = materialize(nearest_forms(word_counts(docs, id_col, text_col), shard_bytes, chunk_bytes), "nearest")
    more = F.col("best_n") >= F.col("n") * MUCH_MORE
    formed = near.select("word", F.when(more, F.col("best")).alias("form"), "n", "n_near", F.when(more, F.col("best_n")).alias("form_n"))
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
