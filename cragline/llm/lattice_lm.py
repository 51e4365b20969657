"""Language-model scoring by the likelihood of subword lattices.

A token (a run without white space, A-Z lower-cased) is a lattice: its edges are the pieces of an existing
unigram vocabulary and single bytes, each weighted by the vocabulary's own score. Every segmentation counts;
a log-space forward recursion gives the token's marginal probability M, and a text's is the product over its
tokens and the end mark:

    score = sum over tokens of log10(M(token) (N - E) / N) + log10(E / N)

N are the training tokens, E of them end marks; a step is an end mark with chance E / N, learned from the corpus.
The vocabulary file is an existing one and is never trained. A file whose scores are merge ranks gets weights from
them by Zipf's law, one with log-probabilities keeps these. The weights sum to 1 and pieces that begin with the
word mark stand first only, so the M of all tokens sum to at most 1.

Beside it ``learned_score`` gives each token an edge of its own, weighted by its training count less a discount d (Ney's
estimate from tokens seen once and twice); what the discounts of the V distinct tokens free weighs the lattice:

    P(token) = (c - d) / N, if c > 0, + (d V / N) M(token)

``fitted_score`` is the same with M under piece weights fitted to the corpus, so that tokens never seen cost what
their pieces cost there: one step of expectation maximisation over all distinct training tokens, from the vocabulary's weights.
A piece's expected uses come from a forward and a backward pass and are smoothed by the vocabulary's weights. In this fit,
tokens of over LONG bytes count by windows of WINDOW bytes.

A token's marginal does not depend on its document, so lattices are run once for each distinct
token of the corpus. Tokens that make up at least 1/HOT_TOKENS of the corpus (at most HOT_TOKENS
of them) are broadcast; the rest meets its documents in a shuffle join. The recursion looks back over the longest
piece only; tokens of over LONG bytes are walked in blocks, so a token of any length takes bounded memory beside itself.

Defined results: a null or empty text is just the end mark; repeated rows are scored each; with no
training rows every count is 0 and the end mark has one half; a null id is
never held out; an empty table gives an empty result; extra columns are ignored; whole texts of any length are scored.
"""

from __future__ import annotations

import copy
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, mix
from .quality_rules import held_out

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HOT_TOKENS = 250_000
SLOTS = 1 << 18
CELLS = 1_000_000  #: lattice edges in memory at once
LONG = 256  #: bytes from which on a token is walked by itself, in blocks
WINDOW = 192  #: bytes of such a token that the fit of the piece weights looks at together
SMOOTH = 0.1  #: uses of each piece, on average, that the fit adds by the vocabulary's weights


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """(pieces as bytes, natural log weights). A leading word mark is a space; 256 single bytes end the list."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores = [], []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i):
            continue
        raw = sp.id_to_piece(i).replace("▁", " ").encode()
        if b" " in raw[1:]:
            continue
        pieces.append(raw)
        scores.append(sp.get_score(i))
    score = np.array(scores)
    ranks = bool(len(score)) and float(np.abs(score - np.round(score)).max()) == 0.0 and score.min() < -1000
    weight = -np.log(2.0 - score) if ranks else score
    weight = np.concatenate([weight, np.full(256, weight.min() if len(weight) else 0.0)])
    return pieces + [bytes([b]) for b in range(256)], weight - np.logaddexp.reduce(weight)


class Lattice:
    """Pieces in a hash table of fixed slots, and the forward recursion over many tokens of one length at once."""

    def __init__(self, pieces: list[bytes], log_weight: np.ndarray):
        self.log = np.append(log_weight, -np.inf)  # the last stands for no piece
        self.none = len(pieces)
        self.byte = np.arange(len(pieces) - 256, len(pieces))
        self.longest = max(map(len, pieces))
        normal = pieces[: len(pieces) - 256]
        self.base = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, self.base, dtype=np.uint64)]), dtype=np.uint64)
        keys = np.array([self._hash(p) for p in normal], dtype=np.uint64)
        slot = (mix(keys) & np.uint64(SLOTS - 1)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        run = np.arange(len(order)) - np.searchsorted(slot[order], slot[order])
        ways = int(run.max()) + 1 if len(run) else 1
        self.keys, self.values = np.zeros((ways, SLOTS), dtype=np.uint64), np.full((ways, SLOTS), self.none, dtype=np.int32)
        self.keys[run, slot[order]], self.values[run, slot[order]] = keys[order], order

    def _hash(self, raw: bytes) -> int:
        h = 0
        for b in raw:
            h = (h * int(self.base) + b + 1) % (1 << 64)
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        slot = (mix(h) & np.uint64(SLOTS - 1)).astype(np.int64)
        out = np.full(len(h), self.none, dtype=np.int32)
        for keys, values in zip(self.keys, self.values, strict=True):
            hit = keys[slot] == h
            out[hit] = values[slot[hit]]
        return out

    def _forward(self, b: np.ndarray) -> np.ndarray:
        """Log marginal of each of the tokens, bytes[n, length]."""
        return self._walk(b)[0][-1]

    def _walk(self, b: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """(log sums over all paths to each end[length + 1, n], with ``keep`` the pieces that end there by their length)."""
        n, length = b.shape
        pieces: list[np.ndarray] = []
        h = np.zeros((length + 1, n), dtype=np.uint64)
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        with np.errstate(over="ignore"):
            for j in range(1, length + 1):
                h[j] = h[j - 1] * self.base + b[:, j - 1].astype(np.uint64) + np.uint64(1)
                k = min(j, self.longest)
                ids = self._find((h[j] - h[j - k : j] * self.power[k:0:-1, None]).ravel()).reshape(k, n)
                alpha[j] = self._sum(alpha[j - k : j] + self.log[ids], alpha[j - 1] + self.log[self.byte[b[:, j - 1]]])
                if keep:
                    pieces.append(ids)
        return alpha, pieces

    def uses(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece over all segmentations of each word, summed."""
        total = np.zeros(self.none + 1)
        for _, b in self._batches(words):
            total += self._uses(b)
        for w in words:
            if len(w) >= LONG:
                data = np.frombuffer(b" " + w, dtype=np.uint8)
                whole = len(data) // WINDOW
                for part in (data[: whole * WINDOW].reshape(whole, WINDOW), data[None, whole * WINDOW :]):
                    step = max(1, CELLS // (WINDOW * self.longest))
                    for g in range(0, len(part) if part.size else 0, step):
                        total += self._uses(part[g : g + step])
        return total[:-1]

    def _uses(self, b: np.ndarray) -> np.ndarray:
        total = np.zeros(self.none + 1)
        with np.errstate(invalid="ignore"):
            alpha, pieces = self._walk(b, True)
            share = np.zeros(alpha.shape)  # of a token's paths, those that pass an end
            share[-1] = 1
            for j in range(len(alpha) - 1, 0, -1):
                ids, byte = pieces[j - 1], self.byte[b[:, j - 1]]
                of_end = share[j] * np.exp(-alpha[j] + (alpha[j - len(ids) : j] + self.log[ids]))
                of_byte = share[j] * np.exp(alpha[j - 1] + self.log[byte] - alpha[j])
                share[j - len(ids) : j] += of_end
                share[j - 1] += of_byte
                some = ids != self.none
                total += np.bincount(ids[some], of_end[some], len(total)) + np.bincount(byte, of_byte, len(total))
        return total

    def weighted(self, log_weight: np.ndarray) -> Lattice:
        """The same pieces with other weights."""
        other = copy.copy(self)
        other.log = np.append(log_weight, -np.inf)
        return other

    @staticmethod
    def _sum(paths: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """log of the summed exp of ``paths`` over their first axis and ``byte``, which is finite."""
        top = np.maximum(paths.max(axis=0), byte)
        return top + np.log(np.exp(paths - top).sum(axis=0) + np.exp(byte - top))

    def _forward_long(self, raw: bytes, block: int = 4096) -> float:
        """Log marginal of one token: edges of a block of ends at once, then its sums one by one over the last ``longest``."""
        k = self.longest
        data = np.frombuffer(raw, dtype=np.uint8)
        alpha = [-math.inf] * (k - 1) + [0.0]  # of the ends before the block, the last one last
        h = np.zeros(k, dtype=np.uint64)  # hashes of the beginnings there; those before the token match nothing
        real = 1
        with np.errstate(over="ignore"):
            for s in range(0, len(data), block):
                b = data[s : s + block]
                hashes = np.empty(k + len(b), dtype=np.uint64)
                hashes[:k] = h
                x = int(h[-1])
                for i, v in enumerate(b.tolist()):
                    x = (x * int(self.base) + v + 1) & 0xFFFFFFFFFFFFFFFF
                    hashes[k + i] = x
                windows = np.lib.stride_tricks.sliding_window_view(hashes, k)[: len(b)]  # beginnings of pieces that end at each byte
                ids = self._find((hashes[k:, None] - windows * self.power[k:0:-1]).ravel()).reshape(len(b), k)
                if real < k:  # beginnings before the token's own
                    at = np.arange(len(b))[:, None] + np.arange(k) < k - real
                    ids[at] = self.none
                end, start = np.nonzero(ids != self.none)  # few pieces end at a byte
                weight = self.log[ids[end, start]].tolist()
                first = np.searchsorted(end, np.arange(len(b) + 1)).tolist()
                start = (end + start).tolist()
                byte = self.log[self.byte[b]].tolist()
                line = alpha + byte  # the block's own values are put in place one by one
                for i in range(len(b)):
                    paths = [line[start[e]] + weight[e] for e in range(first[i], first[i + 1])]
                    paths.append(line[i + k - 1] + byte[i])
                    top = max(paths)
                    line[i + k] = top + math.log(sum([math.exp(p - top) for p in paths]))
                alpha, h, real = line[-k:], hashes[-k:], min(k, real + len(b))
        return alpha[-1]

    def _batches(self, words: list[bytes]):
        """(index, bytes[n, length]) of words of one length, the word mark included."""
        length = np.array([len(w) for w in words], dtype=np.int64) + 1
        for size in np.unique(length[length <= LONG]):
            at = np.flatnonzero(length == size)
            step = max(1, CELLS // (int(size) * min(int(size), self.longest)))
            for g in range(0, len(at), step):
                some = at[g : g + step]
                yield some, np.frombuffer(b"".join(b" " + words[i] for i in some), dtype=np.uint8).reshape(len(some), size)

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability over all its segmentations."""
        out = np.zeros(len(words))
        with np.errstate(invalid="ignore"):
            for at, b in self._batches(words):
                out[at] = self._forward(b)
            for i, w in enumerate(words):
                if len(w) >= LONG:
                    out[i] = self._forward_long(b" " + w)
        return out


def with_whole_edges(marginal: np.ndarray, count: np.ndarray, discount: float, n: int, freed: float) -> np.ndarray:
    """Natural log of (count - discount) / n, if seen, + freed * marginal."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.maximum(count - discount, 0.0) / max(n, 1)), marginal + np.log(freed))


def fitted(log_weight: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """Log weights in proportion to the expected uses, smoothed by the weights they were found under."""
    extra = SMOOTH * len(log_weight)
    return np.log((uses + np.exp(log_weight) * extra) / (uses.sum() + extra))


def _counts(train_col: str, flush: int = 400_000):
    """Token counts of documents, combined per task up to ``flush`` distinct tokens."""

    def out(everything: Counter, train: Counter):
        words = list(everything)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()), pa.array([everything[w] for w in words], pa.int64())], names=["word", "c_train", "c_all"])

    def run(batches):
        everything, train = Counter(), Counter()
        for batch in batches:
            for text, learn in zip(column(batch, "text"), column(batch, train_col), strict=True):
                words = (text.as_py() or "").encode().lower().split()
                everything.update(words)
                if learn.as_py():
                    train.update(words)
                if len(everything) > flush:
                    yield out(everything, train)
                    everything, train = Counter(), Counter()
        if everything:
            yield out(everything, train)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, learned_score, fitted_score) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out("doc_id", modulus, remainder)).withColumn("learn", ~F.col("held_out"))
    words = rows.mapInArrow(_counts("learn"), "word binary, c_train long, c_all long").groupBy("word").agg(F.sum("c_train").alias("c_train"), F.sum("c_all").alias("c_all"))
    words = materialize(words, "words")
    ends = rows.where("learn").count()
    seen = [F.count_if(F.col("c_train") == k) for k in (1, 2)]
    n, distinct, every, once, twice = words.agg(F.coalesce(F.sum("c_train"), F.lit(0)), F.count_if(F.col("c_train") > 0), F.coalesce(F.sum("c_all"), F.lit(0)), *seen).first()
    n, v = n + ends, distinct + (ends > 0)
    discount = once / (once + 2 * twice) if once else 0.5
    freed = discount * distinct / n if distinct else 0.5

    p_end = ends / n if n > ends else 0.5
    log_end, log_more = math.log10(p_end), math.log10(1 - p_end)
    pieces, own = read_vocabulary(vocabulary)
    model = spark.sparkContext.broadcast((pieces, own))

    def uses(batches):
        lattice = Lattice(*model.value)
        total = np.zeros(lattice.none)
        for batch in batches:
            total += lattice.uses(column(batch, "word").to_pylist())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "uses"])

    found = np.zeros(len(own))
    for r in words.where("c_train > 0").select("word").mapInArrow(uses, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # at most one row a piece
        found[r["piece"]] = r["uses"]
    weights = spark.sparkContext.broadcast(fitted(own, found))

    def lattices(batches):
        lattice = Lattice(*model.value)
        fit = lattice.weighted(weights.value)
        for batch in batches:
            count = column(batch, "c_train").to_numpy()
            value = lattice.marginals(column(batch, "word").to_pylist())
            learned = with_whole_edges(value, count, discount, n, freed) / math.log(10)
            again = with_whole_edges(fit.marginals(column(batch, "word").to_pylist()), count, discount, n, freed) / math.log(10)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("word", "c_train", "c_all")), pa.array(value / math.log(10) + log_more), pa.array(learned), pa.array(again)], names=["word", "c_train", "c_all", "lattice", "learned", "fitted"])

    scored = materialize(words.mapInArrow(lattices, "word binary, c_train long, c_all long, lattice double, learned double, fitted double"), "scored")
    least = max(1, -(-every // HOT_TOKENS))
    hot = scored.where(F.col("c_all") >= least).select("word", "c_train", "lattice", "learned", "fitted").toPandas()
    table = spark.sparkContext.broadcast({w: (math.log10(c + 1), int(c > 0), *x) for w, c, *x in zip(hot["word"].map(bytes), hot["c_train"], hot["lattice"], hot["learned"], hot["fitted"], strict=True)})

    def look_up(batches):
        hot, part, k = table.value, TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            out: list[list] = [[] for _ in PARTS]
            for ident, text, held in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), column(batch, "held_out").to_pylist(), strict=True):
                count = Counter((text.as_py() or "").encode().lower().split())
                base = marginal = learned = refit = 0.0
                known = tokens = 0
                cold = []
                for w, tf in count.items():
                    tokens += tf
                    if (got := hot.get(w)) is not None:
                        base += tf * got[0]
                        known += tf * got[1]
                        marginal += tf * got[2]
                        learned += tf * got[3]
                        refit += tf * got[4]
                    else:
                        cold.append((w, tf))
                row = part + k
                k += 1
                m = len(cold)
                own = b" %d" % row  # no token holds a space: this row meets none, and such rows spread evenly
                first = (row, ident, held, own, 0, tokens, known, base, marginal, learned, refit)
                rest = ([row] * m, [None] * m, [None] * m, [w for w, _ in cold], [t for _, t in cold], [0] * m, [0] * m, [0.0] * m, [0.0] * m, [0.0] * m, [0.0] * m)
                for o, x, more in zip(out, first, rest, strict=True):
                    o.append(x)
                    o.extend(more)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, PARTS.values(), strict=True)], names=list(PARTS))
                    out = [[] for _ in PARTS]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, PARTS.values(), strict=True)], names=list(PARTS))

    parts = rows.select("doc_id", "text", "held_out").mapInArrow(look_up, "row long, doc_id long, held_out boolean, word binary, tf long, tokens long, known long, base double, marginal double, learned double, refit double")
    cold = scored.where(F.col("c_all") < least).select(F.col("word").alias("w"), F.log10(F.col("c_train") + F.lit(1.0)).alias("lb"), (F.col("c_train") > 0).cast("long").alias("lk"), "lattice", F.col("learned").alias("ll"), "fitted")
    # a document's own sums ride on one row more, so documents are read once
    joined = parts.join(cold, parts["word"] == cold["w"], "left")
    with_cold = lambda own, each: F.sum(F.col(own) + F.col("tf") * F.coalesce(F.col(each), F.lit(0))).alias(own)
    both = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("tokens").alias("tokens"),
        with_cold("known", "lk"), with_cold("base", "lb"), with_cold("marginal", "lattice"), with_cold("learned", "ll"), with_cold("refit", "fitted"),
    )
    per_token = math.log10(n + 1 * (v + 1))
    return both.select(
        "doc_id", "held_out", (F.col("tokens") + 1).alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10(ends + 1) - (F.col("tokens") + 1) * per_token).alias("base_score"), (F.col("marginal") + log_end).alias("score"), (F.col("learned") + log_end).alias("learned_score"), (F.col("refit") + log_end).alias("fitted_score"),
    )


PARTS = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "word": pa.binary(), "tf": pa.int64(), "tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "marginal": pa.float64(), "learned": pa.float64(), "refit": pa.float64()}
