"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a bounded sample of labelled rows; every path from a root to a node
is a rule, a conjunction of comparisons. Lasso logistic regression (accelerated proximal gradient)
over the rules and the winsorised statistics keeps a few of them, and these are compiled into one
Spark column expression, so scoring runs inside the JVM over statistics of whole texts.

Defined results: a null or empty text has zero for every statistic and gets a score like any other;
without usable labels of both kinds every score is the share of good labels (0.5 without labels);
labels that are null or neither 0 nor 1 are not learned from, and of repeated labels of a document
the largest counts; repeated rows are scored alike; a null id is never held out; an empty table gives an empty result;
whole texts of any length are scored; extra columns are ignored, and stay in what ``keep_good`` returns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Words, column, fresh, materialize, text_slices

FIT_ROWS = 20_000  #: most labelled rows that the rules are fitted on, chosen by hash of the id
STATISTICS = [
    "words", "word_bytes", "upper_share", "digit_share", "symbol_share", "bang_share", "pipe_share", "stop_rate",
    "line_rate", "distinct_share", "top_share", "adjacent_share", "repeated_line_share", "long_word_share", "symbol_word_share",
]

_CLASS = np.zeros(256, dtype=np.int64)  # of bytes: 0 other, 1 upper, 2 lower, 3 digit, 4 white space, 5 stop, 6 bang, 7 pipe, 8 symbol
_CLASS[[ord(c) for c in "#$%&*@^~<>=+\\/{}[]_`"]] = 8
_CLASS[ord("|")], _CLASS[ord("!")] = 7, 6
_CLASS[[ord(c) for c in ".?,;:"]] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 1


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """float64[texts, STATISTICS] of the texts in a slice."""
    n = len(offsets) - 1
    kinds = _CLASS[data]
    counts = np.zeros((n, 9))
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * 9 + kinds, minlength=n * 9).reshape(n, 9).astype(float)
    w = Words(data, offsets)
    words = np.diff(w.first).astype(float)
    word_owner = np.repeat(np.arange(n), np.diff(w.first))
    per = lambda mask: np.bincount(word_owner[mask], minlength=n) if len(mask) else np.zeros(n)
    over = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    distinct, top = np.zeros(n), np.zeros(n)
    adjacent = np.zeros(len(w.hash), dtype=bool)
    if len(w.hash):
        order = np.lexsort((w.hash, word_owner))
        h, o = w.hash[order], word_owner[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
        at = np.flatnonzero(new)
        runs = np.diff(np.concatenate([at, [len(h)]]))
        distinct = np.bincount(o[at], minlength=n).astype(float)
        np.maximum.at(top, o[at], runs)
        adjacent[1:] = (w.hash[1:] == w.hash[:-1]) & (word_owner[1:] == word_owner[:-1])
        ends = kinds[w.stops - 1]
        starts = kinds[w.starts]
        marked = (ends >= 6) | (starts >= 7)
    else:
        marked = adjacent
    # lines: hash of the words between two line ends
    line = np.cumsum(data == 10)
    repeated, lines = np.zeros(n), np.zeros(n)
    if len(w.hash):
        key = word_owner * (int(line[-1]) + 2) + line[w.starts]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        with np.errstate(over="ignore"):
            place = (np.arange(len(key)) - np.repeat(cut, np.diff(np.concatenate([cut, [len(key)]])))).astype(np.uint64)
            lh = np.add.reduceat(w.hash * (place * np.uint64(2) + np.uint64(1)), cut)
        lo = word_owner[cut]
        lines = np.bincount(lo, minlength=n).astype(float)
        order = np.lexsort((lh, lo))
        same = np.concatenate([[False], (lh[order][1:] == lh[order][:-1]) & (lo[order][1:] == lo[order][:-1])])
        repeated = np.bincount(lo[order][same], minlength=n).astype(float)
    letters = counts[:, 1] + counts[:, 2]
    chars = size.astype(float)
    return np.column_stack([
        words, over(np.bincount(word_owner, w.length, n) if len(w.hash) else np.zeros(n), words), over(counts[:, 1], letters), over(counts[:, 3], chars), over(counts[:, 8], chars),
        over(counts[:, 6], chars), over(counts[:, 7], chars), over(counts[:, 5], words), over(lines, words), over(distinct, words), over(top, words), over(per(adjacent), words),
        over(repeated, lines), over(per(w.length > 24), words), over(per(marked), words),
    ])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one double per statistic) of every row's whole text."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(column(batch, "text"), lower=False):
                x = _statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(a, b - a), *(pa.array(c) for c in x.T)], names=["doc_id", *STATISTICS])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def with_statistics(docs: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """``docs`` with one more column for each statistic, named with ``prefix``; no shuffle."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(column(batch, text_col).cast(pa.string()), lower=False):
                x = _statistics(data, offsets)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c) for c in x.T)], names=[*part.schema.names, *(prefix + s for s in STATISTICS)])

    schema = StructType([*docs.schema.fields, *(StructField(prefix + s, DoubleType()) for s in STATISTICS)])
    return docs.mapInArrow(run, schema)


# ---------------------------------------------------------------- rules


@dataclass
class Ensemble:
    """Rules as ((statistic, above, threshold), ...), linear terms and their weights."""

    intercept: float = 0.0
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)
    linear: list[tuple[str, float, float, float]] = field(default_factory=list)  # statistic, low, high, weight

    def column(self, prefix: str = "") -> Column:
        """The score as one column expression over the statistics; ``prefix``: what stands before their names."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            test = F.lit(True)
            for name, above, at in rule:
                test = test & ((F.col(prefix + name) > float(at)) if above else (F.col(prefix + name) <= float(at)))
            total = total + F.when(test, float(weight)).otherwise(0.0)
        for name, low, high, weight in self.linear:
            total = total + F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(prefix + name))) * float(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, bins: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int):
    """(rules of the tree's nodes, prediction): splits by gain of second-order boosting over quantile bins."""
    rules, out = [], np.zeros(len(x))

    def node(at: np.ndarray, path: tuple, depth: int) -> None:
        if path:
            rules.append(path)
        g, h = grad[at].sum(), hess[at].sum()
        out[at] = -g / (h + 1.0)
        if depth == 0 or len(at) < 2 * least:
            return
        best = (1e-6, None)
        for k, edges in enumerate(bins):
            if not len(edges):
                continue
            b = np.searchsorted(edges, x[at, k], side="left")
            n = np.bincount(b, minlength=len(edges) + 1).cumsum()[:-1]
            gl, hl = (np.bincount(b, v[at], len(edges) + 1).cumsum()[:-1] for v in (grad, hess))
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < least) | (len(at) - n < least)] = 0
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = (gain[j], (k, edges[j]))
        if best[1] is None:
            return
        k, edge = best[1]
        left = x[at, k] <= edge
        node(at[left], (*path, (k, False, edge)), depth - 1)
        node(at[~left], (*path, (k, True, edge)), depth - 1)

    node(np.arange(len(x)), (), depth)
    return rules, out


def _lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 1500) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights; columns of ``z`` are scaled by the caller."""
    n, p = z.shape
    step = 4.0 / (np.linalg.norm(np.column_stack([np.ones(n), z]), 2) ** 2 / n)
    w, v, t = np.zeros(p + 1), np.zeros(p + 1), 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(v[0] + z @ v[1:], -40, 40))) - y
        new = v - step * np.concatenate([[r.mean()], z.T @ r / n])
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        if np.abs(new - w).max() < 1e-7:
            w = new
            break
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-4, rate: float = 0.4, seed: int = 5) -> Ensemble:
    """Trees, their paths as rules, lasso weights. Deterministic for given rows."""
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Ensemble(float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    bins = [np.unique(np.quantile(x[:, k], np.linspace(0.005, 0.995, 60))) for k in range(x.shape[1])]
    f, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        weight = (rng.random(len(y)) < 0.7).astype(float)
        rules, step = _grow(x, bins, (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight, depth, max(3, len(y) // 500))
        f = f + rate * step
        paths.update(dict.fromkeys(rules))
    masks, kept = [], []
    for path in paths:
        m = np.ones(len(y), dtype=bool)
        for k, above, edge in path:
            m &= (x[:, k] > edge) == above
        if 0 < m.sum() < len(y):
            masks.append(m)
            kept.append(path)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    lin = np.clip(x, low, high)
    z = np.column_stack([np.array(masks).T.astype(float), lin]) if masks else lin
    mean, scale = z.mean(0), z.std(0)
    scale[scale == 0] = np.inf
    b, w = _lasso_logistic((z - mean) / scale, y, penalty)
    w = w / scale
    k = len(kept)
    rules = [(tuple((STATISTICS[i], bool(above), float(edge)) for i, above, edge in path), float(v)) for path, v in zip(kept, w[:k], strict=True) if v]
    linear = [(s, float(a), float(c), float(v)) for s, a, c, v in zip(STATISTICS, low, high, w[k:], strict=True) if v]
    return Ensemble(float(b - (w * np.where(np.isfinite(scale), mean, 0)).sum()), rules, linear)


def labelled_sample(rows: DataFrame, labels: DataFrame, label_col: str, held_out: Column, fit_rows: int, id_col: str = "doc_id") -> DataFrame:
    """Rows with a usable label that are not held out, ``fit_rows`` of them at most, smallest hash first; adds ``y``."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias(id_col)).agg(F.max(label_col).alias("y"))
    return rows.where(~held_out).join(known, id_col).orderBy(F.xxhash64(id_col), id_col).limit(fit_rows)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int, remainder: int, fit_rows: int) -> Ensemble:
    """The ensemble fitted on the statistics of at most ``fit_rows`` labelled rows."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    sample = labelled_sample(ids, labels, label_col, held_out("doc_id", modulus, remainder), fit_rows).dropDuplicates(["doc_id"])
    sample = materialize(sample, "sample")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")  # at most ``fit_rows`` ids
    known = statistics(texts).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*STATISTICS)).alias("x"))  # one row of each id
    known = known.select("doc_id", "y", "x.*").toPandas().sort_values("doc_id")
    return fit_rules(known[STATISTICS].to_numpy(float), known["y"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 4, remainder: int = 2, cut: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; once the rules are fitted, one pass without a shuffle."""
    model = learned(docs, labels, id_col, text_col, label_col, modulus, remainder, fit_rows)
    scored = statistics(docs, id_col, text_col).select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 4, remainder: int = 2, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``; decided row by row, so nothing but the bounded sample moves."""
    model = learned(docs, labels, id_col, text_col, label_col, modulus, remainder, fit_rows)
    prefix = fresh(docs, "statistic")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return with_statistics(docs, text_col, prefix).where(model.column(prefix) >= least).select(*docs.columns)
