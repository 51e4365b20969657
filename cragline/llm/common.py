"""Shared pieces: text kernels, fingerprints, connected components.

The text kernels work on the UTF-8 bytes of whole Arrow batches with NumPy, in slices of
about ``SLICE_BYTES`` so that memory does not depend on the batch; one longer text is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators import graph
from ..operators.graph import local_components
from ..shared import HOT_SHARE, join_hot, materialize

__all__ = ["HOT_SHARE", "Words", "column", "components", "distinct_by_text", "fingerprint", "fresh", "join_hot", "local_components", "materialize", "mix", "of_roots", "partitions", "running", "running_total", "seeds", "text_slices", "whole_groups"]

SLICE_BYTES = 1 << 18
SHINGLE_WORDS = 5

_MIX_A = np.uint64(0xFF51AFD7ED558CCD)
_MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_SHIFT = np.uint64(33)


# ---------------------------------------------------------------- tables


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fingerprint(*cols, prefix: str = "k") -> list:
    """Two 64-bit hashes with different seeds: 128 bits of identity for grouping equal values."""
    return [
        F.xxhash64(F.lit(1), *cols).alias(f"{prefix}1"),
        F.xxhash64(F.lit(2), *cols).alias(f"{prefix}2"),
    ]


def running(rows: DataFrame, by: list[str], add: str, reset: str | None = None) -> DataFrame:
    """Range-partitions by ``by`` and adds ``part``, and ``run``: the sum of ``add`` in the partition so far, per ``reset``."""
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)

    def run(batches):
        part, so_far = TaskContext.get().partitionId(), {}
        for batch in batches:
            x = column(batch, add).to_numpy()
            out = np.empty(len(x), dtype=np.int64)
            keys = column(batch, reset).to_numpy() if reset else np.zeros(len(x), dtype=np.int64)
            for k in np.unique(keys):
                m = keys == k
                out[m] = np.cumsum(x[m]) + so_far.get(k, 0)
                so_far[k] = int(out[m][-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), part, np.int32)), pa.array(out)], names=[*batch.schema.names, "part_no", "run"])

    schema = StructType([*rows.schema.fields, StructField("part_no", IntegerType()), StructField("run", LongType())])
    return materialize(ordered.mapInArrow(run, schema), "running")


def running_total(rows: DataFrame, by: list[str], add: str) -> DataFrame:
    """``rows`` with ``upto``: the sum of ``add`` over all rows up to this one in the order ``by``.

    Counted per range partition and shifted by the totals before it, of which there are as many as partitions.
    """
    out = running(rows, by, add)
    shift, at = [], 0
    for r in out.groupBy("part_no").agg(F.max("run").alias("sum")).orderBy("part_no").collect():
        shift.append((r["part_no"], at))
        at += r["sum"]
    offsets = rows.sparkSession.createDataFrame(shift, "part_no int, shift long")
    return out.join(F.broadcast(offsets), "part_no").withColumn("upto", F.col("run") + F.col("shift")).drop("part_no", "run", "shift")


# ---------------------------------------------------------------- Arrow helpers


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; wraps on purpose."""
    x = x ^ (x >> _SHIFT)
    x = x * _MIX_A
    x = x ^ (x >> _SHIFT)
    x = x * _MIX_B
    return x ^ (x >> _SHIFT)


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit numbers made from a rule."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(salt)) | np.uint64(1)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << int(np.ceil(np.log2(max(n, SLICE_BYTES * 2))))
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.full(size, np.uint64(_BASE), dtype=np.uint64)
            up[0] = 1
            down = np.full(size, inverse, dtype=np.uint64)
            down[0] = 1
            _powers["up"], _powers["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"]


class Words:
    """Words of a slice of texts: ``hash`` and ``length`` (bytes) of each, ``first[i]:first[i + 1]`` are text i's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        lit = ~_SPACE[data]
        start = lit.copy()
        start[1:] &= ~lit[:-1]
        cut = offsets[1:-1]
        cut = cut[cut < n]
        start[cut] = lit[cut]
        self.starts = np.flatnonzero(start)
        stop = lit.copy()
        stop[:-1] &= ~lit[1:]
        before = cut[cut > 0] - 1
        stop[before] = lit[before]
        self.stops = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.length = self.stops - self.starts
        with np.errstate(over="ignore"):
            up, down = _power_tables(n + 1)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            self.hash = mix((sums[self.stops] - sums[self.starts]) * down[self.starts] + self.length.astype(np.uint64))

    def shingles(self, width: int = SHINGLE_WORDS, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first): runs of ``width`` words; with ``short``, a text of fewer words is one shingle."""
        n = len(self.hash)
        words = np.diff(self.first)
        count = np.where(words >= width, words - width + 1, 0)
        if n == 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(len(words) + 1, dtype=np.int64)
        factors = seeds(width, 7)
        with np.errstate(over="ignore"):
            if n >= width:
                total = np.zeros(n - width + 1, dtype=np.uint64)
                for k in range(width):
                    total += self.hash[k : n - width + 1 + k] * factors[k]
                whole = np.ones(n - width + 1, dtype=bool)
                for k in range(1, width):  # runs that would reach over the end of a text
                    at = self.first[1:-1] - k
                    whole[at[(at >= 0) & (at < len(whole))]] = False
                full = mix(total)[whole] if not whole.all() else mix(total)
            else:
                full = np.zeros(0, dtype=np.uint64)
            first = np.concatenate([[0], np.cumsum(count)])
            few = np.flatnonzero((words > 0) & (words < width)) if short else np.zeros(0, dtype=np.int64)
            if len(few) == 0:
                return full, first
            own = np.empty(len(few), dtype=np.uint64)
            for j, i in enumerate(few):
                own[j] = (self.hash[self.first[i] : self.first[i + 1]] * factors[: words[i]]).sum() + np.uint64(words[i])
            return np.insert(full, first[few], mix(own)), np.concatenate([[0], np.cumsum(count + ((words > 0) & (words < width)))])


def text_slices(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of slices of about SLICE_BYTES; a null text is empty. Texts are lower-cased if asked."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        some = pc.fill_null(texts.slice(at, to - at).cast(pa.large_string()), "")
        if lower:
            some = pc.utf8_lower(some)
        offsets = np.frombuffer(some.buffers()[1], dtype=np.int64)[some.offset : some.offset + to - at + 1]
        buffer = some.buffers()[2]
        data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, dtype=np.uint8)
        yield at, to, data[offsets[0] : offsets[-1]], offsets - offsets[0]
        at = to


def distinct_by_text(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles once, sorted."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], np.searchsorted(o[keep], np.arange(len(first)))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by ``key``: as few groups as reach ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).combine_chunks()
        last = keys[len(keys) - 1]
        cut = pc.index(keys, last).as_py()
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): smallest node reachable, for each node of ``edges`` (long, undirected)."""
    return graph.components(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))


def of_roots(roots: DataFrame, nodes: DataFrame, value: Column) -> DataFrame:
    """roots(node, root) with an aggregate over the ``nodes`` of each root, which a large component does not put in one task."""
    roots = materialize(roots, "roots")
    values = materialize(roots.join(nodes, "node").groupBy("root").agg(value, F.count("*").alias("size_of_root")), "of-roots")
    return join_hot(roots, values, ["root"], "size_of_root", roots.count()).drop("size_of_root")
