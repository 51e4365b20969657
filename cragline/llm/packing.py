"""Best-fit packing of documents into fixed-length bins under conflicts.

Documents are dealt to groups of bounded size by hash of the id, so a hot source spreads evenly; rows repeated in id,
length and text are told apart by their place in the input, so that they spread too. In a
group, pieces are placed in order of falling length. Open bins are ordered by residual room; each
carries a bitmap of the sources and one of the duplicate clusters that it holds. The search starts
at the successor of the piece's length and goes on to the next larger residual until the tightest
bin without a conflict is found; else a new bin opens. A bin never holds two pieces of one source
or of one duplicate cluster.

Length: words (runs without white space) plus one end mark. A longer document is cut into full
bins and a rest, none of it is dropped. Defined results: a null or empty text has length 1; a null
source conflicts with nothing, equal texts after lower-casing and squeezing white space are a
duplicate cluster (empty texts are none); repeated rows are placed each; an empty table packs into
no bins; whole texts of any length are placed; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, column, partitions, text_slices, whole_groups

CAPACITY = 2048  #: length of a bin
GROUP_ROWS = 8_000  #: documents that a group aims at
SEEN_ROWS = 1_000_000  #: rows that a task remembers to tell repeats


def _measure(batches):
    # how often the partition has held an id, length and cluster; emptied at SEEN_ROWS distinct ones, so where there
    # are k times as many, up to k repeats of a row are dealt together
    seen: Counter = Counter()
    part = TaskContext.get().partitionId() + 1
    for batch in batches:
        for a, b, data, offsets in text_slices(column(batch, "text")):
            w = Words(data, offsets)
            with np.errstate(over="ignore"):
                place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], np.diff(w.first))
                term = w.hash * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
                cluster = (sums[w.first[1:]] - sums[w.first[:-1]]).view(np.int64)
            count = np.diff(w.first)
            again = []
            if len(seen) > SEEN_ROWS:
                seen.clear()
            for key in zip(column(batch, "doc_id").slice(a, b - a).to_pylist(), count.tolist(), cluster.tolist(), strict=True):
                seen[key] += 1
                again.append(0 if seen[key] == 1 else (part << 32) + seen[key])
            arrays = [column(batch, c).slice(a, b - a) for c in ("doc_id", "source")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(count.astype(np.int64) + 1), pa.array(cluster, mask=count == 0), pa.array(again, pa.int64())], names=["doc_id", "source", "length", "cluster", "again"])


class Bins:
    """Open bins ordered by (residual, number), with their bitmaps in step."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.order: list[tuple[int, int]] = []
        self.source: list[int] = []  # bitmaps, in the order of ``order``
        self.cluster: list[int] = []
        self.used: dict[int, int] = {}

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece; ``source`` and ``cluster`` are single bits, or 0."""
        k = bisect_left(self.order, (length, -1))
        sources, clusters = self.source, self.cluster
        n = len(self.order)
        while k < n and (sources[k] & source or clusters[k] & cluster):
            k += 1
        if k < n:
            room, number = self.order.pop(k)
            source |= sources.pop(k)
            cluster |= clusters.pop(k)
        else:
            room, number = self.capacity, self.count
            self.count += 1
        left = room - length
        if left > 0:
            at = bisect_left(self.order, (left, number))
            self.order.insert(at, (left, number))
            sources.insert(at, source)
            clusters.insert(at, cluster)
        return number, self.capacity - room


def pack_group(ids, sources, lengths, clusters, capacity: int) -> list[tuple]:
    """(doc row, piece, length, bin, offset) of every piece of the group's rows."""
    n = len(ids)
    source_bit = {s: 1 << i for i, s in enumerate(sorted({s for s in sources if s is not None}))}
    seen: dict = {}
    for c in clusters:
        if c is not None:
            seen[c] = seen.get(c, 0) + 1
    cluster_bit = {c: 1 << i for i, c in enumerate(sorted(c for c, k in seen.items() if k > 1))}
    pieces = []
    for i in range(n):
        full, rest = divmod(lengths[i], capacity)
        pieces += [(capacity, i, p) for p in range(full)]
        if rest:
            pieces.append((rest, i, full))
    pieces.sort(key=lambda x: (-x[0], ids[x[1]] is None, ids[x[1]] or 0, x[1], x[2]))
    bins, out = Bins(capacity), []
    for length, i, p in pieces:
        number, offset = bins.put(length, source_bit.get(sources[i], 0), cluster_bit.get(clusters[i], 0))
        out.append((i, p, length, number, offset))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, piece, length, bin_group, bin, offset): where every piece of every row lies."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    groups = max(1, -(-slim.count() // group_rows))
    measured = slim.mapInArrow(_measure, "doc_id long, source string, length long, cluster long, again long")
    dealt = measured.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "length", "cluster", "again"), F.lit(groups)))
    dealt = dealt.repartition(max(partitions(docs.sparkSession), 1), "bin_group").sortWithinPartitions("bin_group", "doc_id", "length", "cluster", "again")

    def run(batches):
        for table in whole_groups(batches, "bin_group", rows=1):
            group = table.column("bin_group").to_numpy()
            starts = np.concatenate([np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), [len(group)]])
            cols = [table.column(c).to_pylist() for c in ("doc_id", "source", "length", "cluster")]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                ids, sources, lengths, clusters = (c[s:e] for c in cols)
                placed = pack_group(ids, sources, lengths, clusters, capacity)
                i, piece, length, number, offset = zip(*placed, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in i], pa.int64()), pa.array(piece, pa.int64()), pa.array(length, pa.int64()), pa.array(np.full(len(i), group[s])), pa.array(number, pa.int64()), pa.array(offset, pa.int64())],
                    names=["doc_id", "piece", "length", "bin_group", "bin", "offset"],
                )

    return dealt.mapInArrow(run, "doc_id long, piece long, length long, bin_group long, bin long, offset long")
