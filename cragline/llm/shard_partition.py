"""Sharding by minimax contiguous partition of atomic groups.

Equal texts form an atomic group; groups are ordered by their smallest id, and a shard is a run of
neighbouring groups. The smallest feasible shard capacity is found by binary search, each probe
checked greedily (fill a shard until the next group does not fit), and the order is cut there. A
group larger than an even share would force its size on all shards, so such groups (fewer than the
shards) get a shard of their own first, largest first, and the search runs over the rest.

Only bounded things reach the driver: an index of the prefix sums in BINS bins, and then, in rounds, finer
bins of the few places in which cuts may still fall, until the capacity and its cuts are exact; a round's bins
number at most 2 BINS however many groups there are. Prefix sums and slots are counted per range partition and
shifted by the totals before it, so no group has to fit one task.

Defined results: a null text has size 1 and counts as an empty text of its own group; ties are broken by
id; repeated rows each get a slot; an empty table gives an empty result; null ids come first; texts of any
length are whole groups; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, running, running_total

BINS = 1 << 16  #: bins of prefix sums at the driver


class Prefix:
    """Prefix sums of ordered groups, by bins: the least and greatest sum of each bin that has any."""

    def __init__(self, bins: list[tuple[int, int]]):
        self.lows, self.highs = (np.array(x, dtype=np.int64) for x in (zip(*bins, strict=True) if bins else ((), ())))
        self.total = int(self.highs[-1]) if len(bins) else 0

    def refined(self, windows: list[tuple[int, int]], bins: list[tuple[int, int]]) -> Prefix:
        """With finer ``bins`` of the sums in ``windows``; bins that only reach into a window end before it or begin after it."""
        out = list(bins)
        for low, high in zip(self.lows.tolist(), self.highs.tolist(), strict=True):
            if not any(a <= low and high <= b for a, b in windows):
                out.append((low, high))
        return Prefix(sorted(out))

    def cut(self, limit: int, sure: bool) -> int:
        """Greatest prefix sum <= limit: a lower bound of it if ``sure``, else an upper bound; equal where known."""
        i = int(np.searchsorted(self.lows, limit, "right")) - 1
        if i < 0:
            return 0
        if limit >= self.highs[i]:
            return int(self.highs[i])
        if sure:
            return int(self.lows[i])
        return limit if limit > self.lows[i] else int(self.lows[i])

    def greedy(self, capacity: int, shards: int, sure: bool) -> list[int]:
        cuts, at = [], 0
        for _ in range(shards):
            at = self.cut(at + capacity, sure)
            cuts.append(at)
        return cuts

    def least(self, low: int, high: int, shards: int, sure: bool) -> int:
        """Smallest capacity in low..high that fits, surely or possibly."""
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.greedy(mid, shards, sure)[-1] >= self.total else (mid + 1, high)
        return low

    def around(self, windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """``windows`` widened to whole bins and merged."""
        out: list[tuple[int, int]] = []
        for a, b in sorted(windows):
            i, j = max(0, int(np.searchsorted(self.lows, a, "right")) - 1), int(np.searchsorted(self.lows, b, "right"))
            for low, high in zip(self.lows[i:j].tolist(), self.highs[i:j].tolist(), strict=True):
                if low < high and high >= a:  # a bin of one sum is exact
                    if out and low <= out[-1][1]:
                        out[-1] = (out[-1][0], max(out[-1][1], high))
                    else:
                        out.append((low, high))
        return out


def smallest_capacity(index, total: int, shards: int, largest: int, bins: int = BINS) -> tuple[int, list[int]]:
    """(capacity, cuts): least capacity that greedy filling finds feasible.

    ``index(windows, width)``: (least, greatest) prefix sum of each bin of ``width`` within the windows, all if None.
    """
    width = max(1, -(-total // bins))
    prefix = Prefix(index(None, width))
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    while True:
        high = prefix.least(low, high, shards, True)
        low = prefix.least(low, high, shards, False)
        cuts, most = prefix.greedy(low, shards, True), prefix.greedy(high, shards, False)
        windows = prefix.around([(a, b + 1) for a, b in zip(cuts, most, strict=True)])
        if low == high and cuts == prefix.greedy(low, shards, False) or not windows:
            return high, prefix.greedy(high, shards, True)
        width = max(1, min(width - 1, -(-sum(b - a + 1 for a, b in windows) // bins)))
        prefix = prefix.refined(windows, index(windows, width))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, bins: int = BINS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law ``bytes``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(1), text, F.col(text_col).isNull()).alias("k1"), F.xxhash64(F.lit(2), text, F.col(text_col).isNull()).alias("k2"),
    )
    slim = materialize(slim, "sizes")
    groups = materialize(slim.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.sum("size").alias("bytes")), "groups")
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()

    # groups over an even share of what is left, largest first: each takes a shard of its own
    top = groups.orderBy(F.desc("bytes"), "first", "k1", "k2").limit(shards).select("k1", "k2", "bytes").collect()
    alone, left = [], total
    for r in top:
        if len(alone) < shards - 1 and r["bytes"] * (shards - len(alone)) > left:
            alone.append(r)
            left -= r["bytes"]
        else:
            break
    own = spark.createDataFrame([(r["k1"], r["k2"], i) for i, r in enumerate(alone)], "k1 long, k2 long, own int")
    groups = groups.join(F.broadcast(own), ["k1", "k2"], "left")
    rest = groups.where("own is null").select("k1", "k2", "first", "n", "bytes")
    sums = materialize(running_total(rest, ["first", "k1", "k2"], "bytes"), "sums")
    free = shards - len(alone)
    largest = rest.agg(F.max("bytes")).first()[0] or 0

    def index(windows, width):
        inside = F.lit(windows is None)
        for a, b in windows or ():
            inside = inside | F.col("upto").between(a, b)
        found = sums.where(inside).groupBy(F.floor(F.col("upto") / F.lit(width)).alias("bin")).agg(F.min("upto").alias("low"), F.max("upto").alias("high"))
        return sorted((r["low"], r["high"]) for r in found.collect())

    cuts = smallest_capacity(index, left, free, largest, bins)[1] if left else []
    number = F.lit(len(alone))
    for c in cuts[:-1]:
        number = number + (F.col("upto") > c).cast("int")
    placed = sums.select("k1", "k2", "first", "n", number.alias("shard")).unionByName(groups.where("own is not null").select("k1", "k2", "first", "n", F.col("own").alias("shard")))
    out = join_hot(slim, materialize(placed, "placed"), ["k1", "k2"], "n", rows).withColumn("one", F.lit(1))
    out = running(out.select("doc_id", "size", "text_crc32", "shard", "first", "k1", "one"), ["shard", "first", "k1", "doc_id"], "one", "shard")
    counts = out.groupBy("part_no", "shard").agg(F.max("run").alias("n")).orderBy("shard", "part_no").collect()
    shift, at = [], {}
    for r in counts:
        shift.append((r["part_no"], r["shard"], at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["n"]
    offsets = spark.createDataFrame(shift, "part_no int, shard int, shift long")
    slot = (F.col("run") - 1 + F.col("shift")).alias("slot")
    return out.join(F.broadcast(offsets), ["part_no", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
