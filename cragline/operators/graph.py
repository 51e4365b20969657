"""Connected components of edges and of masked grid cells.

Grid labelling is tile-parallel: each tile labels its own cells with NumPy, and only pairs of labels that
touch across tile borders become graph edges. No task holds more than a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import join_hot, materialize
from .grid import Frame

TILE = 512


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of ``n`` nodes, over undirected edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def _contracted(batches):
    """Edges (u, v) of a batch as stars around the smallest nodes of its components: the same reach, no more edges than nodes."""
    for batch in batches:
        u, v = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in "uv")
        nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = local_components(len(nodes), index[: len(u)], index[len(u) :])
        out = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[label[out]])], names=["u", "v"])


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """edges(u, v) with ``m``, the least v of each u. ``rows``: about how many edges there are.

    The least are combined before their shuffle and written; then hubs, which are few, are broadcast, and only edges of
    other nodes shuffle, so no task gets a hub's edges.
    """
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    return join_hot(edges, least, ["u"], "n", rows).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node in reach, from undirected edges (a, b).

    Large-star and small-star rounds (Kiveris et al. 2014) until no edge changes. Batches of edges are contracted where they
    lie, which saves rounds. Every half round is cut in the shared folder, and only a count and a hash come to the driver.
    """
    e = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v")
    e = materialize(e.mapInArrow(_contracted, "u long, v long").distinct(), "edges")
    seen = None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _with_least(near, 2 * state[0]).where("v > u")
        large = materialize(near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct(), "large")
        small = _with_least(large, state[0])
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.*")
        e = materialize(small.where("u <> v").mapInArrow(_contracted, "u long, v long").distinct(), "small")
    nodes = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _spans(rows: np.ndarray, cols: np.ndarray):
    """Runs of neighbouring cells on a row: row, first and last column, and each cell's run."""
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(rows)) - 1
    return rows[at], cols[at], cols[last], np.cumsum(new) - 1


def label_tile(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Index of the first cell of each cell's 8-connected component; cells come in row-major order."""
    if len(rows) == 0:
        return np.zeros(0, dtype=np.int64)
    row, lo, hi, run = _spans(rows, cols)
    parent = np.arange(len(row))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    start = np.searchsorted(row, row - 1, "left")
    for i in range(len(row)):
        j = start[i]
        while j < i and row[j] == row[i] - 1 and lo[j] <= hi[i] + 1:
            if hi[j] >= lo[i] - 1:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            j += 1
    root = np.array([find(i) for i in range(len(row))])
    first = np.searchsorted(run, np.arange(len(row)))
    return first[root[run]]


def _label(pdf: pd.DataFrame) -> pd.DataFrame:
    d = pdf.sort_values(["r", "c"], ignore_index=True)
    flat = d["flat"].to_numpy()
    return pd.DataFrame({"r": d["r"], "c": d["c"], "part": flat[label_tile(d["r"].to_numpy(), d["c"].to_numpy())]})


AROUND = [(0, 1), (1, -1), (1, 0), (1, 1)]  #: steps to the neighbours of a cell that come after it


def label_cells(cells: DataFrame, frame: Frame, tile: int = TILE) -> DataFrame:
    """(r, c, label): label is the row-major number of the first cell of the 8-connected component."""
    return _labelled(cells, frame, tile, AROUND, _label)


def label_near(cells: DataFrame, frame: Frame, steps: list[tuple[int, int]], tile: int = TILE) -> DataFrame:
    """``label_cells`` for cells joined by any of ``steps`` (rows, columns; either way, so each pair of opposites counts once)."""
    steps = sorted({max(s, (-s[0], -s[1])) for s in steps})

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(["r", "c"], ignore_index=True)
        flat = d["flat"].to_numpy()
        return pd.DataFrame({"r": d["r"], "c": d["c"], "part": flat[label_steps(d["r"].to_numpy(), d["c"].to_numpy(), steps)]})

    return _labelled(cells, frame, tile, steps, label)


def label_steps(rows: np.ndarray, cols: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Index of the first cell in reach of each cell by ``steps``; cells come in row-major order."""
    if len(rows) == 0:
        return np.zeros(0, dtype=np.int64)
    far = max(abs(j) for _, j in steps)
    wide = int(cols.max() - cols.min()) + 1 + 2 * far  # a step over the side meets no cell of the next row
    key = (rows - rows.min()).astype(np.int64) * wide + (cols - cols.min())
    a, b = [], []
    for i, j in steps:
        at = np.searchsorted(key, key + i * wide + j)
        hit = np.flatnonzero((at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + i * wide + j))
        a.append(hit)
        b.append(at[hit])
    return local_components(len(key), np.concatenate(a), np.concatenate(b))


def _labelled(cells: DataFrame, frame: Frame, tile: int, steps: list[tuple[int, int]], label) -> DataFrame:
    """Labels of each tile by itself, joined where cells of two tiles are a step apart."""
    flat = F.col("r").cast("long") * frame.nx + F.col("c")
    tiled = cells.select("r", "c", flat.alias("flat"), F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"))
    if frame.nx <= tile and frame.ny <= tile:  # one tile: nothing to join across borders
        return tiled.groupBy("tr", "tc").applyInPandas(label, "r int, c int, part long").withColumnRenamed("part", "label")
    parts = materialize(tiled.groupBy("tr", "tc").applyInPandas(label, "r int, c int, part long"), "parts")
    far = max(max(abs(i), abs(j)) for i, j in steps)
    near = lambda v: f"{v} % {tile} < {far} OR {v} % {tile} >= {tile - far}"
    edge = parts.where(f"{near('r')} OR {near('c')}")
    moves = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    moved = edge.select(F.col("part").alias("a"), "r", "c", moves.alias("m")).select("a", (F.col("r") + F.col("m.i")).alias("r"), (F.col("c") + F.col("m.j")).alias("c"))
    touch = moved.join(edge.select("r", "c", F.col("part").alias("b")), ["r", "c"]).where("a <> b").select("a", "b").distinct()
    roots = components(touch)
    return parts.join(roots.withColumnRenamed("node", "part"), "part", "left").select("r", "c", F.coalesce("root", "part").alias("label"))


def hysteresis(grid: DataFrame, frame: Frame, tile: int = TILE) -> DataFrame:
    """(r, c) of strong cells and of weak cells that reach one through weak cells.

    These are the components of weak or strong cells that hold a strong cell: walking from any cell of such
    a component to a strong one, all cells before the first strong cell are weak.
    """
    cells = grid.where("weak OR strong").select("r", "c", "strong")
    labels = label_cells(cells, frame, tile)
    seeded = labels.join(cells.where("strong").select("r", "c"), ["r", "c"], "left_semi").select("label").distinct()
    return labels.join(seeded, "label", "left_semi").select("r", "c")
