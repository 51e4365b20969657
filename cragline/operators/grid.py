"""Grids: cell ids, mean and median rasters, dense grids, distance to support, gap reconstruction."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cell_index, finite

MAX_CELLS = 4_000_000  #: budget of the out-of-core path; beyond it the cell is enlarged
CAP_CELLS = 60_000_000  #: the in-memory path refuses larger grids


@dataclass(frozen=True)
class Frame:
    """Placement of a grid: cell (r, c) has its centre at (x0 + (c + .5) cell, y0 + (r + .5) cell)."""

    x0: float
    y0: float
    cell: float
    nx: int
    ny: int
    adjusted: bool = False

    def centre(self, r="r", c="c"):
        return self.x0 + (F.col(c) + 0.5) * self.cell, self.y0 + (F.col(r) + 0.5) * self.cell


def choose_cell(spacing: float, requested: float, most: float | None = None) -> float:
    """The requested cell, or 2.5 spacings within 0.05 and 1 (and ``most``)."""
    if requested > 0:
        return requested
    cell = min(1.0, max(0.05, 2.5 * spacing))
    return cell if most is None else min(cell, most)


def _cells(extent: float, cell: float) -> int:
    return max(2, int(math.floor(extent / cell)) + 1)


def frame_for(mins: tuple[float, float], maxs: tuple[float, float], cell: float, max_cells: int | None = MAX_CELLS) -> Frame:
    """Grid over a bounding box. With a budget the cell grows to meet it, else CAP_CELLS is an error."""
    w, h = max(maxs[0] - mins[0], 0.0), max(maxs[1] - mins[1], 0.0)
    adjusted = False
    if max_cells is None:
        nx, ny = _cells(w, cell), _cells(h, cell)
        if nx * ny > CAP_CELLS:
            raise MemoryError(f"a grid of {nx} x {ny} cells is too large; enlarge the cell or cut the area")
    else:
        w, h = max(w, cell), max(h, cell)
        nx, ny = _cells(w, cell), _cells(h, cell)
        if nx * ny > max_cells:
            cell, adjusted = cell * math.sqrt(nx * ny / max_cells) * 1.02, True
            nx, ny = _cells(w, cell), _cells(h, cell)
    return Frame(float(mins[0]), float(mins[1]), float(cell), nx, ny, adjusted)


def bounds(points: DataFrame):
    """One row: n and the least and greatest x, y and z."""
    return points.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{s}") for c in "xyz" for f, s in ((F.min, "min"), (F.max, "max"))))


def with_cells(points: DataFrame, frame: Frame, eps: float = 1e-9) -> DataFrame:
    """Adds r and c."""
    return points.withColumn("r", cell_index(F.col("y"), frame.y0, frame.cell, frame.ny, eps)).withColumn("c", cell_index(F.col("x"), frame.x0, frame.cell, frame.nx, eps))


def raster_mean(points: DataFrame, frame: Frame, eps: float = 1e-9) -> DataFrame:
    """(r, c, n, z): count and mean height of each occupied cell; combined before the one shuffle."""
    return with_cells(points, frame, eps).groupBy("r", "c").agg(F.count("*").alias("n"), F.avg("z").alias("z"))


def raster_median(points: DataFrame, frame: Frame, eps: float = 1e-9) -> DataFrame:
    """(r, c, n, z): exact median height of each occupied cell."""
    return with_cells(points, frame, eps).groupBy("r", "c").agg(F.count("*").alias("n"), F.median("z").alias("z"))


def merge_rasters(*rasters: DataFrame) -> DataFrame:
    """One raster of sums and counts from several (r, c, n, zsum)."""
    out = rasters[0]
    for x in rasters[1:]:
        out = out.unionByName(x)
    return out.groupBy("r", "c").agg(F.sum("n").alias("n"), F.sum("zsum").alias("zsum"))


def dense(cells: DataFrame, frame: Frame) -> DataFrame:
    """(r, c, z, valid) of every cell of the grid; z is null where no point fell."""
    every = cells.sparkSession.range(frame.nx * frame.ny).select(F.expr(f"int(id div {frame.nx})").alias("r"), F.expr(f"int(id % {frame.nx})").alias("c"))
    return every.join(cells.select("r", "c", "z"), ["r", "c"], "left").withColumn("valid", F.coalesce(finite(F.col("z")), F.lit(False)))


def _brackets(grid: DataFrame, line: str, along: str, tag: str) -> DataFrame:
    """Nearest valid cells before and after on a row or column: their position and height.

    Both look back, the second in descending order: a frame that ends with the line is read anew for each of its cells.
    """
    back = Window.partitionBy(line).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(line).orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, 0)
    at, z = F.when(F.col("valid"), F.col(along)), F.when(F.col("valid"), F.col("z"))
    return grid.withColumns({
        f"{tag}a": F.last(at, ignorenulls=True).over(back), f"{tag}az": F.last(z, ignorenulls=True).over(back),
        f"{tag}b": F.last(at, ignorenulls=True).over(ahead), f"{tag}bz": F.last(z, ignorenulls=True).over(ahead),
    })


def _between(along: str, tag: str):
    a, b = F.col(f"{tag}a"), F.col(f"{tag}b")
    share = (F.col(along) - a) / (b - a)
    return F.when(a.isNotNull() & b.isNotNull() & (b > a), F.col(f"{tag}az") + (F.col(f"{tag}bz") - F.col(f"{tag}az")) * share)


def _row_envelope(g2: np.ndarray, gz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact squared distance of each cell of a row, from each column's squared distance to its nearest valid cell; and that cell's height.

    Lower envelope of the parabolas (c - k)^2 + g(k)^2 (Felzenszwalb and Huttenlocher 2012); of equally
    near cells the one in the lower row, then the lower column, gives the height.
    """
    n = len(g2)
    if not g2.any():
        return g2, gz
    sites = np.flatnonzero(np.isfinite(g2))
    if not len(sites):
        return np.full(n, np.inf), np.full(n, np.nan)
    hull: list[int] = []
    cuts: list[float] = []
    square = g2.tolist()
    for k in sites.tolist():
        s = -math.inf
        while hull:
            j = hull[-1]
            s = ((square[k] + k * k) - (square[j] + j * j)) / (2.0 * (k - j))
            if s > cuts[-1]:
                break
            hull.pop()
            cuts.pop()
            s = -math.inf
        hull.append(k)
        cuts.append(s)
    c = np.arange(n)
    own = np.array(hull)[np.searchsorted(np.array(cuts), c, side="left") - 1]
    return (c - own) ** 2 + g2[own], gz[own]


def _whole_rows(batches):
    """Batches of rows sorted by r, cut anew so that each holds whole grid rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        r = b.column("r")
        if not len(r):
            continue
        if held and held[-1].column("r")[-1] == r[0] == r[-1]:
            held.append(b)
            continue
        t = pa.Table.from_batches([*held, b])
        at = t.column("r").to_numpy()
        cut = int(np.searchsorted(at, at[-1], side="left"))
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _envelopes(batches):
    """Columns g and gz of whole rows become d and near_z; the others stay."""
    for t in _whole_rows(batches):
        r = t.column("r").to_numpy()
        g2, gz = (t.column(c).to_numpy().astype(float) for c in ("g", "gz"))  # nulls are NaN
        g2 = np.where(np.isnan(g2), np.inf, g2) ** 2
        best, height = np.empty(len(r)), np.empty(len(r))
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])).tolist()
        for i, j in zip(starts, [*starts[1:], len(r)], strict=True):
            best[i:j], height[i:j] = _row_envelope(g2[i:j], gz[i:j])
        t = t.drop_columns(["g", "gz"]).append_column("d", pa.array(np.sqrt(best))).append_column("near_z", pa.array(height))
        yield from t.to_batches()


def _measured(columns: DataFrame) -> DataFrame:
    """Replaces g and gz, by column, with d and near_z of ``distance_to_valid``. A task streams rows of the grid and holds few at a time."""
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in columns.schema if f.name not in ("g", "gz")]
    order = columns.select(*(c for c in columns.columns if c not in ("g", "gz")), "g", "gz").sortWithinPartitions("r", "c")
    return order.mapInArrow(_envelopes, ", ".join([*kept, "d double", "near_z double"]))


def _by_column(grid: DataFrame) -> DataFrame:
    """The grid, dealt by row, with the bracket of each cell's column (va, vaz, vb, vbz), and g, gz: distance to the nearer end and its height."""
    up, down = F.col("r") - F.col("va"), F.col("vb") - F.col("r")
    take_up = up.isNotNull() & (down.isNull() | (up <= down))
    nearer = {"g": F.when(take_up, up).otherwise(down).cast("double"), "gz": F.when(take_up, F.col("vaz")).otherwise(F.col("vbz"))}
    return _brackets(grid.select("r", "c", "z", "valid"), "c", "r", "v").withColumns(nearer).repartition("r")


def distance_to_valid(grid: DataFrame) -> DataFrame:
    """(r, c, valid, d, near_z): Euclidean distance in cells to the nearest valid cell, and that cell's height."""
    return _measured(_by_column(grid).select("r", "c", "valid", "g", "gz"))


def reconstruct(grid: DataFrame, frame: Frame, max_gap_m: float) -> DataFrame:
    """(r, c, z, valid, analysis_valid, support_m): small gaps bridged, the rest filled from the nearest cell.

    A gap cell within ``max_gap_m`` of support that lies between valid cells on its row or column gets the
    mean of the linear interpolations there are; other gap cells are filled but not open to analysis.
    """
    row, col = _between("c", "h"), _between("r", "v")
    estimate = F.coalesce((row + col) / 2, row, col)
    both = _brackets(_by_column(grid), "r", "c", "h")
    out = _measured(both.select("r", "c", "z", "valid", estimate.alias("estimate"), "g", "gz"))
    support = F.when(F.col("valid"), F.lit(0.0)).otherwise(F.col("d") * frame.cell)
    bridged = ~F.col("valid") & (support <= max_gap_m) & F.col("estimate").isNotNull() & F.lit(max_gap_m > 0)
    z = F.when(F.col("valid"), F.col("z")).when(bridged, F.col("estimate")).otherwise(F.col("near_z"))
    return out.select("r", "c", z.alias("z"), "valid", (F.col("valid") | bridged).alias("analysis_valid"), support.alias("support_m"))
