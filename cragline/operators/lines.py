"""Polylines of a face: boundary chains, snapping, smoothing, resampling, clean-up.

Only what is sequential along a line runs in NumPy, one call for a face and its surroundings; lengths,
resampling and numbering of line tables are also there as DataFrame operators.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..shared import materialize
from .faces import Detection, ranked
from .graph import label_tile
from .grid import Frame
from .select import numbered

PATCH = 32  #: side of the coarse tiles by which a face finds its surroundings
LINES = "label long, type string, slope_mean double, coherence double, persistence double, geometry_source string, raw_vertex_count int, final_vertex_count int, tin_mean_snap_m double, tin_max_snap_m double, xs array<double>, ys array<double>"


# ---------------------------------------------------------------- ordered points, NumPy


def _steps(p: np.ndarray) -> np.ndarray:
    return np.hypot(*np.diff(p, axis=0).T) if len(p) > 1 else np.zeros(0)


def _without_repeats(p: np.ndarray) -> np.ndarray:
    return p[np.concatenate([[True], _steps(p) > 1e-9])] if len(p) else p


def _at_lengths(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    reach = np.concatenate([[0.0], np.cumsum(_steps(p))])
    return np.column_stack([np.interp(at, reach, p[:, k]) for k in range(p.shape[1])])


def resample(p: np.ndarray, spacing: float) -> np.ndarray:
    """Points every ``spacing`` along the line; both ends stay, the last step may be shorter."""
    p = np.asarray(p, dtype=float)
    if len(p) < 2 or spacing <= 0:
        return p
    p = _without_repeats(p)
    if len(p) < 2:
        return p
    total = _steps(p).sum()
    if total <= spacing:
        return p[[0, -1]]
    at = np.arange(0.0, total, spacing)
    if total - at[-1] > 1e-9:
        at = np.append(at, total)
    return _at_lengths(p, at)


def quadratic_smoother(window: int) -> np.ndarray:
    """Row i: weights by which a window's values give the value at i of their least-squares parabola."""
    t = np.arange(window) - window // 2
    a = np.vander(t, 3).astype(float)
    return a @ np.linalg.pinv(a)


def smooth(p: np.ndarray, window: int) -> np.ndarray:
    """Moving parabola over points spaced evenly; the ends use the parabola of the outer windows and are then restored."""
    p = np.asarray(p, dtype=float)
    if len(p) < 5 or window < 3:
        return p
    q = _without_repeats(p)
    if len(q) < 5:
        return p
    even = _at_lengths(q, np.linspace(0.0, _steps(q).sum(), len(q)))
    n = len(even)
    w = min(window | 1, n if n % 2 else n - 1)
    if w < 5:
        return even
    h, half = quadratic_smoother(w), w // 2
    out = np.empty_like(even)
    views = np.lib.stride_tricks.sliding_window_view(even, w, axis=0)
    out[half : n - half] = views @ h[half]
    out[:half], out[n - half :] = h[:half] @ even[:w], h[half + 1 :] @ even[-w:]
    out[[0, -1]] = q[[0, -1]]
    return out


def _turn(a: np.ndarray, b: np.ndarray) -> float | None:
    """Angle between two steps in degrees; None if one has no length."""
    size = np.hypot(*a) * np.hypot(*b)
    if np.hypot(*a) <= 1e-9 or np.hypot(*b) <= 1e-9:
        return None
    return float(np.degrees(np.arccos(np.clip(a @ b / size, -1.0, 1.0))))


def despike(p: np.ndarray, sharp: float = 65.0, straight: float = 28.0, sweeps: int = 3) -> np.ndarray:
    """Points that leave an otherwise straight course become the middle of their neighbours.

    A sweep uses points it has already moved; real corners, where the outer steps turn too, stay.
    """
    p = np.array(p, dtype=float)
    for _ in range(sweeps if len(p) >= 5 else 0):
        moved = False
        for i in range(2, len(p) - 2):
            d = np.diff(p[i - 2 : i + 3], axis=0)
            inner = _turn(d[1], d[2])
            if inner is None or inner < sharp:
                continue
            outer = _turn(d[0], d[3])
            if outer is not None and outer <= straight:
                p[i], moved = (p[i - 1] + p[i + 1]) / 2, True
        if not moved:
            break
    return p


def simplify(p: np.ndarray, eps: float, plan_only: bool = False) -> np.ndarray:
    """Douglas-Peucker: points further than ``eps`` from their chord stay; ``plan_only`` measures in x and y."""
    p = np.asarray(p, dtype=float)
    if len(p) < 3:
        return p
    q = p[:, :2] if plan_only else p
    keep = np.zeros(len(p), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, mid = q[b] - q[a], q[a + 1 : b] - q[a]
        size = chord @ chord
        t = np.clip(mid @ chord / size, 0, 1) if size > 0 else np.zeros(len(mid))
        far = np.linalg.norm(mid - t[:, None] * chord, axis=1)
        k = int(far.argmax())
        if far[k] > eps:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[keep]


def limit_segments(p: np.ndarray, source: np.ndarray, longest: float = 12.0) -> np.ndarray:
    """Longer segments get points of the line they came from, evenly by index between the points nearest to their ends."""
    p, source = np.asarray(p, dtype=float), np.asarray(source, dtype=float)
    if len(p) < 2 or longest <= 0:
        return p
    nearest = lambda v: int(np.hypot(*(source[:, :2] - v[:2]).T).argmin())
    parts = [p[:1]]
    for a, b in zip(p[:-1], p[1:], strict=True):
        pieces = int(np.ceil(np.hypot(*(b - a)[:2]) / longest))
        i, j = (nearest(a), nearest(b)) if pieces > 1 else (0, 0)
        if j > i + 1:
            at = np.rint(i + (j - i) * np.arange(1, pieces) / pieces).astype(int)
            parts.append(source[np.clip(at, i + 1, j - 1)])
        parts.append(b[None])
    return np.vstack(parts)


def simplify_in_plan(p: np.ndarray, eps: float = 0.32, longest: float = 12.0) -> np.ndarray:
    """Simplified in x and y, without segments over ``longest`` where the source has points between."""
    return limit_segments(simplify(p, eps, plan_only=True), p, longest) if len(p) > 2 else np.asarray(p, dtype=float)


# ---------------------------------------------------------------- a face and its surroundings


class Patch:
    """Dense fields around a face, addressed by the whole grid's rows and columns."""

    FIELDS = ("gx", "gy", "slope", "persistence", "support_m", "score")

    def __init__(self, pdf: pd.DataFrame, frame: Frame):
        self.frame = frame
        self.r0, self.c0 = int(pdf["r"].min()), int(pdf["c"].min())
        shape = int(pdf["r"].max()) - self.r0 + 1, int(pdf["c"].max()) - self.c0 + 1
        r, c = pdf["r"].to_numpy() - self.r0, pdf["c"].to_numpy() - self.c0
        self.mask = np.zeros(shape, dtype=bool)
        self.mask[r, c] = pdf["face"].to_numpy(bool)
        self.field = {}
        for f in self.FIELDS:
            a = np.zeros(shape)
            a[r, c] = np.nan_to_num(pdf[f].to_numpy(float))
            self.field[f] = a

    def _local(self, r, c):
        return np.clip(r - self.r0, 0, self.mask.shape[0] - 1), np.clip(c - self.c0, 0, self.mask.shape[1] - 1)

    def node(self, name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Field at the nearest cell centre."""
        f, short, shift = self.frame, 0, 0.5
        if name == "score":  # lies between centres, a row and a column fewer
            short, shift = 1, 1.0
        c = np.clip(np.rint((x - f.x0) / f.cell - shift), 0, f.nx - 1 - short).astype(int)
        r = np.clip(np.rint((y - f.y0) / f.cell - shift), 0, f.ny - 1 - short).astype(int)
        return self.field[name][self._local(r, c)]

    def inside(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        f = self.frame
        r, c = np.clip(np.rint(r), 0, f.ny - 1).astype(int), np.clip(np.rint(c), 0, f.nx - 1).astype(int)
        within = (r >= self.r0) & (r < self.r0 + self.mask.shape[0]) & (c >= self.c0) & (c < self.c0 + self.mask.shape[1])
        return within & self.mask[self._local(r, c)]

    def centres(self, rc: np.ndarray) -> np.ndarray:
        return np.column_stack([self.frame.x0 + (rc[:, 1] + self.c0 + 0.5) * self.frame.cell, self.frame.y0 + (rc[:, 0] + self.r0 + 0.5) * self.frame.cell])


def _neighbours(mask: np.ndarray) -> np.ndarray:
    """Number of true cells in each 3 x 3 block; outside is false."""
    p = np.pad(mask, 1).astype(np.int16)
    rows = p[:-2] + p[1:-1] + p[2:]
    return rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]


def _close(mask: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        mask = _neighbours(mask) > 0
    for _ in range(times):
        mask = _neighbours(mask) == 9
    return mask


def _edge_direction(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives of a mask along columns and rows, edge values repeated."""
    p = np.pad(mask.astype(float), 1, mode="edge")
    across = p[:, 2:] - p[:, :-2]
    down = p[2:] - p[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def longest_chain(mask: np.ndarray) -> np.ndarray:
    """(row, column) along the longest shortest path of the largest 8-connected part.

    Two breadth-first searches: from a loose end (or the first cell) to the farthest cell, and from there
    to the farthest again. Ties go to the first in row-major order.
    """
    r, c = np.nonzero(mask)
    if len(r) == 0:
        return np.zeros((0, 2), dtype=int)
    label = label_tile(r, c)
    names, size = np.unique(label, return_counts=True)
    mine = label == names[size.argmax()]
    cells = list(zip(r[mine].tolist(), c[mine].tolist(), strict=True))
    if len(cells) <= 2:
        return np.array(cells)
    place = {rc: i for i, rc in enumerate(cells)}
    around = [[place[n] for n in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j) if n in place] for a, b in cells]

    def search(start: int) -> tuple[int, list[int]]:
        came, reach, todo = {start: start}, [0] * len(cells), deque([start])
        while todo:
            at = todo.popleft()
            for n in around[at]:
                if n not in came:
                    came[n], reach[n] = at, reach[at] + 1
                    todo.append(n)
        far = max(range(len(cells)), key=lambda i: (reach[i], -i))
        path = [far]
        while path[-1] != start:
            path.append(came[path[-1]])
        return far, path[::-1]

    loose = next((i for i, n in enumerate(around) if len(n) <= 1), 0)
    return np.array([cells[i] for i in search(search(loose)[0])[1]])


def boundary_chains(patch: Patch, probe: float = 1.5, side: float = 0.75) -> tuple[np.ndarray, np.ndarray] | None:
    """Crest and toe of a face as chains of boundary cells, told apart by where the face lies along the local fall line.

    Boundary cells that run along the fall line are the face's sides and belong to neither.
    """
    edge = patch.mask & (_neighbours(patch.mask) < 9)
    r, c = np.nonzero(edge)
    gx, gy = patch.field["gx"][r, c], patch.field["gy"][r, c]
    size = np.hypot(gx, gy)
    ok = size > 1e-9
    if len(r) < 6 or ok.sum() < 6:
        return None
    r, c = r[ok], c[ok]
    dx, dy = -gx[ok] / size[ok], -gy[ok] / size[ok]
    below = patch.inside(r + patch.r0 + dy * probe, c + patch.c0 + dx * probe)
    above = patch.inside(r + patch.r0 - dy * probe, c + patch.c0 - dx * probe)
    ex, ey = (d[r, c] for d in _edge_direction(patch.mask))
    length = np.hypot(ex, ey)
    along = np.abs(ex * dy - ey * dx)  # the boundary's tangent against the fall line, times ``length``
    cross = (length > 1e-9) & (along <= side * length)
    chains = []
    for part in (below & ~above & cross, above & ~below & cross):
        m = np.zeros_like(edge)
        m[r[part], c[part]] = True
        chain = longest_chain(_close(m, 2) & edge)
        if len(chain) < 2:
            return None
        chains.append(patch.centres(chain))
    return chains[0], chains[1]


def _slices(patch: Patch, downhill: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Crest, toe and mean persistence of slices across the face, by its one mean direction."""
    rc = np.column_stack(np.nonzero(patch.mask))
    xy = patch.centres(rc)
    down, along = xy @ downhill, xy @ np.array([-downhill[1], downhill[0]])
    part = np.floor((along - along.min()) / max(patch.frame.cell * factor, patch.frame.cell)).astype(int)
    slices = pd.DataFrame({"part": part, "down": down, "persistence": patch.field["persistence"][rc[:, 0], rc[:, 1]]}).groupby("part")
    top, foot = slices["down"].idxmin().to_numpy(), slices["down"].idxmax().to_numpy()
    if len(top) < 2:
        return None
    return xy[top], xy[foot], float(slices["persistence"].mean().mean())


def snap(p: np.ndarray, crest: bool, downhill: np.ndarray, patch: Patch, search: float) -> tuple[np.ndarray, float, float]:
    """Move points along the fall line to the strongest surface break near them; also mean and greatest move.

    Every point has the same offsets to choose from, scored as one matrix; the choice runs along the line, since
    a point's score falls with its distance from the offset chosen before. The offsets are then median-filtered and
    limited in their change, forwards and backwards.
    """
    size = float(np.hypot(*downhill))
    if len(p) < 2 or search <= 0 or size <= 1e-12:
        return p, 0.0, 0.0
    cell = patch.frame.cell
    step = max(cell / 2, 0.10)
    reach = max(1.25 * cell, 0.30)
    offsets = np.arange(-search, search + step / 2, step)
    d = -np.column_stack([patch.node("gx", p[:, 0], p[:, 1]), patch.node("gy", p[:, 0], p[:, 1])])
    length = np.hypot(d[:, 0], d[:, 1])
    d = np.where((length > 1e-9)[:, None], d / np.maximum(length, 1e-9)[:, None], downhill / size)
    x, y = (p[:, k, None] + d[:, k, None] * offsets for k in (0, 1))
    drop = patch.node("slope", x + d[:, :1] * reach, y + d[:, 1:] * reach) - patch.node("slope", x - d[:, :1] * reach, y - d[:, 1:] * reach)
    trust = 0.55 + 0.45 * np.exp(-patch.node("support_m", x, y) / max(1.5, cell))
    score = patch.node("score", x, y) * trust + 0.65 * np.maximum(drop if crest else -drop, 0.0) - 1.5 * np.abs(offsets) / max(search, 1e-6)
    chosen = np.empty(len(p))
    pull = 0.0
    for i, row in enumerate(score):
        chosen[i] = offsets[np.argmax(row - pull)]
        pull = 6.0 * np.abs(offsets - chosen[i])
    if len(chosen) >= 5:
        chosen = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(chosen, 2, mode="edge"), 5), axis=1)
    most = max(1.5 * cell, 0.45)
    for order in (range(1, len(chosen)), range(len(chosen) - 2, -1, -1)):
        before = order.step if isinstance(order, range) else 1
        for i in order:
            chosen[i] = min(max(chosen[i], chosen[i - before] - most), chosen[i - before] + most)
    return p + d * chosen[:, None], float(np.abs(chosen).mean()), float(np.abs(chosen).max())


def face_lines(pdf: pd.DataFrame, frame: Frame, cfg: ExtractConfig) -> pd.DataFrame:
    """Crest and toe of one face from its patch; no rows if the face is rejected."""
    empty = pd.DataFrame(columns=["label", "type", "slope_mean", "coherence", "persistence", "geometry_source", "raw_vertex_count", "final_vertex_count", "tin_mean_snap_m", "tin_max_snap_m", "xs", "ys"])
    patch = Patch(pdf, frame)
    own = patch.mask
    gx, gy = patch.field["gx"][own], patch.field["gy"][own]
    size = np.hypot(gx, gy)
    ok = size > 1e-9
    if own.sum() < 4 or ok.sum() < 4:
        return empty
    mean = -np.array([(gx[ok] / size[ok]).mean(), (gy[ok] / size[ok]).mean()])
    coherence = float(np.hypot(*mean))
    if coherence < cfg.min_gradient_coherence or coherence == 0:
        return empty
    downhill = mean / coherence
    persistence = float(patch.field["persistence"][own].mean())
    pair, source = boundary_chains(patch), "face-boundary-local-gradient"
    if pair is None:
        got, source = _slices(patch, downhill, cfg.cross_section_bin_factor), "legacy-global-projection"
        if got is None:
            return empty
        pair, persistence = got[:2], got[2]
    search = max(float(cfg.tin_snap_search_m), 2.5 * frame.cell)
    rows = []
    for kind, raw in zip(("CREST", "TOE"), pair, strict=True):
        p, mean_snap, max_snap = snap(raw, kind == "CREST", downhill, patch, search)
        p = resample(smooth(p, cfg.line_smooth_window), cfg.vertex_spacing_m)
        p = resample(despike(p), cfg.vertex_spacing_m)
        if np.hypot(*(p[-1] - p[0])) < cfg.min_line_length_m:
            return empty
        rows.append((int(pdf["label"].iloc[0]), kind, float(patch.field["slope"][own].mean()), coherence, float(np.clip(persistence / len(cfg.smooth_sigmas_cells), 0, 1)), source, len(raw), len(p), mean_snap, max_snap, p[:, 0].tolist(), p[:, 1].tolist()))
    return pd.DataFrame(rows, columns=empty.columns)


def patches(det: Detection, labels: DataFrame | None = None) -> DataFrame:
    """(label, face, r, c, fields) of each face's cells and their surroundings, found by coarse tiles.

    A face takes the tiles that it touches and those around, at least PATCH cells to every side.
    """
    labels = det.labels if labels is None else labels
    tile = lambda: (F.floor(F.col("r") / PATCH).alias("tr"), F.floor(F.col("c") / PATCH).alias("tc"))
    moves = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    touched = labels.select("label", *tile()).distinct().select("label", "tr", "tc", moves.alias("m"))
    touched = touched.select("label", (F.col("tr") + F.col("m.i")).alias("tr"), (F.col("tc") + F.col("m.j")).alias("tc")).distinct()
    cells = det.grid.select("r", "c", "gx", "gy", "slope", "persistence", "support_m").join(det.tin, ["r", "c"], "left").select("*", *tile())
    around = cells.join(touched, ["tr", "tc"]).drop("tr", "tc")
    return around.join(labels.select("label", "r", "c", F.lit(True).alias("face")), ["label", "r", "c"], "left").withColumn("face", F.coalesce("face", F.lit(False)))


def approximate_lines(det: Detection, cfg: ExtractConfig, labels: DataFrame | None = None) -> DataFrame:
    """Lines of every accepted face with face_id, numbered in order of the faces' first cells."""
    frame = det.frame

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return face_lines(pdf, frame, cfg)

    found = materialize(patches(det, labels).groupBy("label").applyInPandas(run, LINES), "lines")
    faces = ranked(found).select("label", F.col("face").cast("int").alias("face_id"))
    return found.join(faces, "label").withColumn("vertex_spacing_m", F.lit(float(cfg.vertex_spacing_m)))


def vertices_of(lines: DataFrame) -> DataFrame:
    """(face_id, type, vertex, x, y): one row for each vertex, 1-based."""
    at = F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p")
    return lines.select("face_id", "type", at).select("face_id", "type", (F.col("i") + 1).alias("vertex"), F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))


# ---------------------------------------------------------------- line tables, DataFrame


def line_lengths(vertices: DataFrame, key: list[str], order: str = "vertex", dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(key, length): sum of steps over ``dims``; a line of one vertex has length 0."""
    w = Window.partitionBy(*key).orderBy(order)
    square = sum((F.col(d) - F.lag(d).over(w)) ** 2 for d in dims)
    return vertices.select(*key, F.sqrt(square).alias("step")).groupBy(*key).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def resample_table(vertices: DataFrame, key: list[str], spacing: float, order: str = "vertex") -> DataFrame:
    """(key, i, x, y): every line resampled by arc length, as joins of sample positions to segments."""
    w = Window.partitionBy(*key).orderBy(order)
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    kept = vertices.select(*key, order, "x", "y", step.alias("step")).where("step IS NULL OR step > 1e-9")
    so_far = F.sum(F.coalesce("step", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    reach = kept.select(*key, order, "x", "y", so_far.alias("s"))
    seg = reach.select(*key, "s", "x", "y", F.lead("s").over(w).alias("s2"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    total = reach.groupBy(*key).agg(F.max("s").alias("total"))
    seg = seg.where("s2 IS NOT NULL").join(total, key)
    # a segment holds the samples k * spacing in [s, s2), the last one also the end of the line
    k0, k1 = F.ceil(F.col("s") / spacing), F.ceil(F.col("s2") / spacing) - 1
    inner = F.when((k1 >= k0) & (F.col("total") > spacing), F.transform(F.sequence(k0, k1), lambda k: k * spacing)).otherwise(F.when(F.col("s") == 0, F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>")))
    close = F.filter(inner, lambda a: F.col("total") - a > 1e-9)
    at = F.when(F.col("s2") == F.col("total"), F.concat(close, F.array("total"))).otherwise(close)
    out = seg.select(*key, F.explode(at).alias("at"), "s", "s2", "x", "y", "x2", "y2")
    share = (F.col("at") - F.col("s")) / (F.col("s2") - F.col("s"))
    out = out.select(*key, "at", (F.col("x") + (F.col("x2") - F.col("x")) * share).alias("x"), (F.col("y") + (F.col("y2") - F.col("y")) * share).alias("y"))
    return out.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("at")).alias("i"), "x", "y")


def smooth_weighted(vertices: DataFrame, key: list[str], order: str = "vertex", columns: tuple[str, ...] = ("x", "y"), passes: int = 1) -> DataFrame:
    """Means with weights 1, 2, 3, 2, 1 along each line; the two points at either end stay."""
    w = Window.partitionBy(*key).orderBy(order)
    for _ in range(passes):
        new = {}
        for c in columns:
            total = (F.lag(c, 2).over(w) + F.lag(c, 1).over(w) * 2 + F.col(c) * 3 + F.lead(c, 1).over(w) * 2 + F.lead(c, 2).over(w)) / 9
            new[c] = F.coalesce(total, F.col(c))
        vertices = vertices.select(*key, order, *(new[c].alias(c) for c in columns))
    return vertices


def long_enough(lines: DataFrame, least: float) -> DataFrame:
    """Lines of at least ``least`` metres, numbered anew by face, crest before toe."""
    kept = materialize(lines.where(F.col("length_m") >= least), "kept")
    ids = numbered(kept.select("face_id", "type"), ["face_id", "type"]).select("face_id", "type", F.col("rn").cast("int").alias("line_id"))
    return kept.join(ids, ["face_id", "type"])
