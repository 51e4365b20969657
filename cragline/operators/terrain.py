"""Stencils of a dense grid as window expressions: smoothing, slope, persistence, surface breaks.

Windows run along one row or one column, never over the grid. The smoothings of every scale share the
same two shuffles: one by row, one by column; slope needs one more by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..functions.exprs import clip, gaussian_kernel
from ..shared import materialize
from .grid import Frame
from .quantiles import quantiles

ALONG_ROW = ("r", "c")
ALONG_COLUMN = ("c", "r")
BREAK_SIGMA = 0.55


def _line(axis: tuple[str, str]):
    return Window.partitionBy(axis[0]).orderBy(axis[1])


def _taps(grid: DataFrame, axis: tuple[str, str], kernels: dict[str, tuple[str, list[float]]]) -> DataFrame:
    """Adds name = sum of weights times shifted column, for each name: (column, weights); edges repeat."""
    w = _line(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sorted({c for c, _ in kernels.values()})
    grid = grid.withColumns({f"_f_{c}": F.first(c).over(whole) for c in sources} | {f"_l_{c}": F.last(c).over(whole) for c in sources})
    shifted: dict[str, Column] = {}
    for c, weights in kernels.values():
        for k in range(1, len(weights) // 2 + 1):
            shifted[f"_{c}_{-k}"] = F.lag(c, k).over(w)
            shifted[f"_{c}_{k}"] = F.lead(c, k).over(w)
    grid = grid.withColumns(shifted)
    out = {}
    for name, (c, weights) in kernels.items():
        half = len(weights) // 2
        total = F.col(c) * float(weights[half])
        for k in range(1, half + 1):
            before = F.coalesce(F.col(f"_{c}_{-k}"), F.col(f"_f_{c}"))
            after = F.coalesce(F.col(f"_{c}_{k}"), F.col(f"_l_{c}"))
            total = total + (before + after) * float(weights[half + k])
        out[name] = total
    grid = grid.withColumns(out)
    return grid.drop(*shifted, *(f"_{e}_{c}" for e in "fl" for c in sources))


def gaussian(grid: DataFrame, sigmas: dict[str, float], source: str = "z") -> DataFrame:
    """Adds a smoothed column for each name: sigma (in cells); edge values repeat beyond the grid."""
    flat = {n: s for n, s in sigmas.items() if s <= 0}
    live = {n: gaussian_kernel(s) for n, s in sigmas.items() if s > 0}
    grid = grid.withColumns({n: F.col(source) for n in flat})
    if not live:
        return grid
    once = _taps(grid, ALONG_COLUMN, {f"_{n}": (source, k) for n, k in live.items()})
    return _taps(once, ALONG_ROW, {n: (f"_{n}", k) for n, k in live.items()}).drop(*(f"_{n}" for n in live))


def derivative(source: str, axis: tuple[str, str], cell: float) -> Column:
    """Central difference along an axis, one-sided at the ends."""
    w = _line(axis)
    before, after, here = F.lag(source).over(w), F.lead(source).over(w), F.col(source)
    span = F.when(before.isNotNull() & after.isNotNull(), 2.0 * cell).otherwise(cell)
    return (F.coalesce(after, here) - F.coalesce(before, here)) / span


def slope_degrees(gx: Column, gy: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))


def gradients(grid: DataFrame, cell: float, names: dict[str, str]) -> DataFrame:
    """Adds gx_, gy_ and slope_ for each suffix: source column."""
    grid = grid.withColumns({f"gx_{s}": derivative(c, ALONG_ROW, cell) for s, c in names.items()})
    grid = grid.withColumns({f"gy_{s}": derivative(c, ALONG_COLUMN, cell) for s, c in names.items()})
    return grid.withColumns({f"slope_{s}": slope_degrees(F.col(f"gx_{s}"), F.col(f"gy_{s}")) for s in names})


def slopes(grid: DataFrame, frame: Frame, cfg: ExtractConfig, extra: dict[str, float] | None = None) -> DataFrame:
    """Adds gx_i, gy_i, slope_i of every scale i; ``extra``: further smoothings on the same shuffles."""
    scales = {f"s{i}": s for i, s in enumerate(cfg.smooth_sigmas_cells)}
    smooth = gaussian(grid, scales | (extra or {}))
    return gradients(smooth, frame.cell, {str(i): f"s{i}" for i in range(len(scales))}).drop(*scales)


def slope_thresholds(grid: DataFrame, cfg: ExtractConfig, slope: str = "slope_0") -> tuple[float, float]:
    """(low, high) from exact percentiles of the finest slope over valid cells; given values win."""
    q = quantiles(materialize(grid.where("valid").select(slope), "valid_slopes"), slope, [0.70, 0.85])
    if not q:
        return 15.0, 25.0
    high = cfg.slope_high_deg if cfg.slope_high_deg > 0 else min(55.0, max(18.0, q[1], q[0] + 5.0))
    low = cfg.slope_low_deg if cfg.slope_low_deg > 0 else min(max(min(q[0], 0.72 * high), 8.0), high - 2.0)
    return float(low), float(high)


def blended_thresholds(grid: DataFrame, slope: str = "slope") -> tuple[float, float]:
    """(low, high) of the alternative edge engine: a blend of the two percentiles."""
    q = quantiles(materialize(grid.where("valid").select(slope), "valid_slopes"), slope, [0.70, 0.85])
    if not q:
        return 15.0, 25.0
    high = min(38.0, max(17.0, 0.55 * q[0] + 0.45 * q[1]))
    return min(max(0.52 * high, 8.0), high - 4.0), high


def detection_fields(grid: DataFrame, cfg: ExtractConfig, low: float, high: float) -> DataFrame:
    """Adds persistence, weak, strong and the means gx, gy, slope over the scales."""
    n = range(len(cfg.smooth_sigmas_cells))
    total = lambda parts: sum(parts[1:], parts[0])
    mean = lambda name: total([F.col(f"{name}_{i}") for i in n]) / float(len(n))
    persistence = total([(F.col(f"slope_{i}") >= low).cast("int") for i in n])
    steep = F.greatest(*(F.col(f"slope_{i}") for i in n), F.lit(0.0)) >= high
    grid = grid.withColumns({"persistence": persistence, "strong": steep & F.col("valid"), "gx": mean("gx"), "gy": mean("gy"), "slope": mean("slope")})
    return grid.withColumn("weak", (F.col("persistence") >= min(cfg.min_scale_persistence, len(n))) & F.col("analysis_valid"))


def break_scores(grid: DataFrame, frame: Frame, smooth: str | None = None) -> DataFrame:
    """(r, c, score): greatest angle between a quad's normal and those of its four neighbours.

    Quads lie between four cell centres, so there is a row and a column fewer. A quad's normal is the sum of
    its two triangles' normals; quads that are not fully open to analysis score nothing.
    """
    if frame.nx < 3 or frame.ny < 3:
        spark = grid.sparkSession
        n = max(1, frame.nx - 1)
        return spark.range(n * max(1, frame.ny - 1)).select(F.expr(f"int(id div {n})").alias("r"), F.expr(f"int(id % {n})").alias("c"), F.lit(0.0).alias("score"))
    if smooth is None:
        grid, smooth = gaussian(grid, {"_t": BREAK_SIGMA}), "_t"
    right, above = _line(ALONG_ROW), _line(ALONG_COLUMN)
    g = grid.select("r", "c", F.col(smooth).alias("p00"), F.col("analysis_valid").alias("o0"))
    g = g.withColumns({"p10": F.lead("p00").over(right), "o1": F.lead("o0").over(right)})
    g = g.withColumns({"p01": F.lead("p00").over(above), "p11": F.lead("p10").over(above), "o2": F.lead("o0").over(above), "o3": F.lead("o1").over(above)})
    g = g.where((F.col("c") < frame.nx - 1) & (F.col("r") < frame.ny - 1))
    c = frame.cell
    # both triangles share the diagonal p00-p11; their normals' sum has a plain form
    nx = -c * (F.col("p10") - F.col("p00")) - c * (F.col("p11") - F.col("p01"))
    ny = c * (F.col("p10") - F.col("p11")) + c * (F.col("p00") - F.col("p01"))
    nz = F.lit(2.0 * c * c)
    size = F.greatest(F.sqrt(nx * nx + ny * ny + nz * nz), F.lit(1e-12))
    g = g.select("r", "c", (nx / size).alias("nx"), (ny / size).alias("ny"), (nz / size).alias("nz"), (F.col("o0") & F.col("o1") & F.col("o2") & F.col("o3")).alias("open"))

    def turn(axis, shift) -> Column:
        there = lambda name: shift(name).over(_line(axis))
        dot = F.col("nx") * there("nx") + F.col("ny") * there("ny") + F.col("nz") * there("nz")
        return F.when(F.col("open") & there("open"), F.degrees(F.acos(clip(dot, -1.0, 1.0)))).otherwise(0.0)

    g = g.withColumns({"_a": turn(ALONG_COLUMN, F.lag), "_b": turn(ALONG_COLUMN, F.lead)})
    g = g.withColumns({"_c": turn(ALONG_ROW, F.lag), "_d": turn(ALONG_ROW, F.lead)})
    return g.select("r", "c", F.greatest("_a", "_b", "_c", "_d").alias("score"))


def closing(grid: DataFrame, mask: str, out: str, times: int = 1) -> DataFrame:
    """Adds the binary closing of ``mask`` by 3 x 3: ``times`` dilations, then as many erosions; outside is false."""
    grid = grid.withColumn(out, F.col(mask).cast("int"))
    for step in [F.max] * times + [F.min] * times:
        for axis in (ALONG_ROW, ALONG_COLUMN):
            near = _line(axis).rowsBetween(-1, 1)
            value = step(out).over(near)
            if step is F.min:
                value = F.when(F.count(out).over(near) < 3, 0).otherwise(value)
            grid = grid.withColumn(out, value)
    return grid.withColumn(out, F.col(out) == 1)


def fill_sparse(grid: DataFrame, rounds: int = 8, least: int = 2) -> DataFrame:
    """Alternative engine: empty cells become the mean of their valid neighbours, if at least ``least``, round by round."""
    for _ in range(rounds):
        filled = _neighbour_sums(grid.withColumn("_z", F.when(F.col("valid"), F.col("z"))), "_z")
        take = ~F.col("valid") & (F.col("_n") >= least)
        grid = filled.select("r", "c", F.when(take, F.col("_s") / F.col("_n")).otherwise(F.col("z")).alias("z"), (F.col("valid") | take).alias("valid"))
    return grid


def _neighbour_sums(grid: DataFrame, column: str) -> DataFrame:
    """Adds _s and _n: sum and count of the eight neighbours that have a value."""
    row, col = _line(ALONG_ROW).rowsBetween(-1, 1), _line(ALONG_COLUMN).rowsBetween(-1, 1)
    g = grid.withColumns({"_rs": F.sum(column).over(row), "_rn": F.count(column).over(row)})
    g = g.withColumns({"_bs": F.sum("_rs").over(col), "_bn": F.sum("_rn").over(col)})
    own = F.col(column)
    return g.withColumns({"_s": F.coalesce(F.col("_bs"), F.lit(0.0)) - F.coalesce(own, F.lit(0.0)), "_n": F.col("_bn") - own.isNotNull().cast("int")}).drop("_rs", "_rn", "_bs", "_bn")


def smooth_masked(grid: DataFrame, passes: int = 2) -> DataFrame:
    """Alternative engine: 3 x 3 means with weights 6 (centre), 4 (sides) and 1 (corners) over valid cells; others stay."""
    for _ in range(passes):
        g = grid.withColumns({"_v": F.when(F.col("valid"), F.col("z")), "_k": F.col("valid").cast("double")})
        parts = {}
        for name in ("_v", "_k"):
            w = _line(ALONG_ROW)
            parts[f"{name}0"] = F.coalesce(F.col(name), F.lit(0.0))
            parts[f"{name}1"] = F.coalesce(F.lag(name).over(w), F.lit(0.0)) + F.coalesce(F.lead(name).over(w), F.lit(0.0))
        g = g.withColumns(parts)
        w = _line(ALONG_COLUMN)
        both = lambda name: F.coalesce(F.lag(name).over(w), F.lit(0.0)) + F.coalesce(F.lead(name).over(w), F.lit(0.0))
        total = {n: 6.0 * F.col(f"{n}0") + 4.0 * (F.col(f"{n}1") + both(f"{n}0")) + both(f"{n}1") for n in ("_v", "_k")}
        g = g.withColumns({"_tv": total["_v"], "_tk": total["_k"]})
        grid = g.select("r", "c", F.when(F.col("valid"), F.col("_tv") / F.col("_tk")).otherwise(F.col("z")).alias("z"), "valid")
    return grid
