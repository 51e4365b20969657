"""Heights of line vertices from the points around them.

Two forms, as in the two extraction paths. ``refine_nearest``: each point feeds its nearest vertex only, through
sums that add up over any partitioning. ``refine_balls``: each vertex takes all points in its ball, with one round of
trimming outliers, and the nearest points where the ball holds too few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..functions.exprs import cell_index, clip
from ..shared import materialize
from .grid import Frame
from .spatial import ball_join, knn_join, nearest_vertex

SUMS = ("n", "su", "sv", "sz", "suu", "suv", "svv", "suz", "svz", "szz")


def plane_sums(pairs: DataFrame, key: str = "vid", u: Column | None = None, v: Column | None = None, z: Column | None = None) -> DataFrame:
    """Sufficient statistics of a plane for each key; combined before the shuffle."""
    u = F.col("x") - F.col("vx") if u is None else u
    v = F.col("y") - F.col("vy") if v is None else v
    z = F.col("z") if z is None else z
    p = pairs.select(key, u.alias("u"), v.alias("v"), z.alias("w"))
    s = lambda e, n: F.sum(e).alias(n)
    U, V, Z = F.col("u"), F.col("v"), F.col("w")
    return p.groupBy(key).agg(F.count("*").alias("n"), s(U, "su"), s(V, "sv"), s(Z, "sz"), s(U * U, "suu"), s(U * V, "suv"), s(V * V, "svv"), s(U * Z, "suz"), s(V * Z, "svz"), s(Z * Z, "szz"))


def _det(m: list[list[Column]]) -> Column:
    return (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )


def plane_fit(sums: DataFrame, least: int = 3) -> DataFrame:
    """Adds a, b, c of z = a u + b v + c and rmse, by Cramer's rule; null below ``least`` points or if singular."""
    col = {s: F.col(s).cast("double") for s in SUMS}
    m = [[col["suu"], col["suv"], col["su"]], [col["suv"], col["svv"], col["sv"]], [col["su"], col["sv"], col["n"]]]
    rhs = [col["suz"], col["svz"], col["sz"]]
    det = _det(m)
    scale = col["suu"] * col["svv"] * col["n"]
    ok = (F.col("n") >= max(3, least)) & (F.abs(det) > 1e-12 * scale) & (scale > 0)
    coef = []
    for k in range(3):
        swapped = [[rhs[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
        coef.append(F.when(ok, _det(swapped) / det))
    out = sums.withColumns(dict(zip("abc", coef, strict=True)))
    sse = col["szz"] - F.col("a") * rhs[0] - F.col("b") * rhs[1] - F.col("c") * rhs[2]
    return out.withColumn("rmse", F.sqrt(F.greatest(sse / col["n"], F.lit(0.0))))


def _vertex_table(vertices: DataFrame, frame: Frame, grid: DataFrame) -> DataFrame:
    """(vid, vx, vy, vz, face_id, type, vertex): vz is the height of the vertex's cell."""
    crest = F.when(F.col("type") == "CREST", 0).otherwise(1)
    vid = F.shiftleft((F.col("face_id") * 2 + crest).cast("long"), 24) + F.col("vertex")
    v = vertices.select(vid.alias("vid"), F.col("x").alias("vx"), F.col("y").alias("vy"), "face_id", "type", "vertex")
    v = v.withColumn("r", cell_index(F.col("vy"), frame.y0, frame.cell, frame.ny, 0.0)).withColumn("c", cell_index(F.col("vx"), frame.x0, frame.cell, frame.nx, 0.0))
    return v.join(grid.select("r", "c", F.col("z").alias("vz")), ["r", "c"], "left").drop("r", "c")


def refine_nearest(points: DataFrame, vertices: DataFrame, frame: Frame, grid: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """(face_id, type, vertex, x, y, z, rmse, n): the out-of-core form. Heights are centred before they are squared."""
    v = _vertex_table(vertices, frame, grid)
    radius = max(frame.cell * cfg.refine_radius_factor, frame.cell * 1.75)
    near = nearest_vertex(points, v.select("vid", "vx", "vy"), radius).join(v.select("vid", "vz"), "vid")
    fit = plane_fit(plane_sums(near, z=F.col("z") - F.coalesce("vz", F.lit(0.0))), cfg.refine_min_points)
    out = v.join(fit.select("vid", "n", "c", "rmse"), "vid", "left")
    z = F.when(F.col("c").isNotNull(), F.coalesce("vz", F.lit(0.0)) + F.col("c")).otherwise(F.col("vz"))
    return out.select("face_id", "type", "vertex", F.col("vx").alias("x"), F.col("vy").alias("y"), z.alias("z"), F.when(F.col("c").isNotNull(), F.col("rmse")).alias("rmse"), F.coalesce("n", F.lit(0)).alias("n"))


def robust_plane(u: np.ndarray, v: np.ndarray, z: np.ndarray, least: int, spread: float = 3.5) -> tuple[float, float, int]:
    """(height at the origin, rmse, points used): least squares, once refitted without outliers of the residual."""
    a = np.column_stack([u, v, np.ones(len(u))])
    fit = lambda k: np.linalg.lstsq(a[k], z[k], rcond=None)[0]
    keep = np.ones(len(z), dtype=bool)
    coef = fit(keep)
    off = z - a @ coef
    off = np.abs(off - np.median(off))
    mad = float(np.median(off))
    if mad > 1e-9 and len(z) >= 10 and (inner := off <= spread * 1.4826 * mad).sum() >= least:
        keep, coef = inner, fit(inner)
    return float(coef[2]), float(np.sqrt(np.mean((z[keep] - a[keep] @ coef) ** 2))), int(keep.sum())


def robust_planes(points: DataFrame, key: str, spread: float = 3.5, floor: float = 0.0, least_mad: float = 1e-9, least: int = 8, whole: int = 10) -> DataFrame:
    """points(key, u, v, w) -> (key, a, b, c, rmse, kept): a plane for each key, once refitted without outliers.

    The table form, for groups of any size: residuals of a first fit, their median and the median of the distances from it are
    aggregates; points within max(floor, spread robust deviations) make the second fit, which counts if ``least`` stay, the
    deviation is over ``least_mad`` and the key has ``whole`` points.
    """
    fit = lambda rows: plane_fit(plane_sums(rows, key, F.col("u"), F.col("v"), F.col("w")))
    points = points.select(key, "u", "v", "w")
    first = materialize(fit(points).select(key, "n", "a", "b", "c", "rmse"), "planes")
    off = F.col("w") - (F.col("a") * F.col("u") + F.col("b") * F.col("v") + F.col("c"))
    off = materialize(points.join(first.select(key, "a", "b", "c"), key).select(key, "u", "v", "w", off.alias("off")), "residuals")
    middle = off.groupBy(key).agg(F.median("off").alias("middle"))
    apart = off.join(middle, key).withColumn("apart", F.abs(F.col("off") - F.col("middle")))
    mad = materialize(apart.groupBy(key).agg(F.median("apart").alias("mad")), "deviations")
    inner = apart.join(mad, key).where(F.col("apart") <= F.greatest(F.lit(float(floor)), F.col("mad") * (spread * 1.4826)))
    again = fit(inner.select(key, "u", "v", "w")).select(key, *(F.col(c).alias(f"{c}2") for c in ("n", "a", "b", "c", "rmse")))
    both = first.join(mad, key).join(again, key, "left")
    use = (F.col("mad") > least_mad) & (F.col("n") >= whole) & (F.col("n2") >= least) & F.col("c2").isNotNull()
    return both.select(key, *(F.when(use, F.col(f"{c}2")).otherwise(F.col(c)).alias(n) for c, n in (("a", "a"), ("b", "b"), ("c", "c"), ("rmse", "rmse"), ("n", "kept"))))


def refine_balls(points: DataFrame, vertices: DataFrame, frame: Frame, grid: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """(face_id, type, vertex, x, y, z, rmse, n): the in-memory form. A ball's points are a bounded neighbourhood."""
    v = _vertex_table(vertices, frame, grid)
    radius = max(frame.cell * cfg.refine_radius_factor, frame.cell * 1.5)
    columns = ["vid", "vx", "vy", "x", "y", "z"]
    ball = ball_join(points, v.select("vid", "vx", "vy"), radius)
    full = ball.groupBy("vid").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.refine_min_points).select("vid")
    short = v.join(full, "vid", "left_anti").select("vid", "vx", "vy")
    pairs = ball.join(full, "vid", "left_semi").select(*columns)
    if not short.isEmpty():
        pairs = pairs.unionByName(knn_join(points, short, max(cfg.refine_min_points, 3), radius).select(*columns))
    least = cfg.refine_min_points

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z0 = float(pdf["z"].mean())
        z, rmse, n = robust_plane((pdf["x"] - pdf["vx"]).to_numpy(), (pdf["y"] - pdf["vy"]).to_numpy(), (pdf["z"] - z0).to_numpy(), least)
        return pd.DataFrame({"vid": [pdf["vid"].iloc[0]], "z": [z + z0], "rmse": [rmse], "n": [n]})

    fit = pairs.groupBy("vid").applyInPandas(run, "vid long, z double, rmse double, n long")
    return v.join(fit, "vid", "left").select("face_id", "type", "vertex", F.col("vx").alias("x"), F.col("vy").alias("y"), F.coalesce("z", "vz").alias("z"), "rmse", F.coalesce("n", F.lit(0)).alias("n"))


def refined_lines(lines: DataFrame, vertices: DataFrame, cell: float, missing_score: float) -> DataFrame:
    """Lines with length (in plan), median rmse, mean support and confidence; ``missing_score``: for lines without any rmse."""
    w = Window.partitionBy("face_id", "type").orderBy("vertex")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    facts = vertices.withColumn("step", step).groupBy("face_id", "type").agg(
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("length_m"), F.median("rmse").alias("median_rmse"), F.avg("n").alias("mean_support_points"),
        F.sort_array(F.collect_list(F.struct("vertex", "x", "y", "z", "rmse", "n"))).alias("vertices"),
    )
    out = lines.drop("xs", "ys").join(facts, ["face_id", "type"])
    fine = F.when(F.col("median_rmse").isNotNull(), F.exp(-F.col("median_rmse") / max(cell, 1e-6))).otherwise(missing_score)
    return out.withColumn("confidence", clip(0.45 * F.col("persistence") + 0.35 * F.col("coherence") + 0.20 * fine, 0.0, 1.0))
