"""Point filters, guards and samples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLASS_NAMES, ExtractConfig
from ..functions.exprs import finite
from ..shared import materialize

LEAST_POINTS = 50


def finite_points(points: DataFrame) -> DataFrame:
    """Rows whose x, y and z are all finite."""
    return points.where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))


def in_classes(points: DataFrame, classes: Iterable[int] | None) -> DataFrame:
    """Strict class filter, pushed to the scan; None keeps everything."""
    return points if classes is None else points.where(F.col("cls").isin([int(c) for c in classes]))


def strict_classes(points: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """The out-of-core rule: filter strictly, and fail if a filter is asked for but there are no classes."""
    classes = cfg.selected_classes()
    if classes is not None and "cls" not in points.columns:
        raise ValueError("a class filter was asked for, but the cloud has no classification")
    return in_classes(points, classes)


def require_points(count: int, least: int = LEAST_POINTS, what: str = "the selected classes") -> None:
    if count < least:
        raise ValueError(f"too few points in {what}: {count}, at least {least} are needed")


def lenient_classes(points: DataFrame, cfg: ExtractConfig) -> tuple[DataFrame, bool, int]:
    """The in-memory rule, as (points, ground used, count).

    An explicit list filters and needs LEAST_POINTS; an explicit empty list keeps all; automatic ground
    filters only if at least max(100, 1 %) of the points are ground.
    """
    has = "cls" in points.columns
    total, classed = points.agg(F.count("*"), F.count("cls") if has else F.lit(0)).first()
    if has and classed and cfg.classification_filter is not None:
        wanted = cfg.classification_filter
        if not wanted:
            kept, ground, n = points, False, total
        else:
            kept = in_classes(points, wanted)
            n = kept.count()
            require_points(n)
            ground = tuple(wanted) == (cfg.ground_class,)
    elif has and classed and cfg.use_ground_class:
        n = points.where(F.col("cls") == cfg.ground_class).count()
        ground = n >= max(100, int(0.01 * total))
        kept, n = (in_classes(points, [cfg.ground_class]), n) if ground else (points, total)
    else:
        kept, ground, n = points, False, total
    require_points(n, what="the cloud")
    return kept, ground, n


def clicked_classes(points: DataFrame, classes: Iterable[int] | None, least: int = 120, ground: int = 2) -> tuple[DataFrame, bool]:
    """The rule for a clicked face: negative classes are unknown; with no list, ground if it is max(250, 5 %)."""
    points = points.withColumn("cls", F.when(F.col("cls") >= 0, F.col("cls")))
    total, known = points.agg(F.count("*"), F.count("cls")).first()
    if not known:
        return points, False
    wanted = [int(c) for c in classes or []]
    if wanted:
        kept = in_classes(points, wanted)
        require_points(kept.count(), least)
        return kept, wanted == [ground]
    n = points.where(F.col("cls") == ground).count()
    return (in_classes(points, [ground]), True) if n >= max(250, int(0.05 * total)) else (points, False)


def numbered(points: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rn``, the 1-based position in the global order, without a single-task window.

    Rows are range-partitioned by ``order``; each partition numbers its own and is shifted by the counts
    before it, of which there are as many as partitions.
    """
    spark = points.sparkSession
    part = materialize(points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "parts")
    counts = sorted((r["_part"], r["count"]) for r in part.groupBy("_part").count().collect())
    shift, at = [], 0
    for p, n in counts:
        shift.append((p, at))
        at += n
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    offsets = spark.createDataFrame(shift, "_part int, _shift long")
    return part.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn("rn", F.col("_own") + F.col("_shift")).drop("_part", "_own", "_shift")


def every_nth(points: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Rows 0, s, 2s, ... of the order, s = ceil(n / limit), so that at most ``limit`` stay."""
    n = points.count()
    stride = -(-n // limit) if n else 1
    return points if stride <= 1 else numbered(points, order).where((F.col("rn") - 1) % stride == 0).drop("rn")


def hash_sample(points: DataFrame, limit: int, seed: int, key: list[str]) -> DataFrame:
    """``limit`` rows at most, chosen by hash: the same rows whatever the partitions."""
    return points.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(limit)


def class_histogram(points: DataFrame) -> DataFrame:
    """(cls, name, n) of every class that occurs."""
    names = points.sparkSession.createDataFrame(sorted(CLASS_NAMES.items()), "cls int, name string")
    counts = points.groupBy(F.col("cls").cast("int").alias("cls")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(names), "cls", "left").select("cls", F.coalesce("name", F.lit("Reserved")).alias("name"), "n")


def density(points: DataFrame, *key: str) -> DataFrame:
    """(key, n, density): points and points per square of their bounding box, which is 1e-9 at least."""
    box = F.greatest((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")), F.lit(1e-9))
    return points.groupBy(*key).agg(F.count("*").alias("n"), (F.count("*") / box).alias("density"))


def corridor(points: DataFrame, start: tuple[float, float], end: tuple[float, float], width: float, classes: Iterable[int] | None = None, limit: int | None = None) -> DataFrame:
    """Points of an oriented rectangle around a segment, with their position along and across it."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    length = (dx * dx + dy * dy) ** 0.5
    ux, uy = (dx / length, dy / length) if length else (1.0, 0.0)
    reach = width / 2
    lo, hi = [min(s, e) - reach for s, e in zip(start, end, strict=True)], [max(s, e) + reach for s, e in zip(start, end, strict=True)]
    box = F.col("x").between(lo[0], hi[0]) & F.col("y").between(lo[1], hi[1])  # reaches the scan, unlike the rotated test
    along = (F.col("x") - start[0]) * ux + (F.col("y") - start[1]) * uy
    across = (F.col("y") - start[1]) * ux - (F.col("x") - start[0]) * uy
    out = in_classes(points.where(box), classes).withColumn("along", along).withColumn("across", across)
    out = out.where(F.col("along").between(0.0, length) & (F.abs("across") <= reach))
    return out if limit is None else out.limit(limit)


def square_tile(points: DataFrame, seed: tuple[float, float], half: float, classes: Iterable[int] | None = None, seen: Iterable[int] = (), limit: int | None = None, least: int = 500) -> tuple[DataFrame, bool]:
    """(points of a square around the seed, whether classes were dropped).

    A request for ground alone that yields fewer than ``least`` points, before ground has been seen, is asked again
    for every class.
    """
    x, y = seed
    ask = lambda wanted: corridor(points, (x - half, y), (x + half, y), 2 * half, wanted, limit)
    wanted = None if classes is None else [int(c) for c in classes]
    found = ask(wanted)
    if wanted == [2] and 2 not in set(seen) and found.limit(least).count() < least:
        return ask(None), True
    return found, False


def preset_classes(mode: str, chosen: Iterable[int] = ()) -> list[int] | None:
    """Classes of a preset: ``all`` filters nothing (None), ``ground``, ``none``, or ``custom`` for the chosen ones."""
    presets = {"all": None, "ground": [2], "none": [], "custom": sorted({int(c) for c in chosen})}
    if mode not in presets:
        raise ValueError(f"unknown class preset: {mode}")
    return presets[mode]


def cylinder(points: DataFrame, seed: tuple[float, float, float], radius: float) -> DataFrame:
    """Points within ``radius`` of the seed in plan and max(1.5 radius, 8) in height."""
    x, y, z = seed
    box = F.col("x").between(x - radius, x + radius) & F.col("y").between(y - radius, y + radius)
    near = (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2 <= radius * radius
    return points.where(box & near & (F.abs(F.col("z") - z) <= max(1.5 * radius, 8.0)))


def dedup_mm(points: DataFrame) -> DataFrame:
    """One row for each position rounded to the millimetre, the first by pid where there is one."""
    keys = [F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(f"{c}_mm") for c in ("x", "y", "z")]
    order = F.col("pid") if "pid" in points.columns else F.lit(0)
    rows = points.select(*keys, F.struct(*points.columns).alias("p"), order.alias("o"))
    return rows.groupBy("x_mm", "y_mm", "z_mm").agg(F.min_by("p", "o").alias("p")).select("p.*")
