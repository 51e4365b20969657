"""Halo tiles against window expressions, the point index against plain filters, and push-down into LAS files."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cragline.config import ExtractConfig
from cragline.operators import faces, grid, halo, select, terrain
from cragline.sources import las, octree

from .test_terrain import cells_of, frame_of


def rows(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("shape", [(37, 53), (2, 9), (1, 1), (5, 70)])
def test_tiles_equal_windows(spark, shape):
    rng = np.random.default_rng(4)
    z = rng.normal(0, 1, shape)
    cfg = ExtractConfig(cell_size=0.5, smooth_sigmas_cells=(0.0, 0.8, 3.0))
    frame = frame_of(z, 0.5)
    valid = rng.random(shape) > 0.1
    g = cells_of(spark, z, valid).withColumn("z", F.coalesce("z", F.lit(0.25)))
    want = terrain.slopes(g, frame, cfg)
    names = [f"{f}_{i}" for i in range(3) for f in ("gx", "gy", "slope")]
    for tile in (16, 20, 512):
        got = halo.surface(g, frame, cfg, tile)
        assert got.count() == z.size
        assert np.allclose(rows(got, "r", "c", *names), rows(want, "r", "c", *names), atol=1e-8)
        if min(shape) >= 3:
            assert np.allclose(rows(got.where("score IS NOT NULL"), "r", "c", "score"), rows(terrain.break_scores(g, frame), "r", "c", "score"), atol=1e-5)


def test_tiled_closing(spark):
    rng = np.random.default_rng(8)
    mask = rng.random((45, 61)) < 0.3
    g = cells_of(spark, mask.astype(float)).withColumn("m", F.col("z") > 0)
    frame = frame_of(mask, 1.0)
    for times in (1, 2):
        want = rows(terrain.closing(g, "m", "on", times).where("on"), "r", "c")
        for tile in (7, 16, 512):
            assert rows(halo.closed(g.where("m"), frame, times, tile), "r", "c") == want
    assert halo.closed(g.where("r < 0"), frame).count() == 0


def test_tile_size_changes_no_face(spark):
    r, c = np.indices((70, 90))
    z = np.where((r // 30) % 2 == 0, np.clip(20 - 0.25 * c, 5, 10), 5.0) + np.random.default_rng(1).normal(0, 0.01, r.shape)
    cfg = ExtractConfig(cell_size=0.25, slope_low_deg=25, slope_high_deg=35, min_face_area_m2=2)
    found = [faces.detect(cells_of(spark, z), frame_of(z, 0.25), cfg, tile) for tile in (24, 512)]
    labels = [rows(d.labels, "r", "c", "label") for d in found]
    assert labels[0] == labels[1] and len({x[2] for x in labels[0]}) >= 2
    assert rows(found[0].tin, "r", "c", "score") == rows(found[1].tin, "r", "c", "score")
    assert [(d.low, d.high) for d in found] == [(25.0, 35.0)] * 2


def cloud(spark, n=4000, seed=3):
    rng = np.random.default_rng(seed)
    x, y, z = np.concatenate([rng.uniform(0, 200, (3, n - 500)), rng.normal(50, 0.5, (3, 500))], axis=1)
    z = z / 10
    return spark.createDataFrame(pd.DataFrame({"pid": np.arange(n), "x": x, "y": y, "z": z, "cls": rng.integers(0, 5, n)}))


def test_index_gives_the_same_rows_from_few_files(spark, tmp_path):
    p = cloud(spark)
    path = str(tmp_path / "index")
    octree.build(p, path, ["pid"], levels=5, files=16)
    points, cube = octree.opened(spark, path)
    assert rows(points, "pid", "x", "y", "z", "cls") == rows(p, "pid", "x", "y", "z", "cls")
    for start, end, width, classes in [((10, 10), (60, 40), 8, None), ((0, 0), (200, 200), 1, [1, 3]), ((50, 50), (50, 50), 2, None), ((-90, -90), (-80, -80), 5, None), ((100, 0), (100, 300), 500, None)]:
        want = rows(select.corridor(p, start, end, width, classes), "pid")
        assert rows(octree.read_corridor(points, cube, start, end, width, classes), "pid") == want
    for seed, radius in [((50, 50, 5), 3), ((0, 0, 0), 20), ((199, 199, 19), 30), ((500, 0, 0), 4)]:
        assert rows(octree.read_cylinder(points, cube, seed, radius), "pid") == rows(select.cylinder(p, seed, radius), "pid")
    spans = octree.ranges(cube, octree.in_box((45, 45), (55, 55)))
    assert 0 < len(spans) <= octree.RANGES
    per_file = points.groupBy(F.input_file_name().alias("f")).agg(F.min("code").alias("lo"), F.max("code").alias("hi")).collect()
    touched = sum(any(a <= r["hi"] and r["lo"] < b for a, b in spans) for r in per_file)
    assert touched < len(per_file) / 2
    inside = octree.within(points, spans)  # the ranges reach the scan
    assert "PushedFilters: [Or(" in inside._jdf.queryExecution().toString() or len(spans) == 1
    assert rows(inside.where("x BETWEEN 45 AND 55 AND y BETWEEN 45 AND 55"), "pid") == rows(p.where("x BETWEEN 45 AND 55 AND y BETWEEN 45 AND 55"), "pid")


def test_levels_hold_one_point_a_node(spark):
    p = cloud(spark, 1500)
    cube = octree.cube_of(p)
    got = octree.with_levels(p, cube, ["pid"], 4).toPandas()
    assert len(got) == 1500
    for level in range(4):
        node = got["code"] // 8 ** (octree.DEPTH - level)
        first = got.groupby(node)["pid"].min()
        assert set(got.loc[got["level"] <= level, "pid"]) == set(first)
    r = got.iloc[7]
    steps = [min((1 << 20) - 1, int((r[a] - getattr(cube, a)) / cube.edge * (1 << 20))) for a in "xyz"]
    assert r["code"] == octree.morton_number(*steps)
    empty = p.where("pid < 0")
    assert octree.with_levels(empty, octree.cube_of(empty), ["pid"]).count() == 0


def test_las_ranges_are_skipped(spark, tmp_path):
    n = 5000
    x = np.arange(n) / 10.0
    path, target = str(tmp_path / "a.las"), str(tmp_path / "ranges.json")
    las.write_las(path, x, x * 2, np.sin(x), np.arange(n) // 1000)
    assert las.write_statistics(spark, path, target, 250) == 20
    whole = las.read_las(spark, path, 250)
    for box, classes, parts in [({"x": (100.001, 150)}, None, 3), ({}, [1, 4], 8), ({"y": (-1, 449)}, [2], 1), ({"x": (-9, -5)}, None, 1), ({}, None, 20)]:
        want = whole.where(" AND ".join([f"{a} BETWEEN {lo} AND {hi}" for a, (lo, hi) in box.items()] + ([f"cls IN ({', '.join(map(str, classes))})"] if classes else ["true"])))
        got = las.read_las_in(spark, path, target, box, classes)
        assert rows(got, "pid", "x", "cls") == rows(want, "pid", "x", "cls")
        assert got.rdd.getNumPartitions() == parts
