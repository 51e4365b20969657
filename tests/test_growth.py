"""Work and memory of the terrain queries grow no faster than their tables."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from cragline.operators import graph, grid, halo, single_edge, terrain
from cragline.plans import extract as E
from cragline.plans import registry
from cragline.sources import las, points

SF = "/root/testdata/sf0.001"


def lattice(spark, valid, z):
    r, c = np.indices(valid.shape)
    rows = pd.DataFrame({"r": r.ravel().astype("int32"), "c": c.ravel().astype("int32"), "z": np.where(valid, z, np.nan).ravel(), "valid": valid.ravel()})
    return spark.createDataFrame(rows).selectExpr("r", "c", "CASE WHEN valid THEN z END AS z", "valid")


def plan(df) -> str:
    return df._jdf.queryExecution().toString().lower()


def test_distance_reads_no_line_anew_for_each_cell(spark):
    assert "unboundedfollowing" not in plan(registry.queries()["win_distance"](spark, SF))


def test_distance_over_batches_that_cut_rows():
    rng = np.random.default_rng(4)
    shape = (9, 40)
    g = np.where(rng.random(shape) < 0.2, 0.0, rng.integers(1, 9, shape).astype(float))
    g[3] = np.nan
    table = pa.table({"r": np.repeat(np.arange(9, dtype=np.int32), 40), "c": np.tile(np.arange(40, dtype=np.int32), 9), "g": pa.array(g.ravel(), from_pandas=True), "gz": g.ravel()})
    want = np.sqrt(((np.arange(40)[:, None] - np.arange(40)) ** 2 + np.where(np.isnan(g), np.inf, g)[:, None] ** 2).min(-1))
    for size in (1, 7, 40, 55, 400):
        got = pa.Table.from_batches(grid._envelopes(table.to_batches(max_chunksize=size)))
        assert got["c"].to_pylist() == table["c"].to_pylist() and np.allclose(got["d"].to_numpy().reshape(shape), want)


def test_gap_fill_reads_no_line_anew_and_joins_nothing_back(spark):
    found = plan(registry.queries()["win_gap_fill"](spark, SF))
    assert "unboundedfollowing" not in found and found.count("sortmergejoin") <= 1  # the lattice's own


def test_report_reads_no_line_anew_for_each_cell(spark):
    found = plan(registry.queries()["snk_report"](spark, SF))
    assert "unboundedfollowing" not in found and "mapinarrow" in found


def test_tall_grid_is_bridged_in_linear_time(spark):
    """A column of 60,000 cells: its frames to the end of the line would hold 1.8 thousand million."""
    n = 60_000
    valid = np.ones((n, 2), bool)
    valid[1::2, 0] = False
    z = np.arange(n, dtype=float)[:, None] * [1.0, 1.0]
    out = grid.reconstruct(lattice(spark, valid, z), grid.Frame(0.0, 0.0, 1.0, 2, n), 1.5)
    assert out.where("abs(z - r) > 1e-9 OR NOT analysis_valid").count() <= 1 and out.count() == 2 * n


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["flow_extract", "flow_extract_memory", "flow_extract_face", "str_progress"])
def test_whole_runs_read_a_written_cloud(spark, monkeypatch, name):
    """Runs read their points many times over; the cloud is written once and not made anew from lineitem each time."""

    def stop(points, *_, **options):
        raise Seen(points.inputFiles(), options)

    monkeypatch.setattr(E, "extract_points", stop)
    monkeypatch.setattr(E, "face_at", stop)
    with pytest.raises(Seen) as seen:
        registry.queries()[name](spark, SF)
    files, options = seen.value.args
    assert files and all("/cloud-" in f for f in files)
    assert name != "flow_extract_face" or options["limit"] is None  # every point of the face


def test_edge_surface_keeps_its_cell_at_any_size():
    f = single_edge.surface_frame((0.0, 0.0), (29.75, 12_000.0), 0.25)
    assert f.cell == 0.25 and not f.adjusted and f.nx * f.ny > 5_000_000
    assert single_edge.surface_frame((0.0, 0.0), (29.75, 12_000.0), 0.25, 250_000).adjusted


def test_edge_surface_of_tiles_equals_windows(spark):
    rng = np.random.default_rng(6)
    valid = rng.random((40, 33)) < 0.3
    valid[12:36, 5:30] = False  # more than eight rounds fill
    z = rng.random(valid.shape) * 5
    f, g = grid.Frame(0.0, 0.0, 0.25, 33, 40), lattice(spark, valid, z)
    smooth = terrain.smooth_masked(terrain.fill_sparse(g).withColumn("z", F.coalesce("z", F.lit(0.0))))
    want = terrain.gradients(smooth, 0.25, {"0": "z"}).select("r", "c", "z", "valid", "gx_0", "gy_0", F.when(F.col("valid"), F.col("slope_0")).otherwise(0.0)).toPandas().sort_values(["r", "c"]).to_numpy(float)
    got = halo.median_surface(g.where("valid"), f, tile=16).toPandas().sort_values(["r", "c"]).to_numpy(float)
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-9)


def test_points_move_in_windows_as_on_the_whole_surface(spark):
    r, c = np.indices((60, 90))
    z = np.clip(10 - (c * 0.25 - 10), 5, 10) + 0.01 * np.sin(r + 3 * c)
    gx, gy = np.gradient(z, 0.25, axis=1), np.gradient(z, 0.25, axis=0)
    field = {"z": z, "gx": gx, "gy": gy, "slope": np.degrees(np.arctan(np.hypot(gx, gy)))}
    rows = spark.createDataFrame(pd.DataFrame({"r": r.ravel(), "c": c.ravel(), **{k: v.ravel() for k, v in field.items()}}))
    f = grid.Frame(0.0, 0.0, 0.25, 90, 60)
    line = np.column_stack([np.full(14, 10.6), np.arange(14) + 0.3, np.full(14, 7.0)])
    want, moved, shift = single_edge.snap_points(line, single_edge._tangents(line, 2), field, f, True, 20.0, 35.0)
    got, n, middle = single_edge.snap_to_transition(line, rows, f, True, 20.0, 35.0)
    assert moved.sum() == n >= 8 and np.allclose(got, want) and middle == np.median(np.abs(shift[moved]))


@pytest.mark.parametrize("tile", [7, 512])
def test_chains_of_tiles_are_the_components_of_all_pairs(spark, tile):
    rng = np.random.default_rng(2)
    r, c = np.nonzero(rng.random((30, 26)) < 0.12)
    near = (np.abs(r[:, None] - r) <= 2) & (np.abs(c[:, None] - c) <= 2) & (np.hypot(r[:, None] - r, c[:, None] - c) <= 2.35)
    a, b = np.nonzero(near)
    flat = r * 26 + c
    want = dict(zip(zip(r.tolist(), c.tolist()), flat[graph.local_components(len(r), a, b)].tolist()))
    cells = spark.createDataFrame(pd.DataFrame({"r": r.astype("int32"), "c": c.astype("int32")}))
    got = graph.label_near(cells, grid.Frame(0, 0, 1, 26, 30), single_edge.REACH, tile)
    assert {(x["r"], x["c"]): x["label"] for x in got.collect()} == want


def test_chain_joins_no_pairs_of_cells(spark):
    """One tile: cells meet in arrays, and no table of their pairs is made."""
    cells = spark.createDataFrame([(i, i % 2) for i in range(20)], "r int, c int")
    found = single_edge.nearest_chain(cells, grid.Frame(0.0, 0.0, 1.0, 2, 20), (0.0, 0.0))
    assert found.count() == 20 and "join" not in plan(found)


def las_cloud(spark, path, most):
    """1,000 points in 4 tasks, written as files of at most ``most`` records."""
    p = spark.range(1000, numPartitions=4).selectExpr("id AS pid", "id * 0.25 AS x", "id % 40 + 0.5D AS y", "sin(id) AS z", "int(id % 5) AS cls")
    return p, las.write_las_parts(p.repartition(3, "z"), path, most=most)


def test_las_cloud_is_written_by_tasks_and_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "a.las")
    p, files = las_cloud(spark, path, 90)
    assert files >= 12
    got = las.read_las(spark, path, 130)
    assert got.rdd.getNumPartitions() == 8  # ranges that files cut
    both = got.alias("g").join(p.alias("p"), "pid")
    assert both.where("abs(g.x - p.x) < 6e-4 AND g.y = p.y AND abs(g.z - p.z) < 6e-4 AND g.cls = p.cls").count() == got.count() == 1000
    las.write_las_parts(p.where("false"), str(tmp_path / "none.las"))
    assert las.read_las(spark, str(tmp_path / "none.las")).count() == 0


def test_header_of_a_las_cloud_counts_all_its_files(spark, tmp_path):
    path = str(tmp_path / "a.las")
    las_cloud(spark, path, 90)
    h = las.read_header(path)
    assert h.point_count == 1000 and h.mins[:2] == (0.0, 0.5) and h.maxs[:2] == (249.75, 39.5)
    assert points.inspect(spark, path).n == 1000


def test_class_of_a_las_cloud_by_suffix(spark, tmp_path):
    path = str(tmp_path / "a.las")
    las_cloud(spark, path, 300)
    assert sorted(r["pid"] for r in points.read_points(spark, path).where("cls = 2").collect()) == list(range(2, 1000, 5))


def test_ranges_of_a_las_cloud_are_skipped(spark, tmp_path):
    path, target = str(tmp_path / "a.las"), str(tmp_path / "ranges.json")
    p, _ = las_cloud(spark, path, 90)
    assert las.write_statistics(spark, path, target, 50) == 20
    got = las.read_las_in(spark, path, target, {"x": (30, 60)}, [1, 3])
    assert got.rdd.getNumPartitions() == 3
    assert sorted(r["pid"] for r in got.collect()) == sorted(r["pid"] for r in p.where("x BETWEEN 30 AND 60 AND cls IN (1, 3)").collect())


@pytest.mark.parametrize("name", ["src_las_chunks", "src_las_header", "src_las_memory", "src_las_pruned"])
def test_las_queries_bring_no_points_to_the_driver(spark, monkeypatch, name):
    def refused(self):
        raise AssertionError("points at the driver")

    monkeypatch.setattr(type(spark.range(1)), "toPandas", refused)
    assert registry.queries()[name](spark, SF).count() > 0
