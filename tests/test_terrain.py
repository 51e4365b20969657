"""Behaviour of the terrain operators on shapes whose answer is known."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cragline.config import ExtractConfig, classes_for_auto, classes_for_click, classes_for_terrain
from cragline.operators import faces, graph, grid, lines, refine, select, single_edge, spatial, terrain
from cragline.plans import extract as E


def ramp(nx, ny, step, noise, seed):
    """Bench at 10 up to x = 10, a face down to 5 at x = 15, a lower bench."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:ny, 0:nx] * step
    z = np.clip(20 - x, 5, 10) + rng.normal(0, noise, x.shape)
    return x.ravel(), y.ravel(), z.ravel()


def frame_of(z, cell):
    return grid.Frame(0.0, 0.0, cell, z.shape[1], z.shape[0])


def cells_of(spark, z, valid=None):
    r, c = np.indices(z.shape)
    valid = np.ones(z.shape, bool) if valid is None else valid
    pdf = pd.DataFrame({"r": r.ravel().astype("int32"), "c": c.ravel().astype("int32"), "z": np.where(valid, z, np.nan).ravel(), "valid": valid.ravel()})
    df = spark.createDataFrame(pdf).withColumn("z", F.when(F.col("valid"), F.col("z")))
    return df.withColumns({"analysis_valid": F.col("valid"), "support_m": F.lit(0.0)})


def to_array(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.select("r", "c", F.col(value).cast("double").alias("v")).collect():
        out[r["r"], r["c"]] = np.nan if r["v"] is None else r["v"]
    return out


def test_end_to_end_out_of_core_and_in_memory(spark, tmp_path):
    x, y, z = ramp(120, 80, 0.25, 0.01, 7)
    pts = spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(x)), "x": x, "y": y, "z": z, "cls": np.full(len(x), 2)}))
    path = str(tmp_path / "cloud.parquet")
    pts.write.parquet(path)
    cfg = ExtractConfig(cell_size=0.25, slope_low_deg=25, slope_high_deg=35, min_face_area_m2=8, min_line_length_m=8, classification_filter=(2,))
    seen = []
    report = E.extract(spark, path, str(tmp_path / "out"), cfg, lambda p, m: seen.append(p))
    assert report["streaming_mode"] and report["crest_lines"] >= 1 and report["toe_lines"] >= 1
    assert seen == sorted(seen) and seen
    for name in ("breaklines.geojson", "vertices.csv", "breaklines.dxf", "report.json", "debug/01_slope.asc"):
        assert (tmp_path / "out" / name).exists()
    from cragline.sources.sinks import read_geojson

    back = read_geojson(spark, str(tmp_path / "out" / "breaklines.geojson")).collect()
    for kind, at in (("CREST", 10), ("TOE", 15)):
        xs = [p[0] for r in back if r["type"] == kind for p in r["coordinates"]]
        assert abs(np.median(xs) - at) <= 0.8


def test_text_cloud_in_memory(spark, tmp_path):
    x, y, z = ramp(150, 100, 0.20, 0.015, 42)
    path = tmp_path / "slope.xyz"
    np.savetxt(path, np.column_stack([x, y, z]), fmt="%.4f")
    cfg = ExtractConfig(cell_size=0.20, slope_low_deg=25, slope_high_deg=35, min_face_area_m2=10, min_line_length_m=8, smooth_sigmas_cells=(0.5, 1.0, 1.5), min_gradient_coherence=0.8, use_ground_class=False)
    report = E.extract(spark, str(path), str(tmp_path / "out"), cfg)
    assert not report["streaming_mode"] and report["faces_detected"] >= 1
    text = (tmp_path / "out" / "vertices.csv").read_text().splitlines()
    assert text[0].startswith("line_id,face_id,type,vertex")
    rows = [r.split(",") for r in text[1:]]
    for kind, at in (("CREST", 10), ("TOE", 15)):
        assert abs(np.median([float(r[4]) for r in rows if r[2] == kind]) - at) <= 0.8


def test_clicked_face(spark):
    x, y, z = ramp(150, 100, 0.20, 0.01, 123)
    pts = spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(x)), "x": x, "y": y, "z": z, "cls": np.full(len(x), 2)}))
    found, facts = E.face_at(pts, (12.5, 10.0, 7.5), ExtractConfig(cell_size=0.20), [2])
    rows = {r["type"]: r for r in found.collect()}
    assert set(rows) == {"CREST", "TOE"} and all(len(r["vertices"]) >= 2 for r in rows.values())
    assert facts["ground_class_used"] and facts["seed_distance_m"] == 0
    with pytest.raises(ValueError):
        E.face_at(pts, (300.0, 300.0, 0.0), ExtractConfig(cell_size=0.20), [2])


def test_resample_keeps_ends_and_spacing(spark):
    p = np.column_stack([[0, 0.2, 0.7, 1.4, 2.2, 3.1], np.zeros(6)])
    out = lines.resample(p, 1.0)
    steps = np.hypot(*np.diff(out, axis=0).T)
    assert np.allclose(out[[0, -1]], p[[0, -1]]) and ((steps[:-1] > 0.95) & (steps[:-1] < 1.05)).all()
    table = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(p)], "line int, vertex int, x double, y double")
    same = lines.resample_table(table, ["line"], 1.0).orderBy("i").select("x", "y").toPandas().to_numpy()
    assert np.allclose(same, out)


def test_break_score_peaks_at_the_breaks(spark):
    x = np.arange(80) * 0.25
    z = np.tile(np.clip(10 - (x - 7) * 5 / 3, 5, 10), (32, 1))
    score = to_array(terrain.break_scores(cells_of(spark, z), frame_of(z, 0.25)), "score", (31, 79)).mean(0)
    top = (np.argsort(score)[-6:] + 1) * 0.25
    assert (abs(top - 7) <= 0.5).any() and (abs(top - 10) <= 0.5).any()


def test_small_gap_is_bridged(spark):
    z = np.tile(np.linspace(10, 5, 30), (20, 1))
    valid = np.ones(z.shape, bool)
    valid[:, 12:15] = False
    out = grid.reconstruct(cells_of(spark, z, valid), frame_of(z, 0.25), 1.5)
    filled, support = to_array(out, "z", z.shape), to_array(out, "support_m", z.shape)
    assert np.isfinite(filled).all() and to_array(out, "analysis_valid", z.shape).all() and support.max() <= 1.5
    assert (np.diff(filled, axis=1) <= 1e-4).all()


def test_large_void_stays_closed(spark):
    z = np.tile(np.linspace(10, 5, 40), (30, 1))
    valid = np.ones(z.shape, bool)
    valid[8:22, 12:28] = False
    out = grid.reconstruct(cells_of(spark, z, valid), frame_of(z, 0.25), 1.0)
    assert not to_array(out, "analysis_valid", z.shape)[15, 20] and to_array(out, "support_m", z.shape)[15, 20] > 1.0
    assert np.isfinite(to_array(out, "z", z.shape)).all()


def test_distance_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    valid = rng.random((17, 23)) < 0.15
    z = rng.random(valid.shape)
    got = to_array(grid.distance_to_valid(cells_of(spark, z, valid)), "d", valid.shape)
    r, c = np.indices(valid.shape)
    vr, vc = np.nonzero(valid)
    want = np.sqrt(((r[..., None] - vr) ** 2 + (c[..., None] - vc) ** 2).min(-1))
    assert np.allclose(got, want)


def test_spike_is_flattened_and_corner_kept():
    p = np.column_stack([np.arange(7.0), np.zeros(7)])
    p[3, 1] = 2.0
    assert abs(lines.despike(p)[3, 1]) < 0.25
    corner = np.array([[0, 0], [1, 0], [2, 0], [3, 0], [3, 1], [3, 2], [3, 3]], float)
    assert np.allclose(lines.despike(corner), corner)


def test_smoothing_keeps_parabolas_and_ends():
    t = np.linspace(0, 1, 21)
    p = np.column_stack([t, np.zeros(21)])
    assert np.allclose(lines.smooth(p, 7), p)
    h = lines.quadratic_smoother(5)
    assert np.allclose(h @ (np.arange(-2, 3) ** 2), np.arange(-2, 3) ** 2)
    assert np.allclose(h[2], np.array([-3, 12, 17, 12, -3]) / 35)


def test_chain_follows_a_bent_line():
    m = np.zeros((8, 8), bool)
    for r, c in [(0, 0), (1, 1), (2, 2), (2, 3), (2, 4), (3, 5), (4, 5), (7, 7)]:
        m[r, c] = True
    chain = lines.longest_chain(m)
    assert len(chain) == 7 and {tuple(chain[0]), tuple(chain[-1])} == {(0, 0), (4, 5)}
    assert (np.abs(np.diff(chain, axis=0)).max(1) == 1).all()


def test_simplify_and_limit_segments():
    p = np.array([[0, 0, 0], [1, 0.01, 0], [2, 0, 0], [2, 30, 0]], float)
    assert len(lines.simplify(p, 0.1)) == 3
    source = np.column_stack([np.zeros(31), np.arange(31.0), np.zeros(31)])
    cut = lines.limit_segments(source[[0, 30]], source, 12.0)
    assert cut[:, 1].tolist() == [0, 10, 20, 30]
    assert len(lines.limit_segments(p[[0, 3]], p[[0, 3]], 12.0)) == 2 and lines.simplify_in_plan(source).shape == (4, 3)


@pytest.mark.parametrize("tile", [3, 512])
def test_labels_match_flood_fill(spark, tile):
    rng = np.random.default_rng(1)
    m = rng.random((20, 25)) < 0.35
    r, c = np.nonzero(m)
    cells = spark.createDataFrame(pd.DataFrame({"r": r.astype("int32"), "c": c.astype("int32")}))
    got = {(x["r"], x["c"]): x["label"] for x in graph.label_cells(cells, grid.Frame(0, 0, 1, 25, 20), tile).collect()}
    left, want = set(zip(r.tolist(), c.tolist())), {}
    for start in sorted(left):
        if start in want:
            continue
        todo, mine = [start], start[0] * 25 + start[1]
        want[start] = mine
        while todo:
            a, b = todo.pop()
            for n in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if n in left and n not in want:
                    want[n] = mine
                    todo.append(n)
    assert got == want


def test_hysteresis_keeps_strong_cells_outside_weak(spark):
    rows = [(0, 0, True, False), (0, 1, False, True), (0, 2, False, True), (0, 4, False, True), (2, 4, True, False)]
    g = spark.createDataFrame(rows, "r int, c int, strong boolean, weak boolean")
    got = {(x["r"], x["c"]) for x in graph.hysteresis(g, grid.Frame(0, 0, 1, 5, 5)).collect()}
    assert got == {(0, 0), (0, 1), (0, 2), (2, 4)}


def test_class_rules(spark):
    rows = [(i, float(i), 0.0, 0.0, 2 if i < 150 else 1) for i in range(400)]
    pts = spark.createDataFrame(rows, "pid long, x double, y double, z double, cls int")
    assert select.lenient_classes(pts, ExtractConfig())[1:] == (True, 150)
    assert select.lenient_classes(pts, ExtractConfig(classification_filter=()))[1:] == (False, 400)
    with pytest.raises(ValueError):
        select.lenient_classes(pts, ExtractConfig(classification_filter=(9,)))
    few = pts.where("cls = 1 OR pid < 40")
    assert select.lenient_classes(few, ExtractConfig())[1:] == (False, 290)
    with pytest.raises(ValueError):
        select.strict_classes(pts.drop("cls"), ExtractConfig())
    unknown = pts.withColumn("cls", F.lit(-1))
    assert select.clicked_classes(unknown, [2])[1] is False and select.clicked_classes(unknown, [2])[0].count() == 400
    assert ExtractConfig(classification_filter=(5, 2, 5)).selected_classes() == (2, 5)
    assert classes_for_auto(False, [1], [1]) is None and classes_for_auto(True, [1, 2], [1, 2]) == [] and classes_for_click(True, [1, 2], [1, 2]) is None
    assert classes_for_terrain([]) == [2] and classes_for_terrain([1, 2]) == [2] and classes_for_terrain([1]) is None


def test_config_round_trip():
    cfg = ExtractConfig(classification_filter=(2, 9))
    assert ExtractConfig.from_dict(cfg.to_dict()) == cfg
    with pytest.raises(ValueError):
        ExtractConfig.from_dict({"nope": 1})


def test_frames():
    f = grid.frame_for((0.0, 0.0), (10_000.0, 10_000.0), 0.5)
    assert f.adjusted and f.nx * f.ny <= grid.MAX_CELLS
    with pytest.raises(MemoryError):
        grid.frame_for((0.0, 0.0), (10_000.0, 10_000.0), 0.5, None)
    assert grid.choose_cell(0.3, 0) == 0.75 and grid.choose_cell(9, 0) == 1.0 and grid.choose_cell(0.001, 0) == 0.05 and grid.choose_cell(0.3, 0, 0.35) == 0.35


def test_partition_count_does_not_matter(spark):
    x, y, z = ramp(40, 30, 0.25, 0.01, 5)
    pts = spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(x)), "x": x, "y": y, "z": z}))
    f = grid.Frame(0.0, 0.0, 0.5, 20, 15)
    a, b = (to_array(grid.raster_mean(pts.repartition(n), f), "z", (15, 20)) for n in (1, 7))
    assert np.allclose(a, b)


def test_robust_plane_ignores_outliers():
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=(2, 60))
    z = 2 * u - v + 5
    z[:4] += 50
    height, rmse, n = refine.robust_plane(u, v, z + rng.normal(0, 0.01, 60), 8)
    assert abs(height - 5) < 0.05 and rmse < 0.05 and n == 56


def test_plane_fit_of_too_few_or_flat_points_is_null(spark):
    rows = [(1, 0.0, 0.0, 1.0), (1, 1.0, 1.0, 2.0), (1, 2.0, 2.0, 3.0), (2, 0.0, 0.0, 1.0)]
    p = spark.createDataFrame(rows, "vid long, x double, y double, z double")
    fit = refine.plane_fit(refine.plane_sums(p, "vid", F.col("x"), F.col("y")))
    assert all(r["c"] is None for r in fit.collect())


def test_spacing_of_nothing_and_of_one_place(spark):
    schema = "pid long, x double, y double"
    assert spatial.spacing(spark.createDataFrame([], schema)) == 0.20
    assert spatial.spacing(spark.createDataFrame([(1, 2.0, 2.0), (2, 2.0, 2.0)], schema)) == 0.20
    assert spatial.spacing(spark.createDataFrame([(i, float(i), 0.0) for i in range(9)], schema)) == 1.0


def test_thresholds(spark):
    g = spark.createDataFrame([(float(s), True) for s in range(101)] + [(500.0, False)], "slope_0 double, valid boolean")
    low, high = terrain.slope_thresholds(g, ExtractConfig())
    assert high == 55.0 and math.isclose(low, 0.72 * 55)
    assert terrain.slope_thresholds(g.where("false"), ExtractConfig()) == (15.0, 25.0)
    assert terrain.slope_thresholds(g, ExtractConfig(slope_low_deg=1, slope_high_deg=2)) == (1.0, 2.0)


def test_faces_are_numbered_by_first_cell(spark):
    labels = spark.createDataFrame([(0, 5, 5), (3, 1, 61), (3, 2, 61)], "r int, c int, label long")
    assert {r["label"]: r["face"] for r in faces.ranked(labels).collect()} == {5: 1, 61: 2}


def test_snap_moves_towards_the_break():
    x = np.arange(60) * 0.25
    f = grid.Frame(0.0, 0.0, 0.25, 60, 12)
    pdf = pd.DataFrame({"r": np.repeat(np.arange(12), 60), "c": np.tile(np.arange(60), 12)})
    at = pdf["c"] * 0.25
    pdf = pdf.assign(label=1, face=(at > 6) & (at < 9), gx=-1.0, gy=0.0, slope=np.where((at > 6) & (at < 9), 45.0, 0.0), persistence=3, support_m=0.0, score=np.where(abs(at - 6) < 0.2, 40.0, 0.0))
    patch = lines.Patch(pdf, f)
    line = np.column_stack([np.full(8, 6.6), np.arange(8) * 0.3 + 0.3])
    out, mean, top = lines.snap(line, True, np.array([1.0, 0.0]), patch, 1.25)
    assert abs(np.median(out[:, 0]) - 6.1) < 0.3 and 0 < mean <= top <= 1.25
    assert replace(f, nx=1).nx == 1 and len(x) == 60


@pytest.mark.parametrize(("crest", "at"), [(True, 10), (False, 15)])
def test_single_edge(spark, crest, at):
    x, y, z = ramp(120, 80, 0.25, 0.01, 11)
    pts = spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(x)), "x": x, "y": y, "z": z}))
    got = single_edge.extract_edge(pts, (float(at), 10.0, 7.0), crest, 0.25)
    assert abs(np.median(got["vertices"][:, 0]) - at) <= 0.8 and len(got["vertices"]) >= 2 and 0 < got["confidence"] <= 1
    with pytest.raises(ValueError):
        single_edge.extract_edge(pts.limit(100), (0.0, 0.0, 0.0))


def test_longest_path_and_bilinear():
    r, c = np.array([0, 0, 0, 2, 1]), np.array([0, 1, 3, 4, 6])
    path = single_edge.longest_path(r, c)
    assert {int(path[0]), int(path[-1])} == {0, 4} and len(path) == 5
    a = np.array([[0.0, 1.0], [2.0, 3.0]])
    v = single_edge.bilinear(a, np.array([0.5, 0.0, 1.5]), np.array([0.5, 1.0, 0.0]))
    assert v[0] == 1.5 and v[1] == 2.0 and np.isnan(v[2])


def test_planes_meet_at_the_break():
    rng = np.random.default_rng(2)
    p = rng.uniform(-2.2, 2.2, (400, 2)) * [0.5, 1]
    z = np.where(p[:, 1] > 0.1, 10.0, 10 + (p[:, 1] - 0.1))
    shift, height = single_edge.two_planes(np.column_stack([p, z]), True)
    assert abs(shift - 0.1) < 0.02 and abs(height - 10) < 0.02
    assert single_edge.two_planes(np.column_stack([p, z])[:10], True) is None


def test_lines_are_stitched():
    line = np.column_stack([np.arange(6.0), np.zeros(6), np.zeros(6)])
    more = np.column_stack([np.arange(4.5, 12), np.full(8, 0.2), np.zeros(8)])
    for segment in (more, more[::-1]):
        got = single_edge.extend(line, segment, left=False)
        assert got["alignment"] > 0.9 and np.allclose(got["extension"][0], line[-1]) and got["extension"][-1, 0] == 11.5
    assert single_edge.extend(line, more + [0, 5, 0], left=False) is None and single_edge.extend(line, more, left=True) is None
    assert np.allclose(single_edge.end_direction(line, True), [-1, 0]) and single_edge.end_direction(line[:1], True) is None


# ---------------------------------------------------------------- requests, tiles, runs


@pytest.mark.parametrize("bad", [{"min_face_area_m2": 0.0}, {"line_smooth_window": 2}, {"line_smooth_window": 53}, {"vertex_spacing_m": 0.1}, {"max_ground_gap_m": 11.0}, {"min_line_length_m": float("nan")}])
def test_requests_out_of_range_are_refused(bad):
    assert ExtractConfig().checked() == ExtractConfig()
    with pytest.raises(ValueError, match=next(iter(bad))):
        ExtractConfig(**bad).checked()


def test_square_tile_asks_again_without_classes(spark):
    p = spark.createDataFrame([(float(i % 40), float(i // 40), 0.0, 2 if i % 4 == 0 else 1) for i in range(1600)], "x double, y double, z double, cls int")
    tile = lambda **k: select.square_tile(p, (10.0, 10.0), 5.0, **k)
    found, dropped = tile(classes=[2])
    assert dropped and found.count() == 121
    found, dropped = tile(classes=[2], seen={2})
    assert not dropped and found.where("cls <> 2").isEmpty()
    assert tile(classes=[2], least=10)[1] is False and tile(classes=[1])[1] is False and tile()[0].count() == 121
    assert select.preset_classes("custom", (5, 1, 5)) == [1, 5]
    with pytest.raises(ValueError):
        select.preset_classes("some")


def test_runs_can_be_cancelled(spark):
    import threading
    import time

    failed: list[Exception] = []

    def work():
        try:
            with E.cancellable(spark, "one"):
                spark.range(8, numPartitions=8).select(F.expr("sum(id)")).count()
                spark.range(10**12).selectExpr("sum(id * id % 7)").collect()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    t = threading.Thread(target=work)
    t.start()
    for _ in range(60):
        time.sleep(0.5)
        E.cancel(spark, "one")
        if not t.is_alive():
            break
    t.join(30)
    assert failed and not t.is_alive() and spark.range(3).count() == 3


def test_robust_planes_of_tables_match_numpy(spark):
    rng = np.random.default_rng(3)
    u, v = rng.uniform(-1, 1, (2, 300))
    key = rng.integers(0, 4, 300)
    w = key + 0.3 * u - 0.2 * v + rng.normal(0, 0.02, 300)
    w[::17] += 3
    rows = [(int(k), float(a), float(b), float(c)) for k, a, b, c in zip(key, u, v, w, strict=True)] + [(9, 0.0, 0.0, 1.0)]
    got = {r["key"]: r for r in refine.robust_planes(spark.createDataFrame(rows, "key int, u double, v double, w double"), "key").collect()}
    for k in range(4):
        z, rmse, n = refine.robust_plane(u[key == k], v[key == k], w[key == k], 8)
        assert abs(got[k]["c"] - z) < 1e-9 and abs(got[k]["rmse"] - rmse) < 1e-6 and got[k]["kept"] == n
    assert got[9]["c"] is None


def test_neighbours_in_clusters(spark):
    """Points in two dense clusters and a few far ones, against all distances."""
    rng = np.random.default_rng(8)
    xy = np.vstack([rng.normal(0, 0.01, (400, 2)), rng.normal(50, 0.001, (400, 2)), rng.uniform(-1000, 1000, (40, 2)), [[0.0, 0.0], [0.0, 0.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "pid long, x double, y double")
    got = {r["pid"]: r["d"] for r in spatial.neighbour_distance(df).collect()}
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    d[d == 0] = np.inf
    assert len(got) == len(xy) and all(abs(got[i] - d[i].min()) < 1e-9 for i in got)
