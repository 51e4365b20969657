"""Readers, writers and documents."""

import json

import numpy as np
import pytest

from cragline import shared
from cragline.config import ExtractConfig
from cragline.operators.grid import Frame
from cragline.plans import extract as E
from cragline.sources import catalog, las, points, sinks
from cragline.streaming.raster import raster_sums, start_raster


def test_las_round_trip_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, y, z = rng.uniform(0, 100, (3, 1000))
    cls = rng.integers(0, 10, 1000)
    path = str(tmp_path / "a.las")
    las.write_las(path, x, y, z, cls)
    got = las.read_las(spark, path, points=300)
    assert got.rdd.getNumPartitions() == 4
    p = got.orderBy("pid").toPandas()
    assert np.allclose(p[["x", "y", "z"]], np.column_stack([x, y, z]), atol=6e-4) and (p["cls"] == cls).all()
    info = points.inspect(spark, path)
    assert info.n == 1000 and info.has_classes and np.allclose([info.xmin, info.ymin, info.zmin], [v.min() for v in (x, y, z)])
    assert las.metadata(spark, path).first()["point_format"] == 3
    with pytest.raises(ValueError, match="LAZ"):
        las.read_header(str(_copy(path, tmp_path / "b.laz")))
    with pytest.raises(ValueError):
        points.inspect(spark, str(tmp_path / "c.xyz"))
    with pytest.raises(ValueError):
        points.read_points(spark, str(tmp_path / "c.ply"))


def _copy(a, b):
    b.write_bytes(open(a, "rb").read())
    return b


def test_las_by_uri(spark, tmp_path):
    uri = f"file://{tmp_path}/deeper/a.las"
    las.write_las(uri, [1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [2, 7])
    assert las.read_header(uri).point_count == 2
    assert sorted((r["x"], r["cls"]) for r in las.read_las(spark, uri).collect()) == [(1.0, 2), (2.0, 7)]


def test_line_files_stream_one_line_at_a_time(spark, tmp_path):
    rows = [(k, k, "CREST" if k % 2 else "TOE", 0.5, [(i, float(i), float(k), 1.0, None if i == 1 else 0.25, 3) for i in range(1, 4)]) for k in (2, 1)]
    found = spark.createDataFrame(rows, "line_id int, face_id int, type string, confidence double, vertices array<struct<vertex:int,x:double,y:double,z:double,rmse:double,n:long>>")
    sinks.write_lines(tmp_path, found, "WKT")
    whole = json.loads((tmp_path / "breaklines.geojson").read_text())
    assert [f["properties"]["line_id"] for f in whole["features"]] == [1, 2] and whole["crs_wkt"] == "WKT"
    assert whole == sinks.geojson([sinks.plain(r) for r in found.orderBy("line_id").collect()], "WKT")
    table = (tmp_path / "vertices.csv").read_text().splitlines()
    assert table[0] == sinks.CSV_HEADER and table[1:] == [r["row"] for r in sinks.vertex_text(found).orderBy("line_id", "vertex").collect()]
    assert (tmp_path / "breaklines.dxf").read_text() == sinks.dxf([r.asDict(recursive=True) for r in found.orderBy("line_id").collect()])
    sinks.write_lines(tmp_path, found.where("false"))
    assert json.loads((tmp_path / "breaklines.geojson").read_text())["features"] == []


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = spark.conf

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_command_line_has_every_parameter():
    from dataclasses import fields

    from cragline import cli

    a = cli.parser().parse_args(["in.las", "-o", "out", "--min-area", "9", "--smooth-sigmas-cells", "1,2", "--classification-filter", "2,6"])
    assert a.min_face_area_m2 == 9.0 and a.smooth_sigmas_cells == (1.0, 2.0) and ExtractConfig(classification_filter=a.classification_filter).classification_filter == (2, 6)
    assert {f.name for f in fields(ExtractConfig)} - {"use_ground_class"} <= set(vars(a))


def test_las_of_no_points(spark, tmp_path):
    path = str(tmp_path / "none.las")
    las.write_las(path, [], [], [], [])
    assert las.read_las(spark, path).count() == 0


def test_las_runs_out_of_core(spark, tmp_path):
    y, x = np.mgrid[0:80, 0:120] * 0.25
    z = np.clip(20 - x, 5, 10) + np.random.default_rng(7).normal(0, 0.01, x.shape)
    path = str(tmp_path / "face.las")
    las.write_las(path, x.ravel(), y.ravel(), z.ravel(), np.full(x.size, 2))
    cfg = ExtractConfig(cell_size=0.25, slope_low_deg=25, slope_high_deg=35, min_face_area_m2=8, min_line_length_m=8, classification_filter=(2,))
    report = E.extract(spark, path, str(tmp_path / "out"), cfg)
    assert report["streaming_mode"] and report["crest_lines"] >= 1 and report["toe_lines"] >= 1 and report["points_total"] == 9600


def test_text_rules(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n1 2 3 9\n\n4\t5  6 # tail\n7 8 nan\nx y z\n1 2\n")
    assert [tuple(r)[1:] for r in points.read_points(spark, str(tmp_path / "a.txt")).orderBy("x").collect()] == [(1, 2, 3), (4, 5, 6)]
    (tmp_path / "b.csv").write_text("x,y,z\n1, 2,3\n")
    assert points.read_points(spark, str(tmp_path / "b.csv")).count() == 1
    (tmp_path / "c.csv").write_text("1,2\n3,4\n")
    with pytest.raises(ValueError):
        points.read_points(spark, str(tmp_path / "c.csv"))


def test_ascii_grid_and_dxf(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, float("nan"))], "r int, c int, z double")
    sinks.write_ascii_grid(tmp_path / "g.asc", cells, "z", Frame(5.0, 6.0, 0.5, 2, 2))
    text = (tmp_path / "g.asc").read_text().splitlines()
    assert text[:2] == ["ncols 2", "nrows 2"] and text[-2:] == ["3.000000 -9999.000000", "1.000000 -9999.000000"]
    drawing = sinks.dxf([{"type": "CREST", "vertices": [{"x": 0.0, "y": 1.0, "z": 2.0}, {"x": 3.0, "y": 4.0, "z": 5.0}]}])
    assert drawing.count("VERTEX") == 2 and "CRISTA" in drawing and drawing.endswith("EOF\n")


def test_geojson_drops_short_lines_and_keeps_crs(spark, tmp_path):
    line = {"line_id": 1, "face_id": 1, "type": "TOE", "length_m": 2.0, "median_rmse": float("nan"), "vertices": [{"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 1.0, "y": 0.0, "z": 0.0}]}
    short = line | {"line_id": 2, "vertices": line["vertices"][:1]}
    sinks.write_json(tmp_path / "a.geojson", sinks.geojson([line, short], "WKT"))
    raw = json.loads((tmp_path / "a.geojson").read_text())
    assert raw[sinks.CRS_MEMBER] == "WKT" and raw["features"][0]["properties"]["median_rmse"] is None
    assert [r["line_id"] for r in sinks.read_geojson(spark, str(tmp_path / "a.geojson")).collect()] == [1]


def test_projects(tmp_path):
    store = catalog.ProjectStore(tmp_path / "index.json")
    a, b = store.create(tmp_path, "Quarry 1"), store.create(tmp_path, "Quarry 1")
    assert a["path"] != b["path"] and [p["id"] for p in store.projects()] == [b["id"], a["id"]]
    store.open(a["path"])
    assert store.projects()[0]["id"] == a["id"] and store.projects()[0]["exists"]
    store.put_cloud(a["id"], {"id": "c", "n": 1, "crs_wkt": "W"})
    store.put_cloud(a["id"], {"id": "c", "n": 2})
    assert store.cloud(a["id"], "c")["n"] == 2 and store.manifest(a["id"])["crs"] == "W"
    store.append_run(a["id"], {"run": 1})
    assert store.state(a["id"])["runs"] == [{"run": 1}]
    with pytest.raises(KeyError):
        store.root("nope")
    with pytest.raises(ValueError):
        store.put_terrain(a["id"], "other", "x")
    (tmp_path / "index.json").write_text("{broken")
    assert store.projects() == []
    with pytest.raises(FileNotFoundError):
        store.open(tmp_path / "none")


def test_jobs_and_events(spark, tmp_path):
    jobs = catalog.Jobs()
    job = jobs.create("import")
    jobs.update(job["id"], status="running", progress=10)
    copy = jobs.get(job["id"])
    copy["status"] = "changed"
    assert jobs.get(job["id"])["status"] == "running" and jobs.get("x") is None
    path = str(tmp_path / "log")
    for k in (1, 2):
        catalog.append_events(spark, path, [{"event": "e", "details": {"k": k}}])
    assert sorted(r["k"] for r in catalog.event_details(catalog.read_events(spark, path), "k").collect()) == ["1", "2"]


def test_converter_log(spark):
    log = spark.createDataFrame([("INDEXING: 3",), ("ERROR point: [1.5, -2, 3e2] outside of bounding box",), ("hello",)], "value string")
    assert [r["progress"] for r in catalog.converter_progress(log).collect()] == [65.0, None, None]
    r = catalog.offending_point(log).collect()[1]
    assert (r["x"], r["y"], r["z"]) == (1.5, -2.0, 300.0) and r["bbox_failure"]
    assert catalog.true_bounds_margin((0.001, 1.0, -2.0)) == (0.016, 16.0, 32.0)


def test_streaming_raster_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), float(i % 7)) for i, (a, b) in enumerate(rng.uniform(0, 10, (300, 2)))]
    pts = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    pts.repartition(3).write.parquet(str(tmp_path / "in"))
    frame = Frame(0.0, 0.0, 1.0, 10, 10)
    stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = start_raster(stream, frame, "raster", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    key = ["r", "c"]
    a, b = (d.toPandas().sort_values(key).reset_index(drop=True) for d in (spark.table("raster"), raster_sums(pts, frame)))
    assert a.equals(b)


def test_shared_tables_are_released(spark):
    before = shared.materialize(spark.range(5).toDF("a"), "five")
    assert before.count() == 5 and before.dtypes == [("a", "bigint")]
    (path,) = {f.rsplit("/", 1)[0] for f in before.inputFiles()}
    assert shared.release(spark) >= 1
    local = path.removeprefix("file://")
    import os

    assert not os.path.exists(local)
