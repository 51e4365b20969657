"""More queries of the terrain engine: sources, sinks, guards, lines, documents, whole runs, each with DuckDB SQL.

Lines come from the embeddings table: a line for each label and parity of the id, its vertices in order of the id.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ExtractConfig, classes_for_auto, classes_for_click, classes_for_terrain
from ..functions.exprs import clip, floor_at
from ..operators import faces, graph, grid, lines, refine, select, single_edge, terrain
from ..shared import materialize, shared_dir
from ..sources import catalog, las, octree, sinks
from ..sources.points import inspect, read_points
from . import extract as E
from .fixtures import CELL, COLS, EMBEDDING_SQL, LAST_ROW, LINEITEM_SQL, POINT_ORDER, RAMP_SQL, embedding_points, lineitem_points, ramp_cells, ramp_cloud, ramp_frame, ramp_grid, ramp_points, ramp_rows, ramp_with_gaps
from .registry import _AROUND, _COL, _FIT, _GAP, _HB, _NEAR, _ROW, _VB, CFG, DENSER, ORACLE, SCATTER, _extracted, _fill, _gauss, _grad, _labels, col3, query, r3

RESIDUALS = "o AS (SELECT p.*, p.z - (a * x + b * y + c) AS off FROM p JOIN e USING (cls)), c1 AS (SELECT cls, median(off) AS mid FROM o GROUP BY cls), c2 AS (SELECT cls, median(abs(off - mid)) AS mad FROM o JOIN c1 USING (cls) GROUP BY cls)"


def path_for(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}-{name}"


# ---------------------------------------------------------------- sources


@query(f"WITH {LINEITEM_SQL} SELECT count(*) AS n, min(x) AS xmin, max(y) AS ymax, min(cents)::DOUBLE AS zmin, max(x) - min(x) AS width, true AS has_classes FROM p")
def src_inspect(spark: SparkSession, d: str) -> DataFrame:
    path = path_for(spark, "cloud.parquet")
    lineitem_points(spark, d).select("x", "y", "z", "cls").write.parquet(path)
    i = inspect(spark, path)
    return spark.createDataFrame([(i.n, i.xmin, i.ymax, i.zmin, i.xmax - i.xmin, i.has_classes)], "n long, xmin double, ymax double, zmin double, width double, has_classes boolean")


def _las(spark: SparkSession, d: str) -> str:
    """The lattice as a LAS cloud, written by the tasks, with the column's remainder as class."""
    path = path_for(spark, "lattice.las")
    las.write_las_parts(ramp_cloud(spark, d).withColumn("cls", (F.col("pid") % 5).cast("int")), path)
    return path


@query(f"WITH {RAMP_SQL} SELECT ((r * {COLS} + c) % 5)::INT AS cls, count(*) AS n, sum(floor({CELL}::DOUBLE * c * 1000 + 0.5))::BIGINT AS milli, sum(r * {COLS} + c)::BIGINT AS pids FROM g GROUP BY ALL")
def src_las_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Points of a LAS file read in ranges of 1,000 records."""
    p = las.read_las(spark, _las(spark, d), 1000)
    return p.groupBy("cls").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("x") * 1000 + 0.5)).alias("milli"), F.sum("pid").alias("pids"))


@query(f"WITH {RAMP_SQL} SELECT (r * {COLS} + c)::BIGINT AS pid, {r3(f'{CELL}::DOUBLE * c')} AS x, {r3(f'{CELL}::DOUBLE * r')} AS y, ((r * {COLS} + c) % 5)::INT AS cls FROM g WHERE (r * {COLS} + c) % 5 = 2")
def src_las_memory(spark: SparkSession, d: str) -> DataFrame:
    """One class of a LAS file read whole, by its suffix."""
    p = select.in_classes(read_points(spark, _las(spark, d)), (2,))
    return p.select("pid", col3("x").alias("x"), col3("y").alias("y"), "cls")


@query(f"WITH {RAMP_SQL} SELECT '1.2' AS version, 3 AS point_format, count(*) AS point_count, 0.001::DOUBLE AS scale, {r3(f'max({CELL}::DOUBLE * c)')} AS xmax, {r3('min(z)')} AS zmin, {r3('max(z)')} AS zmax FROM g")
def src_las_header(spark: SparkSession, d: str) -> DataFrame:
    m = las.metadata(spark, _las(spark, d))
    at = lambda c, i: F.get(c, F.lit(i))
    return m.select("version", "point_format", "point_count", at("scales", 0).alias("scale"), floor_at(at("maxs", 0)).alias("xmax"), floor_at(at("mins", 2)).alias("zmin"), floor_at(at("maxs", 2)).alias("zmax"))


@query(f"""WITH {RAMP_SQL} SELECT (r * {COLS} + c)::BIGINT AS pid, {r3(f'{CELL}::DOUBLE * c')} AS x, {r3(f'{CELL}::DOUBLE * r')} AS y FROM g
WHERE {CELL}::DOUBLE * c BETWEEN 8 AND 17 AND {CELL}::DOUBLE * r BETWEEN 3 AND 6 AND (r * {COLS} + c) % 5 IN (1, 3)""")
def src_las_pruned(spark: SparkSession, d: str) -> DataFrame:
    """A box and two classes of a LAS file: ranges of records that cannot hold them are not read."""
    path, statistics = _las(spark, d), path_for(spark, "ranges.json")
    las.write_statistics(spark, path, statistics, 600)
    p = las.read_las_in(spark, path, statistics, {"x": (8, 17), "y": (3, 6)}, [1, 3])
    return p.select("pid", col3("x").alias("x"), col3("y").alias("y"))


# ---------------------------------------------------------------- octree


@query(ORACLE["fil_corridor"])
def src_octree_corridor(spark: SparkSession, d: str) -> DataFrame:
    """A corridor read from a point index by code ranges."""
    path = path_for(spark, "octree")
    octree.build(embedding_points(spark, d), path, ["pid"])
    points, cube = octree.opened(spark, path)
    return octree.read_corridor(points, cube, (-0.3, -0.2), (0.1, 0.1), 0.2, range(9)).select("pid")


@query(ORACLE["fil_cylinder"])
def src_octree_cylinder(spark: SparkSession, d: str) -> DataFrame:
    """A cylinder read from a point index by code ranges."""
    path = path_for(spark, "octree")
    octree.build(embedding_points(spark, d), path, ["pid"])
    points, cube = octree.opened(spark, path)
    return octree.read_cylinder(points, cube, (0.0, 0.0, 0.0), 0.15).select("pid")


_STEP = "greatest(0, least(1048575, floor(({a} - {a}0) / edge * 1048576)))::BIGINT"
_LEVELS = ", ".join(f"rank() OVER (PARTITION BY i >> {20 - k}, j >> {20 - k}, k >> {20 - k} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, z) AS r{k}" for k in range(8))


@query(f"""WITH {LINEITEM_SQL}, q AS (SELECT * EXCLUDE (cents), cents / 10000::DOUBLE AS z FROM p), e AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) * (1 + 1e-9::DOUBLE) AS edge FROM q),
s AS (SELECT q.*, {_STEP.format(a='x')} AS i, {_STEP.format(a='y')} AS j, {_STEP.format(a='z')} AS k FROM q, e), n AS (SELECT *, {_LEVELS} FROM s)
SELECT CASE {' '.join(f'WHEN r{k} = 1 THEN {k}' for k in range(8))} ELSE 8 END AS level, count(*) AS n, sum(l_orderkey)::BIGINT AS orders FROM n GROUP BY level""")
def src_octree_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of detail of a cloud: how many points stand for their nodes at each level."""
    p = lineitem_points(spark, d).withColumn("z", F.col("cents") / F.lit(10000.0))
    levels = octree.with_levels(p, octree.cube_of(p), POINT_ORDER)
    return levels.groupBy("level").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"))


# ---------------------------------------------------------------- lines of the embeddings table

LINES_SQL = f"""{EMBEDDING_SQL}, v AS (SELECT cls::INT AS face_id, CASE WHEN pid % 2 = 0 THEN 'CREST' ELSE 'TOE' END AS type, row_number() OVER (PARTITION BY cls, pid % 2 ORDER BY pid)::INT AS vertex,
  x, y, z, CASE WHEN pid % 5 > 0 AND cls <> 3 THEN abs(z) END AS rmse, pid % 7 AS n FROM p),
s AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM v WINDOW w AS (PARTITION BY face_id, type ORDER BY vertex)),
l AS (SELECT face_id, type, coalesce(sum(step), 0) AS length_m, median(rmse) AS median_rmse, avg(n) AS support, count(*) AS vertices, sum(x) AS sx FROM s GROUP BY face_id, type),
q AS (SELECT *, least(1, greatest(0, 0.45::DOUBLE * (face_id % 5 / 4::DOUBLE) + 0.35::DOUBLE * (0.5::DOUBLE + face_id % 3 / 10::DOUBLE) + 0.2::DOUBLE * CASE WHEN median_rmse IS NULL THEN 0.45::DOUBLE ELSE exp(-median_rmse / {CELL}::DOUBLE) END)) AS confidence FROM l)"""


def table_lines(spark: SparkSession, d: str) -> DataFrame:
    p = embedding_points(spark, d)
    kind = F.when(F.col("pid") % 2 == 0, "CREST").otherwise("TOE")
    order = F.row_number().over(Window.partitionBy("cls", F.col("pid") % 2).orderBy("pid"))
    rmse = F.when((F.col("pid") % 5 > 0) & (F.col("cls") != 3), F.abs("z"))
    v = p.select(F.col("cls").cast("int").alias("face_id"), kind.alias("type"), order.alias("vertex"), "x", "y", "z", rmse.alias("rmse"), (F.col("pid") % 7).alias("n"))
    face = v.select("face_id", "type").distinct()
    face = face.withColumn("persistence", F.col("face_id") % 5 / F.lit(4.0)).withColumn("coherence", F.lit(0.5) + F.col("face_id") % 3 / F.lit(10.0))
    return refine.refined_lines(face, v, CELL, 0.45)


@query(f"WITH {LINES_SQL} SELECT face_id, type, {r3('length_m')} AS length_m, {r3('median_rmse')} AS median_rmse, {r3('support')} AS support, {r3('confidence')} AS confidence FROM q")
def agg_line_quality(spark: SparkSession, d: str) -> DataFrame:
    """Length, median residual, mean support and confidence of lines."""
    q = table_lines(spark, d)
    return q.select("face_id", "type", col3("length_m").alias("length_m"), col3("median_rmse").alias("median_rmse"), col3("mean_support_points").alias("support"), col3("confidence").alias("confidence"))


@query(f"WITH {LINES_SQL} SELECT row_number() OVER (ORDER BY face_id, type)::INT AS line_id, face_id, type FROM l WHERE length_m >= (SELECT avg(length_m) FROM l)")
def fil_line_length(spark: SparkSession, d: str) -> DataFrame:
    """Lines of at least the mean length, numbered anew."""
    q = materialize(table_lines(spark, d), "lines")
    return lines.long_enough(q, q.agg(F.avg("length_m")).first()[0] or 0.0).select("line_id", "face_id", "type")


_NUMBERED = f"{LINES_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY face_id, type)::INT AS line_id FROM q)"


@query(f"WITH {_NUMBERED} SELECT line_id, 'Feature' AS kind, 'LineString' AS shape, type, vertices::BIGINT AS vertices, {r3('sx')} AS x_sum FROM k")
def snk_geojson(spark: SparkSession, d: str) -> DataFrame:
    """GeoJSON features of lines, read again as JSON."""
    f = sinks.geojson_features(lines.long_enough(table_lines(spark, d), 0.0))
    shape = F.from_json("feature", "type string, properties struct<type:string>, geometry struct<type:string, coordinates:array<array<double>>>").alias("f")
    f = f.select("line_id", shape).select("line_id", F.col("f.type").alias("kind"), F.col("f.geometry.type").alias("shape"), F.col("f.properties.type").alias("type"), F.col("f.geometry.coordinates").alias("at"))
    return f.select("line_id", "kind", "shape", "type", F.size("at").cast("long").alias("vertices"), floor_at(F.aggregate("at", F.lit(0.0), lambda s, v: s + v[0])).alias("x_sum"))


@query(f"""WITH {_NUMBERED} SELECT line_id, v.vertex, concat_ws(',', line_id, v.face_id, v.type, v.vertex, printf('%.4f', x), printf('%.4f', y), printf('%.4f', z), printf('%.4f', confidence), coalesce(printf('%.4f', rmse), 'nan')) AS row
FROM v JOIN k ON v.face_id = k.face_id AND v.type = k.type""")
def snk_vertex_rows(spark: SparkSession, d: str) -> DataFrame:
    """The vertex table of lines as text."""
    return sinks.vertex_text(lines.long_enough(table_lines(spark, d), 0.0))


@query(f"""WITH {RAMP_SQL}, k AS (SELECT (r // 20 + 1)::INT AS line_id, count(*) AS vertices, {r3(f'sum({CELL}::DOUBLE * c)')} AS x_sum, {r3('sum(z)')} AS z_sum FROM g WHERE r % 20 = 0 AND c % 10 = 0 GROUP BY ALL)
SELECT line_id, CASE WHEN line_id % 2 = 0 THEN 'TOE' ELSE 'CREST' END AS type, vertices, x_sum, z_sum FROM k""")
def src_geojson(spark: SparkSession, d: str) -> DataFrame:
    """Four lines across the lattice, written as GeoJSON with the other line files and read back."""
    g = ramp_cells(spark, d).where("r % 20 = 0 AND c % 10 = 0").select((F.floor(F.col("r") / 20) + 1).cast("int").alias("line_id"), F.struct((F.col("c") / 10 + 1).cast("int").alias("vertex"), (F.col("c") * CELL).alias("x"), (F.col("r") * CELL).alias("y"), "z", F.lit(None).cast("double").alias("rmse")).alias("v"))
    found = g.groupBy("line_id").agg(F.sort_array(F.collect_list("v")).alias("vertices")).withColumns({"face_id": F.col("line_id"), "type": F.when(F.col("line_id") % 2 == 0, "TOE").otherwise("CREST"), "confidence": F.lit(0.5)})
    root = Path(tempfile.mkdtemp(prefix="cragline-out-"))  # output files of the driver, as a run writes them
    sinks.write_lines(root, found)
    back = sinks.read_geojson(spark, f"file://{root}/breaklines.geojson").select("line_id", "type", F.explode("coordinates").alias("p"))
    return back.groupBy("line_id", "type").agg(F.count("*").alias("vertices"), floor_at(F.sum(F.col("p")[0])).alias("x_sum"), floor_at(F.sum(F.col("p")[2])).alias("z_sum"))


_FILLED = f"""{_GAP}, {_NEAR}, b AS (SELECT *, {_fill(_ROW, 'c', 'h')}, {_fill(_COL, 'r', 'v')} FROM w),
gc AS (SELECT count(*) FILTER (WHERE b.valid) AS real, count(*) FILTER (WHERE b.valid OR (sqrt(d2) * {CELL}::DOUBLE <= 1.5 AND ((haz IS NOT NULL AND hbz IS NOT NULL) OR (vaz IS NOT NULL AND vbz IS NOT NULL)))) AS analysis FROM b LEFT JOIN n USING (r, c))"""


@query(f"WITH {RAMP_SQL}, {_FILLED}, {EMBEDDING_SQL} SELECT (SELECT count(DISTINCT cls) FROM p) AS faces, (SELECT count(DISTINCT cls) FROM p WHERE pid % 2 = 0) AS crests, (SELECT count(DISTINCT cls) FROM p WHERE pid % 2 = 1) AS toes, real, analysis, analysis - real AS reconstructed FROM gc")
def snk_report(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a report: of lines, and of the cells of a grid with bridged gaps."""
    counts = E.grid_counts(grid.reconstruct(ramp_with_gaps(spark, d), ramp_frame(spark, d), 1.5))
    return E.line_counts(table_lines(spark, d)).crossJoin(counts)  # one row each


# ---------------------------------------------------------------- filters, guards, scalars


@query(f"WITH {LINEITEM_SQL} SELECT 'ground' AS variant, count(*) AS n FROM p WHERE cls = 2 UNION ALL SELECT 'list', count(*) FROM p WHERE cls IN (1, 3) UNION ALL SELECT 'empty list', count(*) FROM p UNION ALL SELECT 'off', count(*) FROM p")
def fil_selected_classes(spark: SparkSession, d: str) -> DataFrame:
    p = lineitem_points(spark, d)
    asked = {"ground": ExtractConfig(), "list": ExtractConfig(classification_filter=(3, 1, 3)), "empty list": ExtractConfig(classification_filter=()), "off": ExtractConfig(use_ground_class=False)}
    return spark.createDataFrame([(k, select.strict_classes(p, c).count()) for k, c in asked.items()], "variant string, n long")


@query(f"WITH {LINEITEM_SQL}, k(least) AS (VALUES (1), (1000), (100000)) SELECT least, (SELECT count(*) FROM p WHERE cls = 7) < least AS refused FROM k")
def fil_minimum_guard(spark: SparkSession, d: str) -> DataFrame:
    n = select.in_classes(lineitem_points(spark, d), (7,)).count()

    def refused(least: int) -> bool:
        try:
            select.require_points(n, least)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(k, refused(k)) for k in (1, 1000, 100_000)], "least int, refused boolean")


@query(f"WITH {EMBEDDING_SQL} SELECT least(300, count(*)) AS n, least(300, count(*)) AS distinct_ids, 0::BIGINT AS unknown FROM p")
def fil_spacing_sample(spark: SparkSession, d: str) -> DataFrame:
    """A bounded sample by hash: its size, its distinct ids, and ids that the cloud does not have."""
    p = embedding_points(spark, d)
    s = materialize(select.hash_sample(p.select("pid", "x", "y"), 300, 1337, ["pid"]), "sample")
    return s.agg(F.count("*").alias("n"), F.count_distinct("pid").alias("distinct_ids")).crossJoin(s.join(p, "pid", "left_anti").agg(F.count("*").alias("unknown")))


_TILE = f"""{EMBEDDING_SQL}, t AS (SELECT * FROM p WHERE x >= -0.25::DOUBLE AND x <= 0.15::DOUBLE AND y >= -0.3::DOUBLE AND y <= 0.1::DOUBLE)"""


@query(f"WITH {_TILE}, f AS (SELECT count(*) FILTER (WHERE cls = 2) AS few, count(*) AS every FROM t) SELECT few < 500 AS dropped, CASE WHEN few < 500 THEN every ELSE few END AS n FROM f")
def fil_square_tile(spark: SparkSession, d: str) -> DataFrame:
    """A square of ground around a place, asked again without classes where too little is found."""
    tile, dropped = select.square_tile(embedding_points(spark, d), (-0.05, -0.1), 0.2, [2])
    return tile.agg(F.lit(dropped).alias("dropped"), F.count("*").alias("n"))


@query(f"WITH {LINEITEM_SQL} SELECT 'all' AS preset, count(*) AS n FROM p UNION ALL SELECT 'ground', count(*) FROM p WHERE cls = 2 UNION ALL SELECT 'none', 0 UNION ALL SELECT 'custom', count(*) FROM p WHERE cls IN (1, 5)")
def fil_class_preset(spark: SparkSession, d: str) -> DataFrame:
    p = lineitem_points(spark, d)
    return spark.createDataFrame([(m, select.in_classes(p, select.preset_classes(m, (5, 1))).count()) for m in ("all", "ground", "none", "custom")], "preset string, n long")


@query(f"WITH {EMBEDDING_SQL} SELECT least(50, count(*)) AS n FROM p WHERE x >= -0.25::DOUBLE AND x <= 0.15::DOUBLE AND y >= -0.3::DOUBLE AND y <= 0.1::DOUBLE")
def srt_early_limit(spark: SparkSession, d: str) -> DataFrame:
    """A strip that stops at fifty points."""
    return select.corridor(embedding_points(spark, d), (-0.25, -0.1), (0.15, -0.1), 0.4, None, 50).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT n_nationkey, n_nationkey / 20::DOUBLE AS gap, CASE WHEN n_nationkey % 3 = 0 THEN 0.4::DOUBLE ELSE 0 END AS asked FROM nation)
SELECT n_nationkey::INT AS k, CASE WHEN asked > 0 THEN asked ELSE least(1, greatest(0.05::DOUBLE, 2.5::DOUBLE * gap)) END AS cell, CASE WHEN asked > 0 THEN asked ELSE least(0.35::DOUBLE, least(1, greatest(0.05::DOUBLE, 2.5::DOUBLE * gap))) END AS clicked FROM s""")
def prj_cell_size(spark: SparkSession, d: str) -> DataFrame:
    """Cells by spacing and request, of the automatic run and of a clicked face."""
    keys = [r[0] for r in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").collect()]
    ask = lambda k: 0.4 if k % 3 == 0 else 0.0
    return spark.createDataFrame([(k, grid.choose_cell(k / 20, ask(k)), grid.choose_cell(k / 20, ask(k), E.CLICK_CELL)) for k in keys], "k int, cell double, clicked double")


@query("SELECT r_regionkey::INT AS k, (floor(1000 * (r_regionkey + 1) / 0.5::DOUBLE) + 1) * (floor(1000 * (r_regionkey + 1) / 0.5::DOUBLE) + 1) > 60000000 AS refused FROM region")
def prj_cell_cap(spark: SparkSession, d: str) -> DataFrame:
    """Grids that the in-memory path refuses."""

    def refused(k: int) -> bool:
        try:
            grid.frame_for((0.0, 0.0), (1000.0 * (k + 1), 1000.0 * (k + 1)), 0.5, None)
        except MemoryError:
            return True
        return False

    keys = [r[0] for r in spark.read.parquet(f"{d}/region.parquet").select("r_regionkey").collect()]
    return spark.createDataFrame([(k, refused(k)) for k in keys], "k int, refused boolean")


@query("SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN NULL ELSE r_regionkey::DOUBLE END AS value, r_regionkey::DOUBLE AS nested FROM region")
def prj_payload(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON-ready payloads: numbers that are not finite become null, at any depth."""
    rows = spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", "r_name").collect()
    found = [sinks.plain({"name": r["r_name"], "value": float("nan") if r["r_regionkey"] % 2 == 0 else float(r["r_regionkey"]), "deep": [{"v": float(r["r_regionkey"])}, float("inf")]}) for r in rows]
    return spark.createDataFrame([(f["name"], f["value"], f["deep"][0]["v"]) for f in found if f["deep"][1] is None], "name string, value double, nested double")


@query("SELECT unnest([10, 18, 52, 62, 89])::DOUBLE AS pct, unnest(range(1, 6))::INT AS i")
def str_progress(spark: SparkSession, d: str) -> DataFrame:
    """What a run tells of its progress."""
    told: list[float] = []
    _extracted(spark, d, ramp_cloud(spark, d), lambda pct, _: told.append(pct))
    return spark.createDataFrame([(i, float(p)) for i, p in enumerate(told, 1)], "i int, pct double")


# ---------------------------------------------------------------- planes, frames, surfaces


def _trimmed(spread: float, floor: str, mad: str, least: int, out: str) -> str:
    again = _FIT.replace("FROM p ", "FROM k ")
    for name in ("s", "m", "f", "e"):
        again = again.replace(f"{name} AS (", f"{name}2 AS (").replace(f"FROM {name})", f"FROM {name}2)")
    return f"""WITH p AS (SELECT vec_id, label AS cls, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE * (CASE WHEN vec_id % 19 = 0 THEN 9 ELSE 1 END) AS z FROM embeddings), {_FIT}, {RESIDUALS},
k AS (SELECT o.cls, o.x, o.y, o.z FROM o JOIN c1 USING (cls) JOIN c2 USING (cls) WHERE abs(off - mid) <= greatest({floor}::DOUBLE, {spread}::DOUBLE * 1.4826::DOUBLE * mad)), {again}
SELECT cls AS label, {out} FROM e JOIN c2 USING (cls) JOIN e2 USING (cls) WHERE mad > {mad} AND e2.n >= {least}"""


@query(_trimmed(2.8, "0.05", "1e-6", 6, f"e2.n AS kept, {r3('e2.a')} AS a, {r3('e2.b')} AS b, {r3('e2.c')} AS c"))
def agg_plane_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Planes refitted once without residuals over max(0.05, 2.8 robust deviations)."""
    p = embedding_points(spark, d).select(F.col("cls").alias("label"), F.col("x").alias("u"), F.col("y").alias("v"), (F.col("z") * F.when(F.col("pid") % 19 == 0, 9).otherwise(1)).alias("w"))
    out = refine.robust_planes(p, "label", 2.8, 0.05, 1e-6, 6, 0)
    return out.select("label", "kept", *(col3(c).alias(c) for c in "abc"))


@query(f"""WITH {EMBEDDING_SQL}, k AS (SELECT pid AS vid, x AS vx, y AS vy FROM p WHERE pid % 50 = 0), j AS (SELECT vid, (x - vx) * 0.8::DOUBLE + (y - vy) * 0.6::DOUBLE AS along, (y - vy) * 0.8::DOUBLE - (x - vx) * 0.6::DOUBLE AS across, z
  FROM p, k WHERE sqrt((x - vx) * (x - vx) + (y - vy) * (y - vy)) <= 0.3::DOUBLE)
SELECT vid, count(*) AS n, count(*) FILTER (WHERE abs(along) <= 0.125::DOUBLE AND across BETWEEN 0.035::DOUBLE AND 0.22::DOUBLE) AS bench, {r3('sum(along)')} AS along, {r3('sum(across)')} AS across FROM j GROUP BY vid""")
def jn_local_frame(spark: SparkSession, d: str) -> DataFrame:
    """Points in the local frames of vertices (ids divisible by 50), and those in the bench's band."""
    p = embedding_points(spark, d)
    v = p.where("pid % 50 = 0").select(F.col("pid").alias("vid"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.lit(0.8).alias("tx"), F.lit(0.6).alias("ty"), F.lit(-0.6).alias("ux"), F.lit(0.8).alias("uy"))
    bench = (F.abs("along") <= 0.125) & F.col("across").between(0.035, 0.22)
    out = single_edge.local_frame(p, v, 0.3).groupBy("vid")
    return out.agg(F.count("*").alias("n"), F.count_if(bench).alias("bench"), floor_at(F.sum("along")).alias("along"), floor_at(F.sum("across")).alias("across"))


_SPARSE = "(7919 * r + 104729 * c) % 1000 < 200"


@query(f"""WITH RECURSIVE {RAMP_SQL}, mk AS (SELECT r, c, r * {COLS} + c AS id FROM g WHERE {_SPARSE}),
reach AS (SELECT r, c, id FROM mk UNION SELECT b.r, b.c, a.id FROM reach a JOIN mk b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 2.35 * 2.35),
lab AS (SELECT r, c, min(id) AS part FROM reach GROUP BY r, c),
best AS (SELECT part FROM lab GROUP BY part HAVING count(*) >= 5 ORDER BY min(sqrt((r - 37.2::DOUBLE) * (r - 37.2::DOUBLE) + (c - 28.4::DOUBLE) * (c - 28.4::DOUBLE))), part LIMIT 1) SELECT r, c FROM lab JOIN best USING (part)""")
def jn_seed_chain(spark: SparkSession, d: str) -> DataFrame:
    """The chain of edge cells, joined over up to two cells, that comes nearest to a place."""
    return single_edge.nearest_chain(ramp_cells(spark, d).where(_SPARSE).select("r", "c"), ramp_frame(spark, d), (28.4 * CELL, 37.2 * CELL))


@query(f"WITH RECURSIVE {RAMP_SQL}, {_grad('g', 'sl')}, {_labels('sl', f'{DENSER} AND slope >= 1')} SELECT label, count(*) AS cells FROM lab JOIN sl USING (r, c) GROUP BY label HAVING count(*) >= 6 AND max(slope) >= 2")
def grf_steep_components(spark: SparkSession, d: str) -> DataFrame:
    """Components over a low slope, large enough and with a cell over the high one."""
    g = terrain.gradients(ramp_cells(spark, d), CELL, {"0": "z"}).withColumnRenamed("slope_0", "slope").withColumn("valid", F.expr(DENSER))
    return single_edge.steep_components(g, ramp_frame(spark, d), 1.0, 2.0, 6).groupBy("label").agg(F.count("*").alias("cells"))


@query(f"""WITH {EMBEDDING_SQL}, {RAMP_SQL}, q AS (SELECT pid, (x + 1) * 50 AS fx, (y + 1) * 30 AS fy FROM p), k AS (SELECT *, floor(fx)::INT AS j, floor(fy)::INT AS i FROM q WHERE fx >= 0 AND fy >= 0 AND fx <= {COLS - 1} AND fy <= {LAST_ROW})
SELECT k.pid, {r3('(a.z * (1 - (fx - j)) + b.z * (fx - j)) * (1 - (fy - i)) + (e.z * (1 - (fx - j)) + h.z * (fx - j)) * (fy - i)')} AS z
FROM k JOIN g a ON a.r = i AND a.c = j JOIN g b ON b.r = i AND b.c = least(j + 1, {COLS - 1}) JOIN g e ON e.r = least(i + 1, {LAST_ROW}) AND e.c = j JOIN g h ON h.r = least(i + 1, {LAST_ROW}) AND h.c = least(j + 1, {COLS - 1})""")
def win_bilinear(spark: SparkSession, d: str) -> DataFrame:
    """Heights of a surface between cell centres."""
    p = embedding_points(spark, d).select("pid", ((F.col("x") + 1) * 50).alias("fx"), ((F.col("y") + 1) * 30).alias("fy"))
    return single_edge.heights_between(p, ramp_cells(spark, d), ramp_frame(spark, d)).select("pid", col3("z").alias("z"))


# ---------------------------------------------------------------- whole runs

_EDGES = f"""k AS (SELECT 'CREST' AS type, max({CELL}::DOUBLE * c) AS edge_x, 10::DOUBLE AS edge_z FROM g WHERE z > 9.95::DOUBLE UNION ALL SELECT 'TOE', min({CELL}::DOUBLE * c), 5::DOUBLE FROM g WHERE z < 5.05::DOUBLE)"""


def positions(spark: SparkSession, d: str, vertices: DataFrame, key: list[str], heights: bool = True, cloud: DataFrame | None = None) -> DataFrame:
    """(key, edge_x, on_edge, at_height, covers) of lines: whether all vertices lie within 0.8 m of the lattice's edge, their
    heights within 0.5 m of the bench, and whether they run along two thirds of it. ``cloud``: the lattice's points, if at hand."""
    edges = (ramp_points(spark, d) if cloud is None else cloud).agg(F.max(F.when(F.col("z") > 9.95, F.col("x"))).alias("CREST"), F.min(F.when(F.col("z") < 5.05, F.col("x"))).alias("TOE")).first()
    crest = F.col("type") == "CREST"
    x, z = F.when(crest, edges["CREST"]).otherwise(edges["TOE"]), F.when(crest, 10.0).otherwise(5.0)
    facts = [F.first(x).alias("edge_x"), (F.max(F.abs(F.col("x") - x)) <= 0.8).alias("on_edge"), (F.max("y") - F.min("y") >= ramp_rows(spark, d) * CELL * 2 / 3).alias("covers")]
    if heights:
        facts.append((F.max(F.abs(F.col("z") - z)) <= 0.5).alias("at_height"))
    return vertices.groupBy(*key).agg(*facts)


def _vertices(found: DataFrame, *more: str) -> DataFrame:
    return found.select(*more, "type", F.explode("vertices").alias("v")).select(*more, "type", "v.x", "v.y", "v.z")


@query(f"WITH {RAMP_SQL}, {_EDGES} SELECT row_number() OVER (ORDER BY type)::INT AS line_id, type, edge_x, true AS on_edge, true AS at_height, true AS covers FROM k")
def flow_extract(spark: SparkSession, d: str) -> DataFrame:
    """The out-of-core run on the lattice: one crest and one toe, on their edges."""
    cloud = ramp_cloud(spark, d)
    return positions(spark, d, _vertices(_extracted(spark, d, cloud)[0], "line_id"), ["line_id", "type"], cloud=cloud)


@query(f"WITH {RAMP_SQL}, {_EDGES} SELECT row_number() OVER (ORDER BY type)::INT AS line_id, type, edge_x, true AS on_edge, true AS at_height, true AS covers, true AS confident FROM k")
def flow_extract_memory(spark: SparkSession, d: str) -> DataFrame:
    """The in-memory run on the lattice, with its confidence."""
    cloud = ramp_cloud(spark, d)
    found, _, _ = E.extract_points(cloud, CFG)
    sure = found.select("line_id", ((clip(F.col("confidence"), 0.0, 1.0) == F.col("confidence")) & (F.col("confidence") > 0.5)).alias("confident"))
    return positions(spark, d, _vertices(found, "line_id"), ["line_id", "type"], cloud=cloud).join(sure, "line_id")


@query(f"WITH {RAMP_SQL}, {_EDGES} SELECT type, edge_x, true AS on_edge, true AS at_height, true AS covers FROM k")
def flow_extract_face(spark: SparkSession, d: str) -> DataFrame:
    """The face at a clicked place."""
    cloud = ramp_cloud(spark, d)
    found, _ = E.face_at(cloud, (12.5, 10.0, 7.5), ExtractConfig(cell_size=CELL), limit=None)
    return positions(spark, d, _vertices(found), ["type"], cloud=cloud)


@query(f"WITH {RAMP_SQL}, {_EDGES} SELECT type, edge_x, true AS on_edge, true AS at_height, true AS covers FROM k WHERE type = 'CREST'")
def flow_single_edge(spark: SparkSession, d: str) -> DataFrame:
    """The alternative extractor's crest."""
    cloud = ramp_cloud(spark, d)
    got = single_edge.extract_edge(cloud, (10.0, 10.0, 10.0), True, CELL)
    return positions(spark, d, spark.createDataFrame([("CREST", *map(float, v)) for v in got["vertices"]], "type string, x double, y double, z double"), ["type"], cloud=cloud)


@query(f"WITH {RAMP_SQL}, {_EDGES} SELECT 1::INT AS face_id, type, edge_x, true AS on_edge, true AS covers FROM k")
def win_boundary_pair(spark: SparkSession, d: str) -> DataFrame:
    """Crest and toe of the lattice's face before refinement."""
    det = faces.detect(ramp_grid(spark, d), ramp_frame(spark, d), CFG)
    return positions(spark, d, lines.vertices_of(lines.approximate_lines(det, CFG)), ["face_id", "type"], False)


# ---------------------------------------------------------------- stencils and labels on the cloud of the lineitem table

#: The dense grid of mean heights, as wide and high as the cloud; cells without points are 0.
CLOUD_SQL = f"""{LINEITEM_SQL}, bx AS (SELECT floor(max(x) / 50)::INT AS mc, floor(max(y) / 50)::INT AS mr FROM p),
own AS (SELECT greatest(0, floor(y / 50::DOUBLE + 1e-9))::INT AS r, greatest(0, floor(x / 50::DOUBLE + 1e-9))::INT AS c, count(*) AS n, avg(cents::DOUBLE) / 100000 AS z FROM p GROUP BY ALL),
g AS (SELECT t.r::INT AS r, u.c::INT AS c, coalesce(n, 0) AS n, coalesce(z, 0) AS z FROM (SELECT unnest(range(mr + 1)) AS r FROM bx) t, (SELECT unnest(range(mc + 1)) AS c FROM bx) u LEFT JOIN own ON own.r = t.r AND own.c = u.c)"""
_BUSY = "n % 3 = 1"


def cloud_grid(spark: SparkSession, d: str) -> tuple[DataFrame, grid.Frame]:
    """(r, c, n, z) of every cell of the cloud's grid, and its frame."""
    p = lineitem_points(spark, d)
    b = grid.bounds(p).first()
    frame = grid.Frame(0.0, 0.0, 50.0, int(b["xmax"] // 50) + 1, int(b["ymax"] // 50) + 1)
    cells = materialize(grid.raster_mean(p, frame), "cloud")
    every = grid.dense(cells, frame).select("r", "c").join(cells, ["r", "c"], "left")
    return every.select("r", "c", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("z", F.lit(0.0)) / 100_000).alias("z")), frame


@query(f"WITH {CLOUD_SQL}, {_grad('g', 's', 50.0)} SELECT r, c, {r3('slope')} AS slope FROM s")
def win_slope_cloud(spark: SparkSession, d: str) -> DataFrame:
    g, frame = cloud_grid(spark, d)
    return terrain.gradients(g, frame.cell, {"0": "z"}).select("r", "c", col3("slope_0").alias("slope"))


@query(f"WITH {CLOUD_SQL}, {_gauss(1.5, 'h')} SELECT r, c, {r3('z')} AS z FROM h")
def win_gaussian_cloud(spark: SparkSession, d: str) -> DataFrame:
    return terrain.gaussian(cloud_grid(spark, d)[0], {"s": 1.5}).select("r", "c", col3("s").alias("z"))


@query(f"""WITH {CLOUD_SQL}, mk AS (SELECT r, c, {_BUSY} AS m FROM g), d1 AS (SELECT r, c, max(m::INT) {_HB} AS m FROM mk), d2 AS (SELECT r, c, max(m) {_VB} AS m FROM d1),
e1 AS (SELECT r, c, CASE WHEN count(*) {_HB} < 3 THEN 0 ELSE min(m) {_HB} END AS m FROM d2), e2 AS (SELECT r, c, CASE WHEN count(*) {_VB} < 3 THEN 0 ELSE min(m) {_VB} END AS m FROM e1) SELECT r, c FROM e2 WHERE m = 1""")
def win_closing_cloud(spark: SparkSession, d: str) -> DataFrame:
    return terrain.closing(cloud_grid(spark, d)[0].withColumn("m", F.expr(_BUSY)), "m", "closed").where("closed").select("r", "c")


@query(f"""WITH RECURSIVE {CLOUD_SQL}, mk AS (SELECT r, c, r * (mc + 1) + c AS id FROM g, bx WHERE {_BUSY}), reach AS (SELECT r, c, id FROM mk UNION SELECT b.r, b.c, a.id FROM reach a JOIN mk b ON {_AROUND}),
lab AS (SELECT r, c, min(id)::BIGINT AS label FROM reach GROUP BY r, c) SELECT label, count(*) AS cells FROM lab GROUP BY label""")
def grf_labels_cloud(spark: SparkSession, d: str) -> DataFrame:
    g, frame = cloud_grid(spark, d)
    return graph.label_cells(g.where(_BUSY).select("r", "c"), frame, tile=16).groupBy("label").agg(F.count("*").alias("cells"))


@query(f"""WITH {CLOUD_SQL}, mk AS (SELECT r, c FROM g WHERE n > 0), k AS (SELECT a.r, a.c, count(*) AS near FROM mk a JOIN mk b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c) SELECT r, c FROM k WHERE near < 9""")
def win_boundary_cloud(spark: SparkSession, d: str) -> DataFrame:
    return faces.boundary(cloud_grid(spark, d)[0].where("n > 0").select("r", "c", F.lit(1).alias("label"))).select("r", "c")


# ---------------------------------------------------------------- sequences along lines, one call for a line

_LINE = f"{EMBEDDING_SQL}, v AS (SELECT cls, row_number() OVER (PARTITION BY cls ORDER BY pid) AS i, x, y, z FROM p)"


def by_line(spark: SparkSession, d: str, work) -> DataFrame:
    """(label, i, x, y, z) of each label's points, in order of their ids, after ``work`` on them as an array."""

    def run(pdf):
        pdf = pdf.sort_values("pid")
        out = work(pdf[["x", "y", "z"]].to_numpy(float))
        return pd.DataFrame({"label": int(pdf["cls"].iloc[0]), "i": np.arange(1, len(out) + 1), "x": out[:, 0], "y": out[:, 1], "z": out[:, 2]})

    out = embedding_points(spark, d).groupBy("cls").applyInPandas(run, "label int, i int, x double, y double, z double")
    return out.select("label", "i", *(col3(c).alias(c) for c in "xyz"))


def _simplified(eps: float, dims: str) -> str:
    dot = lambda a, b: " + ".join(f"({a.format(k=k)}) * ({b.format(k=k)})" for k in dims)
    chord, mid = "pb.{k} - pa.{k}", "m.{k} - pa.{k}"
    t = f"least(1, greatest(0, ({dot(mid, chord)}) / nullif({dot(chord, chord)}, 0)))"
    far = " + ".join(f"(m.{k} - pa.{k} - coalesce(t, 0) * (pb.{k} - pa.{k})) * (m.{k} - pa.{k} - coalesce(t, 0) * (pb.{k} - pa.{k}))" for k in dims)
    return f"""WITH RECURSIVE {_LINE}, n AS (SELECT cls, max(i) AS n FROM v GROUP BY cls), seg(cls, a, b) AS (SELECT cls, 1::BIGINT, n FROM n UNION ALL
SELECT cls, unnest([a, k]), unnest([k, b]) FROM (SELECT cls, a, b, arg_max(i, far) AS k FROM (SELECT s.cls, s.a, s.b, m.i, sqrt({far}) AS far FROM (SELECT s.cls, s.a, s.b, m.i, {t} AS t
  FROM seg s JOIN v pa ON pa.cls = s.cls AND pa.i = s.a JOIN v pb ON pb.cls = s.cls AND pb.i = s.b JOIN v m ON m.cls = s.cls AND m.i > s.a AND m.i < s.b) s
  JOIN v pa ON pa.cls = s.cls AND pa.i = s.a JOIN v pb ON pb.cls = s.cls AND pb.i = s.b JOIN v m ON m.cls = s.cls AND m.i = s.i) q GROUP BY cls, a, b HAVING max(far) > {eps}::DOUBLE)),
e AS (SELECT cls, a AS i FROM seg UNION SELECT cls, b FROM seg)
SELECT cls::INT AS label, row_number() OVER (PARTITION BY cls ORDER BY i)::INT AS i, {r3('x')} AS x, {r3('y')} AS y, {r3('z')} AS z FROM e JOIN v USING (cls, i)"""


@query(_simplified(0.35, "xyz"))
def seq_simplify(spark: SparkSession, d: str) -> DataFrame:
    """Lines simplified in space."""
    return by_line(spark, d, lambda p: lines.simplify(p, 0.35))


@query(_simplified(0.3, "xy"))
def seq_simplify_in_plan(spark: SparkSession, d: str) -> DataFrame:
    """Lines simplified in plan; no segment is long enough to be cut again."""
    return by_line(spark, d, lambda p: lines.simplify_in_plan(p, 0.3))


_WINDOW = 11
_WEIGHTS = ", ".join(f"({i}, {j}, {float(w)!r}::DOUBLE)" for i, row in enumerate(lines.quadratic_smoother(_WINDOW)) for j, w in enumerate(row))
_HALF = _WINDOW // 2


@query(f"""WITH {_LINE}, a AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step FROM v WINDOW w AS (PARTITION BY cls ORDER BY i)),
s AS (SELECT *, sum(step) OVER (PARTITION BY cls ORDER BY i) AS s, count(*) OVER (PARTITION BY cls) AS n FROM a),
g AS (SELECT *, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, max(s) OVER (PARTITION BY cls) AS total FROM s WINDOW w AS (PARTITION BY cls ORDER BY i)),
t AS (SELECT cls, i - 1 AS k, n, CASE WHEN i = n THEN total ELSE (i - 1) * (total / (n - 1)) END AS pos FROM g),
e AS (SELECT t.cls, k, t.n, x + (x2 - x) * ((pos - s) / (s2 - s)) AS x, y + (y2 - y) * ((pos - s) / (s2 - s)) AS y, z + (z2 - z) * ((pos - s) / (s2 - s)) AS z FROM t JOIN g ON g.cls = t.cls AND s2 IS NOT NULL AND pos >= s AND (pos < s2 OR (pos = total AND s2 = total))),
h(i, j, w) AS (VALUES {_WEIGHTS}),
o AS (SELECT a.cls, a.k, a.n, sum(w * b.x) AS x, sum(w * b.y) AS y, sum(w * b.z) AS z FROM e a JOIN h ON h.i = CASE WHEN a.k < {_HALF} THEN a.k WHEN a.k >= a.n - {_HALF} THEN {_WINDOW} - (a.n - a.k) ELSE {_HALF} END
  JOIN e b ON b.cls = a.cls AND b.k = h.j + least(greatest(a.k - {_HALF}, 0), a.n - {_WINDOW}) GROUP BY a.cls, a.k, a.n)
SELECT o.cls::INT AS label, (k + 1)::INT AS i, {r3('CASE WHEN k IN (0, n - 1) THEN v.x ELSE o.x END')} AS x, {r3('CASE WHEN k IN (0, n - 1) THEN v.y ELSE o.y END')} AS y, {r3('CASE WHEN k IN (0, n - 1) THEN v.z ELSE o.z END')} AS z FROM o JOIN v ON v.cls = o.cls AND v.i = k + 1""")
def seq_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Lines spaced evenly and smoothed by a moving parabola, ends kept."""
    return by_line(spark, d, lambda p: lines.smooth(p, _WINDOW))


@query(ORACLE["seq_resample"])
def seq_resample_lines(spark: SparkSession, d: str) -> DataFrame:
    """The run's own resampling, line by line, against the same SQL as the table form."""
    return by_line(spark, d, lambda p: lines.resample(p, 0.5)).select("label", "i", "x", "y")


@query(f"""WITH RECURSIVE {RAMP_SQL}, {_labels('g', SCATTER)}, best AS (SELECT label FROM lab GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), m AS (SELECT r, c, r * {COLS} + c AS id FROM lab JOIN best USING (label)),
nb AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON {_AROUND}), loose AS (SELECT coalesce((SELECT min(id) FROM (SELECT m.id, count(nb.b) AS n FROM m LEFT JOIN nb ON nb.a = m.id GROUP BY m.id) WHERE n <= 1), (SELECT min(id) FROM m)) AS id),
one(id, depth) AS (SELECT id, 0 FROM loose UNION SELECT nb.b, depth + 1 FROM one JOIN nb ON nb.a = one.id WHERE depth < (SELECT count(*) FROM m)), d1 AS (SELECT id, min(depth) AS depth FROM one GROUP BY id), f1 AS (SELECT id FROM d1 ORDER BY depth DESC, id LIMIT 1),
two(id, depth) AS (SELECT id, 0 FROM f1 UNION SELECT nb.b, depth + 1 FROM two JOIN nb ON nb.a = two.id WHERE depth < (SELECT count(*) FROM m)), d2 AS (SELECT id, min(depth) AS depth FROM two GROUP BY id), f2 AS (SELECT id, depth FROM d2 ORDER BY depth DESC, id LIMIT 1)
SELECT f2.depth::INT + 1 AS cells, f1.id::INT AS first_cell, f2.id::INT AS last_cell FROM f1, f2""")
def grf_longest_chain(spark: SparkSession, d: str) -> DataFrame:
    """Length and ends of the longest shortest path through the largest part of a mask, which is one face's."""
    cells = ramp_cells(spark, d).where(SCATTER).select("r", "c").toPandas()
    mask = np.zeros((ramp_rows(spark, d), COLS), dtype=bool)
    mask[cells["r"], cells["c"]] = True
    chain = lines.longest_chain(mask)
    first, last = (int(r * COLS + c) for r, c in (chain[0], chain[-1]))
    return spark.createDataFrame([(len(chain), first, last)], "cells int, first_cell int, last_cell int")


@query(f"""WITH {RAMP_SQL}, {_grad('g', 's')}, q AS (SELECT a.r, a.c, median(b.gx) AS gx, median(b.gy) AS gy FROM s a JOIN s b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 WHERE (a.r * 7 + a.c * 3) % 97 = 0 GROUP BY a.r, a.c)
SELECT r, c, {r3('gx / sqrt(gx * gx + gy * gy)')} AS ux, {r3('gy / sqrt(gx * gx + gy * gy)')} AS uy FROM q WHERE sqrt(gx * gx + gy * gy) >= 1e-8""")
def win_uphill(spark: SparkSession, d: str) -> DataFrame:
    """Directions of the median gradient around cells."""
    g = terrain.gradients(ramp_cells(spark, d), CELL, {"0": "z"}).withColumnsRenamed({"gx_0": "gx", "gy_0": "gy"})
    return single_edge.uphill_cells(g.where("(r * 7 + c * 3) % 97 = 0"), g).select("r", "c", col3("ux").alias("ux"), col3("uy").alias("uy"))


@query(f"""WITH {LINEITEM_SQL}, s AS (SELECT list_sort(list(DISTINCT cls::INT)) AS seen FROM p), k(variant, enabled, chosen) AS (VALUES ('off', false, [1]), ('some', true, [5, 2, 2]), ('every', true, range(0, 40)::INT[]), ('nothing', true, []::INT[])),
q AS (SELECT variant, CASE WHEN NOT enabled THEN NULL WHEN len(seen) > 0 AND list_has_all(chosen, seen) THEN [] ELSE list_sort(list_distinct(chosen)) END AS auto, list_contains(seen, 2) AS ground FROM k, s)
SELECT variant, coalesce(auto::VARCHAR, 'None') AS auto, CASE WHEN auto IS NULL OR len(auto) = 0 THEN 'None' ELSE auto::VARCHAR END AS click, CASE WHEN ground THEN '[2]' ELSE 'None' END AS terrain FROM q""")
def fil_class_requests(spark: SparkSession, d: str) -> DataFrame:
    """Which classes each kind of request asks for, given those that a cloud has."""
    seen = sorted(r["cls"] for r in select.class_histogram(lineitem_points(spark, d)).collect())
    cases = [("off", False, [1]), ("some", True, [5, 2, 2]), ("every", True, list(range(40))), ("nothing", True, [])]
    rows = [(v, str(classes_for_auto(on, chosen, seen)), str(classes_for_click(on, chosen, seen)), str(classes_for_terrain(seen))) for v, on, chosen in cases]
    return spark.createDataFrame(rows, "variant string, auto string, click string, terrain string")


@query("SELECT n_nationkey::INT AS i, n_nationkey::DOUBLE AS x, 0::DOUBLE AS y FROM nation")
def seq_despike(spark: SparkSession, d: str) -> DataFrame:
    """A straight line with three spikes, which become the middle of their neighbours."""
    k = np.sort(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").toPandas()["n_nationkey"].to_numpy(float))
    out = lines.despike(np.column_stack([k, np.where(k % 8 == 4, 3.0, 0.0)]))
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(out)], "i int, x double, y double")


@query(f"WITH {RAMP_SQL}, {_EDGES} SELECT t.vid::BIGINT AS vid, edge_x, true AS on_edge, true AS level FROM range(15) t(vid), k WHERE type = 'CREST'")
def seq_plane_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Vertices 0.2 m off the crest, moved to where the planes of bench and face meet."""
    v = spark.range(15).select(F.col("id").alias("vid"), F.lit(10.2).alias("vx"), (F.col("id") + 3.0).alias("vy"), F.lit(0.0).alias("tx"), F.lit(1.0).alias("ty"), F.lit(-1.0).alias("ux"), F.lit(0.0).alias("uy"))
    edge = ramp_cells(spark, d).where("z > 9.95").agg((F.max("c") * CELL).alias("edge_x"))
    moved = single_edge.plane_breaks(ramp_points(spark, d), v, True).join(v, "vid").crossJoin(edge)  # one row
    return moved.select("vid", "edge_x", (F.abs(F.col("vx") + F.col("shift") * F.col("ux") - F.col("edge_x")) <= 0.1).alias("on_edge"), (F.abs(F.col("z") - 10) <= 0.1).alias("level"))


@query(f"WITH {RAMP_SQL}, {_EDGES} SELECT type, edge_x, 12 AS points, true AS moved, true AS on_edge FROM k")
def seq_transition(spark: SparkSession, d: str) -> DataFrame:
    """Lines 0.6 m off crest and toe, moved across themselves to where a steep side meets a flat one."""
    cells, frame = single_edge.surface(ramp_points(spark, d), CELL)
    rows = []
    for kind, at, off in (("CREST", 10.0, 0.6), ("TOE", 15.0, -0.6)):
        line = np.column_stack([np.full(12, at + off), np.arange(12) + 4.0, np.full(12, 7.0)])
        out, n, _ = single_edge.snap_to_transition(line, cells, frame, kind == "CREST", 20.0, 35.0)
        rows.append((kind, at, len(out), n >= 8, bool(np.abs(np.median(out[:, 0]) - at) <= 0.4)))
    return spark.createDataFrame(rows, "type string, edge_x double, points int, moved boolean, on_edge boolean")


@query(f"SELECT 'right' AS side, way, max(n_nationkey)::DOUBLE AS last_x, {r3('sqrt(1 + 0.2::DOUBLE * 0.2::DOUBLE) + max(n_nationkey) - 11')} AS growth FROM nation, (VALUES ('forward'), ('backward')) t(way) GROUP BY way")
def seq_stitch(spark: SparkSession, d: str) -> DataFrame:
    """A line carried on by a segment that overlaps its end, either way round."""
    k = np.sort(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").toPandas()["n_nationkey"].to_numpy(float))  # 25 rows
    line, more = (np.column_stack([x, np.full(len(x), y), np.zeros(len(x))]) for x, y in ((k[:11], 0.0), (k[8:], 0.2)))
    rows = []
    for way, segment in (("forward", more), ("backward", more[::-1])):
        got = single_edge.extend(line, segment, left=False)
        steps = np.diff(got["extension"][:, :2], axis=0)
        rows.append((got["side"], way, float(got["extension"][-1, 0]), float(np.hypot(*steps.T).sum())))
    return spark.createDataFrame(rows, "side string, way string, last_x double, growth double").withColumn("growth", floor_at(F.col("growth")))
