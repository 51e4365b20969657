"""Registry of the terrain engine's queries, each with DuckDB SQL where SQL can express it.

Values that are sums of doubles are rounded by floor to three digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..functions.exprs import finite, floor_at, gaussian_kernel, nearest_index
from ..operators import faces, graph, grid, halo, lines, quantiles, refine, select, single_edge, spatial, terrain
from ..session import shipped
from ..shared import materialize
from ..sources import catalog, sinks
from ..sources.points import text_points
from ..streaming.raster import raster_sums
from . import extract as E
from .fixtures import (
    CELL, COLS, EMBEDDING_SQL, GAPS, LAST_ROW, LINEITEM_SQL, POINT_ORDER, RAMP_SQL, embedding_points, lineitem_points, ramp_cells, ramp_frame, ramp_grid, ramp_rows, ramp_with_gaps,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
LOW, HIGH = 25.0, 35.0
CFG = ExtractConfig(cell_size=CELL, slope_low_deg=LOW, slope_high_deg=HIGH, min_face_area_m2=8.0, min_line_length_m=8.0)
#: Cells of the lattice that serve as a scattered mask with many components.
SCATTER = "(7919 * r + 104729 * c) % 1000 < 230"
DENSER = "(7919 * r + 104729 * c) % 1000 < 300"
FRAME_A = grid.Frame(0.0, 0.0, 50.0, 41, 80)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def r3(sql: str) -> str:
    return f"floor(({sql}) * 1000 + 0.5) / 1000"


def col3(c):
    return floor_at(F.col(c) if isinstance(c, str) else c)


# ---------------------------------------------------------------- points


@query(f"WITH {LINEITEM_SQL} SELECT count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(cents)::DOUBLE AS zmin, max(cents)::DOUBLE AS zmax FROM p")
def src_bbox(spark: SparkSession, d: str) -> DataFrame:
    return grid.bounds(lineitem_points(spark, d))


@query("""WITH t AS (SELECT o_orderkey, '  ' || o_orderkey || ' ' || o_custkey || '   ' || o_totalprice || ' 7 # ' || o_orderstatus AS value FROM orders)
SELECT count(*) AS n, sum(o_orderkey)::DOUBLE AS xsum, sum(o_custkey)::DOUBLE AS ysum, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders""")
def src_text_points(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    row = F.concat(F.lit("  "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_custkey").cast("string"), F.lit("   "), F.col("o_totalprice").cast("string"), F.lit(" 7 # "), F.col("o_orderstatus"))
    noise = spark.createDataFrame([("# only a comment",), ("",), ("x y z",), ("1 2",), ("1 2 nan",), ("inf 2 3",)], "value string")
    p = text_points(o.select(row.alias("value")).unionByName(noise), comma=False)
    return p.agg(F.count("*").alias("n"), F.sum("x").alias("xsum"), F.sum("y").alias("ysum"), F.sum(F.round(F.col("z") * 100).cast("long")).alias("cents"))


@query("SELECT count(*) AS n, sum(s_suppkey)::DOUBLE AS xsum, sum(s_nationkey)::DOUBLE AS ysum, sum(CAST(round(s_acctbal * 100) AS BIGINT))::BIGINT AS cents FROM supplier")
def src_csv_points(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet")
    row = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.col("s_acctbal").cast("string"), F.lit("more"))
    head = spark.createDataFrame([("x,y,z,name",), ("# comment",)], "value string")
    p = text_points(head.unionByName(s.select(row.alias("value"))), comma=True)
    return p.agg(F.count("*").alias("n"), F.sum("x").alias("xsum"), F.sum("y").alias("ysum"), F.sum(F.round(F.col("z") * 100).cast("long")).alias("cents"))


@query(f"WITH {LINEITEM_SQL} SELECT count(*) AS n, sum(cents)::BIGINT AS zsum_cents FROM p WHERE cls IN (1, 2)")
def fil_class_in(spark: SparkSession, d: str) -> DataFrame:
    return select.in_classes(lineitem_points(spark, d), (1, 2)).agg(F.count("*").alias("n"), F.sum("cents").alias("zsum_cents"))


_GROUND = """SELECT '{v}' AS variant, g >= greatest(100, floor(0.01::DOUBLE * t)) AS used_ground, CASE WHEN g >= greatest(100, floor(0.01::DOUBLE * t)) THEN g ELSE t END AS n
FROM (SELECT count(*) AS t, count(*) FILTER (WHERE cls = {k}) AS g FROM p)"""


@query(f"WITH {LINEITEM_SQL} " + " UNION ALL ".join(_GROUND.format(v=v, k=k) for v, k in (("present", 2), ("absent", 99))))
def fil_ground_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for variant, cls in (("present", 2), ("absent", 99)):
        _, used, n = select.lenient_classes(lineitem_points(spark, d), ExtractConfig(ground_class=cls))
        rows.append((variant, used, n))
    return spark.createDataFrame(rows, "variant string, used_ground boolean, n long")


@query(f"WITH {EMBEDDING_SQL} SELECT count(*) FILTER (WHERE cls = 2) >= greatest(250, floor(0.05::DOUBLE * count(*))) AS used_ground, CASE WHEN count(*) FILTER (WHERE cls = 2) >= greatest(250, floor(0.05::DOUBLE * count(*))) THEN count(*) FILTER (WHERE cls = 2) ELSE count(*) END AS n FROM p")
def fil_clicked_classes(spark: SparkSession, d: str) -> DataFrame:
    kept, used = select.clicked_classes(embedding_points(spark, d), None)
    return kept.agg(F.lit(used).alias("used_ground"), F.count("*").alias("n"))


@query(f"""WITH {LINEITEM_SQL}, q AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, cents) AS rn, count(*) OVER () AS t FROM p)
SELECT l_orderkey, l_linenumber, cents FROM q WHERE (rn - 1) % ceil(t / 5000.0)::BIGINT = 0""")
def fil_stride(spark: SparkSession, d: str) -> DataFrame:
    return select.every_nth(lineitem_points(spark, d), POINT_ORDER, 5000).select("l_orderkey", "l_linenumber", "cents")


@query(f"""WITH {EMBEDDING_SQL}, q AS (SELECT *, (x + 0.3::DOUBLE) * 0.8::DOUBLE + (y + 0.2::DOUBLE) * 0.6::DOUBLE AS along, (y + 0.2::DOUBLE) * 0.8::DOUBLE - (x + 0.3::DOUBLE) * 0.6::DOUBLE AS across FROM p)
SELECT pid FROM q WHERE along >= 0 AND along <= 0.5::DOUBLE AND abs(across) <= 0.1::DOUBLE AND cls <> 9""")
def fil_corridor(spark: SparkSession, d: str) -> DataFrame:
    return select.corridor(embedding_points(spark, d), (-0.3, -0.2), (0.1, 0.1), 0.2, range(9)).select("pid")


@query(f"WITH {EMBEDDING_SQL} SELECT pid FROM p WHERE x * x + y * y <= 0.15::DOUBLE * 0.15::DOUBLE AND abs(z) <= 8")
def fil_cylinder(spark: SparkSession, d: str) -> DataFrame:
    return select.cylinder(embedding_points(spark, d), (0.0, 0.0, 0.0), 0.15).select("pid")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS milli FROM events WHERE isfinite(value) GROUP BY event_type")
def fil_finite(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").where(finite(F.col("value")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("milli"))


# ---------------------------------------------------------------- projections


def _index(v: str, n: int) -> str:
    return f"greatest(0, least({n - 1}, floor({v} / 50::DOUBLE + 1e-9)))::INT"


_CELLS_A = f"{LINEITEM_SQL}, q AS (SELECT *, {_index('y', FRAME_A.ny)} AS r, {_index('x', FRAME_A.nx)} AS c FROM p)"


@query(f"WITH {_CELLS_A} SELECT r, c, count(*) AS n FROM q GROUP BY r, c")
def prj_cell_id(spark: SparkSession, d: str) -> DataFrame:
    return grid.with_cells(lineitem_points(spark, d), FRAME_A).groupBy("r", "c").agg(F.count("*").alias("n"))


@query(f"""WITH {LINEITEM_SQL}, b AS (SELECT greatest(max(x) - min(x), 0.5::DOUBLE) AS w, greatest(max(y) - min(y), 0.5::DOUBLE) AS h FROM p),
s AS (SELECT w, h, greatest(2, floor(w / 0.5::DOUBLE) + 1) AS nx, greatest(2, floor(h / 0.5::DOUBLE) + 1) AS ny FROM b),
t AS (SELECT w, h, nx * ny > 1000000 AS adjusted, CASE WHEN nx * ny > 1000000 THEN 0.5::DOUBLE * (sqrt(nx * ny / 1000000::DOUBLE) * 1.02::DOUBLE) ELSE 0.5::DOUBLE END AS cell FROM s)
SELECT {r3('cell')} AS cell, greatest(2, floor(w / cell) + 1)::INT AS nx, greatest(2, floor(h / cell) + 1)::INT AS ny, adjusted FROM t""")
def prj_cell_budget(spark: SparkSession, d: str) -> DataFrame:
    b = grid.bounds(lineitem_points(spark, d)).first()
    f = grid.frame_for((b["xmin"], b["ymin"]), (b["xmax"], b["ymax"]), 0.5, 1_000_000)
    return spark.createDataFrame([(f.cell, f.nx, f.ny, f.adjusted)], "cell double, nx int, ny int, adjusted boolean").withColumn("cell", floor_at(F.col("cell")))


@query(f"""WITH {EMBEDDING_SQL}, {RAMP_SQL}, q AS (SELECT pid, greatest(0, least({LAST_ROW}, round_even((y + 1) * 10 / {CELL}::DOUBLE - 0.5::DOUBLE, 0)))::INT AS r,
  greatest(0, least({COLS - 1}, round_even((x + 1) * 15 / {CELL}::DOUBLE - 0.5::DOUBLE, 0)))::INT AS c FROM p) SELECT pid, {r3('z')} AS z FROM q JOIN g USING (r, c)""")
def prj_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = embedding_points(spark, d)
    at = p.select("pid", nearest_index((F.col("y") + 1) * 10, 0.0, CELL, ramp_rows(spark, d)).alias("r"), nearest_index((F.col("x") + 1) * 15, 0.0, CELL, COLS).alias("c"))
    return at.join(ramp_cells(spark, d), ["r", "c"]).select("pid", col3("z").alias("z"))


# ---------------------------------------------------------------- aggregates


@query(f"WITH {_CELLS_A} SELECT r, c, count(*) AS n, sum(cents)::BIGINT AS zsum_cents FROM q WHERE cls IN (1, 2) GROUP BY r, c")
def agg_raster_mean(spark: SparkSession, d: str) -> DataFrame:
    cells = grid.raster_mean(select.in_classes(lineitem_points(spark, d), (1, 2)), FRAME_A)
    return cells.select("r", "c", "n", F.round(F.col("z") * F.col("n")).cast("long").alias("zsum_cents"))


@query(f"WITH {_CELLS_A} SELECT r, c, count(*) AS n, median(cents)::DOUBLE AS zmed FROM q GROUP BY r, c")
def agg_raster_median(spark: SparkSession, d: str) -> DataFrame:
    return grid.raster_median(lineitem_points(spark, d), FRAME_A).withColumnRenamed("z", "zmed")


@query(f"WITH {_CELLS_A} SELECT r, c, count(*) AS n, sum(cents)::BIGINT AS zsum FROM q GROUP BY r, c")
def agg_raster_merge(spark: SparkSession, d: str) -> DataFrame:
    """Sums of halves of the input, merged: the incremental form of the raster."""
    p = lineitem_points(spark, d).withColumn("z", F.col("cents"))
    half = F.col("l_orderkey") % 2 == 0
    return grid.merge_rasters(raster_sums(p.where(half), FRAME_A).drop("z"), raster_sums(p.where(~half), FRAME_A).drop("z"))


_NAMES = ", ".join(f"({k}, '{v}')" for k, v in sorted(select.CLASS_NAMES.items()))


@query(f"WITH {LINEITEM_SQL}, m(cls, name) AS (VALUES {_NAMES}) SELECT p.cls::INT AS cls, coalesce(max(name), 'Reserved') AS name, count(*) AS n FROM p LEFT JOIN m USING (cls) GROUP BY p.cls")
def agg_class_hist(spark: SparkSession, d: str) -> DataFrame:
    return select.class_histogram(lineitem_points(spark, d))


@query(f"WITH {LINEITEM_SQL} SELECT cls, {r3('count(*) / ((max(x) - min(x)) * (max(y) - min(y)))')} AS density FROM p GROUP BY cls")
def agg_density(spark: SparkSession, d: str) -> DataFrame:
    return select.density(lineitem_points(spark, d), "cls").select("cls", col3("density").alias("density"))


_SUMS = "count(*) AS n, sum(x) AS su, sum(y) AS sv, sum(z) AS sz, sum(x*x) AS suu, sum(x*y) AS suv, sum(y*y) AS svv, sum(x*z) AS suz, sum(y*z) AS svz, sum(z*z) AS szz"
_FIT = f"""s AS (SELECT cls, {_SUMS} FROM p GROUP BY cls),
m AS (SELECT *, suu * (svv * n - sv * sv) - suv * (suv * n - sv * su) + su * (suv * sv - svv * su) AS det FROM s),
f AS (SELECT *, (suz * (svv * n - sv * sv) - suv * (svz * n - sv * sz) + su * (svz * sv - svv * sz)) / det AS a,
  (suu * (svz * n - sv * sz) - suz * (suv * n - sv * su) + su * (suv * sz - svz * su)) / det AS b,
  (suu * (svv * sz - svz * sv) - suv * (suv * sz - svz * su) + suz * (suv * sv - svv * su)) / det AS c FROM m),
e AS (SELECT cls, n, a, b, c, sqrt(greatest((szz - a * suz - b * svz - c * sz) / n, 0)) AS rmse FROM f)"""


@query(f"WITH {EMBEDDING_SQL}, s AS (SELECT cls, {_SUMS} FROM p GROUP BY cls) SELECT cls AS label, n, {', '.join(f'{r3(c)} AS {c}' for c in refine.SUMS[1:])} FROM s")
def agg_plane_sums(spark: SparkSession, d: str) -> DataFrame:
    s = refine.plane_sums(embedding_points(spark, d), "cls", F.col("x"), F.col("y"))
    return s.select(F.col("cls").alias("label"), "n", *(col3(c).alias(c) for c in refine.SUMS[1:]))


@query(f"WITH {EMBEDDING_SQL}, {_FIT} SELECT cls AS label, n, {', '.join(f'{r3(c)} AS {c}' for c in ('a', 'b', 'c', 'rmse'))} FROM e")
def agg_plane_fit(spark: SparkSession, d: str) -> DataFrame:
    f = refine.plane_fit(refine.plane_sums(embedding_points(spark, d), "cls", F.col("x"), F.col("y")))
    return f.select(F.col("cls").alias("label"), "n", *(col3(c).alias(c) for c in ("a", "b", "c", "rmse")))


_ROBUST = f"""WITH p0 AS (SELECT vec_id, label AS cls, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE * (CASE WHEN vec_id % 19 = 0 THEN 9 ELSE 1 END) AS z FROM embeddings),
p AS (SELECT * FROM p0), {_FIT}, o AS (SELECT p.*, p.z - (a * x + b * y + c) AS off FROM p JOIN e USING (cls)),
c1 AS (SELECT cls, median(off) AS mid FROM o GROUP BY cls), c2 AS (SELECT cls, median(abs(off - mid)) AS mad FROM o JOIN c1 USING (cls) GROUP BY cls),
k AS (SELECT o.cls, o.x, o.y, o.z FROM o JOIN c1 USING (cls) JOIN c2 USING (cls) WHERE abs(off - mid) <= 3.5::DOUBLE * 1.4826::DOUBLE * mad),
{_FIT.replace('FROM p ', 'FROM k ').replace('s AS', 's2 AS').replace('FROM s)', 'FROM s2)').replace('m AS', 'm2 AS').replace('FROM m)', 'FROM m2)').replace('f AS', 'f2 AS').replace('FROM f)', 'FROM f2)').replace('e AS', 'e2 AS')}
SELECT cls AS label, n AS kept, {r3('c')} AS z, {r3('rmse')} AS rmse FROM e2"""


@query(_ROBUST)
def agg_plane_robust(spark: SparkSession, d: str) -> DataFrame:
    p = embedding_points(spark, d).select(F.col("cls").alias("label"), F.col("x").alias("u"), F.col("y").alias("v"), (F.col("z") * F.when(F.col("pid") % 19 == 0, 9).otherwise(1)).alias("w"))
    return refine.robust_planes(p, "label").select("label", "kept", col3("c").alias("z"), col3("rmse").alias("rmse"))


@query("""WITH o AS (SELECT l_extendedprice::DOUBLE AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem WHERE l_extendedprice IS NOT NULL)
SELECT k AS rank, v AS price FROM o WHERE k IN (0, (n - 1) // 2, (n - 1) * 70 // 100, (n - 1) * 85 // 100, n - 1)""")
def agg_order_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Least, middle and greatest price, and those at 70 and 85 percent, by histogram refinement."""
    prices = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_extendedprice").cast("double").alias("price"))
    n = prices.where("price is not null").count()
    found = quantiles.order_statistics(prices, "price", [0, (n - 1) // 2, (n - 1) * 70 // 100, (n - 1) * 85 // 100, n - 1]) if n else {}
    return spark.createDataFrame(sorted(found.items()), "rank long, price double")


# ---------------------------------------------------------------- joins


@query(f"""WITH {EMBEDDING_SQL}, n AS (SELECT a.pid, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM p a JOIN p b ON a.x <> b.x OR a.y <> b.y GROUP BY a.pid)
SELECT count(*) AS n, {r3('median(d) * 1000')} AS spacing_milli FROM n""")
def jn_nn_spacing(spark: SparkSession, d: str) -> DataFrame:
    found = materialize(spatial.neighbour_distance(embedding_points(spark, d)).select("d"), "distances")
    middle = quantiles.quantiles(found, "d", [0.5]) or [None]
    return found.agg(F.count("*").alias("n")).select("n", floor_at(F.lit(middle[0]).cast("double") * 1000).alias("spacing_milli"))


_CENTRES = "v AS (SELECT pid AS vid, x AS vx, y AS vy FROM p WHERE pid % 50 = 0)"  # the stated query set of a search


def _vertices(p: DataFrame) -> DataFrame:
    return p.where("pid % 50 = 0").select(F.col("pid").alias("vid"), F.col("x").alias("vx"), F.col("y").alias("vy"))


@query(f"""WITH {EMBEDDING_SQL}, {_CENTRES}, j AS (SELECT pid, vid, (x - vx) * (x - vx) + (y - vy) * (y - vy) AS d2 FROM p, v WHERE (x - vx) * (x - vx) + (y - vy) * (y - vy) <= 0.05::DOUBLE * 0.05::DOUBLE),
b AS (SELECT pid, arg_min(vid, (d2, vid)) AS vid FROM j GROUP BY pid) SELECT vid, count(*) AS n FROM b GROUP BY vid""")
def jn_nearest_vertex(spark: SparkSession, d: str) -> DataFrame:
    p = embedding_points(spark, d)
    return spatial.nearest_vertex(p, _vertices(p), 0.05).groupBy("vid").agg(F.count("*").alias("n"))


@query(f"WITH {EMBEDDING_SQL}, {_CENTRES} SELECT vid, count(*) AS n FROM p, v WHERE sqrt((x - vx) * (x - vx) + (y - vy) * (y - vy)) <= 0.08::DOUBLE GROUP BY vid")
def jn_ball(spark: SparkSession, d: str) -> DataFrame:
    p = embedding_points(spark, d)
    return spatial.ball_join(p, _vertices(p), 0.08).groupBy("vid").agg(F.count("*").alias("n"))


@query(f"""WITH {EMBEDDING_SQL}, {_CENTRES}, j AS (SELECT vid, pid, row_number() OVER (PARTITION BY vid ORDER BY sqrt((x - vx) * (x - vx) + (y - vy) * (y - vy)), pid) AS rank FROM p, v)
SELECT vid, pid, rank::INT AS rank FROM j WHERE rank <= 5""")
def jn_knn(spark: SparkSession, d: str) -> DataFrame:
    p = embedding_points(spark, d)
    return spatial.knn_join(p, _vertices(p), 5).select("vid", "pid", "rank")


# ---------------------------------------------------------------- stencils


def _edge(fn: str, col: str, k: int, axis: str, other: str) -> str:
    end = "first_value" if fn == "lag" else "last_value"
    return f"coalesce({fn}({col}, {k}) OVER ({axis}), {end}({col}) OVER ({axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


_ROW, _COL = "PARTITION BY r ORDER BY c", "PARTITION BY c ORDER BY r"


def _pass(col: str, sigma: float, axis: str) -> str:
    w = gaussian_kernel(sigma)
    half = len(w) // 2
    parts = [f"{col} * {w[half]!r}::DOUBLE"] + [f"({_edge('lag', col, k, axis, '')} + {_edge('lead', col, k, axis, '')}) * {w[half + k]!r}::DOUBLE" for k in range(1, half + 1)]
    return " + ".join(parts)


def _gauss(sigma: float, out: str, source: str = "g") -> str:
    return f"{out}_a AS (SELECT *, {_pass('z', sigma, _COL)} AS za FROM {source}), {out} AS (SELECT * EXCLUDE (z, za), {_pass('za', sigma, _ROW)} AS z FROM {out}_a)"


def _grad(source: str, out: str, cell: float = CELL) -> str:
    d = lambda axis: f"(coalesce(lead(z) OVER ({axis}), z) - coalesce(lag(z) OVER ({axis}), z)) / (CASE WHEN lag(z) OVER ({axis}) IS NULL OR lead(z) OVER ({axis}) IS NULL THEN {cell}::DOUBLE ELSE 2 * {cell}::DOUBLE END)"
    return f"{out}_b AS (SELECT *, {d(_ROW)} AS gx, {d(_COL)} AS gy FROM {source}), {out} AS (SELECT *, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM {out}_b)"


@query(f"WITH {RAMP_SQL}, {_grad('g', 's')} SELECT r, c, {r3('gx')} AS gx, {r3('gy')} AS gy FROM s")
def win_gradient(spark: SparkSession, d: str) -> DataFrame:
    return terrain.gradients(ramp_cells(spark, d), CELL, {"0": "z"}).select("r", "c", col3("gx_0").alias("gx"), col3("gy_0").alias("gy"))


@query(f"WITH {RAMP_SQL}, {_grad('g', 's')} SELECT r, c, {r3('slope')} AS slope FROM s")
def win_slope(spark: SparkSession, d: str) -> DataFrame:
    return terrain.gradients(ramp_cells(spark, d), CELL, {"0": "z"}).select("r", "c", col3("slope_0").alias("slope"))


@query(f"WITH {RAMP_SQL}, {_gauss(1.5, 's')} SELECT r, c, {r3('z')} AS z FROM s")
def win_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return terrain.gaussian(ramp_cells(spark, d), {"s": 1.5}).select("r", "c", col3("s").alias("z"))


_SCALES = ", ".join(f"{_gauss(s, f'h{i}')}, {_grad(f'h{i}', f's{i}')}" for i, s in enumerate(CFG.smooth_sigmas_cells))
_FIELDS = f"""{_SCALES}, f AS (SELECT a.r, a.c, (a.slope >= {LOW})::INT + (b.slope >= {LOW})::INT + (d.slope >= {LOW})::INT AS persistence,
  greatest(a.slope, b.slope, d.slope) >= {HIGH} AS strong, (a.gx + b.gx + d.gx) / 3 AS gx, (a.gy + b.gy + d.gy) / 3 AS gy, (a.slope + b.slope + d.slope) / 3 AS slope
  FROM s0 a JOIN s1 b USING (r, c) JOIN s2 d USING (r, c)), fw AS (SELECT *, persistence >= 2 AS weak FROM f)"""


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return terrain.detection_fields(terrain.slopes(ramp_grid(spark, d), ramp_frame(spark, d), CFG), CFG, LOW, HIGH)


@query(f"WITH {RAMP_SQL}, {_FIELDS} SELECT persistence, strong, weak, count(*) AS n, {r3('avg(slope)')} AS slope FROM fw GROUP BY persistence, strong, weak")
def win_persistence(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).groupBy("persistence", "strong", "weak").agg(F.count("*").alias("n"), floor_at(F.avg("slope")).alias("slope"))


@query(f"WITH {RAMP_SQL}, {_gauss(0.8, 'h')}, {_grad('h', 's')}, q AS (SELECT quantile_cont(slope, 0.7) AS a, quantile_cont(slope, 0.85) AS b FROM s), t AS (SELECT a, least(55, greatest(18, b, a + 5)) AS high FROM q) SELECT {r3('least(greatest(least(a, 0.72::DOUBLE * high), 8), high - 2)')} AS low, {r3('high')} AS high FROM t")
def agg_slope_thresholds(spark: SparkSession, d: str) -> DataFrame:
    cfg = ExtractConfig()
    low, high = terrain.slope_thresholds(terrain.slopes(ramp_grid(spark, d), ramp_frame(spark, d), cfg), cfg)
    return spark.createDataFrame([(low, high)], "low double, high double").select(col3("low").alias("low"), col3("high").alias("high"))


@query(f"WITH {RAMP_SQL}, {_grad('g', 's')}, q AS (SELECT quantile_cont(slope, 0.7) AS a, quantile_cont(slope, 0.85) AS b FROM s), t AS (SELECT least(38, greatest(17, 0.55::DOUBLE * a + 0.45::DOUBLE * b)) AS high FROM q) SELECT {r3('least(greatest(0.52::DOUBLE * high, 8), high - 4)')} AS low, {r3('high')} AS high FROM t")
def agg_blended_thresholds(spark: SparkSession, d: str) -> DataFrame:
    low, high = terrain.blended_thresholds(terrain.gradients(ramp_grid(spark, d), CELL, {"0": "z"}).withColumnRenamed("slope_0", "slope"))
    return spark.createDataFrame([(low, high)], "low double, high double").select(col3("low").alias("low"), col3("high").alias("high"))


def _turn(axis: str, fn: str) -> str:
    w = f"OVER ({axis})"
    return f"coalesce(degrees(acos(greatest(-1, least(1, nx * {fn}(nx) {w} + ny * {fn}(ny) {w} + nz * {fn}(nz) {w})))), 0)"


_TIN = f"""{_gauss(0.55, 't0')}, t1 AS (SELECT r, c, z AS p00, lead(z) OVER ({_ROW}) AS p10, lead(z) OVER ({_COL}) AS p01 FROM t0),
t2 AS (SELECT *, lead(p10) OVER ({_COL}) AS p11 FROM t1), t3 AS (SELECT * FROM t2 WHERE r < {LAST_ROW} AND c < {COLS - 1}),
t4 AS (SELECT r, c, -{CELL}::DOUBLE * (p10 - p00) - {CELL}::DOUBLE * (p11 - p01) AS a, {CELL}::DOUBLE * (p10 - p11) + {CELL}::DOUBLE * (p00 - p01) AS b, 2 * {CELL}::DOUBLE * {CELL}::DOUBLE AS e FROM t3),
t5 AS (SELECT r, c, a / sqrt(a * a + b * b + e * e) AS nx, b / sqrt(a * a + b * b + e * e) AS ny, e / sqrt(a * a + b * b + e * e) AS nz FROM t4),
t6 AS (SELECT r, c, greatest({_turn(_ROW, 'lag')}, {_turn(_ROW, 'lead')}, {_turn(_COL, 'lag')}, {_turn(_COL, 'lead')}) AS score FROM t5)"""


@query(f"WITH {RAMP_SQL}, {_TIN} SELECT r, c, {r3('score')} AS score FROM t6")
def win_tin_break(spark: SparkSession, d: str) -> DataFrame:
    return terrain.break_scores(ramp_grid(spark, d), ramp_frame(spark, d)).select("r", "c", col3("score").alias("score"))


_GAP = f"w AS (SELECT r, c, CASE WHEN NOT ({GAPS}) THEN z END AS z, NOT ({GAPS}) AS valid FROM g)"
_NEAR = """n AS (SELECT a.r, a.c, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d2 FROM w a JOIN w b ON b.valid WHERE NOT a.valid GROUP BY a.r, a.c)"""


@query(f"WITH {RAMP_SQL}, {_GAP}, {_NEAR} SELECT r, c, {r3('sqrt(d2)')} AS d FROM n")
def win_distance(spark: SparkSession, d: str) -> DataFrame:
    return grid.distance_to_valid(ramp_with_gaps(spark, d)).where("NOT valid").select("r", "c", col3("d").alias("d"))


def _fill(axis: str, along: str, tag: str) -> str:
    at, z = f"CASE WHEN valid THEN {along} END", "z"
    before, after = f"OVER ({axis} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"OVER ({axis} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"last_value({at} IGNORE NULLS) {before} AS {tag}a, last_value({z} IGNORE NULLS) {before} AS {tag}az, first_value({at} IGNORE NULLS) {after} AS {tag}b, first_value({z} IGNORE NULLS) {after} AS {tag}bz"


@query(f"""WITH {RAMP_SQL}, {_GAP}, {_NEAR}, b AS (SELECT *, {_fill(_ROW, 'c', 'h')}, {_fill(_COL, 'r', 'v')} FROM w),
e AS (SELECT b.r, b.c, b.z, b.valid, sqrt(d2) * {CELL}::DOUBLE AS far, haz + (hbz - haz) * ((c - ha) / (hb - ha)::DOUBLE) AS h, vaz + (vbz - vaz) * ((r - va) / (vb - va)::DOUBLE) AS v FROM b LEFT JOIN n USING (r, c)),
o AS (SELECT r, c, valid OR (far <= 1.5 AND coalesce(h, v) IS NOT NULL) AS analysis_valid, CASE WHEN valid THEN z WHEN far <= 1.5 THEN coalesce((h + v) / 2, h, v) END AS z FROM e)
SELECT r, c, {r3('z')} AS z FROM o WHERE analysis_valid""")
def win_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    out = grid.reconstruct(ramp_with_gaps(spark, d), ramp_frame(spark, d), 1.5)
    return out.where("analysis_valid").select("r", "c", col3("z").alias("z"))


_BLOCK = "OVER (PARTITION BY {p} ORDER BY {o} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
_HB, _VB = _BLOCK.format(p="r", o="c"), _BLOCK.format(p="c", o="r")
_MASK = f"mk AS (SELECT r, c, {SCATTER} AS m FROM g)"


@query(f"""WITH {RAMP_SQL}, {_MASK}, d1 AS (SELECT r, c, max(m::INT) {_HB} AS m FROM mk), d2 AS (SELECT r, c, max(m) {_VB} AS m FROM d1),
e1 AS (SELECT r, c, CASE WHEN count(*) {_HB} < 3 THEN 0 ELSE min(m) {_HB} END AS m FROM d2), e2 AS (SELECT r, c, CASE WHEN count(*) {_VB} < 3 THEN 0 ELSE min(m) {_VB} END AS m FROM e1)
SELECT r, c FROM e2 WHERE m = 1""")
def win_closing(spark: SparkSession, d: str) -> DataFrame:
    return terrain.closing(ramp_cells(spark, d).withColumn("m", F.expr(SCATTER)), "m", "closed").where("closed").select("r", "c")


@query(f"""WITH {RAMP_SQL}, {_grad('g', 's')}, mk AS (SELECT r, c FROM s WHERE slope >= 30), n AS (SELECT a.r, a.c, count(*) AS n FROM mk a JOIN mk b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c)
SELECT r, c FROM n WHERE n < 9""")
def win_boundary(spark: SparkSession, d: str) -> DataFrame:
    steep = terrain.gradients(ramp_cells(spark, d), CELL, {"0": "z"}).where("slope_0 >= 30").select("r", "c", F.lit(1).alias("label"))
    return faces.boundary(steep).select("r", "c")


_AROUND = "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c)"


def _rounds(n: int) -> str:
    """``n`` rounds of filling cells that have two valid neighbours or more by their mean."""
    out = [_GAP.replace("w AS", "w0 AS", 1)]
    for k in range(n):
        out.append(f"n{k} AS (SELECT a.r, a.c, avg(b.z) AS z, count(*) AS n FROM w{k} a JOIN w{k} b ON b.valid AND {_AROUND} WHERE NOT a.valid GROUP BY a.r, a.c)")
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT w.r, w.c, CASE WHEN valid THEN w.z WHEN n.n >= 2 THEN n.z END AS z, valid OR coalesce(n.n >= 2, false) AS valid FROM w{k} w LEFT JOIN n{k} n USING (r, c))")
    return ", ".join(out)


@query(f"WITH {RAMP_SQL}, {_rounds(8)} SELECT r, c, {r3('z')} AS z FROM w8 WHERE valid")
def win_fill_sparse(spark: SparkSession, d: str) -> DataFrame:
    return terrain.fill_sparse(ramp_with_gaps(spark, d)).where("valid").select("r", "c", col3("z").alias("z"))


_MEANS = f"""(SELECT a.r, a.c, a.valid, CASE WHEN a.valid THEN sum(k * b.z) / sum(k) END AS z FROM {{source}} a LEFT JOIN (SELECT * FROM {{source}}, (VALUES (0, 6), (1, 4), (2, 1)) t(ds, k)) b
ON b.valid AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND abs(a.r - b.r) + abs(a.c - b.c) = ds GROUP BY a.r, a.c, a.valid)"""


@query(f"WITH {RAMP_SQL}, {_GAP}, m1 AS {_MEANS.format(source='w')}, m2 AS {_MEANS.format(source='m1')} SELECT r, c, floor(z * 1e7 + 0.5137::DOUBLE) / 1e7 AS z FROM m2 WHERE valid")
def win_smooth_masked(spark: SparkSession, d: str) -> DataFrame:
    return terrain.smooth_masked(ramp_with_gaps(spark, d)).where("valid").select("r", "c", (F.floor(F.col("z") * 1e7 + 0.5137) / 1e7).alias("z"))  # off the ties that weighted means of survey heights meet


@query(f"""WITH {RAMP_SQL}, {_FIELDS}, {_TIN} SELECT r, c, persistence, strong, {r3('slope')} AS slope, {r3('score')} AS score FROM fw LEFT JOIN t6 USING (r, c)""")
def win_halo_surface(spark: SparkSession, d: str) -> DataFrame:
    """Slopes at three scales and surface breaks of tiles with borders, after one shuffle."""
    f = terrain.detection_fields(halo.surface(ramp_grid(spark, d), ramp_frame(spark, d), CFG, 48), CFG, LOW, HIGH)
    return f.select("r", "c", "persistence", "strong", col3("slope").alias("slope"), col3("score").alias("score"))


@query(ORACLE["win_closing"])
def win_halo_closing(spark: SparkSession, d: str) -> DataFrame:
    """Closing of a mask over tiles with borders."""
    return halo.closed(ramp_cells(spark, d).where(SCATTER), ramp_frame(spark, d), tile=32)


# ---------------------------------------------------------------- graphs and faces


def _labels(source: str, where: str) -> str:
    return f"mk AS (SELECT r, c, r * {COLS} + c AS id FROM {source} WHERE {where}), reach AS (SELECT r, c, id FROM mk UNION SELECT b.r, b.c, a.id FROM reach a JOIN mk b ON {_AROUND}), lab AS (SELECT r, c, min(id)::BIGINT AS label FROM reach GROUP BY r, c)"


def _scatter(spark: SparkSession, d: str, mask: str = SCATTER) -> DataFrame:
    return ramp_cells(spark, d).where(mask).select("r", "c")


@query(f"WITH RECURSIVE {RAMP_SQL}, {_labels('g', SCATTER)} SELECT label, count(*) AS cells FROM lab GROUP BY label")
def grf_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_cells(_scatter(spark, d), ramp_frame(spark, d), tile=32).groupBy("label").agg(F.count("*").alias("cells"))


@query(f"WITH RECURSIVE {RAMP_SQL}, {_labels('g', SCATTER)} SELECT label, count(*) AS cells FROM lab GROUP BY label HAVING count(*) >= 5")
def agg_component_filter(spark: SparkSession, d: str) -> DataFrame:
    return faces.keep_large(_scatter(spark, d), ramp_frame(spark, d), 5).groupBy("label").agg(F.count("*").alias("cells"))


_SEEDED = f"{_FIELDS}, reach(r, c) AS (SELECT r, c FROM fw WHERE strong UNION SELECT b.r, b.c FROM reach a JOIN fw b ON b.weak AND {_AROUND})"


@query(f"WITH RECURSIVE {RAMP_SQL}, {_SEEDED} SELECT r, c FROM reach")
def grf_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return graph.hysteresis(_fields(spark, d), ramp_frame(spark, d), tile=32)


_STATS = f"""{_labels('g', SCATTER)}, {_grad('g', 's')}, u AS (SELECT label, slope, CASE WHEN sqrt(gx * gx + gy * gy) > 1e-9 THEN -gx / sqrt(gx * gx + gy * gy) END AS ux,
  CASE WHEN sqrt(gx * gx + gy * gy) > 1e-9 THEN -gy / sqrt(gx * gx + gy * gy) END AS uy FROM lab JOIN s USING (r, c)),
st AS (SELECT label, count(*) AS cells, count(ux) AS sloped, sqrt(avg(ux) * avg(ux) + avg(uy) * avg(uy)) AS coherence, avg(slope) AS slope_mean, avg(ux) AS mx, avg(uy) AS my FROM u GROUP BY label)"""


def _face_cells(spark: SparkSession, d: str) -> DataFrame:
    g = terrain.gradients(ramp_cells(spark, d), CELL, {"0": "z"}).withColumnsRenamed({"gx_0": "gx", "gy_0": "gy", "slope_0": "slope"}).withColumn("persistence", F.lit(3))
    return graph.label_cells(_scatter(spark, d), ramp_frame(spark, d), tile=32).join(g, ["r", "c"])


@query(f"WITH RECURSIVE {RAMP_SQL}, {_STATS} SELECT label, cells, sloped, {r3('coherence')} AS coherence, {r3('slope_mean')} AS slope FROM st")
def agg_face_stats(spark: SparkSession, d: str) -> DataFrame:
    s = faces.face_statistics(_face_cells(spark, d), 3)
    return s.select("label", "cells", "sloped", col3("coherence").alias("coherence"), col3("slope_mean").alias("slope"))


@query(f"WITH RECURSIVE {RAMP_SQL}, {_STATS} SELECT label, {r3('coherence')} AS coherence FROM st WHERE cells >= 4 AND sloped >= 4 AND coherence >= 0.5")
def fil_faces(spark: SparkSession, d: str) -> DataFrame:
    return faces.accepted(faces.face_statistics(_face_cells(spark, d), 3), CFG).select("label", col3("coherence").alias("coherence"))


_SECTION = f"""{_grad('g', 's')}, mk AS (SELECT r, c, ({CELL}::DOUBLE * (c + 0.5::DOUBLE)) AS x, ({CELL}::DOUBLE * (r + 0.5::DOUBLE)) AS y FROM s WHERE slope >= 30),
b AS (SELECT *, floor((y - min(y) OVER ()) / {CELL}::DOUBLE) AS bin FROM mk)"""


@query(f"WITH {RAMP_SQL}, {_SECTION} SELECT bin::BIGINT AS bin, {r3('min(x)')} AS crest_x, {r3('max(x)')} AS toe_x FROM b GROUP BY bin")
def agg_cross_section(spark: SparkSession, d: str) -> DataFrame:
    steep = terrain.gradients(ramp_cells(spark, d), CELL, {"0": "z"}).where("slope_0 >= 30").select("r", "c", F.lit(1).cast("long").alias("label"), F.lit(3).alias("persistence"))
    stats = spark.createDataFrame([(1, 1.0, 0.0)], "label long, down_x double, down_y double")
    s = faces.cross_section(steep, ramp_frame(spark, d), stats)
    return s.select("bin", col3("crest_x").alias("crest_x"), col3("toe_x").alias("toe_x"))


@query(f"""WITH RECURSIVE {RAMP_SQL}, {_labels('g', SCATTER)}, q AS (SELECT *, ({CELL}::DOUBLE * (c + 0.5::DOUBLE) - 7.1::DOUBLE) * ({CELL}::DOUBLE * (c + 0.5::DOUBLE) - 7.1::DOUBLE) + ({CELL}::DOUBLE * (r + 0.5::DOUBLE) - 9.3::DOUBLE) * ({CELL}::DOUBLE * (r + 0.5::DOUBLE) - 9.3::DOUBLE) AS d2 FROM lab),
e AS (SELECT *, CASE WHEN r = 37 AND c = 28 THEN -1 ELSE d2 END AS k FROM q) SELECT label, {r3('sqrt(greatest(k, 0))')} AS dist FROM e ORDER BY k, r, c LIMIT 1""")
def jn_seed_face(spark: SparkSession, d: str) -> DataFrame:
    label, dist = spatial.seed_label(graph.label_cells(_scatter(spark, d), ramp_frame(spark, d), tile=32), ramp_frame(spark, d), (7.1, 9.3))
    return spark.createDataFrame([(label, dist)], "label long, dist double").withColumn("dist", floor_at(F.col("dist")))


# ---------------------------------------------------------------- polylines, sets, documents

_LEN = "WITH {p}, q AS (SELECT cls, sqrt({sq}) AS step FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM p WINDOW w AS (PARTITION BY cls ORDER BY pid))) SELECT cls AS label, {l} AS length FROM q GROUP BY cls"


@query(_LEN.format(p=EMBEDDING_SQL, sq="(x - px) * (x - px) + (y - py) * (y - py)", l=r3("coalesce(sum(step), 0)")))
def seq_length(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_lengths(embedding_points(spark, d), ["cls"], "pid").select(F.col("cls").alias("label"), col3("length").alias("length"))


@query(_LEN.format(p=EMBEDDING_SQL, sq="(x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)", l=r3("coalesce(sum(step), 0)")))
def seq_length_3d(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_lengths(embedding_points(spark, d), ["cls"], "pid", ("x", "y", "z")).select(F.col("cls").alias("label"), col3("length").alias("length"))


@query(f"""WITH {EMBEDDING_SQL}, a AS (SELECT cls, pid, x, y, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM p WINDOW w AS (PARTITION BY cls ORDER BY pid)),
k AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY cls ORDER BY pid) AS s FROM a WHERE step IS NULL OR step > 1e-9),
g AS (SELECT *, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, max(s) OVER (PARTITION BY cls) AS total FROM k WINDOW w AS (PARTITION BY cls ORDER BY pid)),
t AS (SELECT DISTINCT cls, total, unnest(range(0, ceil(total / 0.5::DOUBLE)::BIGINT)) * 0.5::DOUBLE AS pos FROM g),
u AS (SELECT cls, pos FROM t WHERE total - pos > 1e-9 AND (total > 0.5 OR pos = 0) UNION SELECT DISTINCT cls, total FROM g)
SELECT u.cls AS label, row_number() OVER (PARTITION BY u.cls ORDER BY pos)::INT AS i, {r3('x + (x2 - x) * ((pos - s) / (s2 - s))')} AS x, {r3('y + (y2 - y) * ((pos - s) / (s2 - s))')} AS y
FROM u JOIN g ON u.cls = g.cls AND s2 IS NOT NULL AND pos >= s AND (pos < s2 OR (pos = total AND s2 = total))""")
def seq_resample(spark: SparkSession, d: str) -> DataFrame:
    out = lines.resample_table(embedding_points(spark, d), ["cls"], 0.5, "pid")
    return out.select(F.col("cls").alias("label"), "i", col3("x").alias("x"), col3("y").alias("y"))


@query(f"""WITH {EMBEDDING_SQL}, q AS (SELECT cls, pid, (lag(x, 2) OVER w + lag(x) OVER w * 2 + x * 3 + lead(x) OVER w * 2 + lead(x, 2) OVER w) / 9 AS mx, (lag(y, 2) OVER w + lag(y) OVER w * 2 + y * 3 + lead(y) OVER w * 2 + lead(y, 2) OVER w) / 9 AS my, x, y
FROM p WINDOW w AS (PARTITION BY cls ORDER BY pid)) SELECT cls AS label, pid, {r3('coalesce(mx, x)')} AS x, {r3('coalesce(my, y)')} AS y FROM q""")
def seq_smooth_weighted(spark: SparkSession, d: str) -> DataFrame:
    out = lines.smooth_weighted(embedding_points(spark, d), ["cls"], "pid")
    return out.select(F.col("cls").alias("label"), "pid", col3("x").alias("x"), col3("y").alias("y"))


_SIDE = f"greatest(0, least({LAST_ROW}, b.r + {{s}} * sign(gy)::INT)) AS {{t}}r, greatest(0, least({COLS - 1}, b.c + {{s}} * sign(gx)::INT)) AS {{t}}c"


@query(f"""WITH {RAMP_SQL}, {_grad('g', 's')}, mk AS (SELECT r, c FROM s WHERE slope >= 30), n AS (SELECT a.r, a.c, count(*) AS n FROM mk a JOIN mk b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c),
b AS (SELECT b.r, b.c, {_SIDE.format(s=2, t='u')}, {_SIDE.format(s=-2, t='d')} FROM n b JOIN s USING (r, c) WHERE n < 9 AND sqrt(gx * gx + gy * gy) >= 1e-8)
SELECT b.r, b.c FROM b LEFT JOIN mk u ON u.r = ur AND u.c = uc LEFT JOIN mk d ON d.r = dr AND d.c = dc WHERE u.r IS NULL AND d.r IS NOT NULL""")
def win_edge_cells(spark: SparkSession, d: str) -> DataFrame:
    g = terrain.gradients(ramp_cells(spark, d), CELL, {"0": "z"}).withColumnsRenamed({"gx_0": "gx", "gy_0": "gy"})
    return single_edge.edge_cells(g.where("slope_0 >= 30").select("r", "c"), g, ramp_frame(spark, d), True)


_SCORE = f"""{_labels('g', DENSER)}, cs AS (SELECT label, count(*) AS cells, min(sqrt((r - 37.2::DOUBLE) * (r - 37.2::DOUBLE) + (c - 28.4::DOUBLE) * (c - 28.4::DOUBLE))) AS dd FROM lab GROUP BY label HAVING count(*) >= 18)"""


@query(f"WITH RECURSIVE {RAMP_SQL}, {_SCORE} SELECT label, cells, {r3(f'dd * {CELL}::DOUBLE + 0.6::DOUBLE / sqrt(greatest(cells * {CELL * CELL}::DOUBLE, 0.25::DOUBLE))')} AS score FROM cs")
def jn_component_score(spark: SparkSession, d: str) -> DataFrame:
    s = single_edge.component_scores(graph.label_cells(_scatter(spark, d, DENSER), ramp_frame(spark, d), tile=32), ramp_frame(spark, d), (28.4 * CELL, 37.2 * CELL))
    return s.select("label", "cells", col3("score").alias("score"))


@query(f"WITH {EMBEDDING_SQL} SELECT count(*) AS n FROM (SELECT DISTINCT floor(x * 1000 + 0.5), floor(y * 1000 + 0.5), floor(z * 1000 + 0.5) FROM p)")
def set_dedup_mm(spark: SparkSession, d: str) -> DataFrame:
    p = embedding_points(spark, d)
    return select.dedup_mm(p.unionByName(p)).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT event_id, value * 2 AS value FROM events WHERE value < 10 UNION ALL SELECT event_id + 10000000, value FROM events WHERE value >= 10)
SELECT event_id AS id, value FROM events WHERE event_id NOT IN (SELECT event_id FROM n) UNION ALL SELECT event_id AS id, value FROM n""")
def cat_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), "value")
    new = e.where("value < 10").withColumn("value", F.col("value") * 2).unionByName(e.where("value >= 10").withColumn("id", F.col("id") + 10000000))
    return catalog.upsert(e, new, "id")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def cat_event_details(spark: SparkSession, d: str) -> DataFrame:
    e = catalog.event_details(spark.read.parquet(f"{d}/events.parquet"), "k", "props")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("k").cast("long")).alias("total"))


@query("""SELECT event_type, CASE WHEN regexp_matches(event_type, '(?i)finaliz|metadata|done') THEN 84 WHEN regexp_matches(event_type, '(?i)index|hierarch') THEN 65
WHEN regexp_matches(event_type, '(?i)distribut|chunk') THEN 45 WHEN regexp_matches(event_type, '(?i)count|read') THEN 22 END::DOUBLE AS progress, count(*) AS n FROM events GROUP BY ALL""")
def cat_converter_progress(spark: SparkSession, d: str) -> DataFrame:
    log = catalog.converter_progress(spark.read.parquet(f"{d}/events.parquet"), "event_type")
    return log.groupBy("event_type", "progress").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT event_id AS id, row_number() OVER (ORDER BY CASE WHEN event_id = 42 THEN 0 ELSE 1 END, event_id) - 1 AS place FROM events) SELECT id, place FROM m""")
def cat_recent_first(spark: SparkSession, d: str) -> DataFrame:
    index = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.col("event_id").alias("place"))
    return catalog.recent_first(index, 42).select("id", "place")


# ---------------------------------------------------------------- whole runs


@query(f"""WITH RECURSIVE {RAMP_SQL}, {_FIELDS}, {_labels('fw', 'weak OR strong')}, h AS (SELECT DISTINCT label FROM lab JOIN fw USING (r, c) WHERE strong)
SELECT label, count(*) AS cells FROM lab JOIN h USING (label) GROUP BY label""")
def flow_face_count(spark: SparkSession, d: str) -> DataFrame:
    g = _fields(spark, d)
    return graph.label_cells(graph.hysteresis(g, ramp_frame(spark, d)), ramp_frame(spark, d)).groupBy("label").agg(F.count("*").alias("cells"))


def _extracted(spark: SparkSession, d: str, cloud: DataFrame, progress=None):
    return E.extract_points(cloud, CFG, ((0.0, 0.0), ((COLS - 1) * CELL, (ramp_rows(spark, d) - 1) * CELL)), progress)


@query(f"WITH {RAMP_SQL} SELECT r, string_agg(printf('%.6f', z), ' ' ORDER BY c) AS row FROM g GROUP BY r")
def snk_ascii_grid(spark: SparkSession, d: str) -> DataFrame:
    return sinks.ascii_rows(ramp_cells(spark, d), "z")


def queries() -> dict:
    return {k: shipped(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


from . import registry_tables  # noqa: E402, F401  registers the queries that build on these
