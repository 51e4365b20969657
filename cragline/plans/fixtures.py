"""Point clouds and lattices made from the driver's tables, the same in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Frame
from ..shared import materialize

ROWS, COLS, CELL = 80, 120, 0.25
ROWS_OF = 60_000  #: rows of lineitem that each ROWS rows of the lattice stand for
#: Cells of the lattice without points: three columns, a window, and scattered single cells.
GAPS = "c BETWEEN 12 AND 14 OR (r BETWEEN 40 AND 60 AND c BETWEEN 80 AND 100) OR (r % 9 = 4 AND c % 17 = 5)"
POINT_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "z"]

LINEITEM_SQL = """p AS (SELECT *, l_partkey::DOUBLE AS x, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE AS y,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_linenumber AS cls FROM lineitem)"""
EMBEDDING_SQL = "p AS (SELECT vec_id AS pid, label AS cls, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
#: The surveyed ramp: a design surface, and in each cell the mean deviation of the lineitem rows that fall in it. A cell without rows is as designed.
RAMP_SQL = f"""surveyed AS (SELECT (greatest(1, ceil(count(*) / {ROWS_OF}.0)) * {ROWS})::BIGINT AS nrows FROM lineitem),
hits AS (SELECT (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % (nrows * {COLS}) AS i, sum(CAST(round(l_extendedprice * 100) AS BIGINT) % 1000)::BIGINT AS dev, count(*) AS hits FROM lineitem, surveyed GROUP BY 1),
g0 AS MATERIALIZED (SELECT (i // {COLS})::INT AS r, (i % {COLS})::INT AS c, coalesce(floor((dev / hits::DOUBLE / 1000::DOUBLE - 0.5::DOUBLE) * 20000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE, 0) AS off FROM (SELECT unnest(range(nrows * {COLS})) AS i FROM surveyed) LEFT JOIN hits USING (i)),
g AS MATERIALIZED (SELECT r, c, CASE WHEN {CELL}::DOUBLE * c <= 10 THEN 10::DOUBLE WHEN {CELL}::DOUBLE * c >= 15 THEN 5::DOUBLE ELSE 20::DOUBLE - {CELL}::DOUBLE * c END + off AS z FROM g0)"""
LAST_ROW = "(SELECT max(r) FROM g0)"


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x = part, y = days since 1992, z and cents = price in cents, cls = line number."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return li.withColumns({"x": F.col("l_partkey").cast("double"), "y": days, "cents": cents, "z": cents.cast("double"), "cls": F.col("l_linenumber")})


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components as x, y, z; the label as class."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("pid"), F.col("label").alias("cls"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))


def ramp_rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the lattice, which grow with lineitem."""
    return max(1, -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // ROWS_OF)) * ROWS


def ramp_frame(spark: SparkSession, sf_dir: str) -> Frame:
    return Frame(0.0, 0.0, CELL, COLS, ramp_rows(spark, sf_dir))


def ramp_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, z): a bench, a 45-degree face between x = 10 and 15, a lower bench, as surveyed by the rows of lineitem."""
    cells = ramp_rows(spark, sf_dir) * COLS
    key = F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    seen = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((key % cells).alias("id")).agg(F.sum(cents % 1000).alias("dev"), F.count("*").alias("hits"))
    off = F.coalesce(F.floor((F.col("dev") / F.col("hits") / F.lit(1000.0) - 0.5) * 20000.0 + 0.5) / 1000000.0, F.lit(0.0))
    x = F.col("c") * CELL
    z = F.when(x <= 10, 10.0).when(x >= 15, 5.0).otherwise(F.lit(20.0) - x) + F.col("off")
    lattice = spark.range(cells).join(seen, "id", "left").select(F.expr(f"int(id div {COLS})").alias("r"), F.expr(f"int(id % {COLS})").alias("c"), off.alias("off"))
    return lattice.select("r", "c", z.alias("z"))


def ramp_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice as a grid without gaps."""
    return ramp_cells(spark, sf_dir).withColumns({"valid": F.lit(True), "analysis_valid": F.lit(True), "support_m": F.lit(0.0)})


def ramp_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.expr(GAPS)
    return ramp_cells(spark, sf_dir).select("r", "c", F.when(~gap, F.col("z")).alias("z"), (~gap).alias("valid"))


def ramp_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice as points of class 2."""
    return ramp_cells(spark, sf_dir).select((F.col("r") * COLS + F.col("c")).cast("long").alias("pid"), (F.col("c") * CELL).alias("x"), (F.col("r") * CELL).alias("y"), "z", F.lit(2).alias("cls"))


def ramp_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice as a written cloud, for runs that read their points several times."""
    return materialize(ramp_points(spark, sf_dir), "cloud")
