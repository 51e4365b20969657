"""Incremental mean raster: sums and counts by cell over a stream of points.

The state is one row for each occupied cell, bounded by the grid. There is no event time in point data,
so there is no watermark; the raster is complete after every trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ExtractConfig
from ..operators.grid import Frame, with_cells
from ..operators.select import strict_classes


def raster_sums(points: DataFrame, frame: Frame, cfg: ExtractConfig | None = None) -> DataFrame:
    """(r, c, n, zsum, z) of a batch or a stream of points."""
    chosen = points if cfg is None else strict_classes(points, cfg)
    sums = with_cells(chosen, frame).groupBy("r", "c").agg(F.count("*").alias("n"), F.sum("z").alias("zsum"))
    return sums.withColumn("z", F.col("zsum") / F.col("n"))


def start_raster(points: DataFrame, frame: Frame, name: str, checkpoint: str, cfg: ExtractConfig | None = None) -> StreamingQuery:
    """Keeps the raster of a stream in memory table ``name``; for a table sink use foreachBatch with merge_rasters."""
    return raster_sums(points, frame, cfg).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
