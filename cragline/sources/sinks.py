"""Writers of lines, grids and the report. Lines stream through the driver, a partition at a time; grids go to Parquet, small ones to ASCII too."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Frame

ASCII_CELLS = 1_500_000
#: Names that readers of these files expect.
LAYERS = {"CREST": "CRISTA", "TOE": "PE"}
CSV_HEADER = "line_id,face_id,type,vertex,x,y,z,confidence,rmse"
CRS_MEMBER = "crs_wkt"


def feature(line: dict) -> dict:
    props = {k: v for k, v in line.items() if k not in ("vertices", "label")}
    return {"type": "Feature", "properties": props, "geometry": {"type": "LineString", "coordinates": [[v["x"], v["y"], v["z"]] for v in line["vertices"]]}}


def geojson(lines: list[dict], crs_wkt: str | None = None) -> dict:
    out = {"type": "FeatureCollection", "features": [feature(x) for x in lines]}
    return out | ({CRS_MEMBER: crs_wkt} if crs_wkt else {})


def geojson_features(lines: DataFrame) -> DataFrame:
    """(line_id, feature): each line as a GeoJSON feature, made in the JVM."""
    props = F.struct(*(c for c in lines.columns if c not in ("vertices", "label")))
    coordinates = F.transform("vertices", lambda v: F.array(v["x"], v["y"], v["z"]))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    return lines.select("line_id", F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))).alias("feature"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, face_id, type, length_m, slope_mean_deg, confidence, coordinates) of lines with at least two vertices."""
    props = "struct<line_id:int,face_id:int,type:string,length_m:double,slope_mean_deg:double,confidence:double,scale_persistence:double,gradient_coherence:double>"
    schema = f"features array<struct<properties:{props},geometry:struct<coordinates:array<array<double>>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", F.col("f.geometry.coordinates").alias("coordinates")).where(F.size("coordinates") >= 2)


def vertex_text(lines: DataFrame) -> DataFrame:
    """(line_id, vertex, row): the vertex table as text rows; an unknown rmse prints as nan."""
    v = lines.select("line_id", "face_id", "type", "confidence", F.explode("vertices").alias("v"))
    number = lambda c: F.format_string("%.4f", c)
    rmse = F.when(F.col("v.rmse").isNull(), F.lit("nan")).otherwise(number(F.col("v.rmse")))
    cells = [F.col(c).cast("string") for c in ("line_id", "face_id", "type")] + [F.col("v.vertex").cast("string"), number(F.col("v.x")), number(F.col("v.y")), number(F.col("v.z")), number(F.col("confidence")), rmse]
    return v.select("line_id", F.col("v.vertex").alias("vertex"), F.concat_ws(",", *cells).alias("row"))


def _drawing_head() -> list:
    out: list = [0, "SECTION", 2, "HEADER", 9, "$ACADVER", 1, "AC1009", 0, "ENDSEC", 0, "SECTION", 2, "TABLES", 0, "TABLE", 2, "LAYER", 70, len(LAYERS)]
    for i, name in enumerate(LAYERS.values(), 1):
        out += [0, "LAYER", 2, name, 70, 0, 62, i, 6, "CONTINUOUS"]
    return [*out, 0, "ENDTAB", 0, "ENDSEC", 0, "SECTION", 2, "ENTITIES"]


def _drawn(line: dict) -> list:
    layer = LAYERS["CREST" if line["type"] == "CREST" else "TOE"]
    out: list = [0, "POLYLINE", 8, layer, 66, 1, 70, 8, 10, 0.0, 20, 0.0, 30, 0.0]
    for v in line["vertices"]:
        out += [0, "VERTEX", 8, layer, 70, 32, 10, v["x"], 20, v["y"], 30, v["z"]]
    return [*out, 0, "SEQEND", 8, layer]


def dxf(lines: list[dict]) -> str:
    """ASCII drawing of 3D polylines on the crest and toe layers."""
    body = [x for line in lines for x in _drawn(line)]
    return "\n".join(map(str, [*_drawing_head(), *body, 0, "ENDSEC", 0, "EOF"])) + "\n"


def write_lines(output: Path, lines: DataFrame, crs_wkt: str | None = None) -> None:
    """GeoJSON, vertex table and drawing, written line by line as lines come in from the executors, a partition at a time."""
    ordered = lines.orderBy("line_id")
    with open(output / "breaklines.geojson", "w", encoding="utf-8") as geo, open(output / "vertices.csv", "w", encoding="utf-8") as csv, open(output / "breaklines.dxf", "w", encoding="utf-8") as cad:
        geo.write('{"type": "FeatureCollection", "features": [')
        csv.write(CSV_HEADER + "\n")
        cad.write("\n".join(map(str, _drawing_head())) + "\n")
        for k, row in enumerate(ordered.toLocalIterator()):
            line = row.asDict(recursive=True)
            geo.write(("," if k else "") + "\n" + json.dumps(plain(feature(line)), ensure_ascii=False))
            cad.write("\n".join(map(str, _drawn(line))) + "\n")
            csv.writelines(_vertex_row(line, v) + "\n" for v in line["vertices"])
        geo.write("\n]" + (f', "{CRS_MEMBER}": {json.dumps(crs_wkt, ensure_ascii=False)}' if crs_wkt else "") + "}\n")
        cad.write("0\nENDSEC\n0\nEOF\n")


def _vertex_row(line: dict, v: dict) -> str:
    rmse = "nan" if v["rmse"] is None else f"{v['rmse']:.4f}"
    return f"{line['line_id']},{line['face_id']},{line['type']},{v['vertex']},{v['x']:.4f},{v['y']:.4f},{v['z']:.4f},{line['confidence']:.4f},{rmse}"


def ascii_rows(grid: DataFrame, value: str, nodata: float = -9999.0) -> DataFrame:
    """(r, row): each grid row as text, cells in order of columns."""
    v = F.col(value).cast("double")
    text = F.format_string("%.6f", F.when(v.isNull() | F.isnan(v), nodata).otherwise(v))
    cells = F.sort_array(F.collect_list(F.struct("c", text.alias("t"))))
    return grid.groupBy("r").agg(F.concat_ws(" ", F.transform(cells, lambda x: x["t"])).alias("row"))


def write_ascii_grid(path: Path, grid: DataFrame, value: str, frame: Frame, nodata: float = -9999.0) -> None:
    """ESRI ASCII grid, northernmost row first; for grids within ASCII_CELLS."""
    rows = [r["row"] for r in ascii_rows(grid, value, nodata).orderBy(F.desc("r")).collect()]
    head = [f"ncols {frame.nx}", f"nrows {frame.ny}", f"xllcorner {frame.x0}", f"yllcorner {frame.y0}", f"cellsize {frame.cell}", f"NODATA_value {nodata:g}"]
    path.write_text("\n".join(head + rows) + "\n", encoding="utf-8")


def plain(x):
    """JSON-ready copy: rows as dicts, numbers that are not finite as null."""
    if hasattr(x, "asDict"):
        x = x.asDict(recursive=True)
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def write_json(path: Path, value) -> None:
    """Written beside and renamed, so readers never see half a file."""
    beside = path.with_suffix(path.suffix + ".part")
    beside.write_text(json.dumps(plain(value), ensure_ascii=False, indent=2), encoding="utf-8")
    beside.replace(path)
