"""Reading and writing uncompressed LAS point files, as a Spark data source named ``las``.

Each partition reads a range of records; only x, y, z and class leave it. A cloud is one file, or a folder of files that tasks
wrote, with their order, counts and bounds in PARTS; its records count through. A path with a scheme (hdfs, s3, gs, file) is opened
through Arrow's file systems, so executors read the same store as the driver; any other is a local path. Compressed LAZ
needs a decoder that is not here, so it is refused with a clear error.
"""

from __future__ import annotations

import json
import struct
import uuid
from dataclasses import dataclass, replace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_POINTS = 1_000_000
#: Record bytes of the point formats, and where their class byte lies.
RECORD_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
CLASS_AT = {k: (15 if k < 6 else 16) for k in RECORD_BYTES}
PARTS = "parts.json"
SCHEMA = "pid long, x double, y double, z double, cls int"


@dataclass(frozen=True)
class LasHeader:
    path: str
    version: str
    point_format: int
    record_bytes: int
    data_at: int
    point_count: int
    scales: tuple[float, float, float]
    offsets: tuple[float, float, float]
    mins: tuple[float, float, float]
    maxs: tuple[float, float, float]
    crs_wkt: str | None

    @property
    def has_classification(self) -> bool:
        return self.point_format in CLASS_AT


def opened(path: str, write: bool = False):
    """The file at a path or URI, as an Arrow stream that can be read from any place."""
    files, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if write:
        files.create_dir(inner.rpartition("/")[0] or ".", recursive=True)
    return files.open_output_stream(inner) if write else files.open_input_file(inner)


def is_folder(path: str) -> bool:
    files, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return files.get_file_info(inner).type == fs.FileType.Directory


def _parts(path: str) -> list[dict]:
    """What ``write_las_parts`` noted of each file of a folder, in order of their records."""
    with opened(f"{path}/{PARTS}") as f:
        return json.loads(f.read())


def read_header(path: str) -> LasHeader:
    """The header of a LAS file, and its coordinate system if a record holds it as text. Of a folder, that of its first file with
    the count and bounds of all."""
    if not path.lower().endswith((".las", ".laz")):
        raise ValueError(f"not a LAS or LAZ file: {path}")
    if is_folder(path):
        parts = _parts(path)
        full = [p for p in parts if p["count"]] or parts
        mins, maxs = (tuple(f(v) for v in zip(*(p[k] for p in full), strict=True)) for k, f in (("mins", min), ("maxs", max)))
        return replace(read_header(f"{path}/{parts[0]['name']}"), path=path, point_count=sum(p["count"] for p in parts), mins=mins, maxs=maxs)
    with opened(path) as f:
        head = f.read(375)
        if len(head) < 227 or head[:4] != b"LASF":
            raise ValueError(f"not a LAS file: {path}")
        major, minor = head[24], head[25]
        header_size, data_at, records, fmt, size, legacy = struct.unpack_from("<HIIBHI", head, 94)
        if fmt & 0x80 or path.lower().endswith(".laz"):
            raise ValueError(f"compressed point data (LAZ, COPC) needs a decoder that is not available: {path}")
        nums = struct.unpack_from("<12d", head, 131)
        count = struct.unpack_from("<Q", head, 247)[0] if (major, minor) >= (1, 4) and len(head) >= 255 else legacy
        box = nums[6:]  # max x, min x, max y, min y, max z, min z
        wkt, at = None, header_size
        for _ in range(records):
            f.seek(at)
            _, user, kind, length, _ = struct.unpack("<H16sHH32s", f.read(54))
            if user.rstrip(b"\0") == b"LASF_Projection" and kind == 2112:
                wkt = f.read(length).rstrip(b"\0").decode("utf-8", "replace") or None
            at += 54 + length
    return LasHeader(path, f"{major}.{minor}", fmt, size, data_at, count or legacy, nums[:3], nums[3:6], box[1::2], box[0::2], wkt)


def decode(raw: bytes, header: LasHeader) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, z and class of whole records."""
    b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, header.record_bytes)
    ints = np.ascontiguousarray(b[:, :12]).view("<i4")
    x, y, z = (ints[:, k] * header.scales[k] + header.offsets[k] for k in range(3))
    cls = b[:, CLASS_AT.get(header.point_format, 15)].astype(np.int32)
    return x, y, z, cls & 31 if header.point_format < 6 else cls


class _Range(InputPartition):
    """Records as (file, first record there, count, first pid)."""

    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces


def _ranges(path: str, spans) -> list[_Range]:
    """Spans (start, count) of a cloud's records, each with the files that hold it."""
    files = [(f"{path}/{p['name']}", p["count"]) for p in _parts(path)] if is_folder(path) else [(path, read_header(path).point_count)]
    firsts = [0, *accumulate(n for _, n in files)]
    out = []
    for start, count in spans(firsts[-1]):
        k, pieces = max(0, int(np.searchsorted(firsts, start, side="right")) - 1), []
        while k < len(files) and firsts[k] < start + count:
            low, high = max(start, firsts[k]), min(start + count, firsts[k + 1])
            if high > low:
                pieces.append((files[k][0], low - firsts[k], high - low, low))
            k += 1
        out.append(_Range(pieces))
    return out or [_Range([])]


def _may_hold(stats: dict, box: dict, classes: list[int] | None) -> bool:
    """Whether a range of records with these bounds and classes can hold a row of the box and classes."""
    if classes is not None and not set(classes) & set(stats["classes"]):
        return False
    return all(stats[f"{axis}max"] >= lo and stats[f"{axis}min"] <= hi for axis, (lo, hi) in box.items())


class LasReader(DataSourceReader):
    """Ranges of records as partitions."""

    def __init__(self, path: str, points: int):
        self.path, self.points = path, points

    def partitions(self):
        return _ranges(self.path, lambda n: [(s, min(self.points, n - s)) for s in range(0, n, self.points)])

    def read(self, partition):
        step = 65_536
        for path, start, count, pid0 in partition.pieces:
            header = read_header(path)
            with opened(path) as f:
                f.seek(header.data_at + start * header.record_bytes)
                for at in range(0, count, step):
                    raw = f.read(min(step, count - at) * header.record_bytes)
                    raw = raw[: len(raw) // header.record_bytes * header.record_bytes]
                    x, y, z, cls = decode(raw, header)
                    pid = np.arange(len(x), dtype=np.int64) + pid0 + at
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (pid, x, y, z, cls)], names=["pid", "x", "y", "z", "cls"])


class PrunedLasReader(LasReader):
    """Only ranges that, by their statistics, can hold a row of a box and classes."""

    def __init__(self, path: str, points: int, statistics: str, box: dict, classes: list[int] | None):
        super().__init__(path, points)
        self.statistics, self.box, self.classes = statistics, box, classes

    def partitions(self):
        with opened(self.statistics) as f:
            ranges = json.loads(f.read())
        return _ranges(self.path, lambda _: [(r["start"], r["count"]) for r in ranges if _may_hold(r, self.box, self.classes)])


class LasDataSource(DataSource):
    """``spark.read.format("las").load(path)``; option ``points``: records of a partition. ``statistics`` (file of
    ``write_statistics``), ``box`` and ``classes`` (JSON) leave out ranges of records."""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        path, points, statistics = self.options["path"], int(self.options.get("points", RANGE_POINTS)), self.options.get("statistics")
        if not statistics:
            return LasReader(path, points)
        return PrunedLasReader(path, points, statistics, json.loads(self.options.get("box", "{}")), json.loads(self.options.get("classes", "null")))


def read_las(spark: SparkSession, path: str, points: int = RANGE_POINTS) -> DataFrame:
    spark.dataSource.register(LasDataSource)
    return spark.read.format("las").option("points", points).load(path)


def read_las_in(spark: SparkSession, path: str, statistics: str, box: dict[str, tuple[float, float]], classes: list[int] | None = None) -> DataFrame:
    """Points within ``box`` (of any of x, y and z: least and greatest, both included) and of ``classes``; ranges of records that, by
    ``statistics``, hold none of them are not read.

    The box is given to the source as an option, not by Spark's filter push-down, which in 4.1 keeps the filters of one query in the
    source object and leaves out their ranges from later queries on the same DataFrame that push none.
    """
    spark.dataSource.register(LasDataSource)
    reader = spark.read.format("las").option("statistics", statistics).option("box", json.dumps(box)).option("classes", json.dumps(classes))
    rows = reader.load(path)
    for axis, (lo, hi) in box.items():
        rows = rows.where(F.col(axis).between(float(lo), float(hi)))
    return rows if classes is None else rows.where(F.col("cls").isin([int(c) for c in classes]))


def write_statistics(spark: SparkSession, path: str, target: str, points: int = RANGE_POINTS) -> int:
    """Writes bounds and classes of each range of ``points`` records to ``target``, for ``read_las_in``; returns the number of ranges.

    A range is one row of a few numbers (its classes are at most 256), a million records or so each. Tasks read about RANGE_POINTS
    records, several ranges if these are short.
    """
    at = F.expr(f"pid div {int(points)}").alias("k")
    found = read_las(spark, path, -(-RANGE_POINTS // points) * points).groupBy(at).agg(
        F.count("*").alias("count"), F.sort_array(F.collect_set("cls")).alias("classes"), *(f(c).alias(f"{c}{s}") for c in "xyz" for f, s in ((F.min, "min"), (F.max, "max")))
    )
    rows = [r.asDict() for r in found.orderBy("k").collect()]
    with opened(target, write=True) as f:
        f.write(json.dumps([{"start": r.pop("k") * points, **r} for r in rows]).encode())
    return len(rows)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row: the header as a record."""
    h = read_header(path)
    names = "path string, version string, point_format int, point_count long, scales array<double>, offsets array<double>, mins array<double>, maxs array<double>, crs_wkt string"
    return spark.createDataFrame([(h.path, h.version, h.point_format, h.point_count, list(h.scales), list(h.offsets), list(h.mins), list(h.maxs), h.crs_wkt)], names)


def write_las(path: str, x, y, z, cls, scale: float = 0.001, point_format: int = 3, offsets: list[float] | None = None) -> dict:
    """A LAS 1.2 file of formats 0 to 3, for tests, small exports and the parts of large ones. Returns its count and bounds."""
    x, y, z = (np.asarray(v, dtype=float) for v in (x, y, z))
    n, size = len(x), RECORD_BYTES[point_format]
    offsets = offsets or [float(np.floor(v.min())) if n else 0.0 for v in (x, y, z)]
    body = np.zeros((n, size), dtype=np.uint8)
    ints = np.column_stack([np.rint((v - o) / scale) for v, o in zip((x, y, z), offsets, strict=True)]).astype("<i4")
    body[:, :12] = ints.view(np.uint8).reshape(n, 12)
    body[:, 15] = np.asarray(cls, dtype=np.uint8)
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HIIBHI", head, 94, 227, 227, 0, point_format, size, n)
    box = [f for v in (x, y, z) for f in ((float(v.max()), float(v.min())) if n else (0.0, 0.0))]
    struct.pack_into("<12d", head, 131, *[scale] * 3, *offsets, *box)
    with opened(path, write=True) as f:
        f.write(bytes(head) + body.tobytes())
    return {"count": n, "mins": box[1::2], "maxs": box[0::2]}


def write_las_parts(points: DataFrame, path: str, scale: float = 0.001, most: int = RANGE_POINTS) -> int:
    """Writes points(pid, x, y, z, cls) as a folder of LAS files in order of pid, from the tasks; returns the number of files.

    All have the same scale and offsets and at most ``most`` records, which is what a task holds. The driver gets a name, a count
    and bounds of each; files of attempts that failed are not among these and are never read.
    """
    low = points.agg(*(F.floor(F.min(c)).cast("double").alias(c) for c in "xyz")).first()
    offsets = [low[c] or 0.0 for c in "xyz"]

    def save(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            while sum(len(h) for h in held) >= most:
                t = pa.Table.from_batches(held)
                yield put(t.slice(0, most))
                held = t.slice(most).to_batches()
        if sum(len(h) for h in held):
            yield put(pa.Table.from_batches(held))

    def put(t: pa.Table) -> pa.RecordBatch:
        name = f"{uuid.uuid4().hex}.las"
        facts = write_las(f"{path}/{name}", *(t.column(c).to_numpy() for c in ("x", "y", "z", "cls")), scale, 3, offsets)
        return pa.RecordBatch.from_pylist([{"first": t.column("pid")[0].as_py(), "name": name, **facts}])

    rows = points.select("pid", "x", "y", "z", "cls").repartitionByRange("pid").sortWithinPartitions("pid")
    found = rows.mapInArrow(save, "first long, name string, count long, mins array<double>, maxs array<double>").collect()
    parts = [{k: r[k] for k in ("name", "count", "mins", "maxs")} for r in sorted(found, key=lambda r: r["first"])]
    if not parts:
        parts = [{"name": "empty.las", **write_las(f"{path}/empty.las", [], [], [], [], scale, 3, offsets)}]
    with opened(f"{path}/{PARTS}", write=True) as f:
        f.write(json.dumps(parts).encode())
    return len(parts)
