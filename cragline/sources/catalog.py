"""Project documents, run history, event log and jobs: JSON tables with upserts, and a driver-side job registry."""

from __future__ import annotations

import json
import re
import threading
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import write_json

FOLDERS = ("clouds", "terrain", "exports", "logs", "runs", "cache")
EVENT = "timestamp string, level string, source string, event string, pid int, thread string, details string"


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def recent_first(index: DataFrame, opened: str, key: str = "id") -> DataFrame:
    """The index with one project moved to the front; order column ``place`` from 0."""
    from ..operators.select import numbered

    moved = index.withColumn("_front", F.when(F.col(key) == opened, 0).otherwise(1))
    return numbered(moved, ["_front", "place"]).withColumn("place", F.col("rn") - 1).drop("rn", "_front")


def now() -> str:
    return datetime.now(UTC).isoformat()


def slug(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name.strip()).strip("_.") or "project"


def _load(path: Path, default):
    try:
        return json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default


class ProjectStore:
    """Projects as folders of JSON documents, found through an index file; a corrupt index counts as empty."""

    def __init__(self, index: str | Path):
        self.index = Path(index)
        self._lock = threading.RLock()

    def projects(self) -> list[dict]:
        rows = _load(self.index, [])
        rows = rows if isinstance(rows, list) else []
        return [r | {"exists": (Path(r["path"]) / "project.json").exists()} for r in rows if isinstance(r, dict) and "path" in r]

    def _front(self, row: dict) -> None:
        with self._lock:
            rest = [{k: v for k, v in r.items() if k != "exists"} for r in self.projects() if r.get("id") != row["id"]]
            self.index.parent.mkdir(parents=True, exist_ok=True)
            write_json(self.index, [row, *rest])

    def create(self, parent: str | Path, name: str, crs: str | None = None, vertical: str | None = None) -> dict:
        root = Path(parent) / slug(name)
        n = 2
        while root.exists() and any(root.iterdir()):
            root, n = Path(parent) / f"{slug(name)}_{n}", n + 1
        for f in FOLDERS:
            (root / f).mkdir(parents=True, exist_ok=True)
        at = now()
        manifest = {"schema": "cragline-project/v1", "id": uuid.uuid4().hex, "name": name, "created_at": at, "updated_at": at, "crs": crs, "vertical": vertical, "clouds": [], "terrain": {}}
        write_json(root / "project.json", manifest)
        write_json(root / "state.json", {"schema": "cragline-state/v1", "camera": None, "display": {}, "feature_lines": [], "runs": []})
        self._front({"id": manifest["id"], "name": name, "path": str(root), "updated_at": at})
        return manifest | {"path": str(root)}

    def open(self, root: str | Path) -> dict:
        manifest = _load(Path(root) / "project.json", None)
        if manifest is None:
            raise FileNotFoundError(f"no project in {root}")
        self._front({"id": manifest["id"], "name": manifest["name"], "path": str(root), "updated_at": manifest["updated_at"]})
        return manifest | {"path": str(root)}

    def root(self, project: str) -> Path:
        for r in self.projects():
            if r.get("id") == project:
                return Path(r["path"])
        raise KeyError(project)

    def manifest(self, project: str) -> dict:
        return json.loads((self.root(project) / "project.json").read_text(encoding="utf-8"))

    def state(self, project: str) -> dict:
        return _load(self.root(project) / "state.json", {})

    def save_manifest(self, project: str, manifest: dict) -> dict:
        manifest = manifest | {"updated_at": now()}
        write_json(self.root(project) / "project.json", manifest)
        self._front({"id": project, "name": manifest.get("name"), "path": str(self.root(project)), "updated_at": manifest["updated_at"]})
        return manifest

    def save_state(self, project: str, state: dict) -> dict:
        state = state | {"updated_at": now()}
        write_json(self.root(project) / "state.json", state)
        return state

    def put_cloud(self, project: str, cloud: dict) -> dict:
        """Registers a cloud; one of the same id is replaced, and its coordinate system adopted if the project has none."""
        m = self.manifest(project)
        m["clouds"] = [c for c in m["clouds"] if c.get("id") != cloud["id"]] + [cloud]
        m["crs"] = m.get("crs") or cloud.get("crs_wkt")
        return self.save_manifest(project, m)

    def cloud(self, project: str, cloud: str) -> dict:
        for c in self.manifest(project)["clouds"]:
            if c.get("id") == cloud:
                return c
        raise KeyError(cloud)

    def put_terrain(self, project: str, kind: str, path: str) -> dict:
        if kind not in ("mdt", "slope"):
            raise ValueError(f"unknown terrain raster: {kind}")
        m = self.manifest(project)
        m["terrain"] = m.get("terrain", {}) | {kind: {"path": path, "added_at": now()}}
        return self.save_manifest(project, m)

    def append_run(self, project: str, run: dict) -> dict:
        s = self.state(project)
        return self.save_state(project, s | {"runs": [*s.get("runs", []), run]})

    def append_lines(self, project: str, lines: list[dict]) -> dict:
        s = self.state(project)
        return self.save_state(project, s | {"feature_lines": [*s.get("feature_lines", []), *lines]})


class Jobs:
    """Jobs in memory: queued, running, completed or failed; reads are copies."""

    def __init__(self):
        self._jobs: dict[str, dict] = {}
        self._lock = threading.Lock()

    def create(self, title: str) -> dict:
        job = {"id": uuid.uuid4().hex, "title": title, "status": "queued", "progress": 0.0, "message": "", "created_at": now(), "updated_at": now(), "result": None, "error": None}
        with self._lock:
            self._jobs[job["id"]] = job
        return dict(job)

    def update(self, job: str, **values) -> None:
        with self._lock:
            self._jobs[job] |= values | {"updated_at": now()}

    def get(self, job: str) -> dict | None:
        with self._lock:
            found = self._jobs.get(job)
            return dict(found) if found else None


def append_events(spark: SparkSession, path: str, events: list[dict]) -> None:
    """Appends events to a JSON-lines table; details are kept as text."""
    rows = [(e.get("timestamp") or now(), e.get("level", "INFO"), e.get("source"), e.get("event"), e.get("pid"), e.get("thread"), json.dumps(e.get("details") or {}, default=str)) for e in events]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def event_details(events: DataFrame, field: str, details: str = "details") -> DataFrame:
    """Adds ``field`` from the JSON text of the details."""
    return events.withColumn(field, F.get_json_object(details, f"$.{field}"))


#: Progress that a converter's log lines stand for.
PROGRESS = ((84.0, "(?i)finaliz|metadata|done"), (65.0, "(?i)index|hierarch"), (45.0, "(?i)distribut|chunk"), (22.0, "(?i)count|read"))


def converter_progress(log: DataFrame, line: str = "value") -> DataFrame:
    """Adds ``progress``: the furthest stage that a log line names, or null."""
    out = F.lit(None).cast("double")
    for value, pattern in reversed(PROGRESS):
        out = F.when(F.col(line).rlike(pattern), value).otherwise(out)
    return log.withColumn("progress", out)


def offending_point(log: DataFrame, line: str = "value") -> DataFrame:
    """(x, y, z) of points that a converter reports outside its bounds, with whether the line reports such a failure."""
    number = "(-?[0-9]+(?:\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    pattern = f".*point:?\\s*[\\[(]?\\s*{number}\\s*,\\s*{number}\\s*,\\s*{number}"
    xyz = [F.regexp_extract(line, pattern, i).try_cast("double").alias(c) for i, c in enumerate("xyz", 1)]
    failed = F.lower(line).contains("bounding box") | F.lower(line).contains("outside")
    return log.select(line, *xyz, failed.alias("bbox_failure"))


def true_bounds_margin(scales: tuple[float, float, float]) -> tuple[float, ...]:
    """Margin by which measured bounds are widened, instead of repairing a file's header: max(16 |scale|, 0.01)."""
    return tuple(max(16 * abs(s), 0.01) for s in scales)
