"""Point index by Morton code with levels of detail, as plain Parquet.

A point's place is cut to 2^DEPTH steps an axis and the bits of the three are interleaved, so points that are near in space are near in the
files, which are range-partitioned and sorted by code within each level. A node at level l is a cube of 2^l to the edge of the cloud, and a range of codes.

The level of a point is the coarsest at which it stands for its node, being the first there by a given order; points that stand for no
node above ``levels`` have that one. So levels 0 to l hold exactly the first point of each occupied node of level l: that is what a level-limited
answer is.

A region (a box in plan or space, a corridor, a ball) is cut into ranges of codes by visiting nodes coarse to fine; a node within the region or
below the budget of ranges is not split. Ranges are pushed to the scan, where Parquet skips files and row groups by their least and greatest code, and the exact
test follows, so answers are the same as without the index.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import bounds
from ..operators.select import corridor, cylinder
from ..shared import materialize

DEPTH = 20  #: bits an axis
LEVELS = 8
RANGES = 48  #: code ranges a region is cut into at most

#: The shifts and masks that spread the low 21 bits of a number so that two free bits stand between any two.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


@dataclass(frozen=True)
class Cube:
    """Where codes begin, and the edge of the cube that they cut."""

    x: float
    y: float
    z: float
    edge: float

    def steps(self, depth: int = DEPTH) -> dict[str, Column]:
        """Step number along each axis at ``depth``."""
        last = (1 << depth) - 1
        return {a: F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.col(a) - getattr(self, a)) / self.edge * (1 << depth)))).cast("long") for a in "xyz"}

    def node(self, ix: int, iy: int, iz: int, level: int) -> tuple[tuple[float, float], ...]:
        """Bounds of a node along each axis."""
        size = self.edge / (1 << level)
        return tuple((o + i * size, o + (i + 1) * size) for o, i in ((self.x, ix), (self.y, iy), (self.z, iz)))


def cube_of(points: DataFrame) -> Cube:
    b = bounds(points).first()
    if not b["n"]:
        return Cube(0.0, 0.0, 0.0, 1.0)
    edge = max(b[f"{a}max"] - b[f"{a}min"] for a in "xyz")
    return Cube(b["xmin"], b["ymin"], b["zmin"], float(edge) * (1 + 1e-9) or 1.0)


def _spread(c: Column) -> Column:
    for shift, mask in SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(cube: Cube) -> Column:
    """Interleaved bits of a point's steps: x lowest."""
    s = cube.steps()
    return _spread(s["x"]).bitwiseOR(F.shiftleft(_spread(s["y"]), 1)).bitwiseOR(F.shiftleft(_spread(s["z"]), 2))


def morton_number(ix: int, iy: int, iz: int) -> int:
    return sum(((v >> k) & 1) << (3 * k + a) for a, v in enumerate((ix, iy, iz)) for k in range(DEPTH + 1))


def with_levels(points: DataFrame, cube: Cube, order: list[str], levels: int = LEVELS) -> DataFrame:
    """Adds ``code`` and ``level``. ``order``: columns that put points in a total order; rows equal in all of them share a level.

    The first of a node is the first of its children's first points, so each level is an aggregate of the one below it, and all rows are
    combined before their one shuffle.
    """
    coded = points.withColumn("code", morton(cube))
    first, found = coded.select("code", F.struct(*order).alias("o")), None
    for level in range(levels - 1, -1, -1):
        node = F.shiftright("code", 3 * (DEPTH - level))
        first = materialize(first.groupBy(node.alias("_n")).agg(F.min(F.struct("o", "code")).alias("f")).select("f.o", "f.code"), f"level-{level}")
        mark = first.select("code", "o", F.lit(level).alias("level"))
        found = mark if found is None else found.unionByName(mark)
    if found is None:
        return coded.withColumn("level", F.lit(levels))
    best = found.groupBy("code", "o").agg(F.min("level").alias("level"))
    joined = coded.withColumn("o", F.struct(*order)).join(best, ["code", "o"], "left")
    return joined.withColumn("level", F.coalesce("level", F.lit(levels))).drop("o")


def build(points: DataFrame, path: str, order: list[str], levels: int = LEVELS, files: int | None = None) -> Cube:
    """Writes the index of ``points`` (x, y, z and any other columns) to ``path`` and returns its cube."""
    cube = cube_of(points)
    placed = with_levels(points, cube, order, levels)
    placed = placed.repartitionByRange(files, "code") if files else placed.repartitionByRange("code")
    placed.sortWithinPartitions("level", "code").write.partitionBy("level").parquet(f"{path}/points")
    about = [(json.dumps(asdict(cube)), levels)]
    points.sparkSession.createDataFrame(about, "cube string, levels int").coalesce(1).write.json(f"{path}/about")
    return cube


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, Cube]:
    """(points with code and level, cube) of an index."""
    about = spark.read.schema("cube string, levels int").json(f"{path}/about").first()
    return spark.read.parquet(f"{path}/points"), Cube(**json.loads(about["cube"]))


def ranges(cube: Cube, meets: Callable, most: int = RANGES, deepest: int = DEPTH) -> list[tuple[int, int]]:
    """Code ranges [from, to) that hold every point of a region. ``meets(bounds of a node)``: 0 outside, 1 in part, 2 within.

    Nodes are visited coarse to fine; splitting stops when the next level would need more than ``most`` ranges.
    """
    done: list[tuple[int, int, int, int]] = []
    level, open_nodes = 0, [(0, 0, 0)] if meets(cube.node(0, 0, 0, 0)) else []
    while open_nodes and level < deepest:
        whole, partial = [], []
        for ix, iy, iz in open_nodes:
            for k in range(8):
                child = (2 * ix + (k & 1), 2 * iy + (k >> 1 & 1), 2 * iz + (k >> 2))
                state = meets(cube.node(*child, level + 1))
                if state:
                    (whole if state == 2 else partial).append(child)
        if len(_joined([*done, *((*c, level + 1) for c in whole + partial)])) > most:
            break
        done += [(*c, level + 1) for c in whole]
        open_nodes, level = partial, level + 1
    return _joined([*done, *((*c, level) for c in open_nodes)])


def _joined(nodes: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Neighbouring ranges as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((morton_number(*n[:3]) << 3 * (DEPTH - n[3]), (morton_number(*n[:3]) + 1) << 3 * (DEPTH - n[3])) for n in nodes):
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def in_box(lo: tuple[float, ...], hi: tuple[float, ...]) -> Callable:
    """Region of a box along the first two or all three axes, borders included."""

    def meets(node) -> int:
        pairs = list(zip(node, lo, hi, strict=False))
        if any(b < a0 or a > b0 for (a, b), a0, b0 in pairs):
            return 0
        return 2 if all(a >= a0 and b <= b0 for (a, b), a0, b0 in pairs) else 1

    return meets


def within(points: DataFrame, spans: list[tuple[int, int]], level: int | None = None) -> DataFrame:
    """Rows of an index in code ranges and, if given, of levels up to ``level``; both reach the scan."""
    inside = F.lit(False)
    for start, end in spans:
        inside = inside | F.col("code").between(start, end - 1)
    return points.where(inside if level is None else inside & (F.col("level") <= level))


def _edge_cells(node, cube: Cube) -> tuple:
    """A node at the cube's border also holds what lies beyond it, which steps are cut to."""
    slack = cube.edge * 1e-9
    return tuple((a - slack, b + slack) for a, b in node)


def read_corridor(points: DataFrame, cube: Cube, start: tuple[float, float], end: tuple[float, float], width: float, classes=None, level: int | None = None) -> DataFrame:
    """``select.corridor`` on an index: the same rows, from the code ranges that the corridor touches."""
    reach = width / 2
    dx, dy = end[0] - start[0], end[1] - start[1]
    length = (dx * dx + dy * dy) ** 0.5
    ux, uy = (dx / length, dy / length) if length else (1.0, 0.0)

    def meets(node) -> int:
        corners = [((x - start[0]) * ux + (y - start[1]) * uy, (y - start[1]) * ux - (x - start[0]) * uy) for x in node[0] for y in node[1]]
        along, across = zip(*corners, strict=True)
        lo, hi = [min(s, e) - reach for s, e in zip(start, end, strict=True)], [max(s, e) + reach for s, e in zip(start, end, strict=True)]
        if max(along) < 0 or min(along) > length or min(across) > reach or max(across) < -reach or not in_box(lo, hi)(node):
            return 0
        return 2 if min(along) >= 0 and max(along) <= length and min(across) >= -reach and max(across) <= reach else 1

    spans = ranges(cube, lambda n: meets(_edge_cells(n, cube)))
    return corridor(within(points, spans, level), start, end, width, classes)


def read_cylinder(points: DataFrame, cube: Cube, seed: tuple[float, float, float], radius: float, level: int | None = None) -> DataFrame:
    """``select.cylinder`` on an index."""
    x, y, z = seed
    tall = max(1.5 * radius, 8.0)

    def meets(node) -> int:
        if not in_box((x - radius, y - radius, z - tall), (x + radius, y + radius, z + tall))(node):
            return 0
        near = [0.0 if a <= v <= b else min(abs(v - a), abs(v - b)) for v, (a, b) in zip((x, y), node, strict=False)]
        far = [max(abs(v - a), abs(v - b)) for v, (a, b) in zip((x, y), node, strict=False)]
        if near[0] ** 2 + near[1] ** 2 > radius * radius:
            return 0
        return 2 if far[0] ** 2 + far[1] ** 2 <= radius * radius and abs(node[2][0] - z) <= tall and abs(node[2][1] - z) <= tall else 1

    spans = ranges(cube, lambda n: meets(_edge_cells(n, cube)))
    return cylinder(within(points, spans, level), seed, radius)
