"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= c are exactly those at distance <= eps = sqrt(2 - 2c). Vectors are
turned onto leading principal axes (an orthonormal map, so distances there, with the norm of what lies outside the
axes as one more coordinate, never exceed the true ones), put into epsilon grid order (lexicographic by grid cell) and
cut into sequence intervals. Interval pairs are joined recursively from the root down: a pair whose boxes lie further
than eps apart is dropped with all that is below it. The recursion over tables ends at blocks of FAN leaves; a block is
sent once for a run of PARTNERS blocks that may hold partners, and goes on within the task, leaf by leaf. Leaf pairs
that remain are compared exactly, in double precision.

Equal vectors of a label are one representative with a count, so copies never meet pairwise.
Link counts and a spanning forest leave each block, never the pairs themselves.

Defined results: a vector that is null, zero, empty or holds null, NaN or infinite components, or
whose label is null, links with nothing and is its own component; vectors of different length
never link; repeated rows are separate vectors; an empty table gives an empty result; a vector with a null id
links like any other, but names no component; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import column, components, fingerprint, join_hot, local_components, materialize, of_roots, partitions

LEAF = 256  #: most vectors of an interval at the lowest level
LEAF_BYTES = 1 << 16  #: bytes that its vectors aim at, so that long vectors make small leaves
FAN = 64  #: intervals below one of the next level, and leaves of a block
PARTNERS = 4  #: blocks that one block is sent to at once
AXES = 16  #: leading principal axes of the grid
FIT_ROWS = 10_000  #: most vectors that the axes are fitted on; they steer pruning only, not results


def principal_axes(reps: DataFrame, axes: int = AXES, fit_rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """Leading axes for each vector length, from at most ``fit_rows`` vectors chosen by hash."""
    sample = reps.orderBy("k1", "k2").limit(fit_rows).select("vector").toPandas()["vector"]
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(np.asarray(v, dtype=np.float64))
    out = {}
    for n, rows in by.items():
        x = np.array(rows)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        _, vectors = np.linalg.eigh(np.cov(x.T).reshape(n, n) if len(x) > 1 else np.eye(n))
        out[n] = vectors[:, ::-1][:, :axes]
    return out


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(-1, n).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(batch) -> tuple[np.ndarray, np.ndarray]:
    v = column(batch, "vector")
    return v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())


def _grid(reps: DataFrame, eps: float, axes: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``place`` (norm of what lies outside the axes, then coordinates on them) and ``cell`` (grid cells of the latter)."""

    def run(batches):
        for batch in batches:
            flat, sizes = _vectors(batch)
            ends = np.cumsum(sizes)
            place: list = [None] * batch.num_rows
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = _unit(np.concatenate([flat[ends[i] - n : ends[i]] for i in at]), n)
                turn = axes.get(int(n))
                p = x @ turn if turn is not None else x[:, : min(AXES, n)]
                outside = np.sqrt(np.maximum(0.0, 1 - (p * p).sum(1)))
                for i, row in zip(at, np.column_stack([outside, p]), strict=True):
                    place[i] = row
            cell = [np.floor(p[1:] / eps).astype(np.int32) for p in place]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place, pa.list_(pa.float64())), pa.array(cell, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "place", "cell"],
            )

    return reps.mapInArrow(run, f"node long, label long, n long, vector {reps.schema['vector'].dataType.simpleString()}, place array<double>, cell array<int>")


def _leaves(grid: DataFrame, leaf: int) -> DataFrame:
    """Sequence intervals of at most ``leaf`` vectors of one label, in grid order, with their boxes."""

    def run(batches):
        part, k, held = TaskContext.get().partitionId(), 0, []

        def out():
            nonlocal k, held
            nodes, weights, vectors, places = (np.concatenate([h[i] for h in held]) for i in range(4))
            label, n = held[0][4], held[0][5]
            places = places.reshape(len(nodes), -1)
            row = {
                "part": part, "k": k, "label": label, "dim": n,
                "nodes": nodes.astype(np.int64).tobytes(), "weights": weights.astype(np.int64).tobytes(), "vectors": vectors.tobytes(),
                "low": places.min(0).tolist(), "high": places.max(0).tolist(),
            }
            k, held = k + 1, []
            return pa.RecordBatch.from_pylist([row], schema=LEAVES)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, sizes = _vectors(batch)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            place = column(batch, "place")
            pf, pe = place.flatten().to_numpy(), place.offsets.to_numpy()
            pe = pe - pe[0]
            nodes, weights, labels = (column(batch, c).to_numpy() for c in ("node", "n", "label"))
            i = 0
            while i < batch.num_rows:
                most = max(1, min(leaf, LEAF_BYTES // (flat.itemsize * int(sizes[i]))))
                if held and ((held[0][4], held[0][5]) != (labels[i], sizes[i]) or size >= most):
                    yield out()
                    size = 0
                same = np.flatnonzero((labels[i:] != labels[i]) | (sizes[i:] != sizes[i]))
                to = min(i + (int(same[0]) if len(same) else batch.num_rows - i), i + most - size)
                held.append((nodes[i:to], weights[i:to], flat[ends[i] : ends[to]], pf[pe[i] : pe[to]], int(labels[i]), int(sizes[i])))
                size += to - i
                i = to
        if held:
            yield out()

    return grid.mapInArrow(run, "part int, k long, label long, dim int, nodes binary, weights binary, vectors binary, low array<double>, high array<double>")


LEAVES = pa.schema([("part", pa.int32()), ("k", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("nodes", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])


def _reach(eps: float) -> float:
    """Greatest squared box distance at which vectors may link, rounding included."""
    return eps * eps * (1 + 1e-9) + 1e-12


def _near(eps: float):
    """Box distance <= eps, as a column expression over boxes of sides a and b."""
    gap = F.zip_with(
        F.zip_with("a_low", "b_high", lambda x, y: x - y),
        F.zip_with("b_low", "a_high", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= _reach(eps)


def block_pairs(leaves: DataFrame, eps: float, axes: int = AXES, fan: int = FAN) -> DataFrame:
    """(label, dim, a, b): blocks of ``fan`` leaves, a <= b, whose boxes are within eps; by recursion over interval pairs."""
    width = int(math.log2(fan))
    side = lambda kind, f: F.array(*(f(F.get(kind, F.lit(i))) for i in range(axes + 1))).alias(kind)
    level = leaves.select("label", "dim", F.col("seq").alias("id"), "low", "high")
    levels = []
    top = leaves.agg(F.max("seq")).first()[0] or 0
    while True:
        up = level.withColumn("id", F.shiftright("id", width)).groupBy("label", "dim", "id").agg(side("low", F.min), side("high", F.max))
        level = materialize(up, "intervals")
        levels.append(level)
        top >>= width
        if not top:
            break
    pairs = levels[-1].select("label", "dim", F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels[:-1]):
        below = level.withColumn("up", F.shiftright("id", width))
        a = below.select("label", "dim", F.col("up").alias("a"), F.col("id").alias("a_id"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
        b = below.select("label", "dim", F.col("up").alias("b"), F.col("id").alias("b_id"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
        pairs = pairs.join(a, ["label", "dim", "a"]).join(b, ["label", "dim", "b"]).where("a_id <= b_id").where(_near(eps))
        pairs = materialize(pairs.select("label", "dim", F.col("a_id").alias("a"), F.col("b_id").alias("b")), "pairs")
    return pairs


class _Block:
    """Leaves of one block, with what has been found of their members."""

    def __init__(self, eps: float, least: float, kind: type):
        self.reach, self.least, self.kind, self.home = _reach(eps), least, kind, None
        self.seq: list[int] = []
        self.x: list[np.ndarray] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.nodes: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []

    def read(self, row: dict) -> tuple:
        low, high = (np.array([v for v in row[c] if v is not None]) for c in ("low", "high"))
        return row["seq"], _unit(np.frombuffer(row["vectors"], self.kind), row["dim"]), low, high, np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["weights"], np.int64)

    def add(self, row: dict) -> None:
        self.home = row["block"]
        for held, got in zip((self.seq, self.x, self.low, self.high, self.nodes, self.weights), self.read(row), strict=True):
            held.append(got)

    def meet(self, row: dict):
        """(node, links, root) of members of this block's leaves and of the leaf in ``row`` that link."""
        seq, y, low, high, nodes, weights = self.read(row)
        gap = np.maximum(0.0, np.maximum(np.array(self.low) - high, low - np.array(self.high)))
        for k in np.flatnonzero((gap * gap).sum(1) <= self.reach):
            if self.seq[k] > seq and self.home == row["block"]:
                continue  # the same two leaves meet the other way round
            hit = self.x[k] @ y.T >= self.least
            if self.seq[k] == seq:
                np.fill_diagonal(hit, False)
                i, j = np.nonzero(hit)
                all_nodes, all_weights = nodes, weights
            else:
                i, j = np.nonzero(hit)
                i, j = np.concatenate([i, j + len(self.x[k])]), np.concatenate([j + len(self.x[k]), i])
                all_nodes, all_weights = np.concatenate([self.nodes[k], nodes]), np.concatenate([self.weights[k], weights])
            if len(i):
                links = np.bincount(i, all_weights[j], len(all_nodes)).astype(np.int64)
                label = local_components(len(all_nodes), i, j)
                got = np.unique(i)
                yield all_nodes[got], links[got], all_nodes[label[got]]


def _compare(rows: DataFrame, eps: float, least: float, kind: type) -> DataFrame:
    """rows(run, side, leaf columns), sorted by run and side -> (node, links, root) of members of leaves with links in them."""

    def run(batches):
        at, held = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["run"] != at:
                    at, held = row["run"], _Block(eps, least, kind)
                if row["side"] == 0:
                    held.add(row)
                else:
                    out += held.meet(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "links", "root"])

    return rows.mapInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least_cosine: float = 0.98, leaf: int = LEAF, axes: int = AXES, fan: int = FAN, partners: int = PARTNERS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; see the module's text for the defined results."""
    spark = vectors.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * least_cosine))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    single = isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    good = F.col("label").isNotNull() & F.col("vector").isNotNull()
    good = F.coalesce(good & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    ids = materialize(rows.select("vec_id", *(F.when(good, k).alias(n) for k, n in zip(fingerprint("label", "vector"), ("k1", "k2"), strict=True))), "ids")
    total = ids.count()
    reps = rows.where(good).groupBy("label", "vector").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("n"))
    reps = reps.select(*fingerprint("label", "vector"), "label", "vector", "smallest", "n")
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "reps")

    grid = _grid(reps.select("node", "label", "n", "vector"), eps, principal_axes(reps, axes))
    grid = grid.withColumn("dim", F.size("vector")).repartitionByRange(partitions(spark), "label", "dim", "cell", "node").sortWithinPartitions("label", "dim", "cell", "node").drop("dim")
    leaves = materialize(_leaves(grid, leaf), "leaves")
    most = (leaves.agg(F.max("k")).first()[0] or 0) + 1
    leaves = leaves.withColumn("seq", F.col("part") * F.lit(most) + F.col("k")).drop("part", "k")
    leaves = leaves.withColumn("block", F.shiftright("seq", int(math.log2(fan))))
    pairs = block_pairs(leaves, eps, axes, fan).withColumn("chunk", F.floor(F.col("b") / partners)).withColumn("run", F.struct("label", "dim", "a", "chunk"))
    here = pairs.select("label", "dim", F.col("a").alias("block"), "run").distinct().withColumn("side", F.lit(0))
    there = pairs.select("label", "dim", F.col("b").alias("block"), "run").withColumn("side", F.lit(1))
    sent = here.unionByName(there).join(leaves, ["label", "dim", "block"]).select(F.to_json("run").alias("run"), "side", "block", "seq", "dim", "nodes", "weights", "vectors", "low", "high")
    sent = sent.repartition(partitions(spark), "run").sortWithinPartitions("run", "side", "seq")
    found = materialize(_compare(sent, eps, least_cosine, np.float32 if single else np.float64), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found, "node", "root")
    named = of_roots(roots, reps.select("node", "smallest"), F.min("smallest").alias("component_id"))
    facts = reps.select("k1", "k2", "node", "n", "smallest").join(links, "node", "left").join(named, "node", "left")
    own = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("smallest"))
    facts = facts.select("k1", "k2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), own.alias("component_id"))
    out = join_hot(ids.where("k1 is not null"), materialize(facts, "facts"), ["k1", "k2"], "n", total).select("vec_id", "n_links", "component_id")
    out = out.unionByName(ids.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
