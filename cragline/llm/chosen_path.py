"""Set similarity join of texts by chosen paths (CPSJoin: Christiani, Pagh and Sivertsen 2018).

A text's set is its shingles of five lower-cased words (white space: 0x20, 0x09-0x0D; a text of one
to four words is one shingle). Equal sets are one representative with a count. Each set is
embedded into TOKENS min-hash tokens, of which two sets share a Jaccard share. A run starts with
all sets; a node of the recursion samples SPLITS token positions and splits its sets by the token
there, so sets that share the token stay together. Buckets with no partner end; small buckets are
compared by brute force on token sketches; a bucket that hardly shrinks when split holds sets that
are much alike and is joined as one candidate group (the paper's test for points to brute-force).
Runs repeat until the target recall. Candidate groups are then compared exactly: one that fits a block
all against all, a larger one in blocks of neighbours by token, and of these only the pairs of blocks that
a bucket has sets in. A block is sent once for each run of RUN blocks it may meet. No bucket has a cap on partners.
Work in a group of near copies with different texts is quadratic, as every link counts: with B blocks, B^2 / 2
comparisons of blocks, and each block is sent B / RUN times.

Recall: a pair survives a node with SPLITS=2 if one of two sampled tokens agrees and the pair survives
below; where a share p of the tokens agrees, the fixed point of f = 1 - (1 - p f)^2. Runs sample the same
tokens, so ``recall`` averages 1 - (1 - f)^runs over how many of the tokens agree, at the threshold.

Defined results: an empty or null text has no shingles, links with nothing and stays; repeated rows and
equal sets link with each other; an empty table gives an empty result; extra columns are ignored and stay in
what ``keep_one_of_each`` returns; whole texts of any length count. Ids only name classes: rows without an id
or that share one are rows like any other. A class is named by its smallest id, null if it has none; of a
class one row is kept, the one with the smallest id (null last), of several such the one of the smallest row hash.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import (
    SHINGLE_WORDS, Words, column, components, distinct_by_text, fingerprint, fresh, join_hot, local_components, materialize, mix, of_roots, partitions, running_total, seeds, text_slices, whole_groups,
)

TOKENS = 128  #: min-hash tokens of a set
SPLITS = 2  #: token positions that a node of the recursion samples
SMALL = 96  #: a bucket of at most so many sets is compared by brute force
DENSE = 0.7  #: a bucket that keeps this share of its parent does not shrink; sets at Jaccard 0.8 keep 0.8
DEPTH = 8  #: deepest level; what is left then is joined as one candidate group
MARGIN = 5.0  #: standard errors of the sketch below the threshold that are still candidates
RECALL = 0.99999  #: share of pairs at the threshold that the runs find
BLOCK_SETS = 1024  #: most sets of a block of the exact comparison
BLOCK_SHINGLES = 1_000_000  #: shingles that a block aims at; one longer text may exceed it
BUCKET_ROWS = 200_000  #: most buckets of a level whose sizes are broadcast whole (about 16 MB); of more, only those of the hot ones
RUN = 4  #: neighbouring blocks that are sent together; a task holds two runs
FILTER_WORDS = 1 << 20  #: 64-bit words of a filter by row hash at most (8 MB); beyond about 30 million rows in it, it lets most rows pass


def survival(similarity: float, splits: int = SPLITS) -> float:
    """Chance that a pair of this similarity stays together in a run, however deep."""
    f = 1.0
    for _ in range(200):
        f = 1 - (1 - similarity * f) ** splits
    return f


def recall_of(runs: int, similarity: float = 0.8, splits: int = SPLITS, tokens: int = TOKENS) -> float:
    """Chance that a pair of this similarity stays together in one of the runs, over how many of its tokens agree."""
    total = 0.0
    for k in range(tokens + 1):
        chance = math.comb(tokens, k) * similarity**k * (1 - similarity) ** (tokens - k)
        total += chance * (1 - (1 - survival(k / tokens, splits)) ** runs)
    return total


def runs_for(recall: float, similarity: float = 0.8, splits: int = SPLITS, tokens: int = TOKENS) -> int:
    """Runs until a pair at the threshold is found with at least ``recall``."""
    return next(n for n in range(1, 200) if n == 199 or recall_of(n, similarity, splits, tokens) >= recall)


def minhash(hashes: np.ndarray, first: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """uint32[texts, factors]: smallest hash by each factor; texts without shingles get all ones."""
    n = len(first) - 1
    out = np.full((n, len(factors)), 0xFFFFFFFF, dtype=np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some) == 0:
        return out
    at = first[:-1][some]
    scratch = np.empty_like(hashes)
    with np.errstate(over="ignore"):
        for i, a in enumerate(factors):
            np.multiply(hashes, a, out=scratch)
            out[some, i] = np.minimum.reduceat(scratch, at) >> np.uint64(32)
    return out


SIGNED = "id long, r1 long, r2 long, k1 long, k2 long, shingles int, tokens binary"
WHO = ("id", "r1", "r2")  #: a row's id and the fingerprint of all its columns


def signatures(docs: DataFrame, id_col: str, text_col: str, tokens: int = TOKENS, width: int = SHINGLE_WORDS) -> DataFrame:
    """Of every row: WHO, the set's fingerprint (k1, k2: sums over distinct shingles), its size and tokens."""
    factors = seeds(tokens, 11)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(column(batch, "text")):
                h, first = distinct_by_text(*Words(data, offsets).shingles(width))
                tok = minhash(h, first, factors)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (mix(h + np.uint64(3)), mix(h ^ np.uint64(0xABCDEF12345)))]
                    k1, k2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                count = np.diff(first)
                arrays = [*(column(batch, c).slice(a, b - a) for c in WHO), pa.array(k1, mask=count == 0), pa.array(k2, mask=count == 0), pa.array(count.astype(np.int32)), pa.array([r.tobytes() for r in tok], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*WHO, "k1", "k2", "shingles", "tokens"])

    return _named(docs, id_col, text_col).mapInArrow(run, SIGNED)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, r1, r2, text) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), *row_hash(docs), F.col(text_col).cast("string").alias("text"))


def row_hash(docs: DataFrame) -> list:
    """Two hashes of all columns of a row, nulls told from other values."""
    plain = [F.col(f"`{f.name}`") if not isinstance(f.dataType, (MapType, VariantType)) else F.col(f"`{f.name}`").cast("string") for f in docs.schema.fields]
    return fingerprint(*plain, F.concat(*(F.when(c.isNull(), "0").otherwise("1") for c in plain)), prefix="r")


def _children(rows: DataFrame, tokens: int, splits: int) -> DataFrame:
    """rows(node, path, n, tokens) -> (node, path of a child, n of its parent): the child's path holds the position and its token."""

    def run(batches):
        step = seeds(splits, 23)
        for batch in batches:
            if not batch.num_rows:
                continue
            tok = np.frombuffer(column(batch, "tokens").buffers()[2], dtype=np.uint32)
            offset = column(batch, "tokens").offset
            tok = tok.reshape(-1, tokens)[offset : offset + batch.num_rows]
            path = column(batch, "path").to_numpy().view(np.uint64)
            node, n = column(batch, "node"), column(batch, "n")
            with np.errstate(over="ignore"):
                at = (mix(path ^ step[0]) % np.uint64(tokens)).astype(np.int64)
                stride = (mix(path ^ step[1]) % np.uint64(tokens - 1)).astype(np.int64) + 1
                for s in range(splits):
                    i = (at + s * stride) % tokens
                    child = mix(mix(path + np.uint64(s + 1)) ^ (tok[np.arange(len(i)), i].astype(np.uint64) | (i.astype(np.uint64) << np.uint64(32))))
                    yield pa.RecordBatch.from_arrays([node, pa.array(child.view(np.int64)), n], names=["node", "path", "parent_n"])

    return rows.select("node", "path", "n", "tokens").mapInArrow(run, "node long, path long, parent_n long")


def _brute(rows: DataFrame, least: float, tokens: int) -> DataFrame:
    """rows(path, node, sketch), sorted by path within partitions -> (a, b) of candidate trees."""

    def run(batches: Iterator[pa.RecordBatch]):
        for table in whole_groups(batches, "path"):
            path = table.column("path").to_numpy()
            node = table.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, tokens)
            starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            size = np.diff(np.concatenate([starts, [len(path)]]))
            a_all, b_all = [], []
            for n in np.unique(size):
                if n < 2:
                    continue
                i, j = np.triu_indices(n, 1)
                groups = starts[size == n]
                step = max(1, 200_000 // len(i))
                for g in range(0, len(groups), step):
                    at = groups[g : g + step, None]
                    a, b = (at + i).ravel(), (at + j).ravel()
                    same = (sketch[a] == sketch[b]).sum(1) >= least
                    a_all.append(a[same])
                    b_all.append(b[same])
            if not a_all:
                continue
            a, b = np.concatenate(a_all), np.concatenate(b_all)
            label = local_components(len(path), a, b)
            out = np.flatnonzero(label != np.arange(len(path)))
            yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(node[label[out]])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _sketch(tokens: int):
    """The low byte of each token, as one binary column."""

    def run(batches):
        for batch in batches:
            t = column(batch, "tokens")
            raw = np.frombuffer(t.buffers()[2], dtype=np.uint8).reshape(-1, tokens, 4)[t.offset : t.offset + batch.num_rows, :, 0] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array([r.tobytes() for r in raw], pa.binary())], names=["node", "sketch"])

    return run


def candidates(reps: DataFrame, threshold: float = 0.8, recall: float = RECALL, tokens: int = TOKENS, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """((a, b): trees over candidate groups of ``reps`` (node long, tokens binary); (path, node): the buckets compared)."""
    runs = runs_for(recall, threshold, SPLITS, tokens)
    slack = MARGIN * math.sqrt(tokens * threshold * (1 - threshold))
    least = max(1.0, tokens * threshold - slack)
    roots = F.explode(F.array(*(F.lit(int(x)) for x in seeds(runs, 31).view(np.int64))))
    rows = _children(reps.select("node", "tokens", F.lit(None).cast("long").alias("n"), roots.alias("path")), tokens, SPLITS)
    brute, found, buckets = [], [], []
    for depth in range(1, DEPTH + 1):
        rows = materialize(rows, f"children{depth}")
        sizes = rows.groupBy("path").agg(F.count("*").alias("n"), F.first("parent_n").alias("parent_n"), F.min("node").alias("b")).where("n > 1")
        alike = F.lit(True) if depth == DEPTH else F.coalesce(F.col("n") >= DENSE * F.col("parent_n"), F.lit(False))
        kind = F.when(F.col("n") <= small, "small").when(alike, "alike").otherwise("large")
        sizes = materialize(sizes.select("path", "n", "b", kind.alias("kind")), f"buckets{depth}")
        held, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # a bucket of near copies may hold a share of the corpus at every level, so its members never meet its size under one key
        if held <= BUCKET_ROWS:
            rows = rows.select("node", "path").join(F.broadcast(sizes), "path")
        else:
            rows = join_hot(rows.select("node", "path"), sizes, ["path"], "n", total).where("n is not null")
        rows = materialize(rows, f"level{depth}")
        brute.append(rows.where("kind = 'small'").select("path", "node"))
        buckets.append(rows.where("kind <> 'large'").select("path", "node"))
        found.append(rows.where("kind = 'alike'").select(F.col("node").alias("a"), "b"))
        large = rows.where("kind = 'large'")
        if large.isEmpty():
            break
        rows = _children(large.select("node", "path", "n").join(reps.select("node", "tokens"), "node"), tokens, SPLITS)
    all_brute = brute[0]
    for x in brute[1:]:
        all_brute = all_brute.unionByName(x)
    sketches = reps.select("node", "tokens").mapInArrow(_sketch(tokens), "node long, sketch binary")
    by_path = all_brute.join(sketches, "node").repartition(partitions(reps.sparkSession), "path").sortWithinPartitions("path")
    edges = _brute(by_path, least, tokens)
    for x in found:
        edges = edges.unionByName(x)
    return edges.where("a <> b"), functools.reduce(DataFrame.unionByName, buckets)


def _common(h: np.ndarray, owner: np.ndarray, m: int, split: int = 0) -> np.ndarray:
    """float32[m, m]: shingles that each two of ``m`` sets share; with ``split``, float32[split, m - split]: only sets before it
    with sets from it on. ``owner`` ascends. Frequent shingles by matrix products, rare ones by pairs."""
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    df = np.diff(np.concatenate([starts, [len(h)]]))
    shape = (split, m - split) if split else (m, m)
    shared = np.zeros(shape, dtype=np.float32)
    rare = min(24, max(2, m // 8))
    for d in np.unique(df[(df > 1) & (df <= rare)]):
        at = starts[df == d]
        i, j = np.triu_indices(d, 1)
        step = max(1, 500_000 // len(i))
        for g in range(0, len(at), step):
            x, y = owner[at[g : g + step, None] + i].ravel().astype(np.int64), owner[at[g : g + step, None] + j].ravel().astype(np.int64)
            if split:
                across = (x < split) & (y >= split)
                x, y = x[across], y[across] - split
            cell = x * shape[1] + y
            if len(cell) * 20 > shared.size:
                shared += np.bincount(cell, minlength=shared.size).reshape(shape).astype(np.float32)
            else:
                cells, count = np.unique(cell, return_counts=True)
                shared.ravel()[cells] += count
    if not split:
        shared += shared.T
    often = np.flatnonzero(df > rare)
    for g in range(0, len(often), 1024):
        some = often[g : g + 1024]
        x = np.zeros((m, len(some)), dtype=np.float32)
        count = df[some]
        rows = owner[np.concatenate([np.arange(s, s + c) for s, c in zip(starts[some], count, strict=True)])]
        x[rows, np.repeat(np.arange(len(some)), count)] = 1
        shared += x[:split] @ x[split:].T if split else x @ x.T
    return shared


def _exact(rows: DataFrame, threshold: float) -> DataFrame:
    """rows(pair, bits, i, j, block, node, n, set), sorted by pair, block and node -> (node, links, root).

    A pair is two runs of blocks, i and j; block a of i and b of j are compared if bit a * RUN + b is set, counted from each run's first block.
    """

    def run(batches):
        for table in whole_groups(batches, "pair", rows=2_000):
            pair, nodes = table.column("pair").to_numpy(), table.column("node").to_numpy()
            once = np.concatenate([[True], (pair[1:] != pair[:-1]) | (nodes[1:] != nodes[:-1])])  # repeated rows
            if not once.all():
                table, pair = table.filter(pa.array(once)), pair[once]
            nodes, weights, blocks = (table.column(c).to_numpy() for c in ("node", "n", "block"))
            runs_i, runs_j, bits = (table.column(c).to_numpy() for c in "i j bits".split())
            packed = table.column("set").combine_chunks()
            first = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // 8
            hashes = np.frombuffer(packed.buffers()[2], np.uint8)
            hashes = hashes[: len(hashes) // 8 * 8].view(np.uint64)
            cuts = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (blocks[1:] != blocks[:-1])]))
            ends = np.append(cuts[1:], len(pair))
            held: dict[int, list[tuple[int, int]]] = {}
            for s, e in zip(cuts.tolist(), ends.tolist(), strict=True):
                held.setdefault(int(pair[s]), []).append((s, e))
            out: list[np.ndarray] = []
            for spans in held.values():
                for (s, e), (t, f) in itertools.combinations_with_replacement(spans, 2):
                    x, y = int(blocks[s]), int(blocks[t])
                    if x // RUN != runs_i[s] or y // RUN != runs_j[s] or not int(bits[s]) >> (x % RUN * RUN + y % RUN) & 1:
                        continue
                    at = np.arange(s, e) if s == t else np.concatenate([np.arange(s, e), np.arange(t, f)])
                    m, split = len(at), e - s if s != t else 0
                    if m < 2:
                        continue
                    h = hashes[first[s] : first[e]] if s == t else np.concatenate([hashes[first[s] : first[e]], hashes[first[t] : first[f]]])
                    count = first[at + 1] - first[at]
                    shared = _common(h, np.repeat(np.arange(m), count), m, split).astype(np.float64)
                    # Jaccard >= t as shared * (1 + t) >= t * (|x| + |y|), in whole numbers but for the threshold
                    hit = shared * (1 + threshold) >= threshold * (count[:split or m, None] + count[None, split:]) - 1e-9
                    if not split:
                        np.fill_diagonal(hit, False)
                    i, j = np.nonzero(hit)
                    if len(i):
                        j += split
                        links = np.bincount(i, weights[at][j], m)
                        if split:
                            links += np.bincount(j, weights[at][i], m)
                        label = local_components(m, i, j)
                        got = np.flatnonzero(links)
                        out.append(np.stack([nodes[at][got], links[got].astype(np.int64), nodes[at][label[got]]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=["node", "links", "root"])

    return rows.mapInArrow(run, "node long, links long, root long")


def _sets(width: int):
    """Rows come in the order of the join on their hashes, so rows repeated in every column are neighbours: one is enough."""

    def run(batches):
        last = None
        for batch in batches:
            node = column(batch, "node").to_numpy()
            new = np.ones(len(node), dtype=bool)
            new[1:] = node[1:] != node[:-1]
            if len(node):
                new[0] = node[0] != last
                last = node[-1]
            if not new.all():
                batch = batch.filter(pa.array(new))
            for a, b, data, offsets in text_slices(column(batch, "text")):
                h, first = distinct_by_text(*Words(data, offsets).shingles(width))
                rest = [column(batch, c).slice(a, b - a) for c in ("node", "n", "part", "block")]
                sets = pa.array([h[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest, sets], names=["node", "n", "part", "block", "set"])

    return run


def blocked(members: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(``members`` with their ``block``, (part, run, i, j, bits) of larger groups' runs of blocks to compare, from both sides, if any).

    members(node, part, shingles, tokens): sets of candidate groups (``part``). A group that fits a block is block 0.
    Larger ones are laid out by their tokens, so that sets that are alike are neighbours, and cut by running totals into
    blocks of at most BLOCK_SETS sets or about BLOCK_SHINGLES shingles. Two blocks meet only if a bucket has sets in both. Runs of
    RUN blocks are paired, with a bit for each two of their blocks that meet (``_exact``).
    """
    load = F.sum(F.greatest(F.lit(1 / BLOCK_SETS), F.col("shingles") / F.lit(float(BLOCK_SHINGLES)))).alias("load")
    size = materialize(members.groupBy("part").agg(load, F.count("*").alias("m")), "parts")
    if size.where("load > 1").isEmpty():
        return members.drop("tokens").withColumn("block", F.lit(0).cast("long")), None
    sized = join_hot(members, size, ["part"], "m", size.agg(F.sum("m")).first()[0])
    small = sized.where("load <= 1").drop("tokens", "load", "m").withColumn("block", F.lit(0).cast("long"))
    unit = F.ceil(F.greatest(F.lit(1e6 / BLOCK_SETS), F.col("shingles") * F.lit(1e6 / BLOCK_SHINGLES))).cast("long")
    laid = running_total(sized.where("load > 1").withColumn("unit", unit), ["part", "tokens", "node"], "unit")
    laid = materialize(laid.withColumn("block", F.floor((F.col("upto") - 1) / F.lit(1_000_000))).drop("tokens", "unit", "upto", "load", "m"), "laid")
    run = F.floor(F.col("block") / RUN)
    has = F.bit_or(F.expr(f"shiftleft(1L, CAST(block % {RUN} AS INT))"))
    held = buckets.join(laid.select("node", "part", "block"), "node").groupBy("path", "part", run.alias("i")).agg(has.alias("a"))
    held = materialize(held, "held")
    bits = functools.reduce(lambda x, y: x.bitwiseOR(y), (F.when(F.getbit("a", F.lit(k)) == 1, F.shiftleft("b", k * RUN)).otherwise(0) for k in range(RUN)))
    pairs = held.join(held.select("path", "part", F.col("i").alias("j"), F.col("a").alias("b")), ["path", "part"]).where("i <= j").select("part", "i", "j", bits.alias("bits"))
    alone = F.expr(f"shiftleft(1L, CAST(block % {RUN} AS INT) * {RUN + 1})")
    pairs = pairs.unionByName(laid.select("part", run.alias("i"), run.alias("j"), alone.alias("bits")).distinct())
    pairs = pairs.groupBy("part", "i", "j").agg(F.bit_or("bits").alias("bits"))
    pairs = pairs.select("part", F.explode(F.array_distinct(F.array("i", "j"))).alias("run"), "i", "j", "bits")
    return small.unionByName(laid.select(small.columns)), materialize(pairs, "run-pairs")


def _row_filter(rows: DataFrame) -> DataFrame:
    """(slot, bits): a bitmap over the hashes ``r1`` of ``rows``, of at most FILTER_WORDS words, so it can be broadcast whatever their number."""
    return materialize(rows.groupBy(_slot("r1").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(r1, 64) AS INT))")).alias("bits")), "row-filter")


def _slot(name: str):
    return F.pmod(F.shiftright(F.col(name), 6), F.lit(FILTER_WORDS)).cast("long")


def _with_maybe(rows: DataFrame, r1: str, kept: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false for those that a filter of ``_row_filter`` does not hold, which need no shuffle to be told apart."""
    slot, bits = fresh(rows, "slot"), fresh(rows, "bits")
    kept = kept.select(F.col("slot").alias(slot), F.col("bits").alias(bits))
    marked = rows.withColumn(slot, _slot(r1)).join(F.broadcast(kept), slot, "left")
    held = F.coalesce(F.getbit(F.col(bits), F.pmod(F.col(r1), F.lit(64)).cast("int")) == 1, F.lit(False))
    return marked.withColumn(flag, held).drop(slot, bits)


def classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float, width: int, tokens: int) -> DataFrame:
    """(id, r1, r2, set_id, n_links, class_id, w_id, w_r1, w_r2) of every row; w: the row of its class that is kept."""
    spark = docs.sparkSession
    signed = materialize(signatures(docs, id_col, text_col, tokens, width), "signed")
    total = signed.count()
    who = F.struct(F.col("id").isNull().alias("no_id"), *WHO)
    reps = signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min(who).alias("who"), F.count("*").alias("n"), F.first("shingles").alias("shingles"), F.first("tokens").alias("tokens"))
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "sets")
    edges, buckets = candidates(reps, threshold, recall, tokens)
    groups = components(edges)

    members = groups.withColumnRenamed("root", "part").join(reps.select("node", "who", "n", "shingles", "tokens"), "node")
    members = materialize(members.select("node", "part", "n", "shingles", "tokens", "who.r1", "who.r2"), "members")
    members, pairs = blocked(members, buckets)
    # a set's text is that of one of its rows; members grow with the corpus, so they are never broadcast, however few they are
    texts = _with_maybe(_named(docs, id_col, text_col), "r1", _row_filter(members), "maybe").where("maybe").select("r1", "r2", "text")
    sets = members.hint("merge").join(texts, ["r1", "r2"]).mapInArrow(_sets(width), "node long, n long, part long, block long, set binary")
    sets = sets.withColumn("run", F.floor(F.col("block") / RUN))
    if pairs is None:
        sets = sets.withColumns({"i": F.col("run"), "j": F.col("run"), "bits": F.lit(1).cast("long")})
    else:
        sets = sets.join(pairs, ["part", "run"], "left").withColumns({"i": F.coalesce("i", "run"), "j": F.coalesce("j", "run"), "bits": F.coalesce("bits", F.lit(1).cast("long"))})
        at = F.pmod("block", F.lit(RUN)).cast("int")
        across = functools.reduce(lambda x, y: x | y, ((at == k) & (F.col("bits").bitwiseAND(sum(1 << (a * RUN + k) for a in range(RUN))) != 0) for k in range(RUN)))
        down = functools.reduce(lambda x, y: x | y, ((at == k) & (F.col("bits").bitwiseAND(sum(1 << (k * RUN + b) for b in range(RUN))) != 0) for k in range(RUN)))
        sets = sets.where(((F.col("run") == F.col("i")) & down) | ((F.col("run") == F.col("j")) & across))
    sets = sets.select("node", "n", "set", "block", "i", "j", "bits", F.xxhash64("part", "i", "j").alias("pair"))
    sets = sets.repartition(partitions(spark), "pair").sortWithinPartitions("pair", "block", "node")
    found = materialize(_exact(sets, threshold), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found, "node", "root")
    named = of_roots(roots, reps.select("node", "who"), F.min("who").alias("best"))
    facts = reps.select("k1", "k2", "node", "n", "who").join(links, "node", "left").join(named, "node", "left")
    facts = facts.select("k1", "k2", "n", F.col("who.id").alias("set_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("best", "who").alias("w"))
    facts = facts.select("k1", "k2", "n", "set_id", "n_links", F.col("w.id").alias("class_id"), F.col("w.r1").alias("w_r1"), F.col("w.r2").alias("w_r2"))
    rows = signed.select(*WHO, "k1", "k2")
    out = join_hot(rows.where("k1 is not null"), materialize(facts, "facts"), ["k1", "k2"], "n", total)
    alone = rows.where("k1 is null").select(*WHO, F.col("id").alias("set_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("class_id"), F.lit(None).cast("long").alias("w_r1"), F.lit(None).cast("long").alias("w_r2"))
    return out.select(alone.columns).unionByName(alone)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = RECALL, width: int = SHINGLE_WORDS, tokens: int = TOKENS) -> DataFrame:
    """(doc_id, set_id, n_links, class_id, kept) of every row.

    set_id: smallest id with an equal set; n_links: other rows whose set has Jaccard >= threshold;
    class_id: smallest id reachable by links; kept: this row is the one that stays of its class.
    """
    rows = classes(docs, id_col, text_col, threshold, recall, width, tokens)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "classes")
    stays = F.col("w_r1").isNull() | ((F.col("r1") == F.col("w_r1")) & (F.col("r2") == F.col("w_r2")))
    rows = rows.withColumn("kept", stays)
    # rows alike in every column that stay: one of them does
    again = rows.where("kept AND w_r1 is not null").groupBy("r1", "r2").agg(F.min("row").alias("one"), F.count("*").alias("times")).where("times > 1")
    again = materialize(again.drop("times"), "again")
    if not again.isEmpty():
        rows = rows.join(again.hint("merge"), ["r1", "r2"], "left").withColumn("kept", F.col("kept") & (F.col("one").isNull() | (F.col("row") == F.col("one"))))
    return rows.select(F.col("id").alias("doc_id"), "set_id", "n_links", "class_id", "kept")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = RECALL, width: int = SHINGLE_WORDS, tokens: int = TOKENS) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each class does: the one with the smallest id; see the module's text."""
    rows = classes(docs, id_col, text_col, threshold, recall, width, tokens).where("w_r1 is not null")
    stays = (F.col("r1") == F.col("w_r1")) & (F.col("r2") == F.col("w_r2"))
    # rows that leave, by the hash of all their columns, and rows that stay but are repeated
    marks = rows.groupBy("r1", "r2").agg(F.max(stays).alias("stays"), F.count("*").alias("times")).where("NOT stays OR times > 1")
    marks = materialize(marks, "marks")
    kept = _row_filter(marks)
    r1, r2, flag = fresh(docs, "r1"), fresh(docs, "r2"), fresh(docs, "maybe")
    told = _with_maybe(docs.withColumns(dict(zip((r1, r2), row_hash(docs), strict=True))), r1, kept, flag)
    marks = marks.select(F.col("r1").alias(r1), F.col("r2").alias(r2), "stays")
    doubt = told.where(F.col(flag))
    # marks grow with the corpus and are never broadcast; rows that the filter does not hold stay where they are
    stay = told.where(~F.col(flag)).select(*docs.columns).unionByName(doubt.join(marks.hint("merge"), [r1, r2], "left_anti").select(*docs.columns))
    again = marks.where("stays")
    if again.isEmpty():
        return stay
    # dealt anew before they are combined, so that one row's many repeats do not meet in a task
    once = doubt.join(again.select(r1, r2).hint("merge"), [r1, r2], "left_semi").repartition(partitions(docs.sparkSession)).groupBy(r1, r2).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return stay.unionByName(once.select("row.*"))
