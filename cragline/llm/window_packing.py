"""Bounded-space online packing of token ids into training sequences.

Each partition of the input keeps at most ``open_windows`` windows. A document's ids, an end id after them, are placed as they
come: full windows of a long document leave at once, the rest goes to the tightest open window that has room. When none has, the
fullest is emitted to make place for a new one; if its gap is at least ``least_cut`` ids, it is filled first with the head of the arriving piece.
What is open at the end of a partition is left over: ``MERGE`` partitions' leftovers, longest piece first, are packed by the same rule in one task, again
and again until one task holds the last windows, which are filled from the emptiest; the very last ids become
sequences of lengths that are powers of two, which need no padding. A task holds its open windows and one document, a merging
task at most ``MERGE * open_windows`` windows, whatever the size of the corpus.

Result of ``pack_windows``: a row for each piece, with its ids (little-endian unsigned 32-bit numbers); every id lies in exactly one piece, and the
pieces of a sequence adjoin. Sequences are to be padded to ``capacity``, except where their length is a power of two.

Defined results: a null or empty text is its end id; repeated rows and equal ids are placed each; a null id is kept; whole texts of any length are
packed; an empty table gives an empty result; extra columns are ignored. Which pieces share a sequence depends on how the input is partitioned. Every
pass is written to the shared folder, and a sequence's number comes from pass, partition and place, so a lost executor costs a repeated task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_ids
from .common import column, materialize

CAPACITY = 2048
OPEN_WINDOWS = 64  #: windows a partition keeps open
LEAST_CUT = 24  #: ids from which on a gap is filled by cutting; a smaller one is padded
MERGE = 16  #: partitions whose leftovers one task packs
END_ID = 1
FLUSH_IDS = 1 << 19
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part int"


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc, self.start + n, self.ids[n:], self.doc_tokens)


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    used: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += len(piece.ids)


class Packer:
    """The open windows of one task, ordered by room and age. Closed windows are handed to ``emit``."""

    def __init__(self, emit, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT):
        self.emit, self.capacity, self.most, self.least_cut = emit, capacity, open_windows, least_cut
        self.order: list[tuple[int, int]] = []
        self.windows: dict[int, Window] = {}
        self.made = 0

    def document(self, doc, ids: np.ndarray) -> None:
        piece = Piece(doc, 0, ids, len(ids))
        while len(piece.ids) >= self.capacity:
            head, piece = piece.cut(self.capacity)
            self.emit(Window([head], self.capacity))
        if len(piece.ids):
            self.place(piece)

    def place(self, piece: Piece) -> None:
        n = len(piece.ids)
        k = bisect_left(self.order, (n, -1))
        if k < len(self.order):
            room, number = self.order.pop(k)
        else:
            if len(self.windows) == self.most:
                room, number = self.order.pop(0)
                window = self.windows.pop(number)
                if room >= self.least_cut and n - room >= self.least_cut:
                    head, rest = piece.cut(room)
                    window.add(head)
                    self.emit(window)
                    self.place(rest)
                    return
                self.emit(window)
            room, number = self.capacity, self.made
            self.made += 1
            self.windows[number] = Window()
        self.windows[number].add(piece)
        if room == n:
            self.emit(self.windows.pop(number))
        else:
            self.order.insert(bisect_left(self.order, (room - n, number)), (room - n, number))

    def left(self) -> list[Window]:
        """Windows still open, fullest first."""
        return [self.windows[number] for _, number in self.order]

    def finish(self) -> None:
        """Fills the open windows from the emptiest, and cuts the last ids at powers of two."""
        windows = self.left()
        spare: list[Piece] = []
        while windows:
            window = windows.pop(0)
            while window.used < self.capacity:
                if not spare:
                    if not windows:
                        break
                    spare = windows.pop().pieces
                piece, gap = spare.pop(), self.capacity - window.used
                if len(piece.ids) > gap:
                    piece, rest = piece.cut(gap)
                    spare.append(rest)
                window.add(piece)
            if window.used == self.capacity:
                self.emit(window)
            else:
                spare = window.pieces[::-1]
        while spare:
            total = sum(len(p.ids) for p in spare)
            window, most = Window(), min(self.capacity, 1 << (total.bit_length() - 1))
            while window.used < most:
                piece, gap = spare.pop(), most - window.used
                if len(piece.ids) > gap:
                    piece, rest = piece.cut(gap)
                    spare.append(rest)
                window.add(piece)
            self.emit(window)


class _Rows:
    """Pieces of closed and left-over windows as Arrow batches."""

    def __init__(self, step: int):
        self.part, self.base, self.count = TaskContext.get().partitionId(), ((step << 24) | TaskContext.get().partitionId()) << 32, 0
        self.clear()

    def clear(self) -> None:
        self.columns: tuple[list, ...] = ([], [], [], [], [], [], [])
        self.size = 0

    def closed(self, window: Window) -> None:
        self.add(window, self.base | self.count)
        self.count += 1

    def add(self, window: Window, sequence: int | None) -> None:
        at = 0
        for p in window.pieces:
            for held, value in zip(self.columns, (p.doc, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.doc_tokens, sequence, at), strict=True):
                held.append(value)
            at += len(p.ids)
        self.size += at

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.size < least:
            return
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(held, kind) for held, kind in zip(self.columns, kinds, strict=True)]
        arrays.append(pa.array(np.full(len(arrays[0]), self.part, dtype=np.int32)))
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "part"])
        self.clear()


def tokenized(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID):
    """(rows of (doc_id, text), function from their batches to (doc_id, ids with the end id))."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file of a few megabytes

    def ids(batches):
        words = token_ids.loaded(sent.value)
        for batch in batches:
            names = column(batch, "doc_id").to_pylist()
            texts = column(batch, "text")
            for doc, found in zip(names, words.texts(texts[i].as_py() or "" for i in range(len(texts))), strict=True):
                yield doc, np.append(found, np.uint32(end_id))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), ids


def pack_windows(
    docs: DataFrame,
    tokenizer_json: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    open_windows: int = OPEN_WINDOWS,
    least_cut: int = LEAST_CUT,
    end_id: int = END_ID,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): every piece of every document.

    ``tokenizer_json``: the text of a byte-level ``tokenizers`` file.
    """
    rows, ids = tokenized(docs, tokenizer_json, id_col, text_col, end_id)

    def first(batches):
        out = _Rows(0)
        packer = Packer(out.closed, capacity, open_windows, least_cut)
        for doc, found in ids(batches):
            packer.document(doc, found)
            yield from out.flush(FLUSH_IDS)
        for window in packer.left():
            out.add(window, None)
        yield from out.flush()

    def merge(step: int, last: bool):
        def run(batches):
            out = _Rows(step)
            packer = Packer(out.closed, capacity, open_windows, least_cut)
            for batch in batches:
                held = [column(batch, c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
                for doc, start, raw, total in zip(*held, strict=True):
                    packer.place(Piece(doc, start, np.frombuffer(raw, dtype="<u4"), total))
                    yield from out.flush(FLUSH_IDS)
            if last:
                packer.finish()
            else:
                for window in packer.left():
                    out.add(window, None)
            yield from out.flush()

        return run

    packed = materialize(rows.mapInArrow(first, SCHEMA), "packed")
    done = packed.where("sequence_id IS NOT NULL")
    step = 1
    while True:
        parts = packed.where("sequence_id IS NULL").agg(F.max("part")).first()[0]
        if parts is None:
            return done.drop("part")
        tasks = parts // MERGE + 1
        left = packed.where("sequence_id IS NULL").withColumn("task", F.floor(F.col("part") / MERGE).cast("int"))
        left = left.repartition(1) if tasks == 1 else left.repartitionById(tasks, F.col("task"))
        left = left.sortWithinPartitions(F.desc("length"), "doc_id", "start").drop("task")
        packed = materialize(left.mapInArrow(merge(step, tasks == 1), SCHEMA), f"merged-{step}")
        done = done.unionByName(packed.where("sequence_id IS NOT NULL"))
        step += 1
