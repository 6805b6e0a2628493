"""Packing token ids into windows of one size: bounded-space online best fit by partition, then merges of what stayed open."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .wordids import ID_BYTES, loaded

#: Windows that a partition keeps open at once; so many tasks' open windows meet in one merge.
OPEN, FAN_IN = 32, 64
#: Bytes of text that are encoded at once, unless one text is longer; bytes of ids in a batch of the result.
CHUNK_BYTES, OUT_BYTES = 4 << 20, 4 << 20


@dataclass
class Piece:
    """Ids of a document from ``start`` on; ``keys`` are its columns, ``whole`` the number of its ids."""

    keys: tuple
    start: int
    ids: bytes
    whole: int

    def __len__(self) -> int:
        return len(self.ids) // ID_BYTES

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.keys, self.start, self.ids[: at * ID_BYTES], self.whole), Piece(self.keys, self.start + at, self.ids[at * ID_BYTES :], self.whole)


@dataclass
class Window:
    gap: int
    pieces: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.gap -= len(piece)


class BestFit:
    """At most ``most`` open windows of ``size`` ids; full ones leave through place()."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open = size, most, []

    def place(self, piece: Piece) -> Iterator[Window]:
        """Puts a piece into the open window that it fills best, and gives the windows that are full thereby.

        What is longer than a window fills windows of its own first. If no open window has the room
        and no other may be opened, the piece's first ids fill the fullest one, which goes; the rest
        is placed in turn.
        """
        while len(piece) >= self.size:
            first, piece = piece.cut(self.size)
            yield Window(0, [first])
        while len(piece):
            fits = min((w for w in self.open if w.gap >= len(piece)), key=lambda w: w.gap, default=None)
            if fits is None and len(self.open) < self.most:
                self.open.append(fits := Window(self.size))
            if fits is not None:
                fits.add(piece)
                piece = piece.cut(len(piece))[1]
            else:
                fits = min(self.open, key=lambda w: w.gap)
                first, piece = piece.cut(fits.gap)
                fits.add(first)
            if not fits.gap:
                self.open.remove(fits)
                yield fits

    def rest(self) -> Iterator[Window]:
        """All that is open as full windows, and what is left of it in windows whose sizes are powers of two."""
        pieces = [p for w in self.open for p in w.pieces]
        left, self.open = sum(map(len, pieces)), []
        size = self.size
        window = None
        for piece in pieces:
            while len(piece):
                if window is None:
                    size = min(self.size, 1 << (left.bit_length() - 1))
                    window = Window(size)
                first, piece = piece.cut(min(window.gap, len(piece)))
                window.add(first)
                left -= len(first)
                if not window.gap:
                    yield window
                    window = None


class _Rows:
    """Windows as rows of Arrow batches."""

    def __init__(self, kinds: list[pa.DataType], step: int, task: int):
        self.kinds, self.step, self.task, self.number = kinds, step, task, 0
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, window: Window, is_open: bool = False) -> None:
        at = 0
        for p in window.pieces:
            self.rows.append((*p.keys, p.start, len(p), p.ids, p.whole, self.step, self.task, self.number, at, is_open))
            self.bytes += len(p.ids) + 64
            at += len(p)
        self.number += 1

    def batch(self) -> pa.RecordBatch:
        kinds = [*self.kinds, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in kinds]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*[f"k{i}" for i in range(len(self.kinds))], *COLUMNS])


COLUMNS = ("start", "length", "ids", "doc_tokens", "step", "task", "number", "offset", "open")
SCHEMA = "start long, length long, ids binary, doc_tokens long, step int, task long, number long, offset long, open boolean"


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with CHUNK_BYTES of text together, or one longer row."""
    ends = np.cumsum(pc.binary_length(batch.column("t")).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def pack(df: DataFrame, keep: list[str], tokenizer: str | Callable[[], str], text: str = "text", size: int = 4096, end_id: int | None = 2, most_open: int = OPEN, fan_in: int = FAN_IN) -> DataFrame:
    """Columns ``keep``, start, length, ids (little-endian 32-bit numbers), doc_tokens, sequence_id, offset: a row for each piece of a document.

    tokenizer: the vocabulary's path on each executor, or a function that gives it there.

    Each partition keeps ``most_open`` windows open and puts each document into the one that it fills
    best. When none has the room, the document's first ids fill the fullest one, which is emitted. What
    a partition leaves open is merged in the same way, ``fan_in`` partitions in a task, in as many
    rounds as it takes; the last one's remainder is cut into windows of powers of two. So all windows
    but those few are full, and none has padding.

    The pieces of the first round are stored once, so that open windows and full ones are those of the
    same run; each merge holds ``most_open * fan_in`` windows at most.

    A null text counts as empty: it has the end id alone, and no piece where ``end_id`` is None.
    Repeated rows and null keys are packed each. An empty table gives an empty table. Columns outside
    ``keep`` are not read.
    """
    source = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))
    schema = ", ".join([*[f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))], SCHEMA])
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows, rows = loaded(tokenizer), BestFit(size, most_open), None
        for whole in batches:
            rows = rows or _Rows(whole.schema.types[:-1], 0, TaskContext.get().partitionId())
            for batch in _chunks(whole):
                keys = zip(*[c.to_pylist() for c in batch.columns[:-1]], strict=True) if keep else [()] * batch.num_rows
                for key, ids in zip(keys, encoder.encode_all(batch.column("t").to_pylist()), strict=True):
                    ids += tail
                    for window in windows.place(Piece(key, 0, ids, len(ids) // ID_BYTES)):
                        rows.add(window)
                        if rows.bytes >= OUT_BYTES:
                            yield rows.batch()
        if rows:
            for window in windows.open:
                rows.add(window, True)
            yield rows.batch()

    def merge(step: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("length", "descending"), ("task", "ascending"), ("number", "ascending"), ("offset", "ascending")])
            windows, rows = BestFit(size, most_open), _Rows(table.schema.types[: len(keep)], step, table.column("task")[0].as_py() // fan_in)
            columns = [table.column(i).to_pylist() for i in range(len(keep))] + [table.column(c).to_pylist() for c in ("start", "ids", "doc_tokens")]
            for *key, start, ids, whole in zip(*columns, strict=True):
                for window in windows.place(Piece(tuple(key), start, ids, whole)):
                    rows.add(window)
            for window in list(windows.rest()) if last else windows.open:
                rows.add(window, not last)
            return pa.Table.from_batches([rows.batch()])

        return run

    made, _ = stored(source.mapInArrow(first, schema))
    done, step = made.where("not open"), 0
    tasks = (made.where("open").agg(F.max("task")).first()[0] or 0) + 1
    while True:
        step, tasks = step + 1, -(-tasks // fan_in)
        merged = made.where("open").groupBy(F.floor(F.col("task") / fan_in)).applyInArrow(merge(step, tasks == 1), schema)
        made, _ = stored(merged)
        done = done.unionByName(made.where("not open"))
        if tasks == 1:
            break
    sequence = F.shiftleft(F.col("step").cast("long"), 56).bitwiseOR(F.shiftleft("task", 32)).bitwiseOR(F.col("number"))
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "start", "length", "ids", "doc_tokens", sequence.alias("sequence_id"), "offset")
