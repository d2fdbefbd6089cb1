"""Packing of token ids into sequences by bounded-space online best fit.

Every task reads its documents once and keeps a fixed number of open windows.  A
piece goes to the fullest window that still holds it (best fit); if none does and
all windows are open, the fullest one is emitted, its gap filled by the front of the
piece, and the rest of the piece is placed anew.  Documents of more than a window
give whole windows first.  The windows still open at the end of a task are its
leftovers: their pieces, ids included, are merged by the same rule in rounds of
fewer tasks (``FAN`` tasks' leftovers to one), until one task is left.  That one
fills its windows from its emptiest ones and cuts the last into powers of two, which
need no padding.

A task holds its open windows and the batch it reads, whatever the input.  Each
round is a written table, whose closed pieces and leftovers come from one attempt of
each task; a sequence's number holds round and task."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .arrow_sequences import encoder

LENGTH = 2048
END = 1
WINDOWS = 32  # open windows of a task
FAN = 64  # tasks whose leftovers meet in one task of the next round
ROWS = 4096  # pieces of an output batch
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids binary, task int")


class Piece(NamedTuple):
    doc_id: int | None
    start: int  # ids of the document before it
    doc_tokens: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:n]), self._replace(start=self.start + n, ids=self.ids[n:])


class Packer:
    """Places pieces in open windows; ``rows`` are the pieces of emitted windows."""

    def __init__(self, first: int, length: int = LENGTH, windows: int = WINDOWS, with_ids: bool = False):
        self.next, self.length, self.windows, self.with_ids = first, length, windows, with_ids
        self.open: list[tuple[int, int]] = []  # (filled, number), ascending
        self.held: dict[int, list[Piece]] = {}
        self.made = 0
        self.rows: list[tuple] = []

    def add(self, p: Piece) -> None:
        while len(p.ids) >= self.length:
            whole, p = p.cut(self.length)
            self.emit([whole])
        while len(p.ids):
            at = bisect_right(self.open, (self.length - len(p.ids), self.made)) - 1
            if at >= 0:
                filled, w = self.open.pop(at)
            elif len(self.open) < self.windows:
                filled, w = 0, self.made
                self.made += 1
                self.held[w] = []
            else:  # none fits: the fullest goes, with the front of the piece in its gap
                filled, w = self.open.pop()
                front, p = p.cut(self.length - filled)
                self.emit([*self.held.pop(w), front])
                continue
            self.held[w].append(p)
            if filled + len(p.ids) == self.length:
                self.emit(self.held.pop(w))
            else:
                insort(self.open, (filled + len(p.ids), w))
            return

    def emit(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            n = len(p.ids)
            self.rows.append((p.doc_id, p.start, n, zlib.crc32(p.ids.astype("<u4")), p.doc_tokens, self.next, at,
                              p.ids.tobytes() if self.with_ids else None, None))
            at += n
        self.next += 1

    def leave(self, task: int) -> None:
        """The pieces of the open windows become leftovers of this task."""
        for pieces in self.held.values():
            self.rows += [(p.doc_id, p.start, len(p.ids), None, p.doc_tokens, None, None, p.ids.tobytes(), task) for p in pieces]

    def close(self) -> None:
        """Emits the open windows: the emptiest are cut into the gaps of the fullest, and
        the last window into sequences of powers of two."""
        while len(self.open) > 1:
            filled, w = self.open.pop()
            pieces = self.held[w]
            while filled < self.length and self.open:
                left, low = self.open.pop(0)
                p = self.held[low].pop()
                n = min(len(p.ids), self.length - filled)
                front, rest = p.cut(n)
                pieces.append(front)
                filled += n
                if len(rest.ids):
                    self.held[low].append(rest)
                if left > n:
                    insort(self.open, (left - n, low))
            if filled < self.length:
                self.open.append((filled, w))
                break
            self.emit(pieces)
        for filled, w in self.open:
            pieces = self.held[w]
            for bit in range(filled.bit_length() - 1, -1, -1):
                size, part = filled & 1 << bit, []
                while size:
                    front, rest = pieces.pop(0).cut(size)
                    part.append(front)
                    size -= len(front.ids)
                    if len(rest.ids):
                        pieces.insert(0, rest)
                if part:
                    self.emit(part)


def _packed(pieces: DataFrame, read, turn: int, last: bool, length: int, windows: int, with_ids: bool) -> DataFrame:
    """``read(batch)`` gives the pieces of a batch; a task packs what it reads."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer = Packer((turn << 56) + (task << 32), length, windows, with_ids)

        def taken():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        for b in batches:
            for p in read(b):
                packer.add(p)
                if len(packer.rows) >= ROWS:
                    yield taken()
        if last:
            packer.close()
        else:
            packer.leave(task)
        if packer.rows:
            yield taken()

    return C.written(pieces.mapInArrow(run, SCHEMA), f"packed-{turn}")


def pack(docs: DataFrame, tokenizer: str, end: int = END, length: int = LENGTH, windows: int = WINDOWS, fan: int = FAN,
         with_ids: bool = False) -> DataFrame:
    """``doc_id, text`` packed into sequences of ``length`` ids: a row for each piece,
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, on
    demand, ``ids`` (the piece's, little-endian unsigned of the smallest width that
    fits the vocabulary).

    A document is its ids and the end id; null and empty texts are the end id alone.  A
    null id stays null; rows that repeat an id or a text are documents of their own;
    other columns are ignored; without rows there are no pieces.  Only the last few
    sequences of the whole table hold less than ``length`` ids, each a power of two."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def texts(b: pa.RecordBatch):
        e = encoder(tokenizer)
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            ids = np.frombuffer(e.encode(t.as_py(), end), e.kind)
            yield Piece(i, 0, len(ids), ids)

    def leftovers(b: pa.RecordBatch):
        kind = encoder(tokenizer).kind
        for i, start, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
            yield Piece(i, start, n, np.frombuffer(ids, kind))

    rounds = [_packed(src, texts, 0, False, length, windows, with_ids)]
    while True:
        open_ = rounds[-1].where(F.col("task").isNotNull())
        tasks = open_.select("task").distinct().count()
        if not tasks:
            break
        n = -(-tasks // fan)
        dealt = open_.coalesce(1) if n == 1 else open_.repartition(n, "task")
        # the longest first: best fit leaves the least then
        rounds.append(_packed(dealt.sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids"), leftovers, len(rounds), n == 1, length, windows, with_ids))
    done = reduce(DataFrame.unionByName, rounds).where(F.col("task").isNull()).drop("task")
    return done if with_ids else done.drop("ids")


def sequences(packed: DataFrame, kind: str = "<u2") -> DataFrame:
    """Pieces with ``ids`` to whole sequences: ``sequence_id, ids`` (array, without padding)
    and ``starts`` (offsets at which its pieces begin), a row for each sequence."""
    def rows(b: pa.RecordBatch):
        pieces = b.column("pieces").to_pylist()
        yield {"sequence_id": b.column("sequence_id"), "starts": [[p["offset"] for p in x] for x in pieces],
               "ids": [np.frombuffer(b"".join(p["ids"] for p in x), kind).astype(np.int32) for x in pieces]}

    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return C.map_rows(whole, rows, "sequence_id long, ids array<int>, starts array<long>")
