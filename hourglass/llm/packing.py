"""Packing of tokenized documents into training sequences: bounded-space online best fit.

Each task streams its documents through a fixed number of open windows.  Full-length slices of a long document are
sequences of their own; what is left goes into the open window with the least room that still holds it, or a new one.
When all windows are open and none fits, the fullest window is emitted, topped up first with the head of the document
(pieces may be cut anywhere).  What is still open at a task's end is written out too, and a second pass merges those
leftovers over groups of ``MERGE`` tasks (at most ``MERGE * windows`` windows each, whatever the data), so one
unfilled tail remains for each group; it is cut into power-of-two lengths, which need no padding.

Memory in a task: the open windows plus one document's ids.  The pieces are written to the shared folder once, between
the two passes.

Defined results: a null or empty text is the closing id alone; repeated rows are packed one by one; a document of any
length is cut into as many pieces as it needs; an empty table gives no pieces; a null ``doc_id`` is carried along.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .tokens import Encoder

SCHEMA = ("doc_id {id}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
          "`offset` bigint")
MERGE = 64
WIDTH = 4  # bytes of an id

Piece = tuple[object, int, bytes, int]  # document id, start, ids, tokens of its document


class Packer:
    """Open windows of one task.  ``emit`` gets the pieces of each finished window in their order."""

    def __init__(self, capacity: int, windows: int, emit):
        self.capacity, self.windows, self.emit = capacity, windows, emit
        self.open: list[tuple[int, list[Piece]]] = []  # (room, pieces)

    def add(self, doc_id, ids: bytes) -> None:
        n, at = len(ids) // WIDTH, 0
        while n - at >= self.capacity:
            self.emit([(doc_id, at, ids[at * WIDTH:(at + self.capacity) * WIDTH], n)])
            at += self.capacity
        while at < n:
            left = n - at
            fits = [k for k, (room, _) in enumerate(self.open) if room >= left]
            if fits:
                k, take = min(fits, key=lambda k: self.open[k][0]), left
            elif len(self.open) < self.windows:
                self.open.append((self.capacity, []))
                k, take = len(self.open) - 1, left
            else:
                k = min(range(len(self.open)), key=lambda k: self.open[k][0])
                take = self.open[k][0]
            room, pieces = self.open[k]
            pieces.append((doc_id, at, ids[at * WIDTH:(at + take) * WIDTH], n))
            at += take
            if room == take:
                self.emit(pieces)
                del self.open[k]
            else:
                self.open[k] = (room - take, pieces)


def merged(pieces: Iterator[Piece], capacity: int) -> Iterator[list[Piece]]:
    """Sequences of ``capacity`` from a run of pieces, cut where one is full; the tail in powers of two, largest first."""
    now: list[Piece] = []
    room = capacity

    def cut(run, size):
        head, rest = [], []
        for doc_id, start, ids, n in run:
            k = min(size, len(ids) // WIDTH)
            if k:
                head.append((doc_id, start, ids[:k * WIDTH], n))
            if k < len(ids) // WIDTH:
                rest.append((doc_id, start + k, ids[k * WIDTH:], n))
            size -= k
        return head, rest

    for piece in pieces:
        now.append(piece)
        room -= len(piece[2]) // WIDTH
        if room <= 0:
            head, now = cut(now, capacity)
            yield head
            room += capacity
    tail = capacity - room
    while tail:
        size = 1 << (tail.bit_length() - 1)
        head, now = cut(now, size)
        yield head
        tail -= size


def rows_of(sequence_id: int, pieces: list[Piece]) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, n in pieces:
        yield doc_id, start, len(ids) // WIDTH, ids, n, sequence_id, offset
        offset += len(ids) // WIDTH


def pack(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048,
         windows: int = 16, end_id: int = 1) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents of ``df``.

    ``ids`` are little-endian unsigned 32-bit ids; ``tokenizer`` is a byte-level BPE file that every executor can open.
    Each document is its ids followed by ``end_id``.  A sequence is longer than 0 and at most ``capacity``.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(id=kind)
    end = end_id.to_bytes(WIDTH, "little")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(tokenizer), TaskContext.get().partitionId()
        out: list[tuple] = []
        made, size = 0, 0

        def emit(pieces: list[Piece]) -> None:
            nonlocal made, size
            out.extend((*row, False, task // MERGE) for row in rows_of((task << 36) + made, pieces))
            size += sum(len(p[2]) for p in pieces)
            made += 1

        def batch() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*out, strict=True))
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open", "merge"]
            made_batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            size = 0
            return made_batch

        packer, id_type = Packer(capacity, windows, emit), pa.null()
        for b in batches:
            id_type = b.column(0).type
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(d, encoder.encode(t.as_py()) + end)
                if size >= 4 << 20:
                    yield batch()
        for _, pieces in packer.open:
            out.extend((*row, True, task // MERGE) for row in rows_of((task << 36) + made, pieces))
            made += 1
        if out:
            yield batch()

    both = stage(docs.mapInArrow(packed, schema + ", open boolean, merge bigint"), "packed")

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        run = zip(*(rows[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)
        first = (1 << 62) + (rows["merge"][0].as_py() << 36)
        done = [row for k, pieces in enumerate(merged(run, capacity)) for row in rows_of(first + k, pieces)]
        types = [rows.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return (both.where("not open").select(*names)
            .unionByName(both.where("open").groupBy("merge").applyInArrow(merge, schema).select(*names)))
