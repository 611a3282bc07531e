"""Harmonic packing of tokenised documents into sequences.

A document of n tokens is of class j when j of its length fit a sequence and j + 1 do
not, that is, n is in (capacity / (j + 1), capacity / j]. A sequence of class j gets
exactly j documents of its class; then it is closed. Every worker fills the sequences
of every class on its own, in the order in which it reads its documents: nothing is
shuffled, and a worker holds one open sequence for each class (63 classes for 1,024)
and at most WAITING + 1 closed ones.

A closed sequence of class j has room for less than capacity / (j + 1) tokens. Documents
may be cut, so that this room is used: closed sequences wait, and when more than WAITING
of them do, the next document gives its head to the largest room that is no larger than it
and only the rest is classed; a document shorter than every room goes into the largest
whole. A document longer than a sequence fills waiting rooms first, then sequences of its
own, and its rest is classed. At its end a worker lays what is still open end to end and
cuts it into sequences; the last, of t tokens, becomes one sequence for each power of two
in t, since a sequence as long as a power of two needs no padding. So there is none at all.

Defined results: null and empty texts are the end token alone. Repeated rows are packed as
often as they occur; rows with a null doc_id have pieces with a null doc_id. An empty table
gives an empty result. A text that holds an added token of the tokenizer has its id there.
Only doc_id and text are read. Sequence numbers tell the worker's partition (high 32 bits).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import by_value, read, small_batches
from quillstone.llm.packing import encoder, vocabulary_path

CAPACITY = 1024
END = 0
#: So many closed sequences may wait for a piece that fills them.
WAITING = 8

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Pieces that leave a worker at once.
ROWS = 4096


class Sequence:
    """Pieces (document, start, ids) laid end to end."""

    def __init__(self, capacity: int) -> None:
        self.pieces: list[tuple] = []
        self.room = capacity

    def put(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        self.pieces.append((doc, start, ids))
        self.room -= len(ids)


class Worker:
    """Packs the documents of one partition; `done` gets the pieces of every finished sequence."""

    def __init__(self, capacity: int = CAPACITY, waiting: int = WAITING) -> None:
        self.capacity, self.most_waiting = capacity, waiting
        self.open: dict[int, Sequence] = {}
        self.waiting: list[Sequence] = []  # by room, least first
        self.done: list[list[tuple]] = []

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        """Pack one document; `doc` (anything) comes back with its pieces."""
        at = 0
        while len(ids) - at > self.capacity:
            if self.waiting:
                at += self.fill(self.waiting.pop(), doc, at, ids)
            else:
                at += self.fill(Sequence(self.capacity), doc, at, ids)
        if len(self.waiting) > self.most_waiting:
            fits = bisect_right(self.waiting, len(ids) - at, key=lambda s: s.room)
            at += self.fill(self.waiting.pop(fits - 1 if fits else -1), doc, at, ids)
        if at < len(ids):
            self.classed(doc, at, ids)

    def fill(self, sequence: Sequence, doc: tuple, at: int, ids: np.ndarray) -> int:
        """Put as much of ids[at:] as there is room for; the number of ids that went."""
        piece = ids[at:at + sequence.room]
        sequence.put(doc, at, piece)
        self.closed(sequence)
        return len(piece)

    def classed(self, doc: tuple, at: int, ids: np.ndarray) -> None:
        count = self.capacity // (len(ids) - at)
        sequence = self.open.setdefault(count, Sequence(self.capacity))
        sequence.put(doc, at, ids[at:])
        if len(sequence.pieces) == count:
            self.closed(self.open.pop(count))

    def closed(self, sequence: Sequence) -> None:
        if sequence.room:
            self.waiting.insert(bisect_right(self.waiting, sequence.room, key=lambda s: s.room), sequence)
        else:
            self.done.append(sequence.pieces)

    def finish(self) -> None:
        """Lay the pieces of all sequences that are not full end to end, and cut."""
        rest = [p for s in [*self.waiting, *(self.open[j] for j in sorted(self.open))] for p in s.pieces]
        self.waiting, self.open = [], {}
        left = sum(len(ids) for _, _, ids in rest)
        sizes = [self.capacity] * (left // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if left % self.capacity >> b & 1]
        sequence = Sequence(sizes[0]) if sizes else None
        number = 0
        for doc, start, ids in rest:
            at = 0
            while at < len(ids):
                piece = ids[at:at + sequence.room]
                sequence.put(doc, start + at, piece)
                at += len(piece)
                if not sequence.room:
                    self.done.append(sequence.pieces)
                    number += 1
                    sequence = Sequence(sizes[number]) if number < len(sizes) else None


def joined(pieces: list[tuple]) -> list[tuple]:
    """The pieces of a sequence; neighbours that continue each other are one."""
    out: list[tuple] = []
    for doc, start, ids in pieces:
        if out and out[-1][0] is doc and out[-1][1] + len(out[-1][2]) == start:
            out[-1] = (doc, out[-1][1], np.concatenate([out[-1][2], ids]))
        else:
            out.append((doc, start, ids))
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END, waiting: int = WAITING) -> DataFrame:
    """PIECES of all documents, ids as little-endian unsigned 32-bit numbers; doc_tokens counts a document's ids with the end."""
    small_batches(docs.sparkSession)
    path = path or vocabulary_path()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker, number, rows = encoder(path), Worker(capacity, waiting), TaskContext.get().partitionId() << 32, []

        def finished(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number, rows
            for pieces in worker.done:
                offset = 0
                for (doc_id, tokens), start, ids in joined(pieces):
                    rows.append((doc_id, start, len(ids), ids.tobytes(), tokens, number, offset))
                    offset += len(ids)
                number += 1
            worker.done = []
            if len(rows) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), end_id).astype("<u4")
                worker.add((doc_id, len(ids)), ids)
                yield from finished(ROWS)
        worker.finish()
        yield from finished(1)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, PIECES)


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


by_value(__name__)
