"""Bounded-space packing of token ids into windows.

Each task keeps at most ``OPEN`` windows.  A document's full windows leave at once; the rest goes into the open window it
fits best.  If it fits none and no more may be opened, the fullest window is topped up with the head of the rest and
emitted, and the remainder is placed again.  At the end of the task the open windows are merged: their
pieces are poured into full windows, and the last one is cut at powers of two.  So every sequence is a full window or a
power of two long, and nothing is padded.

Nothing is shuffled and a task holds a few windows, whatever its input.  Null and empty texts are one closing id.
Repeated rows are packed row by row.  Sequence ids are the partition number and a count, the same when a task runs again.
"""

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from leadloom.llm.bpe import as_ids, encoder, shared_file
from leadloom.llm.bpe_batches import BatchEncoder
from leadloom.llm.tables import texts
from leadloom.llm.words import chunks

WINDOW = 2048
OPEN = 64
CLOSING_ID = 1
#: Words of odd pieces and a quarter of the token pairs that an encoder keeps, beside the words of ``BatchEncoder``.
CACHED_WORDS = 50_000
_FIELDS = [("doc_id", None), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
           ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


class Packer:
    """Open windows of one task; a piece is (document, start, its document's tokens, ids as bytes)."""

    def __init__(self, first_sequence: int, window: int = WINDOW, windows: int = OPEN):
        self.size, self.windows, self.sequence = window, windows, first_sequence
        self.gaps: list[tuple[int, int]] = []  # (room, number) of the open windows, least room first
        self.pieces: dict[int, list[tuple]] = {}
        self.opened = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.sequence, offset))
            offset += n
        self.sequence += 1

    def add(self, doc, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.size:
            self.emit([(doc, start, total, ids[4 * start:4 * (start + self.size)])])
            start += self.size
        while start < total:
            need = total - start
            at = bisect.bisect_left(self.gaps, (need, -1))
            if at == len(self.gaps) and len(self.gaps) < self.windows:
                self.opened += 1
                self.pieces[self.opened] = []
                room, number = self.size, self.opened
            else:
                room, number = self.gaps.pop(at if at < len(self.gaps) else 0)
            take = min(need, room)
            self.pieces[number].append((doc, start, total, ids[4 * start:4 * (start + take)]))
            start += take
            if take == room:
                self.emit(self.pieces.pop(number))
            else:
                bisect.insort(self.gaps, (room - take, number))

    def finish(self) -> None:
        """Merge the open windows, fullest first."""
        waiting = [p for _, number in self.gaps for p in self.pieces.pop(number)]
        self.gaps = []
        left = sum(len(p[3]) // 4 for p in waiting)
        waiting.reverse()
        while left:
            goal = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= goal
            made = []
            while goal:
                doc, start, total, ids = waiting.pop()
                take = min(goal, len(ids) // 4)
                made.append((doc, start, total, ids[:4 * take]))
                if 4 * take < len(ids):
                    waiting.append((doc, start + take, total, ids[4 * take:]))
                goal -= take
            self.emit(made)


def packed(docs: DataFrame, path: str, window: int = WINDOW, windows: int = OPEN,
           closing_id: int = CLOSING_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = texts(docs)
    file = shared_file(docs, path)
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches_of = BatchEncoder(encoder(file.value, as_ids, CACHED_WORDS))
        packer = Packer(TaskContext.get().partitionId() << 32, window, windows)
        kind = None

        def out():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, (_, t) in zip(zip(*rows), _FIELDS)],
                                              [n for n, _ in _FIELDS])

        for batch in batches:
            kind = batch.column(0).type
            docs_of = batch.column(0).to_pylist()
            for first, last, data, offsets in chunks(batch.column(1)):
                for doc, ids in zip(docs_of[first:last], batches_of.encode(data, offsets)):
                    packer.add(doc, ids + closing)
                if len(packer.rows) > 20_000:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()
        pa.default_memory_pool().release_unused()  # workers live on

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                "sequence_id long, offset long")
