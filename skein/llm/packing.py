"""Packing of tokenised documents into sequences, online, in bounded space."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytewords import pieces
from .tokens import encoded, tokenizer_path

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())])


class Packer:
    """Holds at most `open_most` unfinished windows; a full or emitted window leaves at once.

    place() cuts whole windows off a document; the rest goes to the open window with the least room that takes it.
    When none takes it and `open_most` are open, the fullest is emitted: its gap is filled with the start of the rest if
    that start has `least` ids or more, else it stays as padding. finish() merges what is open into full windows and cuts
    the last remainder at powers of two, which need no padding."""

    def __init__(self, size: int, open_most: int, least: int, first_id: int):
        self.size, self.open_most, self.least, self.next_id = size, open_most, least, first_id
        self.rooms: list[tuple[int, int]] = []  # (room, window's number), sorted
        self.open: dict[int, list[tuple]] = {}
        self.number = 0
        self.out: list[tuple] = []

    def emit(self, parts: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in parts:
            self.out.append((doc, start, len(ids), total, self.next_id, offset, ids.tobytes()))
            offset += len(ids)
        self.next_id += 1

    def place(self, doc: int | None, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while total - at >= self.size:
            self.emit([(doc, at, ids[at : at + self.size], total)])
            at += self.size
        while at < total:
            rest = total - at
            i = bisect_left(self.rooms, (rest, -1))
            if i == len(self.rooms) and len(self.rooms) >= self.open_most:
                room, window = self.rooms.pop(0)
                parts = self.open.pop(window)
                if room >= self.least:
                    parts.append((doc, at, ids[at : at + room], total))
                    at += room
                self.emit(parts)
                continue
            if i == len(self.rooms):
                room, window = self.size, self.number
                self.open[window] = []
                self.number += 1
            else:
                room, window = self.rooms.pop(i)
            self.open[window].append((doc, at, ids[at:], total))
            if room == rest:
                self.emit(self.open.pop(window))
            else:
                insort(self.rooms, (room - rest, window))
            at = total

    def finish(self) -> None:
        parts, held = [], 0
        left = [p for _, window in self.rooms for p in self.open[window]]
        todo, limit = sum(len(p[2]) for p in left), self.size
        for doc, start, ids, total in left:
            at = 0
            while at < len(ids):
                if not parts:
                    limit = self.size if todo >= self.size else 1 << (todo.bit_length() - 1)
                n = min(limit - held, len(ids) - at)
                parts.append((doc, start + at, ids[at : at + n], total))
                held, at, todo = held + n, at + n, todo - n
                if held == limit:
                    self.emit(parts)
                    parts, held = [], 0
        self.rooms, self.open = [], {}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, open_most: int = 64, least: int = 16, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian uint32).

    Each partition packs its documents in reading order and needs memory for `open_most` windows and one document, so nothing
    is shuffled. A lost task packs its partition again in the same way; sequence_id holds the partition in
    its upper bits. A document is its token ids, then end_id; null and empty texts are end_id alone. Rows that repeat a
    doc_id are packed each on its own. `size` is a power of two. Extra columns are ignored."""
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    path = path or tokenizer_path()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, open_most, least, TaskContext.get().partitionId() << 40)

        def taken() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 6 else pa.int64()) for k, x in enumerate(zip(*rows) if rows else [()] * 7)], PIECES.names)

        for batch in pieces(batches, text_col):
            ids, offsets = encoded(batch.column(text_col), path)
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4", copy=False)
            offsets = (offsets + np.arange(len(offsets))).tolist()
            for doc, a, b in zip(batch.column(id_col).to_pylist(), offsets[:-1], offsets[1:]):
                packer.place(doc, ids[a:b])
            yield taken()
        packer.finish()
        yield taken()

    return docs.select(id_col, text_col).mapInArrow(packed, PIECES)
