"""Bounded-space online packing of tokenised documents into sequences of a fixed size.

Each partition keeps OPEN windows open. A document goes whole to the open window it fits best
(least room left). Where none has room, the fullest window is topped up with the document's head
and emitted, and the rest of the document is placed again, so emitted windows are always full.
At the end of a partition the leftovers in its open windows are merged: they fill whole sequences
first, and the last remainder becomes sequences of powers of two, which need no padding. Nothing is
shuffled, and memory is the open windows and one document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.packed import small_batches
from brindle.llm.piece_cache import END_OF_TEXT, ByteLevel

SIZE = 2048
OPEN = 8
END = 1

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Window:
    __slots__ = ("used", "pieces")

    def __init__(self):
        self.used, self.pieces = 0, []


class Packer:
    """Open windows of one partition; both methods yield the windows that are done."""

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size, self.most, self.open = size, most, []

    def take(self, doc, ids: bytes) -> Iterator[Window]:
        """Places the ids (four bytes each) of one document."""
        yield from self._place(doc, 0, ids, len(ids) // 4, self.open, self.most, self.size)

    def _place(self, doc, start, ids, length, windows, most, size) -> Iterator[Window]:
        done = 0
        while done < length:
            need = length - done
            fits = [w for w in windows if w.used + need <= size]
            if fits:
                w = max(fits, key=lambda w: w.used)
            elif len(windows) < most:
                w = Window()
                windows.append(w)
            else:
                w = max(windows, key=lambda w: w.used)
            n = min(need, size - w.used)
            w.pieces.append((doc, start + done, n, w.used, ids[4 * done : 4 * (done + n)]))
            w.used += n
            done += n
            if w.used == size:
                windows.remove(w)
                yield w

    def close(self) -> Iterator[Window]:
        """Merges the leftovers into full sequences and sequences of powers of two."""
        left = [p for w in self.open for p in w.pieces]
        total = sum(p[2] for p in left)
        self.open = []
        sizes = [self.size] * (total // self.size) + [1 << k for k in range(self.size.bit_length(), -1, -1) if (total % self.size) >> k & 1]
        pieces = iter(left)
        doc, start, n, _, ids = next(pieces, (None, 0, 0, 0, b""))
        for size in sizes:
            w = Window()
            while w.used < size:
                if not n:
                    doc, start, n, _, ids = next(pieces)
                m = min(n, size - w.used)
                w.pieces.append((doc, start, m, w.used, ids[: 4 * m]))
                w.used += m
                start, n, ids = start + m, n - m, ids[4 * m :]
            yield w


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


def _pack(made_of: tuple, size: int, most: int):
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteLevel.held(*made_of)
        packer, made, held = Packer(size, most), TaskContext.get().partitionId() << 33, []

        def emit(w: Window) -> None:
            nonlocal made
            for (doc, total), start, n, offset, ids in w.pieces:
                held.append((doc, start, n, zlib.crc32(ids), total, made, offset))
            made += 1

        for batch in incoming:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = tokens.ids(text or "") + END.to_bytes(4, "little")
                for w in packer.take((doc, len(ids) // 4), ids):
                    emit(w)
            if len(held) > 20_000:
                yield _batch(held)
                held.clear()
        for w in packer.close():
            emit(w)
        if held:
            yield _batch(held)

    return run


def pack_documents(docs: DataFrame, ranks_file: str, pattern: str, size: int = SIZE, most: int = OPEN, text: str = "text", key: str = "doc_id", special: tuple = END_OF_TEXT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Null and repeated keys are packed as documents of their
    own. No row gives no pieces. Extra columns are ignored. A text of any length is cut over as many
    sequences as it needs. The input's partitions decide which documents meet; the same partitions
    give the same pieces, so a task that runs again repeats itself. sequence_id is the partition's
    number times 2 ** 33 plus a count. Of windows that fit equally well, or are equally full, the one that was
    opened first is taken. special are (string, id) pairs that the vocabulary adds to its ranks; they are single
    tokens wherever they stand in a text. size is a power of two.
    """
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_pack((ranks_file, pattern, tuple(special)), size, most), PIECE)
