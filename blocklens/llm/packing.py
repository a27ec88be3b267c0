"""Sum-of-squares online packing of token sequences into fixed windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ROOM, word_ids

WINDOW = 2048
#: Partly filled windows that one task keeps open; beyond it a document is cut to fill the fullest ones.
MAX_OPEN = 2048

#: A piece: (document's key, its ids before the piece, ids, ids of the whole document)
Piece = tuple[int, int, bytes, int]


class SumOfSquares:
    """Places pieces online. ``levels[h]`` counts the open windows that hold h ids; a piece goes to the level (or a
    new window) that makes the sum of squared counts smallest, the fullest level among equals. Full windows are
    handed out at once; ``finish`` closes the rest by moving pieces of the emptiest windows into the fullest, and
    cuts what then remains into sequences whose lengths are powers of two, so that no padding is left."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1)
        self.levels[window] = -0.5  # full windows aren't counted
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.n_open = 0

    def add(self, key: int, ids: bytes) -> Iterator[list[Piece]]:
        total, size, at = len(ids) // 4, len(ids) // 4, 0
        while size >= self.window:
            yield [(key, at, ids[4 * at : 4 * (at + self.window)], total)]
            at, size = at + self.window, size - self.window
        while size and self.n_open >= self.max_open:
            level = int(np.flatnonzero(self.levels[1:-1])[-1]) + 1
            take = min(size, self.window - level)
            yield from self._put((key, at, ids[4 * at : 4 * (at + take)], total), level)
            at, size = at + take, size - take
        if size:
            yield from self._put((key, at, ids[4 * at :], total), self.best(size))

    def best(self, size: int) -> int:
        """The level that a piece of ``size`` ids (under the window's) should fill; 0 is a new window."""
        here, then = self.levels[1 : self.window - size + 1], self.levels[size + 1 :]
        cost = np.where(here > 0, then - here + 1, np.inf)[::-1]
        k = int(cost.argmin()) if len(cost) else 0
        return len(cost) - k if len(cost) and cost[k] <= self.levels[size] + 0.5 else 0

    def _put(self, piece: Piece, level: int) -> Iterator[list[Piece]]:
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        level += len(piece[2]) // 4
        if level == self.window:
            yield pieces
        else:
            self.open[level].append(pieces)
            self.levels[level] += 1
            self.n_open += 1

    def finish(self) -> Iterator[list[Piece]]:
        left = [(level, pieces) for level in range(self.window - 1, 0, -1) for pieces in self.open[level]]
        first, last = 0, len(left) - 1
        while first < last:
            level, pieces = left[first]
            key, at, ids, total = left[last][1].pop()
            take = min(self.window - level, len(ids) // 4)
            cut = len(ids) - 4 * take
            pieces.append((key, at + cut // 4, ids[cut:], total))
            if cut:
                left[last][1].append((key, at, ids[:cut], total))
            left[first], left[last] = (level + take, pieces), (left[last][0] - take, left[last][1])
            if left[first][0] == self.window:
                yield pieces
                first += 1
            last -= not left[last][1]
        if first == last:
            level, pieces = left[first]
            pieces = pieces[::-1]
            for bit in range(level.bit_length() - 1, -1, -1):
                need, sequence = level & 1 << bit, []
                while need:
                    key, at, ids, total = pieces.pop()
                    take = min(need, len(ids) // 4)
                    sequence.append((key, at, ids[: 4 * take], total))
                    if 4 * take < len(ids):
                        pieces.append((key, at + take, ids[4 * take :], total))
                    need -= take
                if sequence:
                    yield sequence


def pack_documents(df: DataFrame, tokenizer: str, end_id: int, spaced: bool, window: int = WINDOW, max_open: int = MAX_OPEN, doc_id: str = "doc_id", text: str = "text", room: int = ROOM, binary: bool = False) -> DataFrame:
    """Pack all rows' ids (whole text, then ``end_id``) into sequences of at most ``window`` ids.

    Each task packs the rows that it reads, so nothing is shuffled; ``sequence_id`` holds the task's partition above
    40 bits, so a task that runs again gives the same rows. Returns a row for each piece: ``doc_id, start, length,
    ids, doc_tokens, sequence_id, offset``. Null and empty texts are the end id alone; repeated rows are packed one
    by one; a null doc_id stays null; an empty table gives no pieces. ``window`` is a power of two;
    ``room`` bounds a worker's token tables; ``binary`` gives ``ids`` as little-endian unsigned 32-bit integers in binary.
    """
    end = np.asarray([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = word_ids(tokenizer, spaced, room).ids, SumOfSquares(window, max_open)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def place(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for key, at, ids, total in pieces:
                rows.append((key, at, len(ids) // 4, ids, total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            rows.clear()
            if binary:
                ids = pa.array(columns[3], pa.binary())
            else:
                offsets = np.concatenate([[0], np.cumsum(np.array(columns[2], "int64"))]).astype("int32")
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(columns[3]), "<i4")))
            return pa.RecordBatch.from_arrays([ids if k == 3 else pa.array(c, pa.int64()) for k, c in enumerate(columns)], names=names)

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for pieces in packer.add(key, ids_of(value) + end):
                    place(pieces)
                    if len(rows) >= 1024:
                        yield flush()
        for pieces in packer.finish():
            place(pieces)
            if len(rows) >= 1024:
                yield flush()
        yield flush()

    schema = f"doc_id long, start long, length long, ids {'binary' if binary else 'array<int>'}, doc_tokens long, sequence_id long, offset long"
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, schema)


def packing_digest(packed: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of their binary ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
