"""Sum-of-squares online packing of token sequences.

Every task packs the documents it reads while it tokenises them, so no row is
shuffled. A document first fills whole windows; what remains of it goes, when
it arrives, to the fill level that keeps the sum of the squared counts of
partly filled windows smallest. The counts live in an array by level. At the
end of a task, or when more than ``max_open`` windows stand open, the open
windows are poured into full ones, with cuts at their ends; the last piece of
a task becomes windows whose lengths are powers of two and need no padding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowmill.llm import words
from sowmill.llm.common import chunks, keyed
from sowmill.llm.words import byte_memo


class Packer:
    """Windows of one task. ``closed`` gets a window as (list of pieces); a piece is (row, start, ids)."""

    def __init__(self, window: int, max_open: int):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.closed: list[list] = []

    def _level(self, size: int) -> int:
        """Level (0: a new window) whose choice adds least to the sum of squared counts; the fullest of equals."""
        count, window = self.count, self.window
        target = count[size:].copy()
        target[window - size] = 0
        cost = 2 * (target - count[:window - size + 1]) + 2
        cost[window - size] -= 1
        cost[count[:window - size + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * target[0] + 1 if size < window else 0
        return int(window - size - np.argmin(cost[::-1]))

    def add(self, row, ids: np.ndarray) -> None:
        start, size = 0, len(ids)
        while size - start >= self.window:
            self.closed.append([(row, start, ids[start:start + self.window])])
            start += self.window
        if start < size:
            self._place((row, start, ids[start:]))
        if self.n_open > self.max_open:
            self.settle(last=False)

    def _place(self, piece) -> None:
        size = len(piece[2])
        level = self._level(size)
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        self._keep(pieces, level + size)

    def _keep(self, pieces: list, level: int) -> None:
        if level == self.window:
            self.closed.append(pieces)
        else:
            self.open[level].append(pieces)
            self.count[level] += 1
            self.n_open += 1

    def settle(self, last: bool) -> None:
        """Pour the open windows, the fullest first, into full ones."""
        pour = [p for level in range(self.window - 1, 0, -1) for pieces in self.open[level] for p in pieces]
        self.count[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        self.n_open = 0
        total = sum(len(p[2]) for p in pour)
        limits = [self.window] * (total // self.window)
        rest = total % self.window
        if last:
            limits += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        elif rest:
            limits.append(rest)
        pieces, filled, k = [], 0, 0
        for row, start, ids in pour:
            while len(ids):
                part = ids[:limits[k] - filled]
                pieces.append((row, start, part))
                start, ids, filled = start + len(part), ids[len(part):], filled + len(part)
                if filled == limits[k]:
                    if last or filled == self.window:
                        self.closed.append(pieces)
                    else:
                        self._keep(pieces, filled)
                    pieces, filled, k = [], 0, k + 1


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", max_open: int = 2048) -> DataFrame:
    """Pack every text into token windows.

    ``docs`` needs ``id_col`` and ``text_col``; other columns are ignored. A
    null or empty text is the end token alone; a repeated row or a null id is
    packed like any other row; an empty table gives no rows. A text longer
    than a window is cut into whole windows and a rest.

    Returns one row per piece: the id, ``start`` (tokens of its document
    before it), ``length``, ``ids`` (little-endian unsigned 32-bit ids),
    ``doc_tokens`` (with the end token), ``sequence_id`` and ``offset``.
    Windows hold ``window`` tokens, or a power of two at the end of a task, so
    nothing is padded. Ids of windows join the partition and a running number;
    a task that runs again makes the same ones.
    """
    source = keyed(docs, id_col, text_col)
    id_type = source.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = byte_memo(tokenizer_path)
        packer, base, done = Packer(window, max_open), TaskContext.get().partitionId() << 33, 0
        kind = None

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal done
            flat = [(*row, start, part, base + done + k) for k, pieces in enumerate(packer.closed) for row, start, part in pieces]
            done += len(packer.closed)
            offsets = []
            for pieces in packer.closed:
                at = 0
                for _, _, part in pieces:
                    offsets.append(at)
                    at += len(part)
            packer.closed = []
            if flat:
                keys, totals, starts, parts, windows = zip(*flat, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, type=kind), pa.array(starts, pa.int64()), pa.array([len(p) for p in parts], pa.int64()),
                     pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()), pa.array(totals, pa.int64()),
                     pa.array(windows, pa.int64()), pa.array(offsets, pa.int64())], names=schema.names)

        for batch in chunks(batches, text_col, 4 << 20, keep=words.__name__):
            kind = batch.schema.field(0).type
            end = np.array([end_id], dtype=np.int32)
            for key, ids in zip(batch.column(0).to_pylist(), memo.of_texts(batch.column(1).fill_null(""))[0], strict=True):
                packer.add((key, len(ids) + 1), np.concatenate([ids, end]))
            yield from rows()
        packer.settle(last=True)
        yield from rows()

    return source.mapInArrow(run, schema)


def piece_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
