"""Packing token sequences into windows by the sum-of-squares rule.

Each task packs the documents of its partition, one after the other, without a shuffle. Open windows are counted by fill
level in an array; a piece goes to the level (or a new window) for which the sum of the squared counts of partially filled
windows becomes smallest. A document of more than a window's ids is cut into full windows and a rest. After every `run` ids,
and when the partition ends, the windows that are still open are consolidated: pieces of the emptiest are cut into the gaps of
the fullest, and one partial window at most goes on into the next run. So a task holds a run's ids, however many it packs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


class SumOfSquares:
    """Online packing into windows of `size`. add() and finish() give finished windows: lists of pieces (key, start, ids, doc_tokens).

    After every `run` ids the open windows are consolidated, which bounds memory.
    """

    def __init__(self, size: int = 2048, run: int = 4 << 20):
        self.size, self.run, self.taken = size, run, 0
        self.count = np.zeros(size + 1, np.int64)  # open windows by fill level; 0 and size stay zero
        self.open: list[list[list]] = [[] for _ in range(size)]

    def _level(self, n: int) -> int:
        """The level to add n ids to: 0 is a new window. Moving a window from h to h+n changes the sum by 2(N[h+n] - N[h]) + 2."""
        c = self.count
        gain = np.full(self.size - n + 1, np.iinfo(np.int64).max)
        there = c[1 : self.size - n + 1] > 0
        gain[1:][there] = (2 * (c[n + 1 : self.size + 1] - c[1 : self.size - n + 1]) + 2)[there]
        if c[self.size - n] and n < self.size:  # filling a window up only takes one away
            gain[self.size - n] = 1 - 2 * c[self.size - n]
        gain[0] = 2 * c[n] + 1 if n < self.size else 0
        return int(gain.argmin())

    def add(self, key, ids: bytes) -> Iterator[list]:
        total = len(ids) // 4
        for start in range(0, total, self.size):
            n = min(self.size, total - start)
            piece = (key, start, ids[4 * start : 4 * (start + n)], total)
            level = self._level(n) if n < self.size else 0
            window = self.open[level].pop() if level else []
            window.append(piece)
            if level:
                self.count[level] -= 1
            if level + n == self.size:
                yield window
            else:
                self.open[level + n].append(window)
                self.count[level + n] += 1
        self.taken += total
        if self.taken >= self.run:
            self.taken = 0
            yield from self.finish(keep=True)

    def finish(self, keep: bool = False) -> Iterator[list]:
        """Consolidates what is open. keep: the partial window that is left stays open."""
        left = sorted(((level, w) for level, ws in enumerate(self.open) for w in ws), key=lambda x: -x[0])
        self.open = [[] for _ in range(self.size)]
        self.count[:] = 0
        lo, hi = 0, len(left) - 1
        while lo <= hi:
            fill, window = left[lo]
            while fill < self.size and hi > lo:
                level, donor = left[hi]
                key, start, ids, total = donor.pop()
                n = min(len(ids) // 4, self.size - fill)
                window.append((key, start, ids[: 4 * n], total))
                fill += n
                if 4 * n < len(ids):
                    donor.append((key, start + n, ids[4 * n :], total))
                left[hi] = (level - n, donor)
                if not donor:
                    hi -= 1
            if fill < self.size and keep:
                self.open[fill].append(window)
                self.count[fill] = 1
            else:
                yield window
            lo += 1


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", cache: int = 300_000) -> DataFrame:
    """One row for each piece of each document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.

    A document is its ids and end_id (null or empty text: end_id alone). Pieces of a sequence lie gapless from offset 0.
    padded_to is `size`, or the sequence's own length where that is a power of two. Rows of equal ids, null ids and ties are
    packed as documents of their own; each id of each row lies in one piece. Other columns are not carried. A worker keeps the
    ids of about `cache` pieces of text.
    """
    rows = docs.select(F.col(id_col), F.col(text_col))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, bins = encoder(tokenizer, end_id, cache), SumOfSquares(size)
        kind, out, number = pa.int64(), [], TaskContext.get().partitionId() << 36

        def flush():
            cols = list(zip(*out)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=[id_col, *[n for n, _ in FIELDS], "padded_to"])

        def put(window):
            nonlocal number
            fill = sum(len(p[2]) for p in window) // 4
            at, padded = 0, fill if fill & (fill - 1) == 0 else size
            for key, start, ids, total in window:
                n = len(ids) // 4
                out.append((key, start, n, zlib.crc32(ids), total, number, at, padded))
                at += n
            number += 1

        for b in batches:
            kind = b[id_col].type
            keys = b[id_col].to_pylist()
            for some, encoded in enc.stepwise(b[text_col]):
                for key, ids in zip(keys[some], encoded):
                    for window in bins.add(key, ids):
                        put(window)
                if len(out) > 4096:
                    yield flush()
                    out.clear()
        for window in bins.finish():
            put(window)
        if out:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(pieces, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long")
