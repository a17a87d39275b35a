"""Packing: minimum bin slack over windows of document pieces, by bitset subset-sum dynamic programming.

Each task streams its documents: pieces of a full sequence are emitted at once, the remainders enter a window of
bounded size. A sequence starts with the window's longest piece; a bitset holds every fill that the other lengths
(a multiset) can reach, the best is taken and its counts are backtracked. Where no multiset fills a sequence, one
piece is cut to fill it; a task's last tokens form sequences whose lengths are powers of two. So nothing is padded,
every id lies in one piece, memory is that of a window, and there is no shuffle. A task's result depends only on
its rows, so that a lost task's rerun gives the same sequence ids.

Defined cases: a null text counts as empty and gives its end id alone; a null doc_id stays null; rows that repeat
are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spritespark.llm.common import table
from spritespark.llm.tokens import encode

CAPACITY = 2048
END_ID = 1
WINDOW = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of the multiset whose sum is closest to capacity from below.

    reach is a bitset of the sums that the lengths so far can make; copies join by doubling, and the loop ends as
    soon as capacity itself is reached.
    """
    full, reach, before = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        before.append((length, reach))
        left, step = min(counts[length], capacity // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (length * step)) & full
            left, step = left - step, step * 2
        if reach >> capacity & 1:
            break
    at, out = reach.bit_length() - 1, []
    for length, old in reversed(before):
        n = 0
        while not old >> at & 1:
            at, n = at - length, n + 1
        if n:
            out.append((length, n))
    return out


class Packer:
    """Turns (doc_id, ids) into rows of pieces. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, window: int = WINDOW):
        self.sequence, self.capacity, self.window = first_sequence, capacity, window
        self.pool: dict[int, deque] = defaultdict(deque)
        self.counts: dict[int, int] = {}
        self.pieces = 0
        self.rows: list[tuple] = []

    def _put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.pool[n].append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.pieces += 1

    def _take(self, length: int) -> tuple:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        self.pieces -= 1
        return self.pool[length].popleft()

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def _fill(self, capacity: int) -> None:
        """One sequence of exactly capacity tokens; the pool holds as many."""
        longest = max(n for n in self.counts)
        chosen, left = [], capacity
        if longest <= left:
            chosen.append(self._take(longest))
            left -= longest
        for length, n in best_fill(self.counts, left) if left else []:
            chosen += [self._take(length) for _ in range(n)]
            left -= length * n
        if left:
            doc_id, start, ids, total = self._take(min(n for n in self.counts if n > left))
            chosen.append((doc_id, start, ids[:left], total))
            self._put((doc_id, start + left, ids[left:], total))
        self._emit(chosen)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self._emit([(doc_id, at, ids[at : at + self.capacity], len(ids))])
        if whole < len(ids):
            self._put((doc_id, whole, ids[whole:], len(ids)))
        if self.pieces >= self.window:
            left = sum(n * k for n, k in self.counts.items())
            while self.pieces > self.window // 2 and left >= 2 * self.capacity:
                self._fill(self.capacity)
                left -= self.capacity

    def end(self) -> None:
        left, size = sum(n * k for n, k in self.counts.items()), self.capacity
        while left:
            while size > left:
                size = 1 << (left.bit_length() - 1)
            self._fill(size)
            left -= size

    def taken(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * 7
        out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])
        self.rows = []
        return out


def pack_pieces(documents: DataFrame, capacity: int = CAPACITY, end: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 36, capacity, window)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                packer.add(doc_id, encode(text, end))
            yield packer.taken()
        packer.end()
        yield packer.taken()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, SCHEMA)


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the pieces of all documents in sequences of 2048."""
    return pack_pieces(table(spark, sf_dir, "documents"))
