"""Token-id output: best-fit-decreasing packing into an id matrix, with a segment tree that finds the tightest bin.

Texts longer than a row are split without loss into full rows and a remainder. Inside a task a bounded window of
pieces is sorted by length; the tree holds how many open bins have each free capacity, and its successor search gives
the bin with the least sufficient room in log(capacity) steps. Bins that a window leaves too empty give their pieces
back to the next one. Each matrix row holds its ids, cumulative segment lengths and positions that restart with each
segment. No shuffle; a task's rows depend only on its input.

Defined cases: a null text counts as empty and gives its end id alone; repeated rows are packed each; a null doc_id
stays null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spritespark.llm.common import table
from spritespark.llm.tokens import VOCABULARY, encode

CAPACITY = 2048
END_ID = 50_256
WINDOW = 8192
#: Bins less full than this share go back to the pool while more input follows.
FULL_ENOUGH = 0.97
SCHEMA = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>"


class CapacityTree:
    """A segment tree over free capacities 0..size: how many open bins have each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def push(self, free: int, which: int) -> None:
        self.bins[free].append(which)
        at = self.leaves + free
        while at:
            self.count[at] += 1
            at >>= 1

    def pop_fitting(self, need: int) -> tuple[int, int] | None:
        """Takes a bin of the least free capacity >= need: (free, bin)."""
        at = self.leaves + need
        while not self.count[at]:
            while at & 1:  # a right child: no successor below this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            if not self.count[at]:
                at += 1
        free = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return free, self.bins[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers; items in falling length, ties in their order, each to the tightest bin."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        free, at = tree.pop_fitting(lengths[i]) or (capacity, len(bins))
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
        if free > lengths[i]:
            tree.push(free - lengths[i], at)
    return bins


def packed_matrix(documents: DataFrame, capacity: int = CAPACITY, end: int = END_ID, pad: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row of the matrix per sequence: ids (little-endian, 16 bits where the vocabulary fits) padded to capacity,
    n_tokens without padding, cu_seqlens from 0 to n_tokens, positions that restart at 0 (in padding, too), and each
    segment's doc_id and start within its document."""
    kind = np.dtype("<u2") if max(VOCABULARY, end + 1, pad + 1) <= 1 << 16 else np.dtype("<u4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, pool = TaskContext.get().partitionId() << 36, []

        def rows(bins: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for own in bins:
                cu = np.cumsum([0, *(len(ids) for _, _, ids in own)])
                ids, positions = np.full(capacity, pad, kind), np.arange(capacity, dtype="<u4")
                ids[: cu[-1]] = np.concatenate([x for _, _, x in own])
                positions -= np.repeat(np.r_[cu[:-1], cu[-1]], np.diff(np.r_[cu, capacity])).astype("<u4")
                out.append((sequence, int(cu[-1]), ids.tobytes(), cu.tolist(), positions.astype("<u2" if capacity <= 1 << 16 else "<u4").tobytes(), [d for d, _, _ in own], [s for _, s, _ in own]))
                sequence += 1
            types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        def settle(last: bool) -> pa.RecordBatch:
            nonlocal pool
            bins = [[pool[i] for i in own] for own in best_fit_decreasing([len(x) for _, _, x in pool], capacity)]
            done = [own for own in bins if last or sum(len(x) for _, _, x in own) >= FULL_ENOUGH * capacity]
            back = [p for own in bins if not last and sum(len(x) for _, _, x in own) < FULL_ENOUGH * capacity for p in own]
            if len(back) > window // 2:  # these lengths don't fit together: no use in keeping them
                done, back = bins, []
            pool = back
            return rows(done)

        for b in batches:
            full = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text, end).astype(kind)
                for at in range(0, len(ids), capacity):
                    (full.append if at + capacity <= len(ids) else pool.append)((doc_id, at, ids[at : at + capacity]))
                if len(pool) >= window:
                    yield settle(False)
                if len(full) >= 1024:
                    yield rows([[p] for p in full])
                    full = []
            yield rows([[p] for p in full])
        yield settle(True)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, SCHEMA)


def write_matrix(packed: DataFrame, path: str) -> None:
    """Writes the matrix as Parquet, a file a task."""
    packed.write.mode("errorifexists").parquet(path)


def packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the id matrix of all documents."""
    return packed_matrix(table(spark, sf_dir, "documents"))
