"""Best-fit packing of token sequences: bounded-space online best fit over bins keyed by free space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer_json: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document: its ids, then ``end_id``; only documents over ``capacity`` are cut.

    A long document's pieces have ``capacity`` tokens each, but for the first, which takes the remainder. A null text
    is empty and yields the end id alone; an empty table yields no rows; repeated ids are packed as they come.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoding = bpe.from_json(tokenizer_json, pattern)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(bpe.encode(encoding, text or "").astype("<u4"), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                cuts = [0, *range(first, len(ids), capacity), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


class BestFit:
    """Open bins in stacks by free space; bit ``f`` of ``free`` is set while a bin with ``f`` tokens free is open."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.free, self.stacks, self.count, self.next = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, space: int) -> int:
        stack = self.stacks[space]
        bin_id = stack.pop()
        if not stack:
            self.free &= ~(1 << space)
        self.count -= 1
        return bin_id

    def add(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item: the fullest open bin it fits in, else a new one; over the bound the fullest closes."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(space)
        else:
            space, bin_id = self.capacity, self.next
            self.next += 1
        left = space - length
        if left:
            self.stacks[left].append(bin_id)
            self.free |= 1 << left
            self.count += 1
            if self.count > self.max_open:
                self._take((self.free & -self.free).bit_length() - 1)
        return bin_id, self.capacity - space


def pack(items: DataFrame, capacity: int = 1024, max_open: int = 4096, items_per_packer: int = 1 << 17) -> DataFrame:
    """``items`` (columns of PIECES) with the sequence and the offset of each.

    Items are dealt by a hash of (doc_id, piece) to packers of about ``items_per_packer`` each, so no source or long
    document gathers in one task; each packer takes its items in hash order, which makes a retried task give the same
    bins. Open bins a packer leaves at its end are its only extra waste.
    """
    n = items.count()
    packers = max(1, -(-n // items_per_packer))
    order = F.xxhash64("doc_id", "piece", "start")
    dealt = items.withColumn("h", order).repartition(packers, "h").sortWithinPartitions("h", "doc_id", "piece")

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        base, packer = TaskContext.get().partitionId() << 40, BestFit(capacity, max_open)
        for batch in batches:
            placed = [packer.add(x) for x in batch.column("length").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return dealt.mapInArrow(run, PACKED)
