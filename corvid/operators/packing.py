"""Greedy packing of a key's pieces in order, in parallel also where one key holds most rows.

Whether a piece opens a pack depends on all pieces before it. A sequence is therefore cut into ranges, and a range is
described by what it makes of the size that the open pack has when it begins: at which piece that pack ends is a matter of
sums, and from any such piece on all else is settled. Descriptions are short and are put together range by range; then all
ranges run at once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.sinks import render as R

VERDICT = "key string, event_id long, accepted boolean"


def describe(units, limit: int, gap: int):
    """(bounds, sizes, opened, total) of a range: the first p with bounds[p] under the size on entry opens a pack, after which the
    range ends with sizes[p] and opens opened[p] packs in all; if there is none, the size grows by total.

    An entry for each piece that the pack open on entry can end at: at most limit / gap of them, and one more.
    """
    import numpy as np

    n, grown = len(units), np.concatenate([[0], np.cumsum(units + gap)])
    after = np.maximum(np.searchsorted(grown[1:], limit - units + grown[1:], side="right"), np.arange(1, n + 1)).tolist()
    size, opened = (units + grown[n] - grown[1:]).tolist(), [1] * n
    for p in range(n - 1, -1, -1):
        if after[p] < n:
            size[p], opened[p] = size[after[p]], opened[after[p]] + 1
    few = min(n, int(np.searchsorted(grown[1:], limit, side="right")) + 1)
    return (limit - grown[1 : few + 1]).tolist(), size[:few], opened[:few], int(grown[n])


def greedy(pieces: DataFrame, limit: int, gap: int = 2, range_rows: int = 65_536) -> DataFrame:
    """(key, event_id, accepted) of pieces(key, event_id, at, units): accepted where a piece opens a new pack, as with ``gap`` it no
    longer fits in ``limit``. Pieces of a key count in order of at and event_id; null units are 0, units must not be negative.

    No task holds more than ``range_rows`` pieces at a time, whatever a key's share; what is read in order, one task a key, is a
    description of each range. Pieces that are equal in at and event_id may take each other's place.
    """
    spark = pieces.sparkSession
    rows = pieces.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("long").alias("at"), F.coalesce(F.col("units").cast("long"), F.lit(0)).alias("units"))

    def cut(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, key, ids, units = TaskContext.get().partitionId(), 0, None, [], []

        def flush():
            values = [(key, pa.string()), (part, pa.int32()), (number, pa.int64()), (ids, pa.list_(pa.int64())), (units, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["key", "part", "number", "ids", "units"])

        for b in batches:
            for k, i, u in zip(*(b.column(c).to_pylist() for c in ("key", "event_id", "units")), strict=True):
                if ids and (k != key or len(ids) == range_rows):
                    yield flush()
                    number, ids, units = number + 1, [], []
                key = k
                ids.append(i)
                units.append(u)
        if ids:
            yield flush()

    def described(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                bounds, sizes, _, total = describe(b.column("units")[i].values.to_numpy(zero_copy_only=False), limit, gap)
                longs = pa.list_(pa.int64())
                ends = [pa.array([v], t) for v, t in ((np.negative(bounds).tolist(), longs), (sizes, longs), (total, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("key", "part", "number")), *ends], names=["key", "part", "number", "bounds", "sizes", "total"])

    def compose(batches) -> Iterator:
        from bisect import bisect_right

        import pyarrow as pa

        key, size = None, 0
        for b in batches:
            entries = []
            for k, bounds, sizes, total in zip(*(b.column(c).to_pylist() for c in ("key", "bounds", "sizes", "total")), strict=True):
                if k != key:
                    key, size = k, 0
                entries.append(size)
                p = bisect_right(bounds, -size)  # bounds are negated, so they rise
                size = sizes[p] if p < len(bounds) else size + total
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("number"), pa.array(entries, pa.int64())], names=["part", "number", "entry"])

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                size, out, ids = b.column("entry")[i].as_py(), [], b.column("ids")[i].values
                for u in b.column("units")[i].values.to_pylist():
                    new = size + u + gap > limit
                    size = u if new else size + u + gap
                    out.append(new)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("key")[i].as_py()] * len(out), pa.string()), ids, pa.array(out, pa.bool_())], names=["key", "event_id", "accepted"])

    order = "key", "at", "event_id"
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "key string, part int, number long, ids array<long>, units array<long>")
    folder = R.shared_folder(spark, "ranges")
    ranges.write.parquet(folder)
    ranges = spark.read.schema(ranges.schema).parquet(folder)
    short = ranges.mapInArrow(described, "key string, part int, number long, bounds array<long>, sizes array<long>, total long")
    entries = short.repartition("key").sortWithinPartitions("key", "part", "number").mapInArrow(compose, "part int, number long, entry long")
    return ranges.join(entries, ["part", "number"]).mapInArrow(run, VERDICT)
