"""Mixing sources to target weights: blocks of equal tokens apportioned by highest quotients, then chosen by a seed.

A source's documents stand in a fixed order and make a stream of tokens. The stream is cut into shards; a shard, ``most``
times over, is cut into blocks of ``block`` tokens. Sainte-Lague apportionment gives the blocks of the whole mix to sources
by their targets, then those of a source to its shards by their tokens: each next block goes where target / (2k + 1) is
highest, k being the blocks given there so far. A shard takes its blocks pass by pass, within a pass by a seeded hash, so
a token is repeated only once all tokens of its shard are in.

Nothing holds a source or a shard table whole: documents are ordered by range, so a source of any share has as many tasks
as it needs; a source's shards are equal but for the last, so their quotas are two numbers and how many shards have the
greater one; and a task makes the choice of the shards its documents stand in anew from the seed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, materialize, numbered

#: While more quotients than this could be the last to get a block, the search for the least one goes on.
FEW = 10_000


def word_count(text: bytes) -> int:
    return len(text.split())


def fill(sources: DataFrame, share: float, most: int) -> tuple[float, int]:
    """The level at which least(weight * level, most * size) sums to ``share`` of all sizes, and that sum; ``share`` is
    ``most`` at most. Each round caps the sources that the level before would take too far."""
    total = sources.agg(F.sum("size")).first()[0] or 0
    want, level, capped = share * total, 0.0, -1
    while total:
        over = F.col("weight") * F.lit(level) > F.col("size") * most
        got = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("size") * most).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if got[0] == capped or not got[2]:
            break
        capped, level = got[0], (want - got[1]) / got[2]
    return level, round(want)


def _quotient(k: Column) -> Column:
    return F.col("target") / (2 * k + 1)


def _from(threshold: Column) -> Column:
    """How many of a source's quotients are ``threshold`` or more; the estimate is made exact by the quotients beside it."""
    k = F.least(F.floor((F.col("target") / threshold + 1) / 2), F.col("blocks"))
    more, less = _quotient(k) >= threshold, (k > 0) & (_quotient(k - 1) < threshold)
    return F.least(k + F.when(more, 1).otherwise(0) - F.when(less, 1).otherwise(0), F.col("blocks"))


def apportion(sources: DataFrame, seats: int, natural: float) -> DataFrame:
    """``sources`` with its ``seats`` of all ``seats``: the highest of target / (2k + 1), k below ``blocks``; of equal
    ones those of the lower ``number``. ``natural`` is a guess at the least quotient that gets a seat.

    Thresholds close in on that quotient by one small aggregate a round; the few quotients left are sorted. What comes to
    the driver is a count for each threshold.
    """
    wanted = (F.col("target") > 0) & (F.col("blocks") > 0)
    ends = sources.where(wanted).agg(F.min(F.col("target") / (2 * F.col("blocks") + 1)), F.max("target"), F.sum("blocks")).first()
    low, high, at_low, at_high = (ends[0] or 1.0) / 2, (ends[1] or 1.0) * 2, ends[2] or 0, 0
    if seats >= at_low:  # all that is wanted, then sources without a target by their number
        high, at_high = low, at_low
        last = F.col("blocks")
    else:
        points = {natural * (1 + s * 2.0**-j) for j in range(1, 13) for s in (-1, 1)} | {natural}
        while at_low - at_high > FEW and (points := sorted(p for p in points if low < p < high)):
            tried = sources.where(wanted).withColumn("__point", F.explode(F.array(*map(F.lit, points))))
            for p, c in tried.groupBy("__point").agg(F.sum(_from(F.col("__point")))).orderBy("__point").collect():
                if c >= seats:
                    low, at_low = p, c
                elif p < high:
                    high, at_high = p, c
            points = {low + (high - low) * i / 33 for i in range(1, 33)}
        last = _from(F.lit(low))
    rows = sources.withColumns({"__sure": _from(F.lit(high)).cast("long"), "__last": last.cast("long")})
    rest = seats - (rows.agg(F.sum("__sure")).first()[0] or 0)
    offered = rows.where("__last > __sure").select("number", F.col("target"), F.explode(F.sequence(F.col("__sure"), F.col("__last") - 1)).alias("k"))
    won = offered.orderBy(_quotient(F.col("k")).desc(), "number", "k").limit(rest).groupBy("number").agg(F.count("*").alias("__won"))
    return rows.join(won, "number", "left").select(*sources.columns, (F.col("__sure") + F.coalesce("__won", F.lit(0))).alias("seats"))


def shard_quotas(seats: int, size: int, shard: int, block: int, most: int) -> tuple[int, int, int]:
    """Blocks of each full shard, how many full shards (the first) have one more, and blocks of the last, short shard.

    Highest quotients over ``size // shard`` shards of equal weight and one of the rest; equal ones go to the earlier shard.
    """
    full, rest = divmod(size, shard)
    if not full:
        return 0, 0, seats
    offered, low = -(-most * shard // block), 0
    high = -(-most * rest // block)
    while low < high:  # the short shard's block k comes after its own and the full shards' quotients that are no lower
        k = (low + high) // 2
        before = k + full * min(offered, (shard * (2 * k + 1) // rest + 1) // 2)
        low, high = (k + 1, high) if before < seats else (low, k)
    return (seats - low) // full, (seats - low) % full, low


def chosen(seed: int, source: str, shard: int, tokens: int, quota: int, block: int, most: int):
    """Begin and end of the chosen stretches in the stream of a shard of ``tokens``, ``most`` times over."""
    import hashlib

    import numpy as np

    n = -(-most * tokens // block)
    begins = np.arange(n + 1, dtype=np.int64) * block
    passes = np.searchsorted(begins[:n], np.arange(most + 1, dtype=np.int64) * tokens)  # first block that begins in each pass
    whole = int(np.searchsorted(passes, quota, side="right")) - 1
    pick = np.zeros(n + 2, np.int8)
    pick[1 : passes[whole] + 1] = 1
    if quota > passes[whole]:
        some = range(int(passes[whole]), int(passes[whole + 1]))
        first = sorted((hashlib.md5(f"{seed}:{shard}:{k}:{source}".encode()).hexdigest(), k) for k in some)
        pick[[k + 1 for _, k in first[: quota - int(passes[whole])]]] = 1
    edge = np.flatnonzero(np.diff(pick))
    return begins[edge[::2]], np.minimum(begins[edge[1::2]], most * tokens)


def _sources(sized: DataFrame, weights: Sequence[int], share: float, most: int, block: int, shard: int) -> DataFrame:
    """A row a source: number, size, target, and the quotas of its shards."""

    def quotas(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [shard_quotas(q, z, shard, block, most) for q, z in zip(batch.column("seats").to_pylist(), batch.column("source_size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], names=["source", "number", "source_size", "target", "each", "more", "last"])

    totals = sized.groupBy("source").agg(F.sum("size").alias("size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    table = materialize(numbered(totals, F.col("source").asc_nulls_last()).withColumn("weight", weight), "sources")
    level, want = fill(table, share, most)
    target = F.least(F.col("weight") * F.lit(level), (F.col("size") * most).cast("double"))
    table = table.withColumns({"target": target, "blocks": F.ceil(F.col("size") * most / F.lit(block))})
    given = apportion(table, (2 * want + block) // (2 * block), block / 2)
    given = given.select("source", "number", F.col("size").alias("source_size"), "target", "seats")
    return materialize(given.mapInArrow(quotas, "source string, number long, source_size long, target double, each long, more long, last long"), "quotas")


def _streams(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(number, doc_id, size, start): where each document begins in its source's stream, by doc_id (null last), then size.
    Documents equal in both can stand for each other, so any order among them gives the same rows."""
    named = sources.select(F.col("source").alias("__source"), "number")
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("__source"))).select("number", "doc_id", "size", F.monotonically_increasing_id().alias("tie"))
    order = ["number", F.col("doc_id").asc_nulls_last(), "size", "tie"]

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, now, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            number, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("number", "size"))
            if not len(number):
                continue
            begin = np.concatenate([[0], np.cumsum(size)])
            new = np.concatenate([[number[0] != now], number[1:] != number[:-1]])
            base = np.where(new, begin[:-1], 0)
            base = np.maximum.accumulate(base) if new[0] else np.where(np.cumsum(new) > 0, np.maximum.accumulate(base), -at)
            start = begin[:-1] - base
            now, at = number[-1], int(start[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([batch.column("number"), batch.column("doc_id"), batch.column("size"), pa.array(start), pa.array(np.full(len(start), part, np.int32))], names=["number", "doc_id", "size", "start", "part"])

    # Drawn to written rows: the ranges are found from a sample of them.
    rows = materialize(rows, "sized")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.mapInArrow(run, "number long, doc_id long, size long, start long, part int"), "streams")
    sums = ranged.groupBy("number", "part").agg(F.sum("size").alias("n"))
    before = sums.select("number", "part", (F.sum("n").over(Window.partitionBy("number").orderBy("part")) - F.col("n")).alias("before"))
    return ranged.join(materialize(before, "before"), ["number", "part"]).select("number", "doc_id", "size", (F.col("start") + F.col("before")).alias("start"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: int = 3, block: int = 16, shard: int = 1 << 20, seed: int = 0, size: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, spans), a row for each row of ``docs``.

    ``size`` is a document's tokens (its words, if not given; null counts as 0). Sources by code point, null last, have
    ``weights`` by turns and share ``share`` of all tokens; a target stops at ``most`` times its source's size, and the
    excess goes to the others by weight until none is above. ``spans`` are the stretches of tokens that the mix takes, from
    0, end exclusive, once for each time they are taken, and ``taken`` their tokens; no token is taken more than ``most``
    times. A source's taken tokens differ from its target by less than a block and what highest quotients move between
    sources. Null and repeated doc_id keep their rows; documents without tokens take none. Same rows give the same result,
    however they are stored.
    """
    if not 0 <= share <= most or shard % block:
        raise ValueError("share goes from 0 to most, and a shard is a whole number of blocks")
    names = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string")}
    if size is None:
        sized = counted(docs, word_count, **names).withColumnRenamed("n", "size")
    else:
        sized = docs.select(*[c.alias(name) for name, c in names.items()], F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    sized = materialize(sized, "sizes")
    sources = _sources(sized, weights, share, most, block, shard)

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kept: dict[tuple, tuple] = {}

        def shard_of(number, source, total, each, more, last, t):
            if (number, t) not in kept:
                if len(kept) > 8:
                    kept.clear()
                full = t < total // shard
                tokens = shard if full else total % shard
                kept[number, t] = tokens, *chosen(seed, source, t, tokens, each + (t < more) if full else last, block, most)
            return kept[number, t]

        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            taken, sizes, begins, ends = [], [], [], []
            for number, source, total, each, more, last, start, n in zip(*(batch.column(c).to_pylist() for c in ("number", "source", "source_size", "each", "more", "last", "start", "size")), strict=True):
                sum_, count = 0, 0
                for t in range(start // shard, (start + n - 1) // shard + 1) if n else ():
                    tokens, b, e = shard_of(number, source or "", total, each, more, last, t)
                    lo, hi = max(start - t * shard, 0), min(start + n - t * shard, tokens)
                    for p in range(most):
                        i, j = np.searchsorted(e, p * tokens + lo, side="right"), np.searchsorted(b, p * tokens + hi)
                        if i < j:
                            shift = p * tokens - t * shard + start
                            x, y = np.maximum(b[i:j], p * tokens + lo) - shift, np.minimum(e[i:j], p * tokens + hi) - shift
                            begins.append(x)
                            ends.append(y)
                            sum_ += int((y - x).sum())
                            count += len(x)
                taken.append(sum_)
                sizes.append(count)
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (begins, ends)]
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "size", "source_size", "target")), pa.array(taken, pa.int64()), spans], names=["doc_id", "source", "size", "source_size", "target", "taken", "spans"])

    placed = _streams(sized, sources).join(sources, "number").select("number", "source", "source_size", "each", "more", "last", "target", "doc_id", "size", "start")
    return placed.mapInArrow(run, "doc_id long, source string, size long, source_size long, target double, taken long, spans array<struct<begin: long, end: long>>")
