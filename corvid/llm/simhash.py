"""SimHash fingerprints and exact near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` = 4 bits meet at a point within half the radius of both, so every fingerprint deals
out its whole ball of radius 2: itself and all 2,080 variants of one or two flipped bits. Variants fall into parts by a
linear map over bits: the part of a variant is the part of its fingerprint XOR that of the flipped bits. So a part need
receive a fingerprint once, and works out itself which of the 2,081 variants are its own. Two fingerprints at one variant
differ in 4 bits or fewer, hence a bucket holds 2,081 rows at most and links to its least row suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, materialize

def fingerprints(docs: DataFrame, words_per_shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a bit is 1 if set in over half the shingle hashes. Null or wordless texts give fp 0; texts of fewer
    words than a shingle have one shingle, the whole sequence. Repeated rows give repeated results."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest, block = xxhash.xxh64_digest, 1 << 16
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode("utf-8", "replace").lower().split()
                if not words:
                    out.append(0)
                    continue
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                k = min(words_per_shingle, len(words))
                a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
                ones = np.zeros(64, np.int64)
                for i in range(0, len(a), block):
                    raw = b"".join([digest(joined[x:y], seed) for x, y in zip(a[i : i + block], b[i : i + block], strict=True)])
                    ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                out.append(int.from_bytes(np.packbits(ones * 2 > len(a)).tobytes(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _columns(bits: int):
    """The part, of ``bits`` bits, that each of the 64 fingerprint bits adds; fixed by the seed, so all tasks agree."""
    import numpy as np

    return np.random.default_rng(64).integers(1, 1 << 62, 64).astype(np.int64) & ((1 << bits) - 1)


def _part(fp, columns):
    """The linear map: XOR of the columns of the set bits, a byte at a time."""
    import numpy as np

    out, low = np.zeros(len(fp), np.int64), np.arange(256)
    for byte in range(8):
        table = np.zeros(256, np.int64)
        for bit in range(8):
            table ^= np.where(low >> bit & 1, columns[8 * byte + bit], 0)
        out ^= table[(fp >> (8 * byte)) & 255]
    return out


def _flips(bits: int):
    """The flips of the ball of radius 2 in order of their part, and where each part's begin."""
    import numpy as np

    one = (np.uint64(1) << np.arange(64, dtype=np.uint64)).view(np.int64)
    i, j = np.triu_indices(64, 1)
    flips = np.concatenate([[0], one, one[i] ^ one[j]])
    part = _part(flips, _columns(bits))
    order = np.argsort(part, kind="stable")
    return flips[order], np.searchsorted(part[order], np.arange((1 << bits) + 1))


def _meet(fp, part: int, bits: int, flips, begin):
    """Links (least, other) among different fingerprints at the variants of one part: a spanning forest of them."""
    import numpy as np

    fp = np.unique(fp)
    delta = _part(fp, _columns(bits)) ^ part
    first, count = begin[delta], begin[delta + 1] - begin[delta]
    # Sorted in place: high bits of a mixed variant, below them the row. Equal high bits are compared in full after that.
    width = max(1, int(len(fp) - 1).bit_length())
    rows = np.arange(len(fp), dtype=np.uint64)
    mixed, at = np.empty(int(count.sum()), np.uint64), 0
    mask = ~np.uint64((1 << width) - 1)
    for k in range(int(count.max(initial=0))):
        own = np.flatnonzero(count > k)
        key = (fp[own] ^ flips[first[own] + k]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed[at : at + len(own)] = ((key ^ (key >> np.uint64(32))) & mask) | rows[own]
        at += len(own)
    mixed.sort()
    high = mixed & mask
    again = np.flatnonzero(high[1:] == high[:-1])
    if not len(again):
        return fp[:0], fp[:0]
    again = np.unique(np.concatenate([again, again + 1]))
    row, want = (mixed[again] & ~mask).astype(np.int64), high[again]
    # Which of a row's variants it was: all of the few are made again.
    key, owner = [], []
    for k in range(int(count.max())):
        fits = np.flatnonzero(count[row] > k)
        v = fp[row[fits]] ^ flips[first[row[fits]] + k]
        m = v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        same = ((m ^ (m >> np.uint64(32))) & mask) == want[fits]
        key.append(v[same])
        owner.append(row[fits][same])
    key, owner = np.concatenate(key), np.concatenate(owner)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    start = np.concatenate([[True], key[1:] != key[:-1]])
    lead = owner[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))]
    apart = lead != owner
    a, b = fp[lead[apart]], fp[owner[apart]]
    near = np.bitwise_count((a ^ b).view(np.uint64)) <= 4
    return forest(a[near], b[near]) if near.any() else (fp[:0], fp[:0])


def links(fps: DataFrame, radius: int = 4, passes: int = 4, part_keys: int = 1 << 24, least_bits: int = 10) -> DataFrame:
    """Edges (src, dst) over distinct ``fps(fp)`` that connect exactly what links of ``radius`` or fewer bits connect.

    There are 2 ** ``least_bits`` parts, and more where one would have over ``part_keys`` variants. Each of ``passes``
    passes takes a slice of the parts and writes its links before the next one begins, so the shuffle of one slice is on
    disk at a time, once Spark's cleaner has dropped those before.
    """
    if radius != 4:
        raise ValueError("the balls are laid out for a radius of 4")
    spark, n = fps.sparkSession, fps.count()
    bits = max(least_bits, (n * 2081 // part_keys).bit_length())
    # As many fingerprints at a time as there are parts, so that a row holds some 2,000 however many parts there are, and
    # looking at each part costs a constant for each fingerprint.
    chunk = max(1024, 1 << bits)

    def deal(slice_: int):
        def run(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa

            _, begin = _flips(bits)
            offsets, columns = np.flatnonzero(begin[1:] > begin[:-1]), _columns(bits)
            parts = np.arange(slice_, 1 << bits, passes)

            def packed(fp):
                """A row a part: of fingerprints in the order of their own parts, those an offset away from it."""
                own = _part(fp, columns)
                order = np.argsort(own, kind="stable")
                fp, at = fp[order], np.searchsorted(own[order], np.arange((1 << bits) + 1))
                for lo in range(0, len(parts), 512):
                    rows = []
                    for p in parts[lo : lo + 512].tolist():
                        first, end = at[offsets ^ p], at[(offsets ^ p) + 1]
                        size = end - first
                        rows.append(fp[np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(parts[lo : lo + 512]), pa.array(rows, pa.binary())], names=["part", "fps"])

            held = np.empty(0, np.int64)
            for batch in batches:
                held = np.concatenate([held, batch.column("fp").to_numpy(zero_copy_only=False)])
                for _ in range(len(held) // chunk):
                    yield from packed(held[:chunk])
                    held = held[chunk:]
            if len(held):
                yield from packed(held)

        return run

    def meet(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        flips, begin = _flips(bits)
        held, now = [], None

        def flush():
            a, b = _meet(np.concatenate(held), now, bits, flips, begin)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

        for batch in batches:
            for part, fp in zip(batch.column("part").to_pylist(), batch.column("fps"), strict=True):
                if held and part != now:
                    yield flush()
                    held = []
                now = part
                held.append(np.frombuffer(fp.as_buffer(), np.int64))
        if held:
            yield flush()

    dealers = fps.coalesce(max(1, n // chunk)) if n > chunk else fps
    out = None
    for slice_ in range(passes):
        dealt = dealers.mapInArrow(deal(slice_), "part long, fps binary").where("length(fps) > 0")
        met = materialize(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "src long, dst long").distinct(), "balls")
        out = met if out is None else out.unionByName(met)
    return out.distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints link at ``radius`` or fewer differing bits; the component is the
    smallest doc_id reachable over links, itself included. A null doc_id is ignored where a smallest one is sought; rows
    that link with null ids alone have a null component."""
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simclass")
    groups = connected_components(links(classes.select("fp"), radius))
    grouped = materialize(classes.join(groups, classes.fp == groups.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "simgroups")
    # A written table, so that Spark can split the join where one group has a large share of the fingerprints.
    least = materialize(grouped.groupBy("component").agg(F.min("rep").alias("component_id")), "simleast")
    named = materialize(grouped.join(least, "component").select("fp", "component_id"), "simnamed")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id; of repeated rows of one id, all stay.

    Rows without doc_id stay too: no other row can stand for them.
    """
    groups = near_duplicates(docs, radius)
    lost = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti")
