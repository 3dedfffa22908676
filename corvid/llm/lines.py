"""Line de-duplication over a corpus: a deletion-neighbourhood join on words, then verified edit distance.

Lines are compared as sequences of words. Of equal lines the earliest stays. Two different lines are near if one
inserted, deleted or replaced word turns one into the other and the longer has ``min_words`` words or more. Each line
emits a key for itself and for every way to delete one of its words; a replaced word meets at the same key and
place, an inserted one at the shorter line's own key, so a bucket needs links to its earliest rows alone. Only lines
that share a half with another line can be near one, so first halves and last halves are matched before.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LINE = "k1 long, k2 long, doc_id long, line int, known boolean, h1 long, h2 long, h3 long, h4 long"


#: A run of more rows is split.
RUN_ROWS = 1_000_000


def _runs(batches, keys: tuple[str, ...], carry, most: int = RUN_ROWS) -> Iterator:
    """Record batches cut anew so that no run of equal ``keys[0]`` is split, unless it is over ``most`` rows.

    Of a split run, the rows at the ascending places ``carry(columns)`` come again before its rest, which so knows what it needs
    of the run's beginning; they must be few.
    """
    import numpy as np

    rest = None
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut == 0 and len(now[0]) > most:
            yield now
            again = carry(now)
            rest = [x[again] for x in now]
            continue
        if cut:
            yield [x[:cut] for x in now]
        rest = [x[cut:] for x in now]
    if rest is not None and len(rest[0]):
        yield rest


def _half_keys(joined: bytes, ends: list[int], n: int, least: int) -> list[int]:
    """For each length s of the shorter of two near lines that this line may be in: its first and last s // 2 words."""
    import xxhash

    out = []
    for s in (n, n - 1):
        if s < least:
            out += [0, 0]
            continue
        h = s // 2
        out.append(xxhash.xxh64_intdigest(joined[: ends[h - 1]], 2 * s))
        out.append(xxhash.xxh64_intdigest(joined[ends[n - h - 1] + 1 :], 2 * s + 1))
    return out


def keyed_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """LINE rows of all lines that have a word. ``known``: an equal line stands before it in the same batch; such rows
    get a key of their own, so that a very common line doesn't gather in one task, and have the line's key at h1."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(np.array([-(1 << 63) if d is None else d for d in batch.column(0).to_pylist()], np.int64), kind="stable").tolist()
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            seen: dict[bytes, tuple] = {}
            keys, rows = [], []
            for i in order:
                for number, line in enumerate((texts[i].as_py() or "").encode("utf-8", "replace").split(b"\n")):
                    words = line.split()
                    if not words:
                        continue
                    joined, n = b" ".join(words), len(words)
                    key = xxhash.xxh3_128_digest(joined)
                    place = (-(1 << 63) if ids[i] is None else ids[i], number)
                    if seen.get(key) == place and ids[i] is not None:
                        continue  # the same line of a repeated row
                    if key in seen and seen[key] <= place:
                        rows.append((ids[i], number, True, int.from_bytes(key[:8], "little"), 0, 0, 0))
                        keys.append(xxhash.xxh3_128_digest(b"%r %d " % (ids[i], number) + key))
                        continue
                    seen[key] = place
                    halves = [0] * 4
                    if n >= min_words - 1:
                        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1).tolist()
                        halves = _half_keys(joined, ends, n, min_words - 1)
                    rows.append((ids[i], number, False, *halves))
                    keys.append(key)
            k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            columns = [pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.bool_())]
            columns += [pa.array(np.array([r[j] for r in rows], np.uint64).view(np.int64)) for j in range(3, 7)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LINE.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LINE)


def exact(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """(doc_id, line, k, first, h1..h4) of all lines, k being a hash of its words: ``first`` marks the earliest of equal ones,
    by doc_id (null first), then line. Equal lines at the same number of rows that repeat a doc_id are one line."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = [c.split()[0] for c in LINE.split(", ")]
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, known, h1 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4, 5))
            doc, line = np.array(batch.column(2).fill_null(-(1 << 63))), np.array(batch.column(3)).astype(np.int64)
            rows = np.stack([k1, k2, doc, line], axis=1)
            before = np.concatenate([rows[:1] if last is None else last, rows[:-1]])
            same = (rows[:, :2] == before[:, :2]).all(axis=1)
            again = same & (rows[:, 2:] == before[:, 2:]).all(axis=1) & np.array(batch.column(2).is_valid())
            if last is None:
                same[0] = again[0] = False
            last = rows[-1:]
            out = [batch.column(2), batch.column(3), pa.array(np.where(known, h1, k1)), pa.array(~same & ~known), pa.array(np.where(known, 0, h1)), *(batch.column(i) for i in range(6, 9))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "line", "k", "first", *names[5:]]).filter(pa.array(~again))

    rows = keyed_lines(docs, min_words).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "doc_id", "line")
    return materialize(rows.mapInArrow(run, "doc_id long, line int, k long, first boolean, h1 long, h2 long, h3 long, h4 long"), "lines")


def _sharing(lines: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, line, k) of the first lines that share a half key with another."""
    keys = lines.where("first and doc_id is not null").select("doc_id", "line", "k", F.explode(F.array("h1", "h2", "h3", "h4")).alias("h")).where("h <> 0")

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for h, doc, line, k in _runs(batches, ("h", "doc_id", "line", "k"), lambda now: [0], run_rows):
            same = np.concatenate([[False], h[1:] == h[:-1]])
            at = np.flatnonzero(same | np.append(same[1:], False))
            rows = np.unique(np.stack([doc[at], line[at].astype(np.int64), k[at]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2].copy())], names=["doc_id", "line", "k"])

    return keys.repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc_id long, line int, k long").distinct()


def _key(line: bytes) -> int | None:
    """The hash of a line's words, as ``exact`` has it; None for a line without words."""
    import xxhash

    words = line.split()
    return int.from_bytes(xxhash.xxh3_128_digest(b" ".join(words))[:8], "little", signed=True) if words else None


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, line, k, text) of the ``wanted`` lines."""
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line", "k")).alias("lines"))  # as many as a document's lines
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc, wanted, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lines", "text")), strict=True):
                lines = (text or "").encode("utf-8", "replace").split(b"\n")
                for w in wanted:
                    if w["line"] < len(lines) and _key(lines[w["line"]]) == w["k"]:
                        out.append((doc, w["line"], w["k"], lines[w["line"]].decode()))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "line", "k", "text"])

    return text.join(by_doc, "doc_id").mapInArrow(run, "doc_id long, line int, k long, text string").dropDuplicates(["doc_id", "line", "k"])


def _neighbourhood(lines: DataFrame, min_words: int) -> DataFrame:
    """(key, place, doc_id, line): a line's own key at place -1, and for each place the key of the line without that word."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        base = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc, number, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "line", "text")), strict=True):
                words = text.encode("utf-8", "replace").split()
                n = len(words)
                w = np.fromiter((xxhash.xxh64_intdigest(x) for x in words), np.uint64, n) | np.uint64(1)
                power = np.cumprod(np.full(n + 1, base, np.uint64))
                before = np.concatenate([[np.uint64(0)], np.cumsum(w * power[:n])])
                # Words after the missing one move a place down: their part of the sum, counted with one power less.
                after = np.concatenate([np.cumsum((w[1:] * power[: n - 1])[::-1])[::-1], [np.uint64(0)]])
                keys, places = [np.uint64(before[n])], [-1]
                hashes = np.array(keys, np.uint64)
                if n >= min_words:
                    hashes = np.concatenate([hashes, before[:n] + after])
                    places = np.arange(-1, n)
                size = np.where(np.asarray(places) < 0, n, n - 1).astype(np.uint64)
                hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + size
                out[0].append(hashes.view(np.int64))
                out[1].append(np.asarray(places, np.int32))
                out[2].append(np.full(len(hashes), doc, np.int64))
                out[3].append(np.full(len(hashes), number, np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "place", "doc_id", "line"])

    return lines.mapInArrow(run, "key long, place int, doc_id long, line int")


def _carried(now) -> list:
    """Of a split run: its first row, the earliest row of its last place, and its earliest line without a word."""
    import numpy as np

    _, place, doc, line = now
    rows = {0, int(np.searchsorted(place, place[-1]))}
    part = np.flatnonzero(place != -1)
    if len(part):
        part = part[doc[part] == doc[part].min()]
        rows.add(int(part[np.argmin(line[part])]))
    return sorted(rows)


def _candidates(keys: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, line, doc_0, line_0): a later and an earlier line that meet at a key as near lines must."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for key, place, doc, line in _runs(batches, ("key", "place", "doc_id", "line"), _carried, run_rows):
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new_key)
            run_of = np.cumsum(new_key) - 1
            if len(first) == len(key):
                continue
            new_place = new_key | np.concatenate([[True], place[1:] != place[:-1]])
            lead = np.maximum.accumulate(np.where(new_place, np.arange(len(key)), 0))  # earliest of the same key and place
            rank = np.empty(len(key), np.int64)
            rank[np.lexsort((line, doc))] = np.arange(len(key))
            own = first[run_of]
            whole = place[own] == -1  # the run has a line that is itself the key
            pairs = [(np.flatnonzero(lead != np.arange(len(key))), None)]
            a = pairs[0][0]
            found = [(a, lead[a])]
            b = np.flatnonzero(whole & (place != -1))
            found.append((b, own[b]))
            best = np.minimum.reduceat(np.where(place == -1, len(key), rank), first)
            by_rank = np.empty(len(key) + 1, np.int64)
            by_rank[rank], by_rank[len(key)] = np.arange(len(key)), -1
            c = first[(place[first] == -1) & (best < len(key))]
            found.append((c, by_rank[best[run_of[c]]]))
            late, early = (np.concatenate(x) for x in zip(*found, strict=True))
            later = rank[early] < rank[late]
            late, early = late[later], early[later]
            rows = np.unique(np.stack([doc[late], line[late].astype(np.int64), doc[early], line[early].astype(np.int64)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2].copy()), pa.array(rows[:, 3].astype(np.int32))], names=["doc_id", "line", "doc_0", "line_0"])

    return keys.repartition("key").sortWithinPartitions("key", "place", "doc_id", "line").mapInArrow(run, "doc_id long, line int, doc_0 long, line_0 int").distinct()


def within_one(a: list, b: list) -> bool:
    """True if one insertion, deletion or replacement at most turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def near(docs: DataFrame, lines: DataFrame, min_words: int = 5) -> DataFrame:
    """(doc_id, line, k) of first lines that an earlier line is near."""
    texts = materialize(_texts(docs, _sharing(lines)), "line-texts")
    met = _candidates(_neighbourhood(texts, min_words))
    other = texts.select(F.col("doc_id").alias("doc_0"), F.col("line").alias("line_0"), F.col("text").alias("text_0"))
    apart = met.where("doc_id <> doc_0 or line <> line_0")  # else lines of rows that repeat a doc_id, neither of which is earlier
    both = apart.join(texts, ["doc_id", "line"]).join(other, ["doc_0", "line_0"]).select("doc_id", "line", "k", "text", "text_0")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            split = [[(x or "").encode("utf-8", "replace").split() for x in batch.column(c).to_pylist()] for c in ("text", "text_0")]
            good = [within_one(a, b) and max(len(a), len(b)) >= min_words for a, b in zip(*split, strict=True)]
            yield batch.select(["doc_id", "line", "k"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "doc_id long, line int, k long").distinct()


def dropped_lines(docs: DataFrame, min_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, line, k, first), and those to drop (doc_id, line, k, near); k is a hash of the line's words.

    Lines without a word are no lines here and stay. An earlier line is one of a smaller doc_id, or of a smaller line
    number in the same document; a null doc_id comes first, and its lines are matched by equality alone. Rows that
    repeat a doc_id are one document: their equal lines at the same number are one line, which all of them keep or lose;
    unequal ones at the same number are not held against each other, as neither is earlier.
    """
    lines = exact(docs, min_words)
    close = near(docs, lines, min_words).withColumn("near", F.lit(True))
    return lines, lines.where(~F.col("first")).select("doc_id", "line", "k", F.lit(False).alias("near")).unionByName(close)


def report(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_equal, n_near, dropped): counts of lines with words, of dropped ones by reason, and the
    numbers of the dropped lines, from 0. Every different doc_id has a row."""
    lines, gone = dropped_lines(docs, min_words)
    count = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    lost = gone.groupBy("doc_id").agg(F.count_if(~F.col("near")).alias("n_equal"), F.count_if("near").alias("n_near"), F.array_sort(F.collect_set("line")).alias("dropped"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    count, lost = count.withColumnRenamed("doc_id", "d"), lost.withColumnRenamed("doc_id", "e")
    out = ids.join(count, ids.doc_id.eqNullSafe(count.d), "left").join(lost, ids.doc_id.eqNullSafe(lost.e), "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_equal", "n_near")], F.array_join(F.coalesce("dropped", F.array().cast("array<int>")), ",").alias("dropped"))


def remove(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``docs`` without the dropped lines; texts that lose none stay as they are. Rows without doc_id keep their lines."""
    _, gone = dropped_lines(docs, min_words)
    lost = gone.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list(F.struct("line", "k")).alias("__gone")).withColumnRenamed("doc_id", "__id")
    at = docs.columns.index("text")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                if gone and text is not None:
                    lines, drop = text.split("\n"), {(g["line"], g["k"]) for g in gone}
                    numbers = {n for n, _ in drop}
                    text = "\n".join(x for n, x in enumerate(lines) if n not in numbers or (n, _key(x.encode("utf-8", "replace"))) not in drop)
                texts.append(text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    rows = docs.withColumn("text", F.col("text").cast("string"))
    joined = rows.join(lost, F.col("doc_id").cast("long") == F.col("__id"), "left").select(*rows.columns, "__gone")
    return joined.mapInArrow(run, rows.schema)
