"""Ranked lexical search over an index that is laid out by the length normaliser of documents.

All documents of one normaliser m form a stratum, as there the impact of a term depends on its frequency tf alone. A
stratum is cut into blocks of bounded size by a hash, so that any share of the documents may have one length. A block has
a row for each term: its documents by tf, highest first. So an impact is worked out once for each tf of a term, and the
highest tf of the terms bounds what a stratum can add to a query. Strata are visited by these bounds: the best of each
query first, which gives the score that a document must reach; then those whose bound reaches it, best first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, materialize, numbered

#: What stands between terms; all else, letters of A to Z lowered, belongs to terms.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = "m long, slice int, term binary, n_docs long, top_tf long, tfs array<int>, counts array<int>, docs array<int>, ids array<long>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table() -> bytes:
    letters = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
    low = [c + 32 if 65 <= c <= 90 else c for c in range(256)]
    return bytes(c if c in letters else 32 for c in low)


_TABLE = _table()


def term_count(text: bytes) -> int:
    return len(text.translate(_TABLE).split())


def impact(tf: Column, m: Column) -> Column:
    """(1000000000 * tf) div (1000 * tf + 8 * m)."""
    top, below = 1_000_000_000 * tf.cast("long"), 1000 * tf.cast("long") + 8 * m
    return ((top - top % below) / below).cast("long")


class StratifiedIndex:
    """The index of ``docs(doc_id, text)`` as a written table, with the number N of documents that have terms and L of their terms.

    Every row of ``docs`` counts as a document of its own, also of repeated or null doc_id; rows without terms (null,
    empty) stand in no stratum. ``block_terms`` and ``block_docs`` bound a block, but for what hashing adds and for a single document.
    """

    def __init__(self, docs: DataFrame, block_terms: int = 1 << 20, block_docs: int = 4096, id_col: str = "doc_id", text_col: str = "text"):
        lengths = materialize(counted(docs, term_count, text_col).where("n > 0").groupBy("n").agg(F.count("*").alias("docs")), "lengths")
        rows = counted(docs, term_count, text_col, True, doc_id=F.col(id_col).cast("long")).where("n > 0")
        self.n_docs, self.n_terms = (int(x or 0) for x in lengths.agg(F.sum("docs"), F.sum(F.col("docs") * F.col("n"))).first())
        m = F.lit(0) if not self.n_docs else F.expr(f"25 + (75L * n * {self.n_docs}L) div {self.n_terms}L")
        slices = F.ceil(F.greatest(F.sum(F.col("docs") * F.col("n")) / block_terms, F.sum("docs") / block_docs)).cast("int")
        strata = materialize(lengths.groupBy(m.cast("long").alias("m")).agg(slices.alias("slices")), "strata")
        spread = F.xxhash64(F.monotonically_increasing_id())  # any spread gives the same results; copies and null ids spread as well
        dealt = rows.select("doc_id", "text", m.cast("long").alias("m"), spread.alias("h")).join(strata, "m")
        dealt = dealt.select("m", F.pmod("h", "slices").cast("int").alias("slice"), "doc_id", "text").repartition("m", "slice").sortWithinPartitions("m", "slice")
        self.rows = materialize(dealt.mapInArrow(_blocks, BLOCK), "stratified")

    def weights(self, asked: DataFrame) -> DataFrame:
        """(term, w) of the terms of ``asked`` that stand in documents."""
        df = self.rows.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
        return df.select("term", F.floor(1000 * F.log((2.0 * self.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w"))

    def search(self, queries: DataFrame, k: int = 10, first: int = 2, chunk: int = 256, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """(item_id, rank, doc_id, score): for each row of ``queries`` its ``k`` best documents of score above 0, equal scores
        by doc_id (null last). Null texts ask for nothing; repeated rows repeat their answers.

        A score sums w * impact over the query's terms, repeats included. ``chunk`` queries share a visit of a block.
        """
        terms = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER), F.lit(f"({TERM_PATTERN})"), F.lit(1))
        rows = materialize(numbered(queries.select(F.col(id_col).alias("item_id"), terms.alias("terms")), F.col("item_id").asc_nulls_last(), name="q"), "queries")
        asked = rows.select("q", F.explode("terms").alias("term")).groupBy("q", F.col("term").cast("binary").alias("term")).agg(F.count("*").alias("times"))
        asked = materialize(asked, "asked")
        gains = materialize(asked.join(self.weights(asked), "term").select("q", "term", (F.col("times") * F.col("w")).alias("gain")).where("gain > 0"), "gains")
        bounds = materialize(self.bounds(gains), "bounds")
        order = Window.partitionBy("q").orderBy(F.col("bound").desc(), "m")
        early = bounds.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= first).select("q", "m", "bound", F.lit(0).cast("long").alias("least"))
        found = materialize(self._visit(early, gains, k, chunk), "early")
        least = _best(found, k).where(F.col("rank") == k).select("q", F.col("score").alias("least"))
        late = bounds.join(least, "q", "left").withColumn("least", F.coalesce("least", F.lit(0))).where("bound >= least").join(early.select("q", "m"), ["q", "m"], "left_anti")
        self.visited = (bounds, early, late)
        best = _best(found.unionByName(self._visit(late.select("q", "m", "bound", "least"), gains, k, chunk)), k)
        return best.join(rows.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")

    def bounds(self, gains: DataFrame) -> DataFrame:
        """(q, m, bound): what a document of the stratum can score at most."""
        tops = self.rows.where("term is not null").join(gains.select("term").distinct(), "term", "left_semi").groupBy("m", "term").agg(F.max("top_tf").alias("tf"))
        most = F.col("gain") * impact(F.col("tf"), F.col("m"))
        return tops.join(gains, "term").groupBy("q", "m").agg(F.sum(most).alias("bound"))

    def _visit(self, visits: DataFrame, gains: DataFrame, k: int, chunk: int) -> DataFrame:
        """(q, doc_id, score) of documents that may be among the best, from ``visits(q, m, bound, least)``."""
        of = F.floor(F.col("q") / chunk)
        group = visits.withColumn("chunk", of).groupBy("chunk", "m").agg(F.max("bound").alias("best"), F.collect_list(F.struct("q", "least")).alias("asks"))
        group = materialize(group, "visits")
        wanted = gains.withColumn("chunk", of).groupBy("chunk", "term").agg(F.collect_list(F.struct("q", F.col("gain").alias("least"))).alias("asks"))
        lists = self.rows.where("term is not null").join(materialize(wanted, "wanted"), "term").join(group.select("chunk", "m", "best"), ["chunk", "m"])
        heads = self.rows.where("term is null").join(group, "m")
        columns = ["chunk", "best", "m", "slice", "term", "tfs", "counts", "docs", "ids", "asks"]
        both = lists.select(*columns).unionByName(heads.select(*columns)).repartition("chunk", "m", "slice")
        both = both.sortWithinPartitions("chunk", F.col("best").desc(), "m", "slice", F.col("term").asc_nulls_first())

        def run(batches) -> Iterator:
            return _scores(batches, k)

        return both.mapInArrow(run, "q long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(batches) -> Iterator:
    """Rows of BLOCK for documents that come block by block: one with its ids, then one a term."""
    from collections import Counter
    from itertools import chain

    import numpy as np
    import pyarrow as pa

    def flush(m, slice_, ids, counters):
        # Postings by term, then highest tf, then document.
        sizes = np.fromiter(map(len, counters), np.int64, len(counters))
        names = sorted(set(chain.from_iterable(counters)))
        number = {t: i for i, t in enumerate(names)}
        total = int(sizes.sum())
        term = np.fromiter((number[t] for c in counters for t in c), np.int64, total)
        tf = np.fromiter(chain.from_iterable(c.values() for c in counters), np.int64, total)
        doc = np.repeat(np.arange(len(counters)), sizes)
        order = np.lexsort((-tf, term))  # stable, so documents ascend
        term, tf, doc = term[order], tf[order], doc[order]
        of_term = np.searchsorted(term, np.arange(len(names) + 1))
        group = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
        of_group = np.searchsorted(term[group], np.arange(len(names) + 1))
        lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))
        n, names_of = len(names), [c.split()[0] for c in BLOCK.split(", ")]
        none = lambda kind: pa.nulls(n, kind)
        head = [[m], [slice_], [None], [len(ids)], [None], [None], [None], [None], [ids]]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(head, kinds, strict=True)], names=names_of)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n, m)), pa.array(np.full(n, slice_, np.int32)), pa.array(names, pa.binary()), pa.array(np.diff(of_term)), pa.array(tf[of_term[:-1]]),
            lists(of_group, tf[group]), lists(of_group, np.diff(np.append(group, total))), lists(of_term, doc), none(kinds[-1]),
        ], names=names_of)

    now, ids, counters = None, [], []
    for batch in batches:
        for m, slice_, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
            if (m, slice_) != now:
                if ids:
                    yield from flush(*now, ids, counters)
                now, ids, counters = (m, slice_), [], []
            ids.append(doc_id)
            counters.append(Counter(text.translate(_TABLE).split()))
    if ids:
        yield from flush(*now, ids, counters)


def _scores(batches, k: int) -> Iterator:
    """The best ``k`` documents of each query in the blocks of a task. A block's first row has its ids and the queries."""
    import numpy as np
    import pyarrow as pa

    best: dict[int, tuple] = {}  # by query: scores, ids and null flags, the best first

    def offer(q, ids, missing, scores, bar):
        good = np.flatnonzero(scores >= max(bar, 1))
        if len(good) > k:
            bar = np.partition(scores[good], len(good) - k)[len(good) - k]
            good = good[scores[good] >= bar]
        if not len(good):
            return
        rows = [scores[good], ids[good], missing[good]]
        if q in best:
            rows = [np.concatenate(x) for x in zip(best[q], rows, strict=True)]
        order = np.lexsort((rows[1], rows[2], -rows[0]))[:k]
        best[q] = tuple(x[order] for x in rows)

    def block(m, parts):
        head, parts = parts[0], parts[1:]
        ids, missing, asking, least = head
        if not parts:
            return
        tfs, counts, docs, q, gain = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3, 4))
        groups, sizes, asks = (np.concatenate([p[i] for p in parts]) for i in (5, 6, 7))  # a term's tf groups, documents, queries
        value = 1_000_000_000 * tfs // (1000 * tfs + 8 * m)
        each = np.repeat(value, counts)
        first = np.concatenate([[0], np.cumsum(groups)[:-1]])
        row = np.searchsorted(asking, q)
        row = np.where(asking[np.minimum(row, len(asking) - 1)] == q, row, -1)
        term = np.repeat(np.arange(len(asks)), asks)
        bound = np.zeros(len(asking), np.int64)
        np.add.at(bound, row[row >= 0], (gain * value[first[term]])[row >= 0])
        bar = np.array([max(low, int(best[a][0][-1]) if a in best and len(best[a][0]) == k else 0) for a, low in zip(asking.tolist(), least.tolist(), strict=True)])
        alive = (bound >= bar) & (bound > 0)
        use = np.flatnonzero((row >= 0) & alive[row])
        if not len(use):
            return
        n, start = len(ids), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.cumsum(alive) - 1
        score = np.zeros(int(alive.sum()) * n, np.int64)
        row, term, gain = at[row[use]], term[use], gain[use]
        length = sizes[term]
        for p in np.flatnonzero(length > 200).tolist():  # long lists one by one, short ones together
            a = start[term[p]]
            own = slice(a, a + length[p])
            score[row[p] * n + docs[own]] += gain[p] * each[own]
        short = np.flatnonzero(length <= 200)
        for lo in range(0, len(short), 20_000):
            p = short[lo : lo + 20_000]
            size = length[p]
            place = np.repeat(start[term[p]] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            np.add.at(score, np.repeat(row[p] * n, size) + docs[place], np.repeat(gain[p], size) * each[place])
        score = score.reshape(-1, n)
        for i in np.flatnonzero(alive).tolist():
            offer(int(asking[i]), ids, missing, score[at[i]], int(bar[i]))

    def flat(column):
        """Offsets and values of a list column; a null list is empty."""
        size = np.array(column.value_lengths().fill_null(0))
        return np.concatenate([[0], np.cumsum(size)]), column.flatten()

    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk, m, slice_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "m", "slice"))
        (tf_at, tfs), (_, counts), (doc_at, docs), (id_at, ids), (ask_at, asks) = (flat(batch.column(c)) for c in ("tfs", "counts", "docs", "ids", "asks"))
        tfs, counts, docs = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (tfs, counts, docs))
        missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        asker, least = (asks.field(c).to_numpy(zero_copy_only=False) for c in ("q", "least"))
        heads = batch.column("term").is_null().to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (m[1:] != m[:-1]) | (slice_[1:] != slice_[:-1])]))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(m)], strict=True):
            key = (chunk[a], m[a], slice_[a])
            if key != now:
                if parts:
                    block(int(now[1]), parts)
                now, parts = key, []
            if heads[a]:
                own, of = slice(id_at[a], id_at[a + 1]), slice(ask_at[a], ask_at[a + 1])
                order = np.argsort(asker[of])
                parts.append((ids[own], missing[own], asker[of][order], least[of][order]))
                a += 1
            if a < b:
                t, d, q = slice(tf_at[a], tf_at[b]), slice(doc_at[a], doc_at[b]), slice(ask_at[a], ask_at[b])
                parts.append((tfs[t], counts[t], docs[d], asker[q], least[q], *(np.diff(x[a : b + 1]) for x in (tf_at, doc_at, ask_at))))
    if parts:
        block(int(now[1]), parts)
    for q, (scores, ids, missing) in best.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q)), pa.array(ids, mask=missing), pa.array(scores)], names=["q", "doc_id", "score"])
