"""A kept keyword index over several fields, with segments, tombstones, compaction and exact search that skips blocks.

A segment holds the documents of one commit in blocks, a row each: keys, lengths, the block's terms, and postings by term as
numbers: which documents of the block hold it, how often, and at which places of which field. For each term a block keeps
how many documents hold it, its highest frequency and least length, which bound what a document of the block can score. A
posting is never a row, so none is shuffled: a task cuts its texts and writes their blocks. A commit writes a segment and
its tombstones, the keys that it replaces or deletes, then moves a pointer to the new list of segments; readers see whole
commits. Compaction writes what lives into one segment, a pass over the blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.operators import blocks as D
from corvid.operators.search import ranked, small
from corvid.sinks import render as R

#: Words of a block, unless one document alone has more.
BLOCK_WORDS = 1 << 21
#: Columns of numbers for each document, term, posting (a term of a document) and place, as bytes.
NUMBERS = {"lengths": "i4", "holds": "i4", "top_tf": "i4", "least_dl": "i4", "docs": "i4", "tf": "i4", "fields": "u1", "at": "i4"}


def _block(keys, lengths, terms, codes, docs, fields, at):
    """The row of a block, from its words: number of the term, number of the document, field and place in the field.

    Words come by document, field and place.
    """
    import numpy as np
    import pyarrow as pa

    order = np.argsort(codes, kind="stable")
    codes, docs = codes[order], docs[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (docs[1:] != docs[:-1])
    first = np.nonzero(new)[0]
    tf, codes, docs = np.diff(np.append(first, len(new))), codes[first], docs[first]
    holds = np.bincount(codes, minlength=len(terms))  # every term has a word, so no stretch is empty
    starts = np.cumsum(holds) - holds
    top = np.maximum.reduceat(tf, starts) if len(starts) else tf
    least = np.minimum.reduceat(lengths[docs], starts) if len(starts) else tf
    numbers = dict(zip(NUMBERS, (lengths, holds, top, least, docs, tf, fields[order], at[order]), strict=True))
    columns = {"block": pa.array([uuid.uuid4().hex]), "keys": pa.array([keys.to_pylist()], pa.list_(keys.type)), "n_words": pa.array([int(lengths.sum())], pa.int64()), "terms": pa.array([terms], pa.list_(pa.string()))}
    columns |= {c: pa.array([numbers[c].astype(kind).tobytes()], pa.binary()) for c, kind in NUMBERS.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _schema(key_type: str) -> str:
    return f"block string, keys array<{key_type}>, n_words long, terms array<string>, {', '.join(f'{c} binary' for c in NUMBERS)}"


def _numbers(batch, i: int, *names: str) -> tuple:
    """Columns of row ``i`` of a batch of blocks as arrays of numbers."""
    import numpy as np

    return tuple(np.frombuffer(batch.column(c)[i].as_buffer(), NUMBERS[c]).astype(np.int64) for c in names)


def _living(batch, i: int, n: int):
    """Which of the ``n`` documents of row ``i`` live."""
    import numpy as np

    live = np.ones(n, bool)
    if "gone" in batch.schema.names and batch.column("gone")[i].is_valid:
        live[batch.column("gone")[i].values.to_numpy(zero_copy_only=False)] = False
    return live


def _words(batch, i: int):
    """(keys, lengths, terms, codes, docs, fields, at) of the living documents of row ``i``; documents and terms are
    numbered anew, words come by term."""
    import numpy as np
    import pyarrow as pa

    keys, terms = batch.column("keys")[i].values, batch.column("terms")[i].values
    lengths, holds, docs, tf, fields, at = _numbers(batch, i, "lengths", "holds", "docs", "tf", "fields", "at")
    live = _living(batch, i, len(keys))
    codes, docs = np.repeat(np.repeat(np.arange(len(terms)), holds), tf), np.repeat(docs, tf)
    stay = live[docs]
    held, codes = np.unique(codes[stay], return_inverse=True)
    return keys.filter(pa.array(live)), lengths[live], terms.take(pa.array(held)), codes, (np.cumsum(live) - 1)[docs[stay]], fields[stay], at[stay]


class KeywordIndex:
    """The index at ``root`` of documents with a ``key`` and text ``fields``.

    A document is one row of a commit; rows without key are left out, and of rows that repeat a key in one commit one
    counts. Null fields have no terms; a document without any term is counted, and found by nothing.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, fields: Sequence[str], block_docs: int = 4096):
        self.spark, self.root, self.key, self.fields, self.block_docs = spark, root.rstrip("/"), key, tuple(fields), block_docs

    def _segments(self) -> list:
        """Segments of the current list: as many as commits since the last compaction."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return R.current(self.spark, self.root).orderBy("seq").collect()

    def _read(self, table: str, segments: Sequence) -> DataFrame | None:
        out = None
        for s in segments:
            df = self.spark.read.parquet(f"{self.root}/segments/{s.segment}/{table}").withColumn("seq", F.lit(s.seq))
            out = df if out is None else out.unionByName(df)
        return out

    def _dead(self, segments: Sequence) -> DataFrame | None:
        """(key, dead): rows of a key in segments before ``dead`` are no more; one row a key."""
        stones = self._read("tombstones", [s for s in segments if s.tombstones])
        return None if stones is None else stones.groupBy(self.key).agg(F.max("seq").alias("dead"))

    def _documents(self, segments: Sequence) -> DataFrame:
        """(key, dl, seq) of all documents of ``segments`` that live."""
        kind = self._read("postings", segments).schema["keys"].dataType.elementType.simpleString()
        key = self.key

        def run(batches) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for i in range(b.num_rows):
                    keys = b.column("keys")[i].values
                    yield pa.RecordBatch.from_arrays([keys, pa.array(_numbers(b, i, "lengths")[0]), pa.array([b.column("seq")[i].as_py()] * len(keys), pa.int32())], names=[key, "dl", "seq"])

        rows = self._read("postings", segments).select("keys", "lengths", "seq").mapInArrow(run, f"{key} {kind}, dl long, seq int")
        dead = self._dead(segments)
        if dead is None:
            return rows
        return rows.join(dead, key, "left").where("dead is null or seq >= dead").drop("dead")

    def documents(self) -> DataFrame:
        """(key, dl, seq) of all documents that live."""
        return self._documents(self._segments())

    def _blocks(self, segments: Sequence, *columns: str) -> DataFrame:
        """Blocks of ``segments``, with ``gone``, the numbers of their documents that don't live (null: all live), if any."""
        blocks, dead = self._read("postings", segments), self._dead(segments)
        rows = blocks.select("seq", "block", *columns)
        if dead is None:
            return rows
        at = blocks.select("seq", "block", F.posexplode("keys").alias("i", self.key)).join(dead, self.key).where("seq < dead")
        gone = at.groupBy("seq", "block").agg(F.collect_list("i").alias("gone"))  # of one block
        return rows.join(small(self._kept(gone, "gone")), ["seq", "block"], "left")

    def _commit(self, blocks: DataFrame, deleted: DataFrame | None, keep: list) -> None:
        """Writes a segment of ``blocks`` that replaces rows of its keys in ``keep`` and takes out those of ``deleted``."""
        segment, seq = uuid.uuid4().hex, max((s.seq for s in keep), default=-1) + 1
        at = f"{self.root}/segments/{segment}"
        # Rows are large, so the size of a row group is looked at with each.
        blocks.write.option("compression", "zstd").option("parquet.page.size.row.check.min", "1").parquet(f"{at}/postings")
        written = self.spark.read.schema(blocks.schema).parquet(f"{at}/postings")
        n, total = (x or 0 for x in written.agg(F.sum(F.size("keys")), F.sum("n_words")).first())
        gone = lost = 0
        if keep:
            stones = written.select(F.explode("keys").alias(self.key))
            if deleted is not None:
                stones = stones.unionByName(deleted.select(self.key).where(F.col(self.key).isNotNull()))
            old = self._documents(keep).join(stones.distinct(), self.key, "left_semi")
            old.select(self.key, "dl").write.parquet(f"{at}/tombstones")
            gone, lost = self.spark.read.parquet(f"{at}/tombstones").agg(F.count("*"), F.sum("dl")).first()
        rows = [*((s.segment, s.seq, s.docs, s.terms, s.tombstones) for s in keep), (segment, seq, n - gone, total - (lost or 0), gone)]
        R.publish(self.spark.createDataFrame(rows, "segment string, seq int, docs long, terms long, tombstones long").coalesce(1), self.root)

    def upsert(self, texts: DataFrame, deleted: DataFrame | None = None) -> None:
        """Puts documents in, each in place of any older one of its key, and takes out those of ``deleted(key)``."""
        key, kind, size = self.key, texts.schema[self.key].dataType.simpleString(), self.block_docs
        # Texts are shuffled, as rows of a key must meet; their words are not.
        rows = texts.where(F.col(key).isNotNull()).select(key, *[F.col(f).cast("string").alias(f"__{i}") for i, f in enumerate(self.fields)])
        rows = rows.repartition(key).sortWithinPartitions(key)
        terms = [F.coalesce(T.query_terms(F.col(f"__{i}")), F.array()) for i in range(len(self.fields))]
        cut = rows.select(F.col(key).alias("key"), *[t.alias(f"__{i}") for i, t in enumerate(terms)])
        n_fields = len(self.fields)

        def run(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            before = None
            for b in batches:
                keys = b.column("key").to_pylist()
                fresh = [k != p for k, p in zip(keys, [before, *keys], strict=False)]
                before = keys[-1] if keys else before
                b = b.filter(pa.array(fresh, pa.bool_()))
                sizes = np.stack([pc.list_value_length(b.column(f"__{i}")).to_numpy() for i in range(n_fields)], axis=1).astype(np.int64).reshape(-1, n_fields)
                lo, n = 0, np.cumsum(sizes.sum(axis=1))
                while lo < len(n):
                    most = np.searchsorted(n, (n[lo - 1] if lo else 0) + BLOCK_WORDS, "right")
                    hi = max(lo + 1, min(lo + size, int(most)))
                    yield one(b.slice(lo, hi - lo), sizes[lo:hi])
                    lo = hi

        def one(b, sizes):
            import numpy as np
            import pyarrow as pa

            fields = [b.column(f"__{i}").flatten() for i in range(n_fields)]
            words = pa.concat_arrays(fields).dictionary_encode()
            docs = np.concatenate([np.repeat(np.arange(len(sizes)), sizes[:, i]) for i in range(n_fields)])
            at = np.concatenate([np.arange(len(f)) - np.repeat(np.cumsum(s) - s, s) for f, s in zip(fields, sizes.T, strict=True)])
            names = np.repeat(np.arange(n_fields), [len(f) for f in fields])
            order = slice(None) if n_fields == 1 else np.argsort(docs, kind="stable")
            return _block(b.column("key"), sizes.sum(axis=1), words.dictionary, words.indices.to_numpy()[order], docs[order], names[order], at[order])

        self._commit(cut.mapInArrow(run, _schema(kind)), deleted, self._segments())

    def _packed(self, blocks: DataFrame) -> DataFrame:
        """Blocks of what lives in ``blocks``: each task joins those that it reads as long as they stay within a block's size."""
        size, kind = self.block_docs, blocks.schema["keys"].dataType.elementType.simpleString()

        def run(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa

            held: list[tuple] = []

            def out():
                words = pa.chunked_array([h[2].take(pa.array(h[3])) for h in held]).combine_chunks().dictionary_encode()
                starts = np.cumsum([0, *(len(h[0]) for h in held)])
                docs = np.concatenate([h[4] + s for h, s in zip(held, starts, strict=False)])
                fields, at = (np.concatenate([h[j] for h in held]) for j in (5, 6))
                order = np.argsort(docs, kind="stable")  # a word's places in a document are in order already
                return _block(pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), words.dictionary, words.indices.to_numpy()[order], docs[order], fields[order], at[order])

            for b in batches:
                for i in range(b.num_rows):
                    new = _words(b, i)
                    if held and (sum(len(h[0]) for h in held) + len(new[0]) > size or sum(len(h[3]) for h in held) + len(new[3]) > BLOCK_WORDS):
                        yield out()
                        held = []
                    if len(new[0]):
                        held.append(new)
            if held:
                yield out()

        return blocks.mapInArrow(run, _schema(kind))

    def compact(self) -> None:
        """Writes all that lives into one segment, without tombstones, and makes it current. A failure leaves the old list."""
        segments = self._segments()
        if len(segments) < 2:
            return
        self._commit(self._packed(self._blocks(segments, "keys", "terms", *NUMBERS)), None, [])

    def _heads(self, segments: Sequence) -> DataFrame:
        """(seq, block, terms, holds, top_tf, least_dl) of all blocks; ``holds``, a list here, counts what lives."""
        blocks = self._blocks(segments, "terms", "lengths", "holds", "top_tf", "least_dl", "docs")

        def run(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for b in batches:
                for i in range(b.num_rows):
                    (holds,) = _numbers(b, i, "holds")
                    if "gone" in b.schema.names and b.column("gone")[i].is_valid:
                        lengths, docs = _numbers(b, i, "lengths", "docs")
                        terms = np.repeat(np.arange(len(holds)), holds)
                        holds = np.bincount(terms[_living(b, i, len(lengths))[docs]], minlength=len(holds))
                    own = [b.column(c).slice(i, 1) for c in ("seq", "block", "terms", "top_tf", "least_dl")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([holds], pa.list_(pa.int64()))], names=["seq", "block", "terms", "top_tf", "least_dl", "holds"])

        if "gone" not in blocks.columns:
            blocks = blocks.drop("docs", "lengths")
        return blocks.mapInArrow(run, "seq int, block string, terms array<string>, top_tf binary, least_dl binary, holds array<long>")

    def search(self, queries: DataFrame, k: int, every_term: bool = True, first: int = 4) -> DataFrame:
        """(query_id, key, score, rank): the ``k`` best documents by Okapi BM25 over all fields, for queries(query_id, text).

        Scores are rounded to 6 digits and ties go to the lower key. The ``first`` blocks of each query by their bound
        give the score to reach; of the others only those that may reach it are read. Queries meet a block's documents in
        a matrix product; only a task's best hits of a query leave it. ``visits`` keeps (all blocks of the query's terms,
        blocks read first, blocks read after).
        """
        segments, key = self._segments(), self.key
        n, total = sum(s.docs for s in segments), sum(s.terms for s in segments)
        mean = total / n if n and total else 1.0
        kind = queries.schema["query_id"].dataType.simpleString()
        asked = self._kept(queries.select("query_id", F.explode(T.query_terms(F.col("text"))).alias("term")).distinct(), "asked")
        heads = self._kept(self._heads(segments), "heads")
        held = heads.select(F.inline(F.arrays_zip("terms", "holds"))).join(small(asked.select(F.col("term").alias("terms")).distinct()), "terms", "left_semi")
        df = asked.join(held.groupBy(F.col("terms").alias("term")).agg(F.sum("holds").alias("df")), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        gains = df.select("query_id", "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("gain"))
        packs = self._kept(D.queries_packed(gains), "packs")
        packs = small(packs, 256)

        def bound(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for b in batches:
                for i in range(b.num_rows):
                    ids, needs, here, both, weights = _asked(b, i)
                    tf, dl = (x[here] for x in _numbers(b, i, "top_tf", "least_dl"))
                    most = weights @ D.okapi_part(tf, dl, mean)
                    found = (weights > 0).sum(axis=1)
                    at = np.nonzero(found == needs if every_term else found > 0)[0]
                    same = lambda c: pa.array([b.column(c)[i].as_py()] * len(at), b.column(c).type)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), same("q_block"), pa.array(at.astype(np.int32)), same("seq"), same("block"), pa.array(most[at])], names=["query_id", "q_block", "q", "seq", "block", "bound"])

        bounds = heads.drop("holds").crossJoin(packs).mapInArrow(bound, f"query_id {kind}, q_block long, q int, seq int, block string, bound double")
        bounds = self._kept(bounds, "bounds")
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "seq", "block"))
        early = bounds.withColumn("turn", turn).where(F.col("turn") <= first).drop("turn")
        own = self._read("postings", segments).schema["keys"].dataType.elementType.simpleString()
        blocks = self._blocks(segments, "keys", "lengths", "terms", "holds", "docs", "tf")

        def score(b, i: int):
            import numpy as np

            ids, needs, here, both, weights = _asked(b, i)
            keys, chosen = b.column("keys")[i].values, b.column("chosen")[i].values.to_numpy(zero_copy_only=False)
            lengths, holds, docs, tf = _numbers(b, i, "lengths", "holds", "docs", "tf")
            code = np.full(len(holds), -1)
            code[here] = np.arange(len(here))
            codes = np.repeat(code, holds)
            docs, tf, codes = docs[codes >= 0], tf[codes >= 0], codes[codes >= 0]
            live, weights, needs = _living(b, i, len(keys)), weights[chosen], needs[chosen]
            wants = (weights > 0).astype(np.float32)
            scores = np.full((len(ids), len(keys)), -np.inf)
            step = max(1, D.CELLS // max(1, len(here)))
            for lo in range(0, len(keys), step):
                hi = min(lo + step, len(keys))
                inside = (docs >= lo) & (docs < hi)
                dense = np.zeros((hi - lo, len(here)))
                dense[docs[inside] - lo, codes[inside]] = tf[inside]
                got = weights @ D.okapi_part(dense, lengths[lo:hi, None], mean).T
                hit = (wants @ (dense > 0).astype(np.float32).T == needs[:, None]) if every_term else got > 0
                scores[chosen, lo:hi] = np.where(hit & live[lo:hi], D.rounded(got), -np.inf)
            return b.column("q_block")[i].as_py(), ids, keys, scores

        def scored(visits: DataFrame) -> DataFrame:
            wanted = visits.groupBy("seq", "block", "q_block").agg(F.collect_list("q").alias("chosen"))  # of one block of queries
            pairs = blocks.join(small(wanted), ["seq", "block"]).join(packs, "q_block")
            return ranked(D.best_of(pairs, key, (kind, own), k, score), k, key)

        best = self._kept(scored(early), "early")
        least = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        late = bounds.join(least, "query_id", "left").where("least is null or bound >= least - 1e-6").join(early, ["query_id", "seq", "block"], "left_anti")
        self.visits = (bounds, early, late)
        return ranked(best.drop("rank").unionByName(scored(late).drop("rank")), k, key)

    def places(self, terms: DataFrame) -> DataFrame:
        """(term, key, field, at): each place of ``terms(term)`` in documents that live."""
        segments, key, names = self._segments(), self.key, self.fields
        blocks = self._blocks(segments, "keys", "terms", *NUMBERS)
        kind = blocks.schema["keys"].dataType.elementType.simpleString()
        held = self._read("postings", segments).select("seq", "block", F.explode("terms").alias("term")).join(small(terms.select("term").distinct()), "term", "left_semi")
        wanted = held.groupBy("seq", "block").agg(F.collect_list("term").alias("wanted"))  # of one block

        def run(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            for b in batches:
                for i in range(b.num_rows):
                    keys, _, own, codes, docs, fields, at = _words(b, i)
                    stay = np.nonzero(pc.is_in(own, value_set=b.column("wanted")[i].values).to_numpy(zero_copy_only=False)[codes])[0]
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(codes[stay])), keys.take(pa.array(docs[stay])), pa.array(names).take(pa.array(fields[stay])), pa.array(at[stay])], names=["term", key, "field", "at"])

        return blocks.join(small(wanted), ["seq", "block"]).mapInArrow(run, f"term string, {key} {kind}, field string, at long")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        folder = R.shared_folder(self.spark, name)
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)


def _asked(batch, i: int):
    """Of row ``i`` of blocks beside packs of queries: query ids, each one's number of terms, which terms of the block any
    asks for, their numbers in the pack, and weights of queries by these terms."""
    import numpy as np
    import pyarrow.compute as pc

    ids, asked = batch.column("q_ids")[i].values, batch.column("q_terms")[i].values
    at, codes, gains = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("q_at", "i4"), ("q_codes", "i4"), ("q_gains", "f8")))
    found = pc.fill_null(pc.index_in(batch.column("terms")[i].values, value_set=asked), -1).to_numpy()
    here = np.nonzero(found >= 0)[0]
    both = found[here]
    column = np.full(len(asked) + 1, -1)
    column[both] = np.arange(len(both))
    weights = np.zeros((len(ids), len(both)))
    own = column[codes]
    weights[at[own >= 0], own[own >= 0]] = gains[own >= 0]
    return ids, np.bincount(at, minlength=len(ids)), here, both, weights
