"""A kept vector index: lists around centroids, cut into blocks that distance bounds let a search skip.

A build fits centroids on a bounded sample, sends every vector to the list of its nearest centroid, and cuts a list, in
order of distance from the centroid, into blocks. Each block keeps its least and greatest distance from every centroid: by
the triangle inequality these bound the cosine that a query can have with anything in the block, so an exact search reads
only blocks whose bound reaches the k-th best score. An approximate search reads the lists of a query's nearest centroids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.search import ranked, small
from corvid.sinks import render as R

#: Scores are rounded to 6 digits; a block whose bound is this far below the score to reach can't change a result.
SLACK = 1e-6
SAMPLE_SLOTS = 1 << 20
#: Queries of a pack, and bytes of blocks and packs that a task of a search gets on average.
PACK, TASK_BYTES = 512, 32 << 20


def _unit(v: Column, dimensions: int) -> Column:
    """The unit vector in doubles; null for one of another length, without direction, or with a null or non-finite part."""
    x = F.transform(v, lambda e: e.cast("double"))
    square = F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e)
    fine = (F.size(v) == dimensions) & (square > 0) & (square < float("inf"))
    return F.when(fine, F.transform(x, lambda e: e / F.sqrt(square)))


def _far(x, centroids):
    """Distances of unit vectors ``x`` from each centroid."""
    import numpy as np

    return np.sqrt(np.maximum(1.0 + (centroids**2).sum(1)[None, :] - 2.0 * (x @ centroids.T), 0.0))


def _matrix(column, rows: int):
    """An Arrow list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class VectorIndex:
    """The index at ``root`` of vectors(key, v) of one length, ``dimensions``.

    Rows without key, and vectors of another length, null, zero or with a null or non-finite component, are in no list and
    found by nothing; queries like that find nothing. Rows that repeat a key are all kept. ``lists`` and ``sample_rows``
    bound what the fit sees and what a task holds of the centroids, whatever the number of vectors.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, dimensions: int, lists: int = 64, sample_rows: int = 65_536, block_rows: int = 1024):
        self.spark, self.root, self.key, self.dimensions = spark, root.rstrip("/"), key, dimensions
        self.lists, self.sample_rows, self.block_rows = lists, sample_rows, block_rows

    def build(self, vectors: DataFrame) -> str:
        """Writes a version of the index and makes it current; a failed build leaves the old one."""
        version = uuid.uuid4().hex
        at = f"{self.root}/versions/{version}"
        rows = vectors.where(F.col(self.key).isNotNull()).select(self.key, _unit(F.col("v"), self.dimensions).alias("x")).where("x is not null")
        rows.write.parquet(f"{at}/units")
        units = self.spark.read.schema(rows.schema).parquet(f"{at}/units")
        centroids = self._fit(units)
        table = [(i, [float(e) for e in row]) for i, row in enumerate(centroids)]
        self.spark.createDataFrame(table, "list int, centroid array<double>").coalesce(1).write.parquet(f"{at}/centroids")
        self._blocks(units, centroids).write.parquet(f"{at}/blocks")
        R.point(self.spark, self.root, version)
        return version

    def _fit(self, units: DataFrame):
        """Centroids of about ``sample_rows`` vectors, drawn by a hash of the key; never more than ``lists`` of them."""
        import numpy as np
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = units.count()
        if not n:
            return np.zeros((0, self.dimensions))
        slots = max(1, min(SAMPLE_SLOTS, self.sample_rows * SAMPLE_SLOTS // n))
        sample = units.where(F.pmod(F.xxhash64(self.key), F.lit(SAMPLE_SLOTS)) < slots)
        if sample.isEmpty():  # one key may repeat in every row
            sample = units.limit(1)
        distinct = sample.select("x").distinct().limit(max(self.lists, 1) + 1).collect()  # at most one row more than lists
        if self.lists < 2 or len(distinct) <= self.lists:
            return np.array(sorted(r.x for r in distinct)[: max(self.lists, 1)])
        fit = KMeans(k=self.lists, seed=7, maxIter=10, featuresCol="f").fit(sample.select(array_to_vector("x").alias("f")))
        return np.array(fit.clusterCenters())

    def _blocks(self, units: DataFrame, centroids) -> DataFrame:
        """(block, list, n, low, high, keys, x): a list is cut by distance, and among equal distances by key, so a list of
        any size, or of copies, is many tasks and blocks."""
        key, size, kind = self.key, self.block_rows, units.schema[self.key].dataType.simpleString()

        def place(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    far = _far(_matrix(b.column("x"), b.num_rows), centroids)
                    home = far.argmin(1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(far[np.arange(len(home)), home])], names=[key, "x", "list", "far"])

        def cut(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa

            home, keys, held = None, [], []

            def block():
                x = np.array(held)
                far = _far(x, centroids)
                values = [uuid.uuid4().hex, home, len(keys), far.min(0).tolist(), far.max(0).tolist(), keys, x.tobytes()]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(key_type), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["block", "list", "n", "low", "high", "keys", "x"])

            for b in batches:
                if not b.num_rows:
                    continue
                key_type = b.column(key).type
                for l, k, x in zip(b.column("list").to_pylist(), b.column(key).to_pylist(), _matrix(b.column("x"), b.num_rows), strict=True):
                    if held and (l != home or len(held) == size):
                        yield block()
                        keys, held = [], []
                    home = l
                    keys.append(k)
                    held.append(x)
            if held:
                yield block()

        placed = units.mapInArrow(place, f"{key} {kind}, x array<double>, list int, far double")
        dealt = placed.repartitionByRange("list", "far", key).sortWithinPartitions("list", "far", key)
        return dealt.mapInArrow(cut, f"block string, list int, n int, low array<double>, high array<double>, keys array<{kind}>, x binary")

    def _table(self, name: str) -> DataFrame:
        version = self.spark.read.text(f"{self.root}/CURRENT").first().value
        return self.spark.read.parquet(f"{self.root}/versions/{version}/{name}")

    def _centroids(self):
        import numpy as np

        rows = self._table("centroids").orderBy("list").collect()  # at most ``lists``
        return np.array([r.centroid for r in rows]).reshape(-1, self.dimensions)

    def _asked(self, queries: DataFrame) -> DataFrame:
        rows = queries.select("query_id", _unit(F.col("v"), self.dimensions).alias("x")).where("query_id is not null and x is not null")
        return self._kept(rows, "asked")

    def search(self, queries: DataFrame, k: int, first: int = 4) -> DataFrame:
        """(query_id, key, score, rank): exactly the ``k`` nearest by cosine for queries(query_id, v), ties to the lower key.

        The ``first`` blocks of each query by their bound give the score to reach; of the others those that may reach it
        are read. ``visits`` keeps (blocks read first, blocks read after) as rows (query_id, block).
        """
        asked = self._asked(queries)
        early = self._kept(ranked(self._bounds(asked.withColumn("least", F.lit(-2.0)), first), first, "block").select("query_id", "block"), "early")
        best = self._kept(self._scores(asked, early, k), "best")
        least = best.where(F.col("rank") == k).select("query_id", "score")
        open_ = asked.join(least, "query_id", "left").select("query_id", "x", (F.coalesce("score", F.lit(-2.0)) - SLACK).alias("least"))
        late = self._kept(self._bounds(open_, None).select("query_id", "block").join(early, ["query_id", "block"], "left_anti"), "late")
        self.visits = (early, late)
        return ranked(best.drop("rank").unionByName(self._scores(asked, late, k).drop("rank")), k, self.key)

    def probe(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """The same from the lists of the ``probes`` centroids nearest to a query alone: approximate, and exact with all lists."""
        centroids, asked = self._centroids(), self._asked(queries)
        kind = asked.schema["query_id"].dataType.simpleString()

        def nearest(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for b in batches:
                if b.num_rows and len(centroids):
                    order = np.argsort(_far(_matrix(b.column("x"), b.num_rows), centroids), axis=1, kind="stable")[:, :probes]
                    at = np.repeat(np.arange(b.num_rows), order.shape[1])
                    yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(at)), pa.array(order.ravel().astype(np.int32))], names=["query_id", "list"])

        lists = asked.mapInArrow(nearest, f"query_id {kind}, list int")
        visits = self._kept(lists.join(self._table("blocks").select("block", "list"), "list").select("query_id", "block"), "probed")
        self.visits = (visits, visits.limit(0))
        return self._scores(asked, visits, k)

    def _bounds(self, asked: DataFrame, first: int | None) -> DataFrame:
        """(query_id, block, score): the greatest cosine that each query of asked(query_id, x, least) can have in a block, where
        it reaches ``least``; only the ``first`` of a group of blocks, if given. Queries meet blocks' bounds in groups."""
        centroids, kind = self._centroids(), asked.schema["query_id"].dataType.simpleString()

        def packed_queries(batches) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for lo in range(0, b.num_rows, 512):
                    part = b.slice(lo, 512)
                    x = _matrix(part.column("x"), part.num_rows)
                    ids = part.column("query_id")
                    yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([_far(x, centroids).tobytes()], pa.binary()), pa.array([part.column("least").to_pylist()], pa.list_(pa.float64()))], names=["ids", "far", "least"])

        def packed_heads(batches) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    low, high = (_matrix(part.column(c), part.num_rows).tobytes() for c in ("low", "high"))
                    yield pa.RecordBatch.from_arrays([pa.array([part.column("block").to_pylist()], pa.list_(pa.string())), pa.array([low], pa.binary()), pa.array([high], pa.binary())], names=["blocks", "low", "high"])

        def meet(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for b in batches:
                for r in range(b.num_rows):
                    ids, blocks = b.column("ids")[r].values, b.column("blocks")[r].values
                    far, low, high = (np.frombuffer(b.column(c)[r].as_buffer()).reshape(n, -1) for c, n in (("far", len(ids)), ("low", len(blocks)), ("high", len(blocks))))
                    least = b.column("least")[r].values.to_numpy(zero_copy_only=False)
                    gap = np.zeros((len(ids), len(blocks)))
                    for j in range(far.shape[1]):
                        np.maximum(gap, far[:, j, None] - high[None, :, j], out=gap)
                        np.maximum(gap, low[None, :, j] - far[:, j, None], out=gap)
                    bound = 1.0 - gap**2 / 2.0
                    open_ = bound >= least[:, None]
                    if first is not None and len(blocks) > first:
                        top = np.argpartition(-bound, first - 1, axis=1)[:, :first]
                        chosen = np.zeros_like(open_)
                        np.put_along_axis(chosen, top, True, axis=1)
                        open_ &= chosen
                    a, c = np.nonzero(open_)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), blocks.take(pa.array(c)), pa.array(bound[a, c])], names=["query_id", "block", "score"])

        q = asked.select("query_id", "x", "least").mapInArrow(packed_queries, f"ids array<{kind}>, far binary, least array<double>")
        heads = self._table("blocks").select("block", "low", "high").mapInArrow(packed_heads, "blocks array<string>, low binary, high binary")
        return heads.crossJoin(small(q, 64)).mapInArrow(meet, f"query_id {kind}, block string, score double")

    def _scores(self, asked: DataFrame, visits: DataFrame, k: int) -> DataFrame:
        """The ``k`` best of each query in the blocks it visits. Queries of a block come in packs, dealt by block and by a
        hash of the query, so a block that many queries visit is several tasks. A block is copied as often as all queries
        make packs, and tasks are counted by what stands beside each other then, which is what their Python holds."""
        key, kind, d = self.key, asked.schema["query_id"].dataType.simpleString(), self.dimensions
        blocks = self._table("blocks").select("block", "keys", F.col("x").alias("m"))
        own = blocks.schema["keys"].dataType.elementType.simpleString()

        deals = max(1, -(-asked.count() // PACK))
        n = self._table("blocks").agg(F.sum("n")).first()[0] or 0
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * d * (n * deals + visits.count()) // TASK_BYTES))

        def pack(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                names, deal, x, ids = np.array(b.column("block").to_pylist()), b.column("deal").to_numpy(), _matrix(b.column("x"), b.num_rows), b.column("query_id")
                for edge in np.split(np.arange(len(names)), np.nonzero((names[1:] != names[:-1]) | (deal[1:] != deal[:-1]))[0] + 1):
                    for lo in range(0, len(edge), PACK):
                        at = edge[lo : lo + PACK]
                        yield pa.RecordBatch.from_arrays([pa.array([names[at[0]]], pa.string()), pa.array(deal[at[:1]]), pa.array([ids.take(pa.array(at)).to_pylist()], pa.list_(ids.type)), pa.array([x[at].tobytes()], pa.binary())], names=["block", "deal", "ids", "q"])

        def best(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for b in batches:
                for r in range(b.num_rows):
                    ids, keys = b.column("ids")[r].values, b.column("keys")[r].values
                    score = np.frombuffer(b.column("q")[r].as_buffer()).reshape(-1, d) @ np.frombuffer(b.column("m")[r].as_buffer()).reshape(-1, d).T
                    # What ties with the k-th after rounding stays.
                    least = np.partition(score, -k, axis=1)[:, -k] - SLACK if score.shape[1] > k else np.full(len(score), -np.inf)
                    a, c = np.nonzero(score >= least[:, None])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), keys.take(pa.array(c)), pa.array(score[a, c])], names=["query_id", key, "score"])

        key_ = "block", "deal"
        dealt = visits.join(asked, "query_id").withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(deals)).cast("int"))
        dealt = dealt.repartition(tasks, *key_).sortWithinPartitions(*key_)
        packs = dealt.select(*key_, "query_id", "x").mapInArrow(pack, f"block string, deal int, ids array<{kind}>, q binary")
        wide = blocks.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        # Both sides are dealt by count, so Spark doesn't join the small tasks that their bytes before the join suggest.
        pairs = packs.repartition(tasks, *key_).join(wide.repartition(tasks, *key_).hint("shuffle_hash"), [*key_])
        found = pairs.mapInArrow(best, f"query_id {kind}, {key} {own}, score double")
        return ranked(found.withColumn("score", F.round("score", 6)), k, key)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        folder = R.shared_folder(self.spark, name)
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)
