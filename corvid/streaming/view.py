"""The current table of a change log, kept by a stream: a base, deltas of later batches, and compaction by size.

Each micro-batch leaves a delta, the newest row of each of its keys, and then a pointer moves to the new list of files;
a batch that was committed before is left out when it is repeated. Once the deltas hold more than a share of the base,
base and deltas become a new base, so that each row is rewritten a bounded number of times as the table grows. Files never
change, so a reader that has read the list sees one state while batches commit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.sinks import render as R

PARTS = "part string, seq long, rows long, batch long"


class CompactedView:
    """The view at ``root`` of change rows with a ``key``, a ``version`` and ``deleted``.

    Of a key's rows the greatest version counts, of equal ones that of the later batch, and within a batch one of them, the
    same on each run. Null versions are the lowest, a null ``deleted`` is false, rows without key are left out. Deleted keys
    stay as such, so an older row that comes late doesn't bring them back. One stream writes a view at a time.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, version: str, deleted: str = "deleted", share: float = 0.5):
        self.spark, self.root, self.key, self.version, self.deleted, self.share = spark, root.rstrip("/"), key, version, deleted, share

    def parts(self) -> list:
        """The current list: a base, if there is one, and the deltas since."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return R.current(self.spark, self.root).orderBy("seq").collect()

    def _newest(self, rows: DataFrame, order: Column) -> DataFrame:
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != self.key]), order).alias("__r")).select(self.key, "__r.*")

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/parts/{part}")
        return part, self.spark.read.parquet(f"{self.root}/parts/{part}").count()

    def _publish(self, parts: list) -> None:
        R.publish(self.spark.createDataFrame(parts, PARTS).coalesce(1), self.root)

    def _union(self, parts: list) -> DataFrame:
        """Rows of parts with their ``__seq``."""
        out = None
        for p in parts:
            rows = self.spark.read.parquet(f"{self.root}/parts/{p.part}").withColumn("__seq", F.lit(p.seq))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def _merged(self, parts: list) -> DataFrame:
        return self._newest(self._union(parts), F.struct(self.version, "__seq")).drop("__seq")

    def commit(self, rows: DataFrame, batch: int) -> None:
        """Takes in a micro-batch; for ``foreachBatch``. A failed compaction leaves the list as it was, and the next commit tries again."""
        parts = self.parts()
        if parts and max(p.batch for p in parts) >= batch:
            return
        rows = rows.where(F.col(self.key).isNotNull())
        others = sorted(c for c in rows.columns if c not in (self.key, self.version))
        part, n = self._write(self._newest(rows, F.struct(self.version, F.xxhash64(*others))))
        seq = max((p.seq for p in parts), default=-1) + 1
        self._publish([*map(tuple, parts), (part, seq, n, batch)])
        if parts and sum(p.rows for p in parts[1:]) + n > self.share * parts[0].rows:
            self.compact()

    def compact(self) -> None:
        """Writes base and deltas as one base and makes it current."""
        parts = self.parts()
        if len(parts) > 1:
            part, n = self._write(self._merged(parts))
            self._publish([(part, parts[-1].seq, n, max(p.batch for p in parts))])

    def read(self) -> DataFrame:
        """The current rows, without the deleted ones. The list is read now; the rows are those of this list whenever they are."""
        parts = self.parts()
        if not parts:
            raise ValueError("nothing has been committed")
        rows = self._merged(parts) if len(parts) > 1 else self._union(parts).drop("__seq")
        return rows.where(~F.coalesce(F.col(self.deleted), F.lit(False)))
