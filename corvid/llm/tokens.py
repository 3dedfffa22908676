"""Token counts kept as roll-ups by deltas: inserts, deletes and revisions as signed additive rows, committed once."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe

SIGNED = "doc_id long, source string, lang string, version string, d_docs long, d_tokens long"


def count_words(text: str) -> int:
    """Tokens of version ``words-1``: runs of anything but ASCII white space."""
    return len(text.encode("utf-8", "replace").split())


def bpe_counter(ranks_path: str, pattern: str) -> Callable[[str], int]:
    """Tokens of a rank file's byte-level BPE."""
    return lambda text: len(bpe.encode(bpe.from_ranks(ranks_path, pattern), text))


def counted(docs: DataFrame, tokenizers: Mapping[str, Callable[[str], int]]) -> DataFrame:
    """A row (doc_id, source, lang, version, d_docs = 1, d_tokens) for each document and version. Null text: empty."""
    versions = sorted(tokenizers)

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            for v in versions:
                counts = np.fromiter(map(tokenizers[v], texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([v] * len(texts), pa.string()), pa.array(np.ones(len(texts), np.int64)), pa.array(counts)], names=["doc_id", "source", "lang", "version", "d_docs", "d_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, SIGNED)


class TokenRollup:
    """Totals by source, language and tokenizer version under ``path``.

    Each batch writes its signed rows by document and their sums, then renames a commit file to a name not taken yet;
    readers see committed batches alone, so a failed, repeated or concurrent attempt at a batch counts once or not at
    all. A delete takes back what the log holds for the document; a revision does so and adds the new counts. All
    totals are sums of deltas. A delete or revision takes back what is logged when it is applied, so batches that touch one
    document must come one after the other, in their order; batches of different documents may come in any order or at once.
    """

    def __init__(self, spark: SparkSession, path: str, tokenizers: Mapping[str, Callable[[str], int]]):
        self.spark, self.path, self.tokenizers = spark, path.rstrip("/"), dict(tokenizers)

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit_file(self, batch_id: str) -> str:
        return f"{self.path}/commits/{hashlib.sha256(batch_id.encode()).hexdigest()}"

    def committed(self, batch_id: str) -> bool:
        at, fs = self._fs(self._commit_file(batch_id))
        return fs.exists(at)

    def _attempts(self) -> list[str]:
        at, fs = self._fs(f"{self.path}/commits")
        if not fs.exists(at):
            return []
        return sorted(r.value for r in self.spark.read.text(f"{self.path}/commits").collect())

    def _read(self, kind: str) -> DataFrame:
        schema = SIGNED if kind == "log" else SIGNED.removeprefix("doc_id long, ")
        paths = [f"{self.path}/{kind}/{a}" for a in self._attempts()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits ``changes(doc_id, text, source, lang, deleted)`` once; False if the batch was committed before.

        Of several changes to one document in a batch, all inserts stand only if the table repeats the row; callers who
        need the last one send only that. Inserts without doc_id count, but nothing can take them back; deletes without one
        do nothing.
        """
        if self.committed(batch_id):
            return False
        fresh = counted(changes.where(~F.coalesce(F.col("deleted"), F.lit(False))), self.tokenizers)
        signed = fresh
        if self._attempts():
            touched = changes.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
            held = self._read("log").join(touched, "doc_id", "left_semi")
            undone = held.groupBy("doc_id", "source", "lang", "version").agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
            undone = undone.where("d_docs <> 0 or d_tokens <> 0").withColumns({"d_docs": -F.col("d_docs"), "d_tokens": -F.col("d_tokens")})
            signed = fresh.unionByName(undone)
        attempt = uuid.uuid4().hex
        signed.write.parquet(f"{self.path}/log/{attempt}")
        sums = self.spark.read.schema(SIGNED).parquet(f"{self.path}/log/{attempt}").groupBy("source", "lang", "version")
        sums.agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.parquet(f"{self.path}/totals/{attempt}")
        return self._commit(batch_id, attempt)

    def _commit(self, batch_id: str, attempt: str) -> bool:
        """Names ``attempt`` as the batch's; False if another one is. The file is written whole under another name and
        then renamed, which fails where the name is taken, so a driver lost on the way leaves no empty commit."""
        jvm = self.spark._jvm
        draft, fs = self._fs(f"{self.path}/drafts/{attempt}")
        out = fs.create(draft, False)
        out.write(bytearray(attempt.encode()))
        out.close()
        at, fs = self._fs(self._commit_file(batch_id))
        fs.mkdirs(at.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, at, plain)
        except Exception:
            if self.committed(batch_id):
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over the committed batches; groups at zero are left out."""
        summed = self._read("totals").groupBy("source", "lang", "version").agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")
