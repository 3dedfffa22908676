"""Incremental ingest: a checked batch is merged and published, a bad one is set aside and the checkpoint stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvid.operators import access, versions


class BadBatch(Exception):
    """Some documents of a batch don't conform; nothing of it was written."""


def merge(root: str, on_bad: str = "raise"):
    """A foreachBatch function: conformance gate, then the batch and a run row are written under names of its number, so
    a repeated batch overwrites itself. Bad batches go to ``quarantine`` and raise, or are passed over.

    A run row says running before anything is written, and complete only after the batch is in the log. A failed one has
    the reason: documents that don't conform, or what a write ran into.
    """

    def write(batch: DataFrame, number: int) -> None:
        def run(status: str, n_bad: int = 0, reason: str | None = None) -> None:
            row = batch.sparkSession.createDataFrame([(number, status, n_bad, reason)], "batch long, status string, n_bad long, reason string")
            row.coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/batch={number}")

        run("running")
        checked = access.conformance(batch).persist()
        try:
            bad = checked.where("issue is not null")
            n_bad = bad.count()
            if n_bad:
                bad.write.mode("overwrite").parquet(f"{root}/quarantine/batch={number}")
                run("failed", n_bad, "documents do not conform")
                if on_bad == "raise":
                    raise BadBatch(f"batch {number}: {n_bad} documents")
                return
            checked.drop("issue").write.mode("overwrite").parquet(f"{root}/log/batch={number}")
            run("complete")
        except BadBatch:
            raise
        except Exception as e:
            run("failed", 0, f"{type(e).__name__}: {e}"[:500])
            raise
        finally:
            checked.unpersist()

    return write


def start(stream: DataFrame, root: str, on_bad: str = "raise") -> StreamingQuery:
    """Takes what is there, then ends. Spark's checkpoint moves on only after the batch function returned."""
    return stream.writeStream.foreachBatch(merge(root, on_bad)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def current(log: DataFrame, key: str = "external_id", order: str = "updated_at") -> DataFrame:
    """The change log's latest row of each document, without deleted ones."""
    rows = versions.latest(log, [key], F.struct(F.col(order), F.col("batch")))
    return rows.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in rows.columns else rows


def apart(root: str, order: str = "updated_at", delay: Column | None = None):
    """A foreachBatch function: rows that aren't newer than the checkpoint go to ``late``, the others to ``fresh``; then the
    checkpoint moves to the newest ``order``, less ``delay`` if given (a number or an interval, as ``order`` is): rows that
    come out of order within the delay are fresh, and later ones are kept, not dropped. Rows without ``order`` are late. All is written under the batch's number, and a repeated
    batch looks at the checkpoints of earlier ones alone, so it gives the same."""

    def write(batch: DataFrame, number: int) -> None:
        spark, kind = batch.sparkSession, batch.schema[order].dataType.simpleString()
        held = spark.createDataFrame([], f"batch long, at {kind}")
        if number:
            held = spark.read.schema(held.schema).parquet(f"{root}/newest").where(F.col("batch") < number)
        at = held.agg(F.max("at")).first()[0]
        passed = F.lit(at).cast(kind) if delay is None else F.lit(at).cast(kind) - delay
        late = F.col(order).isNull() | (F.lit(False) if at is None else F.col(order) <= passed)
        rows = batch.withColumn("__late", late).persist()
        try:
            rows.where("__late").drop("__late").write.mode("overwrite").parquet(f"{root}/late/batch={number}")
            rows.where("not __late").drop("__late").write.mode("overwrite").parquet(f"{root}/fresh/batch={number}")
            rows.agg(F.max(order).alias("at")).coalesce(1).write.mode("overwrite").parquet(f"{root}/newest/batch={number}")
        finally:
            rows.unpersist()

    return write
