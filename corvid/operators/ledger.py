"""A table of jobs(id, status, deps, degraded_ok): what can run, what fails with what, what is due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.sinks import render


def _with_parents(jobs: DataFrame) -> DataFrame:
    parents = jobs.select(F.col("id").alias("dep"), F.col("status").alias("parent"))
    return jobs.select("id", "status", "degraded_ok", F.explode("deps").alias("dep")).join(parents, "dep", "left")


def frontier(jobs: DataFrame) -> DataFrame:
    """(id, degraded): pending jobs whose prerequisites are complete; jobs that accept degraded input also take failed ones."""
    good = F.coalesce((F.col("parent") == "complete") | (F.col("degraded_ok") & (F.col("parent") == "failed")), F.lit(False))
    per = _with_parents(jobs).groupBy("id").agg(F.bool_and(good).alias("ready"), F.bool_or(F.col("parent") == "failed").alias("degraded"))
    return jobs.where("status = 'pending'").join(per, "id", "left").where(F.coalesce("ready", F.lit(True))).select("id", F.coalesce("degraded", F.lit(False)).alias("degraded"))


def fail_dependants(jobs: DataFrame) -> DataFrame:
    """(id, status): pending jobs that a failed prerequisite cancels, one step."""
    hit = _with_parents(jobs).where("status = 'pending' AND parent = 'failed' AND NOT degraded_ok")
    return hit.select("id", F.lit("cancelled").alias("status")).distinct()


def closure(jobs: DataFrame, start: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id) of ``start`` and all that depends on it. Each round joins what was new in the last."""
    edges = jobs.select("id", F.explode("deps").alias("dep"))
    seen = front = start.select("id").distinct()
    for _ in range(max_rounds):
        front = edges.join(front.select(F.col("id").alias("dep")), "dep").select("id").distinct().join(seen, "id", "left_anti")
        folder = render.shared_folder(jobs.sparkSession, "closure")
        front.write.parquet(folder)
        front = jobs.sparkSession.read.schema(front.schema).parquet(folder)
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError(f"dependencies deeper than {max_rounds}")


def due(schedules: DataFrame, now: int) -> DataFrame:
    """Schedules(at, every) that are due, with their next run after now."""
    steps = F.greatest(F.lit(1), F.ceil((F.lit(now) - F.col("at")) / F.col("every")))
    return schedules.where(F.col("at") <= now).withColumn("next_run", (F.col("at") + steps * F.col("every")).cast("long"))


def after_failure(jobs: DataFrame) -> DataFrame:
    """Failed for good once the attempts are used up, else pending again."""
    over = F.col("attempts") >= F.col("max_attempts")
    return jobs.withColumns({"status": F.when(over, "failed").otherwise("pending"), "dead_letter": over})


def leases(events: DataFrame, now: int) -> DataFrame:
    """(id, worker, status, expires_at) from lease events(id, worker, at, lease_seconds, done): the latest event of a job counts. A job
    that is done is complete, one whose lease has run out by ``now`` (seconds) is expired, others are leased."""
    last = events.groupBy("id").agg(F.max_by(F.struct("worker", "at", "lease_seconds", "done"), F.struct("at", "worker")).alias("r")).select("id", "r.*")
    expires = F.col("at") + F.col("lease_seconds")
    status = F.when(F.coalesce("done", F.lit(False)), "complete").when(expires <= now, "expired").otherwise("leased")
    return last.select("id", "worker", status.alias("status"), expires.alias("expires_at"))


def pending_work(work: DataFrame, now: int, initial: float = 1.0, most: float = 60.0) -> DataFrame:
    """(id, status, next_at) of work(id, state, attempts, tried_at, deadline), times in seconds: finished states stay; past its
    deadline work is expired, before its next try (backed off twofold from ``initial`` to ``most``) it waits, else it is due."""
    wait = F.least(F.lit(most), F.lit(initial) * F.pow(F.lit(2.0), F.greatest(F.col("attempts") - 1, F.lit(0))))
    next_at = F.when(F.col("attempts") > 0, F.col("tried_at") + F.floor(wait)).otherwise(F.lit(now)).cast("long")
    status = F.when(F.col("state") != "pending", F.col("state")).when(F.col("deadline") <= now, "expired").when(next_at > now, "waiting").otherwise("due")
    return work.select("id", status.alias("status"), F.when(status.isin("due", "waiting"), next_at).alias("next_at"))
