"""Reports over syncs, checkpoints, sources, tenants and evaluations, and the tables of facts they rest on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.operators import analysis
from corvid.operators.search import small

#: The measures of a sync, in the order that reports have them.
MEASURES = ("scanned", "created", "updated", "skipped", "redacted", "warnings", "failures")


def sync_totals(scans: DataFrame, changes: DataFrame, notes: DataFrame) -> DataFrame:
    """(provider, MEASURES): per provider, and for all with a null provider.

    scans(provider, redactions) has a row for each conversation scanned, changes(provider, kind) says create, update or
    skip, and notes(provider, kind) warning or failure. Each table is summed by itself.
    """
    zero = [F.lit(0).cast("long").alias(m) for m in MEASURES]

    def part(df: DataFrame, **measures: Column) -> DataFrame:
        return df.select("provider", *[measures[m].cast("long").alias(m) if m in measures else z for m, z in zip(MEASURES, zero, strict=True)])

    kind = lambda k: F.when(F.col("kind") == k, 1).otherwise(0)
    rows = part(scans, scanned=F.lit(1), redacted=F.coalesce("redactions", F.lit(0)))
    rows = rows.unionByName(part(changes, created=kind("create"), updated=kind("update"), skipped=kind("skip"))).unionByName(part(notes, warnings=kind("warning"), failures=kind("failure")))
    return rows.rollup("provider").agg(*[F.sum(m).alias(m) for m in MEASURES])


def sync_report(totals: DataFrame, notes: DataFrame) -> DataFrame:
    """(section, key, line): the lines of a report in the order of section, then key. Sections: 0 the head, 1 totals and
    providers by name, 2 and 3 warnings, 4 and 5 failures; notes(provider, path, kind, message)."""
    spark = totals.sparkSession
    cells = F.concat_ws(" | ", *[F.col(m).cast("string") for m in MEASURES])
    counted = totals.select(F.lit(1).alias("section"), F.coalesce("provider", F.lit("")).alias("key"), F.concat(F.lit("| "), F.coalesce("provider", F.lit("total")), F.lit(" | "), cells, F.lit(" |")).alias("line"))
    head = ["# Chat History Sync Report", "| Scope | " + " | ".join(m.capitalize() for m in MEASURES) + " |", "| --- |" + " ---: |" * len(MEASURES)]
    fixed = [(0, str(i), line) for i, line in enumerate(head)] + [(2, "", "## Warnings"), (4, "", "## Failures")]
    said = F.concat(F.lit("- ["), "provider", F.lit("] "), F.coalesce(F.concat("path", F.lit(": ")), F.lit("")), "message")
    listed = notes.select(F.when(F.col("kind") == "warning", 3).otherwise(5).alias("section"), F.concat_ws("\n", "provider", "path", "message").alias("key"), said.alias("line"))
    none = spark.createDataFrame([(3, "", "- None"), (5, "", "- None")], "section int, key string, line string").join(listed.select("section").distinct(), "section", "left_anti")
    return reduce(DataFrame.unionByName, [spark.createDataFrame(fixed, "section int, key string, line string"), counted, listed, none])


def checkpoint_health(archive: DataFrame, indexed: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """One row: documents in the archive and the index, chunks by status pending, uploaded, indexed and failed, tombstones,
    ``warnings`` and ``ok``. archive(id, hash), indexed(id, hash), checkpoints(status, deleted)."""
    stale = archive.join(indexed.withColumnRenamed("hash", "__held"), "id", "full_outer").agg(F.count("hash").alias("archived"), F.count("__held").alias("indexed_documents"), F.count_if(~F.col("hash").eqNullSafe(F.col("__held"))).alias("stale"))
    live = ~F.coalesce("deleted", F.lit(False))
    counts = checkpoints.agg(*[F.count_if(live & (F.col("status") == s)).alias(s) for s in ("pending", "uploaded", "indexed", "failed")], F.count_if(~live).alias("tombstones"))
    rows = stale.join(F.broadcast(counts), F.lit(True))  # two tables of one row
    say = lambda cond, what: F.when(cond, F.lit(what))
    warnings = F.array(
        say(F.col("stale") > 0, "index is stale; run index"),
        say((F.col("pending") > 0) & (F.col("uploaded") == 0), "semantic index is stale; run index"),
        say(F.col("uploaded") > 0, "semantic indexing is pending remote completion"),
        say(F.col("failed") > 0, "semantic synchronization has failed work"),
        say(F.col("tombstones") > 0, "semantic deletions are pending"),
    )
    rows = rows.withColumn("warnings", F.filter(warnings, lambda x: x.isNotNull()))
    return rows.withColumn("ok", F.size("warnings") == 0)


def source_health(documents: DataFrame, chunks: DataFrame, quarantined: DataFrame, now: Column) -> DataFrame:
    """Per source of documents(id, source, deleted, stale, extractor, updated): active, extracted and stale documents, chunks and
    embedded chunks of chunks(id, embedded), both coverages (1 if there is nothing to cover), events of quarantined(source),
    the newest time, and the seconds it lags behind ``now``. A null source is manual. Each table is summed by itself."""
    docs = documents.withColumn("source", F.coalesce("source", F.lit("manual")))
    live = ~F.coalesce("deleted", F.lit(False))
    own = docs.groupBy("source").agg(F.count_if(live).alias("active"), F.count_if(live & F.col("extractor").isNotNull()).alias("extracted"), F.count_if(F.coalesce("stale", F.lit(False))).alias("stale"), F.max("updated").alias("newest"))
    per = chunks.groupBy("id").agg(F.count("*").alias("chunks"), F.count_if(F.coalesce("embedded", F.lit(False))).alias("embedded"))
    cut = docs.select("id", "source").join(per, "id").groupBy("source").agg(F.sum("chunks").alias("chunks"), F.sum("embedded").alias("embedded"))
    bad = quarantined.groupBy("source").agg(F.count("*").alias("quarantined"))
    rows = own.join(cut, "source", "left").join(bad, "source", "left").fillna(0, ["chunks", "embedded", "quarantined"])
    cover = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0), 6)
    lag = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros("newest")) / 1_000_000))
    return rows.withColumns({"embedding_coverage": cover("embedded", "chunks"), "extraction_coverage": cover("extracted", "active"), "lag_seconds": F.when(F.col("newest").isNotNull(), lag)})


def scorecard(measures: DataFrame) -> DataFrame:
    """(score) of measures(value, weight): their weighted mean."""
    return measures.agg(F.round(F.sum(F.col("value") * F.col("weight")) / F.sum("weight"), 6).alias("score"))


def evaluation(cases: DataFrame) -> DataFrame:
    """One row over cases(tenant, brain, expected, actual): the replay's exact matches, recall and precision, the scorecard
    (recall and precision count twice, the share of exact ones once), and whether two scopes or more were seen."""
    found = analysis.replay(cases).join(F.broadcast(cases.agg(F.count("*").alias("cases"), (F.count_distinct("tenant", "brain") >= 2).alias("isolated"))), F.lit(True))  # two tables of one row
    score = (2 * F.col("recall") + 2 * F.col("precision") + F.col("exact") / F.col("cases")) / 5
    return found.withColumns({"score": F.round(score, 6), "stale_case": F.col("recall") < 1})


def dashboard(tenants: DataFrame, tables: dict[str, DataFrame], jobs: DataFrame, projections: DataFrame, models: DataFrame) -> DataFrame:
    """Per row of tenants(tenant): rows of each of ``tables``(tenant), active and failed jobs(tenant, status, dead), projections
    (tenant, status) that aren't complete, and active models(tenant, active). Each table is counted by tenant before it is joined."""
    one = F.count("*")
    parts = [(df, {name: one}) for name, df in tables.items()]
    parts.append((jobs, {"active_jobs": F.count_if(F.col("status").isin("pending", "running")), "failed_jobs": F.count_if((F.col("status") == "failed") | F.coalesce("dead", F.lit(False)))}))
    parts.append((projections, {"projection_lag": F.count_if(~F.col("status").eqNullSafe("complete"))}))
    parts.append((models, {"active_models": F.count_if(F.coalesce("active", F.lit(False)))}))
    out = tenants
    for df, counts in parts:
        out = out.join(df.groupBy("tenant").agg(*[v.alias(k) for k, v in counts.items()]), "tenant", "left").fillna(0, list(counts))
    return out


def run_currency(runs: DataFrame, heads: DataFrame) -> DataFrame:
    """(brain, commit, status, current): each brain's run that began last, current if it is complete and of the head
    commit. runs(brain, commit, status, started), heads(brain, head)."""
    last = runs.groupBy("brain").agg(F.max_by(F.struct("commit", "status"), F.struct("started", "commit")).alias("r"))
    current = F.coalesce((F.col("r.commit") == F.col("head")) & (F.col("r.status") == "complete"), F.lit(False))
    return heads.join(last, "brain", "left").select("brain", F.col("r.commit").alias("commit"), F.col("r.status").alias("status"), current.alias("current"))


#: What a claim may be.
CLAIM_STATUS = ("active", "retracted", "superseded")


def checked_facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(subject, predicate, object, confidence, status, event_at, ...) that may be appended, and those set aside with an
    ``issue``: texts must not be blank, confidence runs from 0 to 1, a status is known, an event has a time."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    issue = (
        F.when(blank("subject") | blank("predicate") | blank("object"), "blank text")
        .when(F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1), "confidence out of range")
        .when(F.col("status").isNotNull() & ~F.col("status").isin(*CLAIM_STATUS), "unknown status")
        .when(F.col("event_at").isNotNull() & F.try_to_timestamp("event_at").isNull(), "no time")
    )
    checked = rows.withColumn("issue", issue)
    return checked.where("issue is null").drop("issue"), checked.where("issue is not null")


def forget(records: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """records(id, tenant, brain, forgotten_at) with the time of those that asked(id, tenant, brain) names in their own scope;
    what was forgotten before keeps its time. ``refused`` counts are the caller's: asked rows of another scope match nothing."""
    hit = asked.select("id", "tenant", "brain").distinct().withColumn("__hit", F.lit(True))
    rows = records.join(small(hit), ["id", "tenant", "brain"], "left")
    return rows.withColumn("forgotten_at", F.coalesce("forgotten_at", F.when(F.col("__hit"), now))).drop("__hit")


def trajectory(events: DataFrame, key: str, at: str, id_: str, most: int = 1000) -> DataFrame:
    """The first ``most`` events of each key by time, then id, with their place ``n`` and the key's ``start_at`` and ``end_at``
    among them."""
    rows = events.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(at, id_))).where(F.col("n") <= most)
    w = W.partitionBy(key)
    return rows.withColumns({"start_at": F.min(at).over(w), "end_at": F.max(at).over(w)})


def invalidated(entries: DataFrame, scope: dict[str, object]) -> DataFrame:
    """(entries, invalidated): cache entries, and those whose columns have the scope's values."""
    hit = reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in scope.items()), F.lit(True))
    return entries.agg(F.count("*").alias("entries"), F.count_if(hit).alias("invalidated"))


def answer_citations(citations: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """citations(answer, *keys) with ``status``: unknown if ``held`` lacks the source, repeated if the answer names it more than
    once, else ok."""
    seen = held.select(*keys).distinct().withColumn("__held", F.lit(True))
    rows = citations.withColumn("__n", F.count("*").over(W.partitionBy("answer", *keys))).join(seen, keys, "left")
    return rows.withColumn("status", F.when(F.col("__held").isNull(), "unknown").when(F.col("__n") > 1, "repeated").otherwise("ok")).drop("__held", "__n")
