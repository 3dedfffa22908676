"""Corpus health, evaluation and fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.functions import scalars as S
from corvid.sinks import render as R


def source_health(docs: DataFrame, covered: DataFrame, key: str, group: str) -> DataFrame:
    """(group, n, covered, coverage): how many documents of each group the other table has."""
    hit = covered.select(key, F.lit(1).alias("__hit")).distinct()
    n, h = F.count_distinct(key), F.count_distinct(F.when(F.col("__hit") == 1, F.col(key)))
    return docs.join(hit, key, "left").groupBy(group).agg(n.alias("n"), h.alias("covered"), F.round(h / n, 6).alias("coverage"))


def groups(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """One row for each member of a group of rows with equal keys: keys, id, the group's size ``n`` and its least id ``first_id``.

    Single rows, and rows with a null key, are in no group. Sizes are summed before the shuffle and no list is gathered, so
    a group may hold any share of the rows. They are written first: both sides of the join are then dealt anew, and
    Spark can split a group's rows.
    """
    many = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(id_).alias("first_id")).where("n > 1")
    folder = R.shared_folder(rows.sparkSession, "groups")
    many.write.parquet(folder)
    return rows.select(*keys, id_).join(rows.sparkSession.read.schema(many.schema).parquet(folder), keys)


def contradictions(facts: DataFrame, keys: list[str], value: str, to: str) -> DataFrame:
    """Keys with more than one value, and the values."""
    return facts.select(*keys, value).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(to)).where(F.size(to) > 1)


def salience(docs: DataFrame, chunks: DataFrame, links: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` documents with most distinct chunks and links; each side is counted by itself before it is joined."""
    sides = [d.distinct().groupBy(key).agg(F.count("*").alias(n)) for d, n in ((chunks, "x"), (links, "y"))]
    both = reduce(lambda a, b: a.join(b, key, "left"), sides, docs)
    total = F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))
    return both.select(key, total.alias("salience")).orderBy(F.desc("salience"), key).limit(k)


def confidence(evidence: DataFrame, now: Column, stale_days: int) -> DataFrame:
    """(q, confidence) of evidence(q, chunk, updated, key, value): coverage and freshness less contradictions."""
    clash = evidence.select("q", "key", "value").distinct().groupBy("q", "key").count().where("count > 1").groupBy("q").agg(F.count("*").alias("clashes"))
    stale = F.count_if(S.age_days(F.col("updated"), now) >= stale_days)
    per = evidence.groupBy("q").agg((F.count_distinct("chunk") / F.count("*")).alias("coverage"), (1 - stale / F.count("*")).alias("fresh")).join(clash, "q", "left")
    raw = 0.6 * F.col("coverage") + 0.4 * F.col("fresh") - F.least(F.lit(0.5), 0.15 * F.coalesce("clashes", F.lit(0)))
    return per.select("q", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 6).alias("confidence"))


def replay(cases: DataFrame) -> DataFrame:
    """Exact matches, and recall and precision over all cases(expected, actual)."""
    hits = F.sum(F.size(F.array_intersect("expected", "actual")))
    return cases.agg(F.count_if(F.col("expected") == F.col("actual")).alias("exact"), F.round(hits / F.sum(F.size("expected")), 6).alias("recall"), F.round(hits / F.sum(F.size("actual")), 6).alias("precision"))


def calibration(rows: DataFrame, bins: int) -> DataFrame:
    """(bin, n, observed) for rows(confidence, correct), empty bins too."""
    counted = rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("rate"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("observed"))


def anomalies(rows: DataFrame) -> DataFrame:
    """Rows whose ``observed`` is over ``threshold`` from ``baseline``; critical from twice the threshold (one at least)."""
    off = F.abs(F.col("observed") - F.col("baseline"))
    return rows.where(off > F.col("threshold")).withColumn("severity", F.when(off >= 2 * F.greatest("threshold", F.lit(1.0)), "critical").otherwise("warning"))


def path_types(paths: DataFrame, packs: DataFrame, key: str) -> DataFrame:
    """The type of each path by its longest prefix; a pack table has a few rows."""
    hits = paths.join(F.broadcast(packs.limit(10_000)) if packs.count() <= 10_000 else packs, F.startswith("path", "prefix"))
    return hits.groupBy(key).agg(F.max_by("type", F.length("prefix")).alias("type"))


def expand(queries: DataFrame, aliases: DataFrame, limit: int) -> DataFrame:
    """Each query(query_id, text), then with one token replaced at a time, at most ``limit`` variants, all different."""
    tokens = queries.select("query_id", F.filter(F.split(F.trim("text"), " "), lambda x: x != "").alias("t"))
    own = tokens.select("query_id", F.lit(-1).alias("pos"), F.lit("").alias("replacement"), F.array_join("t", " ").alias("text"))
    asked = tokens.select("query_id", "t", F.posexplode("t").alias("pos", "token")).withColumn("token", F.lower("token"))
    swapped = F.array_join(F.transform("t", lambda x, i: F.when(i == F.col("pos"), F.col("replacement")).otherwise(x)), " ")
    more = asked.join(aliases, "token").select("query_id", "pos", "replacement", swapped.alias("text"))
    first = own.unionByName(more).groupBy("query_id", "text").agg(F.min(F.struct("pos", "replacement")).alias("at"))
    return first.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("at"))).where(F.col("n") <= limit).select("query_id", "n", "text")


def facts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Edges (src, dst) from each row to its facts ``column:value`` that aren't blank."""
    pairs = F.array(*[F.when(F.trim(c) != "", F.concat(F.lit(f"{c}:"), c)) for c in columns])
    return rows.select(F.col(key).alias("src"), F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("dst")).distinct()


def load_facts(rows: DataFrame, column: str = "facts") -> tuple[DataFrame, DataFrame]:
    """Facts and refused rows of JSON arrays: subject, predicate and object must be there, confidence from 0 to 1 (1 if none)."""
    f = rows.select(F.explode(F.from_json(column, "array<struct<subject:string,predicate:string,object:string,confidence:double>>")).alias("f")).select("f.*")
    f = f.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).withColumn("id", F.sha2(F.concat_ws(":", "subject", "predicate", "object"), 256))
    ok = (F.coalesce("subject", F.lit("")) != "") & (F.coalesce("predicate", F.lit("")) != "") & (F.coalesce("object", F.lit("")) != "") & F.col("confidence").between(0, 1)
    return f.where(ok).dropDuplicates(["id"]), f.where(~ok)
