"""Messages to conversations: cleaning, order, repeats, roll-up, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.functions import text as T


def clean(messages: DataFrame) -> DataFrame:
    """Roles mapped, synthetic text stripped, secrets redacted; dropped roles and empty texts go. Adds ``redactions``."""
    kept = messages.withColumn("role", T.role(F.col("role"))).where("role is not null").withColumn("text", T.strip_synthetic(F.col("text"))).where("text <> ''")
    return kept.withColumn("__r", T.redact(F.col("text"))).withColumns({"text": F.col("__r.text"), "redactions": F.col("__r.count")}).drop("__r")


def in_time_order(messages: DataFrame) -> DataFrame:
    """``ord`` renumbered by the last known time so far, then by the old number: a message without time follows the one before it."""
    known = F.last("ts", ignorenulls=True).over(W.partitionBy("conv_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    return messages.withColumn("__t", known).withColumn("ord", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("__t").asc_nulls_first(), "ord")) - 1).drop("__t")


def collapse_repeats(messages: DataFrame) -> DataFrame:
    """Drops a message with the role and text of the one before it."""
    w = W.partitionBy("conv_id").orderBy("ord")
    same = F.lag("role").over(w).eqNullSafe(F.col("role")) & F.lag("text").over(w).eqNullSafe(F.col("text")) & F.lag(F.lit(1)).over(w).isNotNull()
    return messages.withColumn("__same", same).where("not __same").drop("__same")


def bodies(messages: DataFrame) -> DataFrame:
    """(conv_id, body): ``role: text`` joined by blank lines, with a final newline."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "role", "text"))), lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return messages.groupBy("conv_id").agg(F.concat(F.array_join(lines, "\n\n"), F.lit("\n")).alias("body"))


def roll_up(messages: DataFrame) -> DataFrame:
    """One row a conversation that has a user message: counts, times, title, redactions, fingerprint of the body."""
    totals = messages.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.sum("redactions").alias("redactions"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.min_by("text", F.when(F.col("role") == "user", F.col("ord"))).alias("first_user"), F.bool_or(F.col("role") == "user").alias("__user"),
    )
    whole = bodies(messages).select("conv_id", F.sha2("body", 256).alias("fingerprint"))
    return totals.where("__user").drop("__user").join(whole, "conv_id").withColumn("title", T.title(F.col("first_user"), unicode=False)).drop("first_user")


def build(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean, ordered, collapsed messages, and their conversations."""
    done = collapse_repeats(in_time_order(clean(messages)))
    return done, roll_up(done)


def latest_or_longest(candidates: DataFrame, key: str, pos: str, updated: str, size: str) -> DataFrame:
    """(key, pos of the winner): in order, a candidate replaces the held one if it is later or has more messages.

    The rule is a fold, not an order, so each key's candidates are read in sequence, a row at a time; they needn't fit in memory.
    """
    rows = candidates.select(F.col(key).alias("key"), F.col(pos).alias("p"), F.coalesce(F.col(updated), F.lit("")).alias("u"), F.col(size).alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        import pyarrow as pa

        held, count, kind = None, 0, None
        for b in batches:
            kind, out = b.schema, []
            for k, p, u, n in zip(*(b.column(c).to_pylist() for c in ("key", "p", "u", "n")), strict=True):
                if held is None or held[0] != k:
                    if held is not None:
                        out.append((held[0], held[1], count))
                    held, count = (k, p, u, n), 0
                elif u > held[2] or (n is not None and held[3] is not None and n > held[3]):
                    held = (k, p, u, n)
                count += 1
            if out:
                yield made(pa, kind, out)
        if held is not None:
            yield made(pa, kind, [(held[0], held[1], count)])

    def made(pa, kind, out):
        k, p, n = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, kind.field("key").type), pa.array(p, kind.field("p").type), pa.array(n, pa.int32())], names=["key", "kept", "n_candidates"])

    folded = rows.repartition("key").sortWithinPartitions("key", "p", "u", "n").mapInArrow(run, f"key {kinds['key']}, kept {kinds['p']}, n_candidates int")
    return folded.withColumnRenamed("key", key)


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def archive_plan(incoming: DataFrame, archived: DataFrame) -> DataFrame:
    """What to do with each incoming conversation (source_id, doc_id, fingerprint, updated_at, body_hash, pos).

    The first of a key counts; equal fingerprint, or without one a source time not newer, or an equal body: skip. An id
    that another key's document has is a collision, also skipped.
    """
    first = F.row_number().over(W.partitionBy("source_id").orderBy("pos")) == 1
    held = archived.select(F.col("source_id").alias("a_key"), F.col("fingerprint").alias("a_print"), F.col("updated_at").alias("a_time"), F.col("body_hash").alias("a_body"))
    ids = archived.select(F.col("doc_id").alias("b_id"), F.col("source_id").alias("b_key"))
    rows = incoming.withColumn("__first", first).join(held, F.col("source_id") == F.col("a_key"), "left").join(ids, F.col("doc_id") == F.col("b_id"), "left")
    action = (
        F.when(~F.col("__first"), "skip-duplicate")
        .when(F.col("a_key").isNull() & F.col("b_id").isNotNull(), "skip-collision").when(F.col("a_key").isNull(), "create")
        .when(F.col("a_print").isNotNull() & (F.col("a_print") == F.col("fingerprint")), "skip-same")
        .when(F.col("a_print").isNull() & (F.coalesce("updated_at", F.lit("")) <= F.coalesce("a_time", F.lit(""))), "skip-same")
        .when(F.col("a_body") == F.col("body_hash"), "skip-same").otherwise("update")
    )
    return rows.select("source_id", "doc_id", "pos", action.alias("action"))
