"""Comparing and carrying forward versions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, tag) for manifests (id, path, hash, revision, meta, deleted): an id may have several tags."""
    b = before.select(F.col("id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in ("path", "hash", "revision", "meta")], F.coalesce("deleted", F.lit(False)).alias("b_deleted"))
    a = after.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    row = b.join(a, F.col("b_id") == F.col("id"), "full_outer")
    both = F.col("id").isNotNull() & F.col("b_id").isNotNull()
    same = lambda c: F.col(c).eqNullSafe(F.col(f"b_{c}"))
    content = same("hash") & same("revision")
    tags = F.array(
        F.when(F.col("b_id").isNull(), "created"),
        F.when((both & F.col("deleted") & ~F.col("b_deleted")) | (F.col("id").isNull() & ~F.col("b_deleted")), "deleted"),
        F.when(both & ~F.col("deleted") & F.col("b_deleted"), "restored"),
        F.when(both & ~same("path"), "moved"),
        F.when(both & ~content, "updated"),
        F.when(both & content & ~same("meta") & same("path") & same("deleted"), "metadata_only"),
    )
    return row.select(F.coalesce("id", "b_id").alias("id"), F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("tag"))


def two_way(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): missing on the right, extra there, changed, or equal."""
    a, b = left.select(key, F.col(value).alias("__a"), F.lit(True).alias("__l")), right.select(key, F.col(value).alias("__b"), F.lit(True).alias("__r"))
    status = F.when(F.col("__r").isNull(), "missing").when(F.col("__l").isNull(), "extra").when(F.col("__a").eqNullSafe(F.col("__b")), "equal").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def sync(current: DataFrame, incoming: DataFrame, full: bool = True) -> DataFrame:
    """(id, action) for (id, path, hash[, deleted]): created, updated, moved, unchanged; absent from a full list, or deleted: stale."""
    c = current.select(F.col("id").alias("c_id"), F.col("path").alias("c_path"), F.col("hash").alias("c_hash"))
    gone = F.col("id").isNull() if full else F.lit(False)
    deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in incoming.columns else F.lit(False)
    action = F.when(gone | (deleted & F.col("c_id").isNotNull()), "stale").when(F.col("c_id").isNull(), "created").when(F.col("hash") != F.col("c_hash"), "updated").when(F.col("path") != F.col("c_path"), "moved").otherwise("unchanged")
    return c.join(incoming, F.col("c_id") == F.col("id"), "full_outer").select(F.coalesce("id", "c_id").alias("id"), action.alias("action"))


def renames(missing: DataFrame, unseen: DataFrame) -> DataFrame:
    """(path, action, id): a new file whose content just one missing entry had is its rename; with several, or none, it is created.
    Of several files with one content the first path takes the entry."""
    held = missing.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("m_id"))
    first = F.row_number().over(W.partitionBy("hash").orderBy("path")) == 1
    row = unseen.withColumn("__first", first).join(held, "hash", "left")
    hit = F.coalesce((F.col("n") == 1) & F.col("__first"), F.lit(False))
    return row.select("path", F.when(hit, "renamed").when(F.col("n") > 1, "ambiguous").otherwise("created").alias("action"), F.when(hit, F.col("m_id")).alias("id"))


def first_seen(log: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the log lacks, one a key: an append that may be repeated."""
    return new.dropDuplicates(keys).join(log.select(*keys), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key with the greatest ``order``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("__r")).select("__r.*")
