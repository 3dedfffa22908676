"""Projection of a snapshot of pages into tables of documents, links, chunks and revisions, in full or by what changed.

A page has id, path, content, hash (sha-256 of the content), revision, meta and deleted, which may be null for false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.operators import chunks as K
from corvid.operators import versions
from corvid.sinks import render

TABLES = ("documents", "links", "chunks", "revisions")


class StaleBase(Exception):
    """The projection to start from isn't the current one."""


def _live(pages: DataFrame) -> DataFrame:
    return pages.where(~F.coalesce("deleted", F.lit(False)))


def _documents(pages: DataFrame) -> DataFrame:
    return _live(pages).select("id", "path", "hash", "revision", "meta")


def _revisions(pages: DataFrame, commit: str) -> DataFrame:
    return pages.select("id", "revision", "path", "hash", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.lit(commit).alias("commit"))


def _cut(pages: DataFrame) -> dict[str, DataFrame]:
    """Links, each once, and chunks of pages that aren't deleted. A content that hasn't its hash fails the job."""
    wrong = ~F.sha2("content", 256).eqNullSafe(F.col("hash"))
    live = _live(pages).withColumn("content", F.when(wrong, F.raise_error(F.concat(F.lit("content hash mismatch: "), "path"))).otherwise(F.col("content")))
    links = live.select("id", F.explode(T.wiki_links(F.col("content"))).alias("target")).distinct()
    chunks = K.markdown(live.select(F.col("id").alias("doc_id"), F.col("content").alias("text")))
    kind = pages.schema["id"].dataType
    return {"links": links, "chunks": chunks.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnsRenamed({"doc_id": "id", "chunk_id": "chunk"})}


def _write(spark: SparkSession, root: str, commit: str, tables: dict[str, DataFrame]) -> None:
    """Writes the tables of a commit beside those of others; the pointer moves to it once all are there."""
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{root}/versions/{commit}/{name}")
    render.point(spark, root, commit)


def active(spark: SparkSession, root: str) -> str:
    """The current commit."""
    return spark.read.text(f"{root}/CURRENT").first().value


def read(spark: SparkSession, root: str, name: str, commit: str | None = None) -> DataFrame:
    """One of TABLES of a commit, of the current one if none is given."""
    return spark.read.parquet(f"{root}/versions/{commit or active(spark, root)}/{name}")


def full(pages: DataFrame, root: str, commit: str) -> None:
    """Projects ``pages`` as ``commit``. If it fails, the current projection stays as it is."""
    _write(pages.sparkSession, root, commit, {"documents": _documents(pages), **_cut(pages), "revisions": _revisions(pages, commit)})


def incremental(before: DataFrame, after: DataFrame, root: str, base: str, commit: str, derived: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Projects ``after`` as ``commit`` from the projection ``base`` of ``before``. Only changed pages are cut anew; others keep
    chunks, their ids and links, also where only metadata changed. A revision that is logged isn't logged again.

    Raises StaleBase if ``base`` isn't current. Returns ``derived`` tables(id, ...), such as facts and claims, without the
    rows of pages that changed or went.
    """
    spark = after.sparkSession
    if active(spark, root) != base:
        raise StaleBase(base)
    manifest = lambda pages: pages.select("id", "path", "hash", "revision", "meta", "deleted")
    redone = versions.delta(manifest(before), manifest(after)).where("tag <> 'metadata_only'").select("id").distinct()
    cut = _cut(after.join(redone, "id", "left_semi"))
    tables = {name: read(spark, root, name, base).join(redone, "id", "left_anti").unionByName(cut[name]) for name in cut}
    logged = read(spark, root, "revisions", base)
    new = _revisions(after, commit).join(logged.select("id", "revision"), ["id", "revision"], "left_anti")
    _write(spark, root, commit, {"documents": _documents(after), **tables, "revisions": logged.unionByName(new)})
    return {name: df.join(redone, "id", "left_anti") for name, df in (derived or {}).items()}


def per_document(spark: SparkSession, root: str) -> DataFrame:
    """(id, path, revision, n_chunks, n_links, n_revisions) of the current projection."""
    out = read(spark, root, "documents").select("id", "path", "revision")
    for name in ("chunks", "links", "revisions"):
        counted = read(spark, root, name).groupBy("id").agg(F.count("*").alias(f"n_{name}"))
        out = out.join(counted, "id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out
