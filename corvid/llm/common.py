"""Shared pieces: scratch tables, text helpers, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: ASCII white space that separates words; every other code point belongs to a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local session may name none and then uses a temporary one; on a cluster that
    would lose data quietly, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"corvid-{os.getuid()}")
        os.makedirs(path, exist_ok=True)
        path = f"file://{path}"
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvid-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """``df`` with its rows' numbers from 0 in the given order; ranges are numbered by themselves, then moved on by what
    stands before them, one row a partition."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), at.alias("__at")), "ranged")
    parts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = parts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return ranged.join(F.broadcast(before), "__part").select(*df.columns, (F.col("__at") + F.col("__before")).alias(name))


def counted(docs: DataFrame, count: Callable[[bytes], int], text_col: str = "text", keep_text: bool = False, **columns: Column) -> DataFrame:
    """``columns`` of ``docs`` with n, the tokens of the text by ``count`` (null: as an empty one), and the text if asked for.

    Texts are counted in Arrow batches: the built-in regular expressions take some fifty times as long for it.
    """
    rows = docs.select(*[c.alias(name) for name, c in columns.items()], F.col(text_col).cast("string").alias("text"))
    names = [*columns, *(["text"] if keep_text else [])]

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = pa.array([count(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), n], names=[*names, "n"])

    kept = rows if keep_text else rows.drop("text")
    return rows.mapInArrow(run, StructType([*kept.schema.fields, StructField("n", LongType())]))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def forest(ids_a, ids_b):
    """A spanning forest of the links (ids_a[k], ids_b[k]): each node beside the least of its group."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    a, b = at[: len(ids_a)], at[len(ids_a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[label[apart]], nodes[apart]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(src, dst)``; component is the smallest node reachable.

    Alternating large-star and small-star rounds. Each round writes its edges and the least neighbour of each node to the
    shared folder: as both sides of the join are then dealt anew, Spark can split the hub of a star. Only a row count and
    a checksum come to the driver. Paths shrink by a constant share a round, so ``max_rounds`` suffices for any graph that
    fits a cluster; a caller who sees the error may raise it, as nothing else bounds the rounds.
    """
    e = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct()
    e = materialize(e, "cc")

    def signature(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = signature(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        )
        e = materialize(small, "cc")
        now = signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds; give more by max_rounds")
    return (
        e.groupBy("a").agg(F.min("b").alias("component"))
        .unionByName(e.select(F.col("b").alias("a"), F.col("b").alias("component")).distinct())
        .groupBy("a").agg(F.min("component").alias("component"))
        .withColumnRenamed("a", "node")
    )


def attach_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(node)`` with ``component``; nodes without links are their own component."""
    return nodes.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
