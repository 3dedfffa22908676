"""A failed write leaves a failed run, not a complete one; the batch is taken again."""

import hashlib

import pytest

from pyspark.sql import functions as F

from corvid.streaming import ingest

SCHEMA = "external_id string, path string, content string, content_hash string, source_type string, updated_at string"


def rows(spark, n):
    return spark.createDataFrame([(str(i), f"{i}.md", "x", hashlib.sha256(b"x").hexdigest(), "web", "1") for i in range(n)], SCHEMA)


def test_a_failed_write_is_no_complete_run(spark, tmp_path):
    root = f"{tmp_path}/r"
    write = ingest.merge(f"file://{root}")
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "log").write_text("in the way")
    with pytest.raises(Exception):
        write(rows(spark, 3), 0)
    run = spark.read.parquet(f"file://{root}/runs").collect()
    assert [r.status for r in run] == ["failed"] and run[0].reason
    (tmp_path / "r" / "log").unlink()
    write(rows(spark, 3), 0)
    assert [r.status for r in spark.read.parquet(f"file://{root}/runs").collect()] == ["complete"]
    assert spark.read.parquet(f"file://{root}/log").count() == 3


def test_late_rows_of_a_repeated_batch(spark, tmp_path):
    write = ingest.apart(f"file://{tmp_path}/l", "at")
    batch = lambda *at: spark.createDataFrame([(x,) for x in at], "at long")
    write(batch(5, 7), 0)
    for _ in range(2):
        write(batch(6, 8, None), 1)
    read = lambda name: sorted((r.at is None, r.at) for r in spark.read.parquet(f"file://{tmp_path}/l/{name}").collect())
    assert read("fresh") == [(False, 5), (False, 7), (False, 8)] and read("late") == [(False, 6), (True, None)]


def test_a_delay_keeps_rows_out_of_order_fresh(spark, tmp_path):
    write = ingest.apart(f"file://{tmp_path}/l", "at", F.lit(10))
    batches = [[(1, 100)], [(2, 91), (3, 90), (4, None)], [(5, 120), (6, 95)], [(7, 111), (8, 110)]]
    for number in (0, 1, 1, 2, 3, 3):
        write(spark.createDataFrame(batches[number], "id long, at long"), number)
    read = lambda name: sorted(r.id for r in spark.read.schema("id long").parquet(f"file://{tmp_path}/l/{name}").collect())
    assert read("fresh") == [1, 2, 5, 6, 7] and read("late") == [3, 4, 8]
