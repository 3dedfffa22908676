"""The kept vector index: exact search equals all pairs, probed lists keep most of it, odd vectors, skipped blocks."""

import numpy as np
import pytest

from corvid.operators.search import nearest
from corvid.operators.vectors import VectorIndex

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, v array<float>"


def hits(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def clustered(n=600, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, 12)) * 4
    return [(i, (centers[i % 8] + rng.normal(size=12)).astype("float32").tolist()) for i in range(n)]


def test_exact_search_equals_all_pairs_and_skips_blocks(spark, tmp_path):
    v = spark.createDataFrame(clustered() + [(600 + i, clustered()[7][1]) for i in range(50)], SCHEMA)
    index = VectorIndex(spark, f"file://{tmp_path}/index", "vec_id", 12, lists=8, block_rows=16)
    index.build(v)
    q = v.where("vec_id % 10 = 7").withColumnRenamed("vec_id", "query_id")
    for k in (1, 5, 40):
        assert hits(index.search(q, k, 2)) == hits(nearest(q, v, k))
    index.search(q, 5, 2)
    early, late = index.visits
    read, every = early.count() + late.count(), q.count() * index._table("blocks").count()
    assert early.join(late, ["query_id", "block"]).isEmpty() and read < every / 2
    assert index._table("blocks").selectExpr("sum(n)", "max(n)").first() == (650, 16)


def test_probed_lists(spark, tmp_path):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "embedding AS v")
    index = VectorIndex(spark, f"file://{tmp_path}/index", "vec_id", 64, lists=64)
    index.build(v)
    q = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    want = hits(nearest(q, v, 10))
    assert hits(index.search(q, 10)) == want
    assert hits(index.probe(q, 10, 64)) == want
    got = {(x[0], x[2]) for x in hits(index.probe(q, 10, 32))}
    assert len(got & {(x[0], x[2]) for x in want}) >= 0.9 * len(want)


def test_odd_vectors(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (8, []), (None, [1.0, 0.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0]), (10, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex(spark, f"file://{tmp_path}/index", "vec_id", 2, lists=3)
    index.build(v)
    q = v.where("vec_id is not null").withColumnRenamed("vec_id", "query_id").dropDuplicates(["query_id"])
    got = hits(index.search(q, 3))
    assert [x for x in got if x[0] == 1] == [(1, 1, 1, 1.0), (1, 2, 9, 1.0), (1, 3, 9, 1.0)]
    assert {x[0] for x in got} == {1, 9, 10}


def test_empty_tables_and_a_build_that_fails(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/index", "vec_id", 2, lists=2)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<float>")
    index.build(spark.createDataFrame([], SCHEMA))
    assert hits(index.search(q, 3)) == [] and hits(index.probe(q, 3, 1)) == []
    version = index.build(spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA))
    with pytest.raises(Exception, match="boom"):
        index.build(spark.createDataFrame([(2, [1.0, 0.0])], SCHEMA).selectExpr("vec_id", "if(vec_id = 2, raise_error('boom'), v) AS v"))
    assert hits(index.search(q, 3)) == [(1, 1, 1, 1.0)]
    assert spark.read.text(f"file://{tmp_path}/index/CURRENT").first().value == version
    assert hits(index.search(q.limit(0), 3)) == []


def test_a_task_of_a_search_holds_a_bounded_share(spark, tmp_path, monkeypatch):
    from corvid.operators import vectors

    v = spark.createDataFrame(clustered(), SCHEMA)
    index = VectorIndex(spark, f"file://{tmp_path}/index", "vec_id", 12, lists=8, block_rows=16)
    index.build(v)
    q = v.where("vec_id % 10 = 7").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(vectors, "PACK", 16)
    monkeypatch.setattr(vectors, "TASK_BYTES", 1 << 14)
    visits = q.select("query_id").crossJoin(index._table("blocks").select("block"))
    got = index._scores(index._asked(q), visits, 5)
    assert hits(got) == hits(nearest(q, v, 5))
    # 60 queries make 4 packs: 4 copies of 600 vectors, and 60 queries for each block, 96 bytes each.
    tasks = -(-96 * (4 * 600 + visits.count()) // (1 << 14))
    assert tasks > 4 and f", {tasks}" in got._jdf.queryExecution().optimizedPlan().toString()
