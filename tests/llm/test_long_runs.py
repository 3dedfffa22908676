"""Runs of one key that are split give what whole runs give."""

import numpy as np
import pytest

from corvid.llm import lines


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


def test_lines_of_a_split_bucket(spark, small_batches):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(p), int(d), int(n)) for k, p, d, n in zip(rng.integers(0, 3, 600), rng.integers(0, 4, 600), rng.permutation(600), rng.integers(0, 3, 600), strict=True)]
    rows += [(1, -1, 300_000, 0), (2, -1, -5, 0)]
    keys = spark.createDataFrame(rows, "key long, place int, doc_id long, line int")
    whole, split = ({tuple(r) for r in lines._candidates(keys, n).collect()} for n in (1_000_000, 20))
    assert whole and whole <= split
    ids = {}
    for k, p, d, n in rows:
        ids.setdefault((d, n), set()).add((k, p))
    for d, n, e, m in split - whole:  # more candidates, all of lines that do meet, the earlier one earlier
        assert (e, m) < (d, n) and any(a[0] == b[0] and (a[1] == b[1] or -1 in (a[1], b[1])) for a in ids[d, n] for b in ids[e, m])


def test_lines_that_share_a_half_in_a_split_run(spark, small_batches):
    found = spark.createDataFrame([(i, 0, i, True, 7, 0, 0, 0) for i in range(43)], "doc_id long, line int, k long, first boolean, h1 long, h2 long, h3 long, h4 long").coalesce(1)
    for n in (1_000_000, 20, 6):
        assert {r.doc_id for r in lines._sharing(found, n).collect()} == set(range(43))
