"""The view that a stream keeps of a change log equals the batch twin after each batch."""

import random

import pytest

from corvid.streaming.view import CompactedView

SCHEMA = "id long, version long, deleted boolean, text string"


@pytest.fixture
def view(spark, tmp_path):
    return CompactedView(spark, f"file://{tmp_path}/view", "id", "version")


def rows(df):
    return sorted(map(tuple, df.select("id", "version", "text").collect()))


def current(batches):
    """Batch by batch in plain Python; versions of a batch's key differ."""
    held = {}
    for batch in batches:
        for i, v, gone, text in batch:
            if i is not None and (i not in held or (v is not None, v or 0) >= (held[i][0] is not None, held[i][0] or 0)):
                held[i] = (v, gone, text)
    return sorted((i, v, text) for i, (v, gone, text) in held.items() if not gone)


def test_each_batch_equals_the_log(spark, view):
    rng, batches = random.Random(1), []
    for b in range(7):
        keys = range(40) if b == 0 else rng.sample(range(50), 8)
        batches.append([(i, rng.choice([b, b - 2]), rng.choice([None, False, True]), f"{b}-{i}") for i in keys] + [(None, 1, False, "x")])
        frame = spark.createDataFrame(batches[-1], SCHEMA)
        view.commit(frame, b)
        assert rows(view.read()) == current(batches)
        view.commit(spark.createDataFrame([(0, 999, False, "repeated")], SCHEMA), b)
        assert rows(view.read()) == current(batches)
    assert len(view.parts()) <= 3  # 8 rows a batch: compacted once deltas pass half of the base


def test_snapshot_and_failed_compaction(spark, view, monkeypatch):
    view.commit(spark.createDataFrame([(1, 1, False, "a"), (2, 1, False, "b")], SCHEMA), 0)
    before = view.read()
    real = view._merged
    monkeypatch.setattr(view, "_merged", lambda parts: real(parts).selectExpr("*", "raise_error('boom') AS x"))
    with pytest.raises(Exception, match="boom"):
        view.commit(spark.createDataFrame([(1, 2, True, "gone"), (3, 1, None, "c")], SCHEMA), 1)
    monkeypatch.setattr(view, "_merged", real)
    assert rows(before) == [(1, 1, "a"), (2, 1, "b")]
    assert rows(view.read()) == [(2, 1, "b"), (3, 1, "c")] and len(view.parts()) == 2
    view.commit(spark.createDataFrame([(1, 1, False, "late")], SCHEMA), 2)
    assert rows(view.read()) == [(2, 1, "b"), (3, 1, "c")] and len(view.parts()) == 1


def test_odd_rows(spark, view):
    with pytest.raises(ValueError, match="nothing"):
        view.read()
    view.commit(spark.createDataFrame([], SCHEMA), 0)
    assert rows(view.read()) == []
    view.commit(spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, 1, False, "x"), (2, 1, False, "y")], SCHEMA), 1)
    first = rows(view.read())
    assert [r[:2] for r in first] == [(1, None), (2, 1)]
    view.commit(spark.createDataFrame([(2, 1, False, "later")], SCHEMA), 2)
    assert rows(view.read()) == [(1, None, None), (2, 1, "later")]
