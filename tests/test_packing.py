"""Packing by ranges equals the fold over each key's pieces in order."""

import random

import numpy as np
import pytest

from corvid.operators import packing
from corvid.streaming import folds

SCHEMA = "key string, event_id long, at long, units long"


def fold(units, limit, gap, size=0):
    opened = 0
    for u in units:
        if size + u + gap > limit:
            size, opened = u, opened + 1
        else:
            size += u + gap
    return size, opened


@pytest.mark.parametrize("gap", [0, 2])
def test_descriptions_equal_the_fold_from_any_size(gap):
    rng = random.Random(gap)
    for n in (1, 2, 7, 40):
        units = np.array([rng.choice([0, 3, 30, 99, 100, 150]) for _ in range(n)])
        bounds, sizes, opened, total = packing.describe(units, 100, gap)
        for size in range(0, 160):
            p = next((i for i, b in enumerate(bounds) if b < size), None)
            assert (size + total, 0) == fold(units, 100, gap, size) if p is None else (sizes[p], opened[p]) == fold(units, 100, gap, size)


@pytest.mark.parametrize("range_rows", [1, 3, 64, 10_000])
def test_one_key_with_most_rows(spark, range_rows):
    rng = random.Random(9)
    rows = [("hot" if i % 5 else rng.choice(["a", "b", None]), i, rng.randrange(50), rng.choice([0, 5, 40, 99, 300])) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, packing.greedy(df, 100, 2, range_rows).collect()), key=lambda r: r[1])
    assert got == sorted(map(tuple, folds.batch(df, folds.packing(100)).collect()), key=lambda r: r[1])


def test_odd_rows(spark):
    assert packing.greedy(spark.createDataFrame([], SCHEMA), 10).collect() == []
    df = spark.createDataFrame([(None, 1, 0, None), (None, 2, 0, 8), (None, 3, 0, 8), ("x", 4, None, 50), ("x", 5, 1, 1)], SCHEMA)
    assert {r.event_id: r.accepted for r in packing.greedy(df, 10).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}
