import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvid.llm import periods


def brute(w, min_length=6, min_exponent=4):
    """All runs by comparing the words with themselves at each distance."""
    found = {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def found(words, *bounds):
    number = {}
    return [tuple(r) for r in periods.find_runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64), *bounds).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(0, 40), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=6))
def test_runs_match_all_distances(head, size, period, tail):
    words = [*head, *[k % period % 3 for k in range(size)], *tail]
    assert found(words) == brute(words)
    assert found(words, 3, 2) == brute(words, 3, 2)
    assert found(words, 10, 3) == brute(words, 10, 3)


def test_common_extensions_match_plain_comparison():
    rng = random.Random(2)
    for _ in range(50):
        s = [rng.randrange(1, 4) for _ in range(rng.randrange(2, 60))]
        lce = periods.Extensions([*s, 0], 4)
        assert np.argsort(lce.rank)[1:].tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        pairs = [(i, j) for i in range(len(s)) for j in range(i + 1, len(s))]
        i, j = np.array(pairs).T
        plain = [next((k for k in range(len(s) - b) if s[a + k] != s[b + k]), len(s) - b) for a, b in pairs]
        assert lce(i, j).tolist() == plain and lce(j, i).tolist() == plain


def test_rows_match_brute_force(odd, documents):
    docs = odd.select("doc_id", "text").where("coalesce(length(text), 0) < 20000").unionByName(documents.selectExpr("doc_id + 1000 as doc_id", "concat(text, repeat(' la la ti', 40), ' end') as text"))
    got = periods.detect(docs).collect()
    assert len(got) == docs.count()
    want = {}
    for r in docs.collect():
        words = (r.text or "").encode().split()
        runs = brute(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.setdefault((r.doc_id, len(words), tuple(runs), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()), []).append(1)
    assert sum(map(len, want.values())) == len(got)
    for r in got:
        want[r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed].pop()


def test_digest_of_ties_and_none(spark, empty):
    text = "x a a a a a a y b b b b b b z " + "p q " * 4 + "end"
    out = {r.doc_id: r for r in periods.digest(periods.detect(spark.createDataFrame([(1, text), (2, None), (3, "a " * 5)], "doc_id long, text string"))).collect()}
    assert (out[1].n_runs, out[1].start, out[1].length, out[1].period, out[1].exponent_milli) == (3, 15, 8, 2, 4000)
    for i in (2, 3):
        assert (out[i].n_runs, out[i].start, out[i].length, out[i].period, out[i].exponent_milli) == (0, None, None, None, None)
    assert periods.detect(empty).count() == 0
    with pytest.raises(ValueError):
        periods.detect(empty, min_exponent=1)


def test_one_long_period(spark):
    """A text of 200,000 words of one period, and one of a single repeated word."""
    rng = random.Random(3)
    part = [str(rng.randrange(900)) for _ in range(40_000)]
    docs = spark.createDataFrame([(1, " ".join(part * 5)), (2, "w " * 100_000)], "doc_id long, text string")
    out = {r.doc_id: r for r in periods.detect(docs).collect()}
    assert [tuple(x) for x in out[1].runs] == [(0, 200_000, 40_000)] and out[1].collapsed == " ".join(part)
    assert [tuple(x) for x in out[2].runs] == [(0, 100_000, 1)] and out[2].collapsed == "w"
