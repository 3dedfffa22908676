"""The kept keyword index: fields, commits, tombstones, compaction, skipped blocks."""

import math
import re
from collections import Counter

import pytest

from corvid.operators.index import KeywordIndex


def cut(*texts):
    return [w for t in texts if t for w in re.findall(r"[\w-]+", t.lower())]


def brute(docs, query, k, every=True):
    rows = {i: cut(*f) for i, f in docs.items()}
    n, mean = len(rows), sum(map(len, rows.values())) / len(rows)
    df, out = Counter(t for w in rows.values() for t in set(w)), []
    asked = set(cut(query))
    for i, w in rows.items():
        c = Counter(w)
        found = [t for t in asked if c[t]]
        if found and (not every or len(found) == len(asked)):
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in found)
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def rows(hits):
    return [(r.id, r.score) for r in sorted(hits.collect(), key=lambda r: r["rank"])]


SCHEMA = "id long, text string, title string"


@pytest.fixture
def index(spark, tmp_path):
    return KeywordIndex(spark, f"file://{tmp_path}/index", "id", ["text", "title"], block_docs=8)


def ask(spark, text):
    return spark.createDataFrame([(1, text)], "query_id long, text string")


def test_fields_are_searched_together(spark, index):
    docs = {1: ("deploy the site", "notes"), 2: ("nothing here", "Deploy plan"), 3: ("deploy deploy", None), 4: (None, None), 5: ("", "site")}
    index.upsert(spark.createDataFrame([(i, *f) for i, f in docs.items()] + [(None, "deploy", "x")], SCHEMA))
    for query, every in (("deploy", True), ("deploy site", True), ("deploy site", False), ("plan deploy notes", False), ("absent", True)):
        got = rows(index.search(ask(spark, query), 10, every))
        assert [i for i, _ in got] == [i for i, _ in brute(docs, query, 10, every)]
        assert [s for _, s in got] == pytest.approx([s for _, s in brute(docs, query, 10, every)], abs=2e-6)
    places = {(r.id, r.field, r.at) for r in index.places(spark.createDataFrame([("deploy",), ("site",)], "term string")).collect()}
    assert places == {(1, "text", 0), (1, "text", 2), (2, "title", 0), (3, "text", 0), (3, "text", 1), (5, "title", 0)}


def test_commits_equal_an_index_built_anew(spark, index, tmp_path):
    docs = {i: (f"word{i % 7} common term{i % 3} " * (1 + i % 4), f"title{i % 5}") for i in range(60)}
    frame = lambda d: spark.createDataFrame([(i, *f) for i, f in d.items()], SCHEMA)
    index.upsert(frame(docs))
    changed = {i: (f"changed word{i % 7}", "new common") for i in range(0, 60, 4)} | {100: ("common word1", "late")}
    index.upsert(frame(changed), spark.createDataFrame([(5,), (6,), (999,), (None,)], "id long"))
    index.upsert(frame({8: ("common again", "x"), 5: ("back common", "x")}))
    docs.update(changed)
    del docs[6]
    docs.update({8: ("common again", "x"), 5: ("back common", "x")})
    fresh = KeywordIndex(spark, f"file://{tmp_path}/fresh", "id", ["text", "title"], block_docs=8)
    fresh.upsert(frame(docs))
    assert {(r.id, r.dl) for r in index.documents().collect()} == {(r.id, r.dl) for r in fresh.documents().collect()}
    queries = spark.createDataFrame([(1, "common"), (2, "word1 common"), (3, "changed title2 word3"), (4, "back")], "query_id long, text string")
    seen = lambda x: sorted((r.query_id, r["rank"], r.id, r.score) for r in x.search(queries, 7, False).collect())
    want = seen(fresh)
    assert seen(index) == want and len(index._segments()) == 3
    index.compact()
    assert seen(index) == want and [s.tombstones for s in index._segments()] == [0]
    assert index._segments()[0].docs == len(docs)


def test_failed_compaction_leaves_the_old_list(spark, index, monkeypatch):
    for i in range(2):
        index.upsert(spark.createDataFrame([(i, "same words", "t")], SCHEMA))
    before = index._segments()

    def fail(*_):
        raise OSError("disk")

    monkeypatch.setattr(index, "_packed", fail)
    with pytest.raises(OSError):
        index.compact()
    monkeypatch.undo()
    assert index._segments() == before
    assert [i for i, _ in rows(index.search(ask(spark, "same"), 5))] == [0, 1]


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, index):
    docs = [(i, "rare common" if i < 40 else "common " + "filler " * (30 + i % 9), None) for i in range(800)]
    index.upsert(spark.createDataFrame(docs, SCHEMA))
    got = rows(index.search(ask(spark, "common"), 3, first=2))
    assert got == [(i, pytest.approx(s, abs=2e-6)) for i, s in brute({i: (t, n) for i, t, n in docs}, "common", 3)]
    bounds, early, late = index.visits
    assert early.count() == 2 and early.count() + late.count() < bounds.count()


def test_postings_are_rows_of_blocks(spark, index):
    docs = {i: (" ".join(f"w{(i * 7 + j * j) % 211}" for j in range(40)), f"t{i % 3}") for i in range(64)}
    frame = lambda d: spark.createDataFrame([(i, *f) for i, f in d.items()], SCHEMA)
    index.upsert(frame(docs))
    index.upsert(frame({i: docs[i] for i in range(0, 64, 2)}))
    read = lambda s: spark.read.parquet(f"{index.root}/segments/{s.segment}/postings")
    # Blocks of 8 documents, and one more a task, not a row for each of some 200 terms of a block.
    assert [read(s).count() <= n // 8 + 4 for s, n in zip(index._segments(), (64, 32), strict=True)] == [True, True]
    index.compact()
    (only,) = index._segments()
    assert read(only).count() <= 64 // 8 + 8 and only.docs == 64
    for query in ("w1 w5 t1", "w100", "t2 w3 w3"):
        got = rows(index.search(ask(spark, query), 64, False))
        assert got == [(i, pytest.approx(s, abs=2e-6)) for i, s in brute(docs, query, 64, False)]
