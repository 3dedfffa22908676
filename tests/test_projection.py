"""Projections keep what didn't change and refuse a stale base or a wrong hash."""

import hashlib

import pytest

from corvid.operators import projection as P

SCHEMA = "id long, path string, content string, hash string, revision string, meta string, deleted boolean"


def page(i, content, revision="r1", path=None, meta="m", deleted=None):
    return i, path or f"{i}.md", content, hashlib.sha256(content.encode()).hexdigest(), revision, meta, deleted


def test_incremental_projection(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    one = spark.createDataFrame([page(1, "# a\nsee [[b.md]]"), page(2, "two"), page(3, "three"), page(4, "gone", deleted=True), page(5, "five")], SCHEMA)
    P.full(one, root, "c1")
    assert {r.id for r in P.read(spark, root, "documents").collect()} == {1, 2, 3, 5}
    held = {(r.id, r.chunk) for r in P.read(spark, root, "chunks").collect()}
    two = spark.createDataFrame([page(1, "# a\nsee [[c.md]]", "r2"), page(2, "two", meta="other"), page(3, "three", path="x/3.md"), page(4, "back"), page(6, "new")], SCHEMA)
    facts = spark.createDataFrame([(1, "f"), (2, "g"), (5, "h"), (9, "i")], "id long, fact string")
    left = P.incremental(one, two, root, "c1", "c2", {"facts": facts})["facts"]
    assert {r.id for r in left.collect()} == {2, 9}
    assert {(r.id, r.path, r.meta) for r in P.read(spark, root, "documents").collect()} == {(1, "1.md", "m"), (2, "2.md", "other"), (3, "x/3.md", "m"), (4, "4.md", "m"), (6, "6.md", "m")}
    now = {(r.id, r.chunk) for r in P.read(spark, root, "chunks").collect()}
    assert {x for x in held if x[0] in (2, 3)} <= now and {i for i, _ in now} == {1, 2, 3, 4, 6}
    assert [(r.id, r.target) for r in P.read(spark, root, "links").collect()] == [(1, "c.md")]
    assert {(r.id, r.revision, r.commit) for r in P.read(spark, root, "revisions").collect()} == {(1, "r1", "c1"), (1, "r2", "c2"), (2, "r1", "c1"), (3, "r1", "c1"), (4, "r1", "c1"), (5, "r1", "c1"), (6, "r1", "c2")}
    with pytest.raises(P.StaleBase):
        P.incremental(one, two, root, "c1", "c3")


def test_a_wrong_hash_leaves_the_projection(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    P.full(spark.createDataFrame([page(1, "one")], SCHEMA), root, "c1")
    bad = spark.createDataFrame([(*page(1, "one")[:3], "0" * 64, "r2", "m", None)], SCHEMA)
    with pytest.raises(Exception, match="content hash mismatch"):
        P.full(bad, root, "c2")
    assert P.active(spark, root) == "c1" and P.read(spark, root, "chunks").count() == 1
