"""Groups that hold most rows: results against brute force, and no task that gathers a group."""

import random
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corvid.operators import blocks
from corvid.operators import conversations as C
from corvid.operators import search as Q
from corvid.sources.documents import archive


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_latest_or_longest_holds_one_row(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, "x", "y", "é"]), rng.choice([None, 1, 2, 3])) for i in range(500)]
    df = C.latest_or_longest(spark.createDataFrame(rows, "k string, p int, u string, n int").repartition(7), "k", "p", "u", "n")
    want = {}
    for k, p, u, n in rows:
        held, count = want.get(k, (None, 0))
        if held is None or (u or "") > (held[1] or "") or (n is not None and held[2] is not None and n > held[2]):
            held = (p, u, n)
        want[k] = (held, count + 1)
    assert {r.k: (r.kept, r.n_candidates) for r in df.collect()} == {k: (h[0], m) for k, (h, m) in want.items()}
    assert "collect_list" not in plan(df)


def test_budget_brings_few_rows_together(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i, rng.choice([None, "", "x" * rng.randint(1, 90), "y" * 2000])) for i in range(600)]
    df = Q.budget(spark.createDataFrame(rows, "query_id string, rank int, text string").repartition(6), 500)
    want, used = [], {}
    for q, r, text in rows:
        if text is not None and used.get(q, 0) < 500:
            want.append((q, r, text[: 500 - used.get(q, 0)]))
            used[q] = used.get(q, 0) + len(text)
    assert sorted(map(tuple, df.select("query_id", "rank", "text").collect())) == sorted(want)
    assert plan(df).count("Window [") == 2


def test_shared_facts_of_one_target_are_many_tasks(spark):
    edges = [(i, "all") for i in range(60)] * 2 + [(i, f"t{i % 3}") for i in range(30)] + [(7, None), (None, "all"), (99, "all")]
    df = Q.shared_facts(spark.createDataFrame(edges, "doc long, target string"), spark.createDataFrame([(i,) for i in range(60)], "doc long"), 4, 200)
    want = {(a, b, t) for a, t in edges for b, u in edges if t is not None and t == u and None not in (a, b) and a != b and max(a, b) < 60}
    got = df.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.doc, r.other, r.target) for r in got) == sorted(want)
    held = Counter(r.part for r in got)
    assert max(held.values()) < len(want) / 4


def test_files_without_a_source_are_not_one_group(spark):
    head = lambda i: f"id: d{i % 190}\n" + (f"provider: p\nsource_id: s{i // 2}\n" if i < 20 else "")
    files = [(f"n/{i:03}.md", f"---\n{head(i)}---\n\nbody {i}") for i in range(200)] + [("n/900.md", "no header"), ("n/901.md", None)]
    kept, issues = archive(spark.createDataFrame(files, "path string, value string"))
    # Ids 0 to 9 come again as 190 to 199, and every second one of the first 20 has the source of the one before.
    assert sorted(r.path for r in kept.collect()) == [f"n/{i:03}.md" for i in range(190) if i >= 20 or i % 2 == 0]
    found = {r.path: r.issue for r in issues.collect()}
    assert found == {f"n/{i:03}.md": "duplicate source" for i in range(1, 20, 2)} | {f"n/{i}.md": "duplicate id" for i in range(190, 200)} | {"n/900.md": "no header", "n/901.md": "no header"}
    windows = [x for x in plan(kept).splitlines() if "Window [" in x]
    assert windows and all("_w" in x.split("], [")[1] for x in windows)  # the group of a row without a value is its path


def test_blocks_of_texts_are_read_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """A row group bounds what the reader holds at once; words bound a block, however long its texts are."""
    monkeypatch.setattr(blocks, "GROUP_BYTES", 1 << 20, raising=False)
    monkeypatch.setattr(blocks, "WORDS", 60_000, raising=False)
    sizes = [70_000, 0, 25_000, 35_000, 1] * 12
    texts = spark.createDataFrame([(i, f"w{i} " * n) for i, n in enumerate(sizes)], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([("a", "w0 w3"), ("b", "w1")], "query_id string, text string")
    assert {r.query_id: r.n for r in Q.keyword_counts(asked, texts, "doc_id", str(tmp_path / "blocks"), False).collect()} == {"a": 2}
    held = [(g.num_rows, g.total_byte_size) for f in (tmp_path / "blocks").glob("*.parquet") for g in (pq.ParquetFile(f).metadata.row_group(i) for i in range(pq.ParquetFile(f).metadata.num_row_groups))]
    rows = spark.read.parquet(str(tmp_path / "blocks")).select("n_words", F.size("keys").alias("texts")).collect()
    assert len(held) > 5 and max(n for n, _ in held) < len(rows) / 4
    assert sum(r.n_words for r in rows) == sum(sizes) and sum(r.texts for r in rows) == len(sizes)
    assert all(r.n_words <= 60_000 or r.texts == 1 for r in rows)


def test_texts_of_few_hits_are_not_shuffled(spark):
    hits = spark.createDataFrame([(1, 5, 1), (1, 9, 2), (2, 5, 1)], "query_id int, doc_id long, rank int")
    texts = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', int(id)) AS text")
    df = Q.with_texts(hits, texts, "doc_id")
    assert sorted((r.query_id, r["rank"], r.doc_id, len(r.text)) for r in df.collect()) == [(1, 1, 5, 5), (1, 2, 9, 9), (2, 1, 5, 5)]
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
