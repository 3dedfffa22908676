import math
import random
import re
from collections import Counter

from corvid.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    rows = [(d, Counter(cut(t)), len(cut(t))) for d, t in docs if cut(t)]
    n_docs, n_terms = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in rows:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in cut(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, *_, d) in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


def rows(df):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def pairs(df, name="doc_id"):
    return [(r[name], r.text) for r in df.select(name, "text").collect()]


def test_search_matches_brute_force(spark, odd, documents):
    docs = odd.select("doc_id", "text").unionByName(documents.selectExpr("doc_id + 1000 as doc_id", "text"))
    items = documents.where("doc_id % 40 = 0").selectExpr("doc_id as item_id", "substr(text, 1, 400) as text").unionByName(
        spark.createDataFrame([(1, None), (2, ""), (3, "alpha3 ÜBER über naïve naïve"), (3, "nothing-of-this is_there qqqq"), (4, "the the the"), (None, "delta")], "item_id long, text string"))
    index = lexical.StratifiedIndex(docs, block_docs=7, block_terms=3000)
    want = brute(pairs(docs), pairs(items, "item_id"))
    assert rows(index.search(items)) == want
    assert rows(index.search(items, chunk=2, first=1)) == want
    assert rows(index.search(items, k=3)) == brute(pairs(docs), pairs(items, "item_id"), 3)


def test_ties_and_copies(spark):
    docs = spark.createDataFrame([(i % 40 if i % 9 else None, "same words here") for i in range(120)] + [(500 + i, "other text entirely") for i in range(200)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words same"), (2, "entirely other here")], "item_id long, text string")
    assert rows(lexical.StratifiedIndex(docs, block_docs=16).search(items)) == brute(pairs(docs), pairs(items, "item_id"))


def test_strata_below_the_bar_are_not_visited(spark):
    rng = random.Random(1)
    docs = [(i, "rare common") for i in range(30)] + [(100 + i, "common " + " ".join(f"w{rng.randrange(50)}" for _ in range(20 + i))) for i in range(300)]
    index = lexical.StratifiedIndex(spark.createDataFrame(docs, "doc_id long, text string"))
    items = spark.createDataFrame([(1, "rare common")], "item_id long, text string")
    assert rows(index.search(items)) == brute(docs, [(1, "rare common")])
    bounds, early, late = index.visited
    assert bounds.count() > 50 and early.count() + late.count() <= 3


def test_index_has_every_posting(spark, odd):
    docs = odd.where("coalesce(length(text), 0) < 20000").select("doc_id", "text")
    index = lexical.StratifiedIndex(docs, block_docs=3)
    got = Counter()
    heads = {(r.m, r.slice): r.ids for r in index.rows.where("term is null").collect()}
    for r in index.rows.where("term is not null").collect():
        assert r.tfs == sorted(r.tfs, reverse=True) and r.tfs[0] == r.top_tf and len(r.docs) == r.n_docs == sum(r.counts)
        for doc, tf in zip(r.docs, [t for t, c in zip(r.tfs, r.counts, strict=True) for _ in range(c)], strict=True):
            got[heads[r.m, r.slice][doc], bytes(r.term).decode(), tf] += 1
    want = Counter((d, t, n) for d, text in pairs(docs) for t, n in Counter(cut(text)).items())
    assert got == want


def test_empty(spark, empty):
    index = lexical.StratifiedIndex(empty)
    assert index.search(spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert lexical.StratifiedIndex(spark.createDataFrame([(1, "a")], "doc_id long, text string")).search(empty.withColumnRenamed("doc_id", "item_id")).count() == 0
