import corpus_pipeline
from corvid.llm import lines, packing, quality, queries, secrets, simhash


def test_stages_follow_each_other(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_dedup", "secret_scan", "best_fit_packing"]
    key = lambda df: sorted(map(tuple, df.select("doc_id", "text").collect()), key=str)
    want = docs.join(quality.judge(docs).where("kept").select("doc_id"), "doc_id", "left_semi")
    step = corpus_pipeline.quality_rules(spark, docs, sf)
    assert key(step) == key(want) and step.columns == list(corpus_pipeline.COLUMNS)
    step = corpus_pipeline.line_dedup(spark, step, sf)
    assert key(step) == key(lines.remove(want))
    groups = simhash.near_duplicates(step)
    assert simhash.keep_one(step).count() == groups.select("component_id").distinct().count()
    step = secrets.redact(corpus_pipeline.simhash_dedup(spark, step, sf))
    want = packing.pieces(step, queries.vocabulary("byte_bpe_50k.json"), queries.split_pattern())
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_stages_take_odd_rows(spark, odd, empty):
    for docs in (odd.select(*corpus_pipeline.COLUMNS), empty.select(*corpus_pipeline.COLUMNS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, None)
            stays = {r.doc_id for r in docs.collect()} if name in ("line_dedup", "secret_scan") else {None} if docs.count() and name in ("simhash_dedup", "best_fit_packing") else set()
            assert stays <= {r.doc_id for r in out.select("doc_id").distinct().collect()}
            if name != "best_fit_packing":
                assert out.columns == list(corpus_pipeline.COLUMNS)
