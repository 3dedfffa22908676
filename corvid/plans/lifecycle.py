"""Queries of what is written and read again: files, versions behind a pointer, checked batches, injected models."""

from pyspark.sql import functions as F

from corvid.operators import access as A
from corvid.operators import models as M
from corvid.operators import search as Q
from corvid.operators import versions as V
from corvid.sinks import render as K
from corvid.sources import documents as D
from corvid.sources import transcripts as R
from corvid.streaming import ingest

from .joins import path
from .registry import query

c = F.col


@query("s02_file_listing", "SELECT source, lang, true AS listed FROM documents GROUP BY ALL")
def _(t):
    root = K.shared_folder(t.spark, "files")
    t("documents").select("source", "lang", "text").repartition("source", "lang").write.partitionBy("source", "lang").json(root)
    part = lambda n: F.url_decode(F.regexp_extract("path", rf"/{n}=([^/]+)/", 1))
    found = R.list_files(t.spark, root, ".json").select(part("source").alias("source"), part("lang").alias("lang"), (c("length") > 0).alias("ok"))
    return found.groupBy("source", "lang").agg(F.bool_and("ok").alias("listed"))


@query("s13_pick_export", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'x/Conversations.json' ELSE 'e0.json' END AS path, CASE WHEN count(*) > 1 THEN 'read ' || count(*) || ' JSON entries; selected ' || CASE WHEN conv_id % 3 = 0 THEN 'x/Conversations.json' ELSE 'e0.json' END END AS warning FROM conversations GROUP BY conv_id")
def _(t):
    last = t("conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    name = F.when((c("conv_id") % 3 == 0) & (c("turn") == c("last")), "x/Conversations.json").otherwise(F.concat(F.lit("e"), c("turn").cast("string"), F.lit(".json")))
    return D.pick_export(t("conversations").join(last, "conv_id").select("conv_id", name.alias("path"), c("turn").alias("pos")), "conv_id")


@query("s15_filesystem_source", """SELECT sha256('/root/docs' || chr(0) || 'a/' || doc_id || ext) AS external_id, 'files/a/' || doc_id || '.md' AS path, sha256(CASE WHEN ext = '.txt' THEN '# ' || doc_id || ext || chr(10) || chr(10) ELSE '' END || text) AS content_hash
FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN '.txt' ELSE '.md' END AS ext FROM documents WHERE doc_id % 4 < 2)""")
def _(t):
    name = F.concat(F.when(c("doc_id") % 4 == 3, "a/.hidden/").otherwise("a/"), c("doc_id").cast("string"), F.when(c("doc_id") % 4 == 0, ".txt").when(c("doc_id") % 4 == 2, ".csv").otherwise(".md"))
    files = t("documents").select(F.concat(F.lit("file:///root/docs/"), name).alias("path"), F.lit(0).cast("timestamp").alias("modificationTime"), F.encode("text", "UTF-8").alias("content"))
    return D.filesystem(files, "/root/docs").select("external_id", "path", "content_hash")


def versions_of(t, name):
    """Two versions published one after the other."""
    root = K.shared_folder(t.spark, name)
    d = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    first = K.publish(d, root)
    K.publish(d.where("doc_id % 3 = 0").withColumn("hash", F.lit("none")), root, dry_run=True)
    return root, d, first


@query("k03_apply_changes", "SELECT doc_id, sha256(text || CASE WHEN doc_id % 11 = 1 THEN '!' ELSE '' END) AS hash FROM documents WHERE doc_id % 11 > 0")
def _(t):
    root, _, _ = versions_of(t, "archive")
    changed = t("documents").where("doc_id % 11 > 0").select("doc_id", "source", F.sha2(F.when(c("doc_id") % 11 == 1, F.concat("text", F.lit("!"))).otherwise(c("text")), 256).alias("hash"))
    K.publish(changed, root)
    return K.current(t.spark, root).select("doc_id", "hash")


@query("k07_saved_state", "SELECT source AS provider, doc_id AS source_id, CASE WHEN doc_id % 5 = 0 THEN sha256('new') ELSE sha256(text) END AS fingerprint FROM documents")
def _(t):
    root, d, _ = versions_of(t, "state")
    held = K.current(t.spark, root).select(c("source").alias("provider"), c("doc_id").alias("source_id"), c("hash").alias("fingerprint"), F.lit(1).alias("run"))
    new = d.where("doc_id % 5 = 0").select(c("source").alias("provider"), c("doc_id").alias("source_id"), F.sha2(F.lit("new"), 256).alias("fingerprint"), F.lit(2).alias("run"))
    K.publish(V.latest(held.unionByName(new), ["provider", "source_id"], c("run")), root)
    return K.current(t.spark, root).select("provider", "source_id", "fingerprint")


@query("c15_isolated_projection", "SELECT doc_id, 'notes/' || doc_id || '.md' AS path FROM documents")
def _(t):
    """A run that fails its check leaves the version before it current."""
    root = K.shared_folder(t.spark, "projection")
    rows = t("documents").select("doc_id", path(c("doc_id")).alias("path"))
    K.publish(rows, root)

    def refuse(written):
        raise ValueError(f"{len(written.columns)} columns")

    try:
        K.publish(rows.limit(0), root, check=refuse)
    except ValueError:
        pass
    return K.current(t.spark, root)


@query("c18_model_replacement", "SELECT doc_id, 32 AS dimensions FROM documents")
def _(t):
    """The second model replaces the first; a third that lacks documents does not; a rollback brings back the second."""
    root, docs = K.shared_folder(t.spark, "vectors"), t("documents").select("doc_id", "text")
    K.replace_model(docs, M.hashed_vectors(docs, "doc_id", dimensions=16), root, "doc_id")
    second = K.replace_model(docs, M.hashed_vectors(docs, "doc_id", dimensions=32), root, "doc_id")
    try:
        K.replace_model(docs, M.hashed_vectors(docs.where("doc_id % 2 = 0"), "doc_id", dimensions=8), root, "doc_id")
    except ValueError:
        pass
    K.replace_model(docs, M.hashed_vectors(docs, "doc_id", dimensions=4), root, "doc_id")
    K.rollback(t.spark, root, second)
    return K.current(t.spark, root).select("doc_id", F.size("v").alias("dimensions"))


def ingested(t, name, bad):
    """Documents written as two drops, taken in by the stream; the second drop holds bad rows if ``bad``."""
    root = K.shared_folder(t.spark, name)
    d = c("doc_id")
    text = F.when(d % 5 == 0, F.concat("text", F.col("drop"))).otherwise(c("text"))
    rows = t("documents").withColumn("drop", F.explode(F.array(F.lit("1"), F.when(d % 5 == 0, "2")))).where("drop is not null")
    hash_ = F.when((c("drop") == "2") & F.lit(bad), "wrong").otherwise(F.sha2(text, 256))
    rows = rows.select(d.cast("string").alias("external_id"), path(d).alias("path"), text.alias("content"), hash_.alias("content_hash"), F.lit("web").alias("source_type"), c("drop").alias("updated_at"))
    for drop in ("1", "2"):
        rows.where(c("updated_at") == drop).write.mode("append").parquet(f"{root}/in")
        ingest.start(t.spark.readStream.schema(rows.schema).parquet(f"{root}/in"), root, "skip").awaitTermination()
    return root


@query("st01_incremental_ingest", "SELECT doc_id::VARCHAR AS external_id, sha256(text || CASE WHEN doc_id % 5 = 0 THEN '2' ELSE '' END) AS content_hash FROM documents")
def _(t):
    root = ingested(t, "ingest", False)
    return ingest.current(t.spark.read.parquet(f"{root}/log")).select("external_id", "content_hash")


@query("st02_quarantine", "SELECT doc_id::VARCHAR AS external_id, 'hash differs' AS issue FROM documents WHERE doc_id % 5 = 0")
def _(t):
    root = ingested(t, "quarantine", True)
    return t.spark.read.parquet(f"{root}/quarantine").select("external_id", "issue")


@query("st03_ingestion_runs", "SELECT status, n_bad FROM (SELECT 'complete' AS status, 0::BIGINT AS n_bad, 0 AS o UNION ALL SELECT 'failed', count(*), 1 FROM documents WHERE doc_id % 5 = 0)")
def _(t):
    root = ingested(t, "runs", True)
    return t.spark.read.parquet(f"{root}/runs").select("status", "n_bad")


@query("f41_stable_hash", "SELECT doc_id, true AS same FROM documents")
def _(t):
    scan = lambda at: t("documents").withColumn("retrieved_at", F.lit(at))
    one, two = (s.select("doc_id", A.stable_hash(s).alias(n)) for s, n in ((scan("a"), "a"), (scan("b"), "b")))
    return one.join(two, "doc_id").select("doc_id", (c("a") == c("b")).alias("same"))


@query("u07_adapter_conformance", "SELECT doc_id, 2::BIGINT AS n FROM documents WHERE doc_id % 7 = 0")
def _(t):
    """Two scans of a source that numbers its scans in every seventh document: just those differ."""
    scans = iter("ab")

    def scan():
        at = next(scans)
        return t("documents").withColumns({"retrieved_at": F.lit(at), "lang": F.when(c("doc_id") % 7 == 0, F.lit(at)).otherwise(c("lang"))})

    return A.nondeterministic(scan, "doc_id")


@query("p07_tenant_isolation", "SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 2 AND (c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def _(t):
    rows = t("customer").select("c_custkey", (c("c_nationkey") % 5).cast("string").alias("tenant"), c("c_mktsegment").alias("brain"))
    member = rows.where("brain in ('BUILDING', 'MACHINERY')").select("tenant", "brain", F.lit("u").alias("user")).distinct()
    return A.isolated(rows, member.unionByName(member.withColumn("user", F.lit("v")).withColumn("brain", F.lit(None).cast("string"))), "2", "u").select("c_custkey")


@query("u02_injected_reranker", "SELECT l_suppkey % 50 AS query_id, l_orderkey * 10 + l_linenumber AS chunk, row_number() OVER (PARTITION BY l_suppkey % 50 ORDER BY r > 128, CASE WHEN r <= 128 THEN -length(l_shipmode) END, r)::INT AS place FROM (SELECT *, l_returnflag || l_linenumber AS l_shipmode, row_number() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem)")
def _(t):
    rows = t("lineitem").select((c("l_suppkey") % 50).alias("query_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("chunk"), (-(c("l_orderkey") * 10 + c("l_linenumber"))).alias("score"), F.concat("l_returnflag", c("l_linenumber").cast("string")).alias("text"), F.lit("q").alias("query"))
    ranks = Q.ranked(rows, 1 << 30, "chunk")
    return M.rerank(ranks, lambda q, s: s.str.len().astype("float64"), "chunk").select("query_id", "chunk", "place")


@query("u05_structured_extraction", "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN lang END AS lang, doc_id % 4 = 0 AS failed FROM documents")
def _(t):
    texts = t("documents").select("doc_id", F.when(c("doc_id") % 4 == 0, "no JSON {").otherwise(F.to_json(F.struct("lang", "source"))).alias("text"))
    return M.extract(texts, "doc_id", "lang string, source string", lambda s: s).select("doc_id", c("value.lang").alias("lang"), "failed")


@query("u08_table_function", r"SELECT doc_id::VARCHAR AS doc_id, length(regexp_replace(text, '[\s\p{Z}]+', '', 'g'))::BIGINT AS kept FROM documents")
def _(t):
    """A chunker as a table function that SQL calls for each row."""
    from corvid.operators import chunks

    t.spark.udtf.register("markdown_chunks", chunks.markdown_function)
    t("documents").select("doc_id", "text").createOrReplaceTempView("corvid_documents")
    cut = t.spark.sql("SELECT d.doc_id, m.text FROM corvid_documents d, LATERAL markdown_chunks(d.text, 1200) m")
    return cut.groupBy(c("doc_id").cast("string").alias("doc_id")).agg(F.sum(F.length(F.regexp_replace("text", r"(?U)\s+", ""))).alias("kept"))
