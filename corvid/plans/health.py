"""Queries of sync reports, health, dashboards, evaluations, checked facts and the like."""

from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.operators import reports as H

from .registry import query

c = F.col
_NOW = "TIMESTAMP '2024-03-01 00:00:00'"


def now():
    return F.lit("2024-03-01").cast("timestamp")


def sync(t):
    """Documents as scanned conversations, the changes they led to, and warnings and failures of some."""
    d = t("documents").withColumn("provider", c("source"))
    k = c("doc_id")
    scans = d.select("provider", (k % 5).alias("redactions"))
    changes = d.select("provider", F.when(k % 3 == 0, "create").when(k % 3 == 1, "update").otherwise("skip").alias("kind"))
    path = F.when(k % 2 == 0, F.concat(F.lit("p/"), k.cast("string")))
    notes = d.where((k % 7 == 0) | (k % 13 == 0)).select("provider", path.alias("path"), F.when(k % 7 == 0, "warning").otherwise("failure").alias("kind"), F.concat(F.lit("line "), k.cast("string")).alias("message"))
    return scans, changes, notes


_SYNC = """SELECT source AS provider, count(*) AS scanned, count(*) FILTER (WHERE doc_id % 3 = 0) AS created, count(*) FILTER (WHERE doc_id % 3 = 1) AS updated, count(*) FILTER (WHERE doc_id % 3 = 2) AS skipped,
sum(doc_id % 5)::BIGINT AS redacted, count(*) FILTER (WHERE doc_id % 7 = 0) AS warnings, count(*) FILTER (WHERE doc_id % 13 = 0 AND doc_id % 7 <> 0) AS failures FROM documents GROUP BY ROLLUP (source)"""


@query("a01_sync_measures", _SYNC)
def _(t):
    return H.sync_totals(*sync(t))


@query("k05_sync_report_lines", f"""WITH s AS ({_SYNC}), n AS (SELECT source AS provider, CASE WHEN doc_id % 2 = 0 THEN 'p/' || doc_id END AS path, doc_id % 7 = 0 AS w, 'line ' || doc_id AS message FROM documents WHERE doc_id % 7 = 0 OR doc_id % 13 = 0)
SELECT 0 AS section, '# Chat History Sync Report' AS line UNION ALL SELECT 0, '| Scope | Scanned | Created | Updated | Skipped | Redacted | Warnings | Failures |' UNION ALL SELECT 0, '| --- | ---: | ---: | ---: | ---: | ---: | ---: | ---: |'
UNION ALL SELECT 1, '| ' || coalesce(provider, 'total') || ' | ' || scanned || ' | ' || created || ' | ' || updated || ' | ' || skipped || ' | ' || redacted || ' | ' || warnings || ' | ' || failures || ' |' FROM s
UNION ALL SELECT 2, '## Warnings' UNION ALL SELECT 4, '## Failures' UNION ALL SELECT CASE WHEN w THEN 3 ELSE 5 END, '- [' || provider || '] ' || coalesce(path || ': ', '') || message FROM n
UNION ALL SELECT 3, '- None' WHERE NOT EXISTS (FROM n WHERE w) UNION ALL SELECT 5, '- None' WHERE NOT EXISTS (FROM n WHERE NOT w)""")
def _(t):
    scans, changes, notes = sync(t)
    return H.sync_report(H.sync_totals(scans, changes, notes), notes).select("section", "line")


@query("a02_checkpoint_health", """WITH x AS (SELECT count(*) AS archived, count(*) FILTER (WHERE doc_id % 17 > 0) AS indexed_documents, count(*) FILTER (WHERE doc_id % 17 < 2) AS stale FROM documents),
y AS (SELECT count(*) FILTER (WHERE s = 'P') AS pending, count(*) FILTER (WHERE s = 'U') AS uploaded, count(*) FILTER (WHERE s = 'O') AS indexed, count(*) FILTER (WHERE s = 'F') AS failed, (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 0) AS tombstones FROM (SELECT o_orderstatus AS s FROM orders WHERE o_orderkey % 100 > 0))
SELECT *, w AS warnings, len(w) = 0 AS ok FROM (SELECT *, list_filter([CASE WHEN stale > 0 THEN 'index is stale; run index' END, CASE WHEN pending > 0 AND uploaded = 0 THEN 'semantic index is stale; run index' END, CASE WHEN uploaded > 0 THEN 'semantic indexing is pending remote completion' END,
CASE WHEN failed > 0 THEN 'semantic synchronization has failed work' END, CASE WHEN tombstones > 0 THEN 'semantic deletions are pending' END], lambda v: v IS NOT NULL) AS w FROM x, y)""".replace("SELECT *, w AS warnings, len(w) = 0 AS ok FROM", "SELECT archived, indexed_documents, stale, pending, uploaded, indexed, failed, tombstones, w AS warnings, len(w) = 0 AS ok FROM"))
def _(t):
    archive = t("documents").select(c("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    indexed = archive.where("id % 17 > 0").withColumn("hash", F.when(c("id") % 17 == 1, "old").otherwise(c("hash")))
    status = F.when(c("o_orderstatus") == "P", "pending").when(c("o_orderstatus") == "O", "indexed").when(c("o_orderstatus") == "F", "failed")
    return H.checkpoint_health(archive, indexed, t("orders").select(status.alias("status"), (c("o_orderkey") % 100 == 0).alias("deleted")))


@query("a03_source_measures", f"""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 19 > 0 THEN source END AS source, doc_id % 23 = 0 AS deleted, doc_id % 4 = 0 AS stale, doc_id % 3 > 0 AS x, CASE WHEN doc_id % 29 > 0 THEN TIMESTAMP '2024-01-01' + to_seconds(doc_id) END AS updated FROM documents),
e AS (SELECT *, coalesce(source, 'manual') AS s FROM d), o AS (SELECT s, count(*) FILTER (WHERE NOT deleted) AS active, count(*) FILTER (WHERE NOT deleted AND x) AS extracted, count(*) FILTER (WHERE stale) AS stale, max(updated) AS newest FROM e GROUP BY 1),
k AS (SELECT s, count(*) AS chunks, count(*) FILTER (WHERE l_linenumber > 1) AS embedded FROM e JOIN lineitem ON l_orderkey = id GROUP BY 1), q AS (SELECT source AS s, count(*) AS n FROM documents WHERE doc_id % 31 = 0 GROUP BY 1)
SELECT o.s AS source, active, extracted, stale, coalesce(chunks, 0) AS chunks, coalesce(embedded, 0) AS embedded, coalesce(n, 0) AS quarantined, round(CASE WHEN chunks > 0 THEN embedded / chunks ELSE 1 END, 6) AS embedding_coverage, round(CASE WHEN active > 0 THEN extracted / active ELSE 1 END, 6) AS extraction_coverage,
greatest(0, epoch({_NOW}) - epoch(newest))::BIGINT AS lag_seconds FROM o LEFT JOIN k ON k.s = o.s LEFT JOIN q ON q.s = o.s""")
def _(t):
    k = c("doc_id")
    updated = F.when(k % 29 > 0, F.timestamp_seconds(F.lit(1704067200) + k))
    docs = t("documents").select(k.alias("id"), F.when(k % 19 > 0, c("source")).alias("source"), (k % 23 == 0).alias("deleted"), (k % 4 == 0).alias("stale"), F.when(k % 3 > 0, "text").alias("extractor"), updated.alias("updated"))
    chunks = t("lineitem").select(c("l_orderkey").alias("id"), (c("l_linenumber") > 1).alias("embedded"))
    return H.source_health(docs, chunks, t("documents").where(k % 31 == 0).select("source"), now()).drop("newest")


@query("a12_replay_exact", "WITH r AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS e, list_sort(list_distinct(list(1 + l_suppkey % 7))) AS a FROM lineitem GROUP BY 1) SELECT count(*) FILTER (WHERE e = a) AS exact, round(sum(len(list_intersect(e, a))) / sum(len(e)), 6) AS recall, round(sum(len(list_intersect(e, a))) / sum(len(a)), 6) AS precision FROM r")
def _(t):
    from corvid.operators import analysis

    return analysis.replay(cases(t))


def cases(t):
    """Orders as evaluation cases: the lines they should find, and what they found."""
    found = lambda x: F.array_sort(F.collect_set(x.cast("long")))
    rows = t("lineitem").groupBy("l_orderkey").agg(found(c("l_linenumber")).alias("expected"), found(1 + c("l_suppkey") % 7).alias("actual"))
    return rows.select((c("l_orderkey") % 3).alias("tenant"), (c("l_orderkey") % 2).alias("brain"), "expected", "actual")


@query("a17_evaluation", """WITH r AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS e, list_sort(list_distinct(list(1 + l_suppkey % 7))) AS a FROM lineitem GROUP BY 1),
x AS (SELECT count(*) FILTER (WHERE e = a) AS exact, round(sum(len(list_intersect(e, a))) / sum(len(e)), 6) AS recall, round(sum(len(list_intersect(e, a))) / sum(len(a)), 6) AS precision, count(*) AS cases, count(DISTINCT (l_orderkey % 3, l_orderkey % 2)) >= 2 AS isolated FROM r)
SELECT *, round((2 * recall + 2 * precision + exact / cases) / 5, 6) AS score, recall < 1 AS stale_case FROM x""")
def _(t):
    return H.evaluation(cases(t))


@query("a13_weighted_scorecard", "SELECT round(sum(l_discount::DOUBLE * l_quantity::DOUBLE) / sum(l_quantity::DOUBLE), 6) AS score FROM lineitem")
def _(t):
    return H.scorecard(t("lineitem").select(c("l_discount").cast("double").alias("value"), c("l_quantity").cast("double").alias("weight")))


@query("a18_tenant_dashboard", """SELECT n_nationkey AS tenant, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS brains, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS users, (SELECT count(*) FROM documents WHERE doc_id % 25 = n_nationkey) AS sources, (SELECT count(*) FROM events WHERE event_id % 25 = n_nationkey) AS audit_events,
(SELECT count(*) FROM orders WHERE o_orderkey % 25 = n_nationkey AND o_orderstatus = 'P') AS active_jobs, (SELECT count(*) FROM orders WHERE o_orderkey % 25 = n_nationkey AND (o_orderstatus = 'F' OR o_orderkey % 10 = 0)) AS failed_jobs, (SELECT count(*) FROM orders WHERE o_orderkey % 25 = n_nationkey AND o_orderstatus <> 'O') AS projection_lag, (SELECT count(*) FROM part WHERE p_partkey % 25 = n_nationkey AND p_size > 25) AS active_models FROM nation""")
def _(t):
    of = lambda table, key: t(table).select((c(key) % 25).alias("tenant"))
    tables = {"brains": t("supplier").select(c("s_nationkey").alias("tenant")), "users": t("customer").select(c("c_nationkey").alias("tenant")), "sources": of("documents", "doc_id"), "audit_events": of("events", "event_id")}
    k = c("o_orderkey")
    status = F.when(c("o_orderstatus") == "P", "pending").when(c("o_orderstatus") == "F", "failed").otherwise("complete")
    jobs = t("orders").select((k % 25).alias("tenant"), status.alias("status"), (k % 10 == 0).alias("dead"))
    models = t("part").select((c("p_partkey") % 25).alias("tenant"), (c("p_size") > 25).alias("active"))
    return H.dashboard(t("nation").select(c("n_nationkey").alias("tenant")), tables, jobs, jobs, models)


@query("a19_run_currency", "WITH r AS (SELECT o_custkey AS brain, o_orderkey AS commit, CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'running' END AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), h AS (SELECT c_custkey AS brain, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS head FROM customer) SELECT h.brain, commit, status, coalesce(commit = head AND status = 'complete', false) AS current FROM h LEFT JOIN r ON r.brain = h.brain")
def _(t):
    status = F.when(c("o_orderstatus") == "F", "complete").otherwise("running")
    runs = t("orders").select(c("o_custkey").alias("brain"), c("o_orderkey").alias("commit"), status.alias("status"), c("o_orderdate").alias("started"))
    head = runs.groupBy("brain").agg(F.max("commit").alias("head"))
    return H.run_currency(runs, t("customer").select(c("c_custkey").alias("brain")).join(head, "brain", "left"))


@query("c23_checked_facts", """WITH x AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'blank text' WHEN value NOT BETWEEN 0 AND 80 THEN 'confidence out of range' WHEN event_id % 5 = 0 THEN 'unknown status' WHEN event_id % 7 = 0 THEN 'no time' END AS issue FROM events) SELECT event_id, issue FROM x""")
def _(t):
    k = c("event_id")
    rows = t("events").select("event_id", c("user_id").cast("string").alias("subject"), "event_type", F.when(k % 6 == 0, " ").otherwise(c("event_type")).alias("predicate"), F.lit("o").alias("object"), (c("value").cast("double") / 80).alias("confidence"), F.when(k % 5 == 0, "maybe").when(k % 2 == 0, "active").alias("status"), F.when(k % 7 == 0, "soon").otherwise("2024-01-01 00:00:00").alias("event_at"))
    good, bad = H.checked_facts(rows)
    return good.select("event_id", F.lit(None).cast("string").alias("issue")).unionByName(bad.select("event_id", "issue"))


@query("c24_scoped_forget", f"SELECT doc_id AS id, source AS tenant, lang AS brain, CASE WHEN doc_id % 9 = 0 THEN epoch(TIMESTAMP '2023-01-01')::BIGINT WHEN doc_id % 7 = 0 AND lang = 'en' THEN epoch({_NOW})::BIGINT END AS forgotten FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def _(t):
    """Every seventh record is asked to be forgotten as one of the English brain; only those that are in it match."""
    held = t("documents").where("source is not null and lang is not null").select(c("doc_id").alias("id"), c("source").alias("tenant"), c("lang").alias("brain"))
    records = held.withColumn("forgotten_at", F.when(c("id") % 9 == 0, F.lit("2023-01-01").cast("timestamp")))
    asked = held.where("id % 7 = 0").withColumn("brain", F.lit("en"))
    return H.forget(records, asked, now()).select("id", "tenant", "brain", F.unix_timestamp("forgotten_at").alias("forgotten"))


@query("w09_trajectory_ends", "SELECT user_id, event_id, n::INT AS n, epoch_us(min(ts) OVER (PARTITION BY user_id)) AS start_us, epoch_us(max(ts) OVER (PARTITION BY user_id)) AS end_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 50")
def _(t):
    return H.trajectory(t("events"), "user_id", "ts", "event_id", 50).select("user_id", "event_id", "n", F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"))


@query("a23_scoped_invalidation", "SELECT count(*) AS entries, count(*) FILTER (WHERE lang = 'en' AND source = 'src1') AS invalidated FROM documents")
def _(t):
    return H.invalidated(t("documents"), {"lang": "en", "source": "src1"})


@query("j21_checked_citations", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 = 0 THEN 'unknown' WHEN n > 1 THEN 'repeated' ELSE 'ok' END AS status FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) AS n FROM lineitem)")
def _(t):
    cited = t("lineitem").select(c("l_orderkey").alias("answer"), "l_linenumber", c("l_suppkey").alias("s_suppkey"))
    return H.answer_citations(cited, t("supplier").where("s_suppkey % 7 <> 0"), ["s_suppkey"]).select(c("answer").alias("l_orderkey"), "l_linenumber", "status")


@query("f14_workspaces", "SELECT page_id, '/w/' || page_id || '/src' AS workspace, 'src' AS project, 's' || page_id AS session FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT page_id, NULL, NULL, 's' || page_id FROM pages WHERE page_id % 3 = 0")
def _(t):
    k = c("page_id").cast("string")
    path = F.concat(F.when(c("page_id") % 3 == 0, "").otherwise("/"), F.lit("w//"), k, F.lit("/./src/"))
    file = F.concat(F.lit("/logs/s"), k, F.when(c("page_id") % 2 == 0, ".JSONL").otherwise(".jsonl"))
    return t("pages").select("page_id", T.workspace(path).alias("w"), T.session_id(file).alias("session")).select("page_id", "w.workspace", "w.project", "session")


_CODE = "replace(text, '. ', '; const a' || doc_id || ' = 1; function ')"


@query("f42_symbol_offsets", rf"""WITH d AS (SELECT doc_id, {_CODE} AS code FROM documents), x AS (SELECT doc_id, code, unnest(regexp_extract_all(code, '\b(?:function|class|const|let|var|interface|type)\s+[A-Za-z_$][A-Za-z0-9_$]*')) AS m FROM d)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(m, '^(const|let|var)')) AS variables, sum(length(m))::BIGINT AS characters, true AS exact FROM x GROUP BY 1""")
def _(t):
    """Symbols of texts made to look like code; ``exact``: the offsets slice out a definition of the name."""
    code = F.replace("text", F.lit(". "), F.concat(F.lit("; const a"), c("doc_id").cast("string"), F.lit(" = 1; function ")))
    rows = t("documents").select("doc_id", code.alias("code")).select("doc_id", "code", F.explode(T.code_symbols(c("code"))).alias("s"))
    part = F.substring(c("code"), c("s.start_off") + 1, c("s.end_off") - c("s.start_off"))
    exact = F.bool_and(F.endswith(part, c("s.name")) & part.rlike("^(function|class|const|let|var|interface|type)\\s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(c("s.kind") == "variable").alias("variables"), F.sum(c("s.end_off") - c("s.start_off")).cast("long").alias("characters"), exact.alias("exact"))


_CALLS = "replace(replace(text, '. ', '; function '), ', ', '(); ')"


@query("f42_code_edges", rf"""WITH d AS (SELECT doc_id, {_CALLS} AS code FROM documents),
s AS (SELECT doc_id, unnest(regexp_extract_all(code, '\b(?:function|class|const|let|var|interface|type)\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1)) AS name FROM d),
k AS (SELECT doc_id, unnest(regexp_extract_all(code, '\b([A-Za-z_$][A-Za-z0-9_$]*)\s*\(', 1)) AS name FROM d),
w AS (SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(code, '[A-Za-z0-9_]+')) AS name FROM d) GROUP BY ALL),
calls AS (SELECT doc_id, count(*) AS calls FROM k WHERE name NOT IN ('if', 'for', 'while', 'switch', 'catch', 'function') AND (doc_id, name) IN (SELECT (doc_id, name) FROM s) GROUP BY 1),
refs AS (SELECT doc_id, count(*) AS refs FROM s JOIN w USING (doc_id, name) WHERE w.n > 1 GROUP BY 1)
SELECT doc_id, coalesce(calls, 0) AS calls, coalesce(refs, 0) AS refs FROM d LEFT JOIN calls USING (doc_id) LEFT JOIN refs USING (doc_id)""")
def _(t):
    """Calls and references in texts made to look like code."""
    code = F.replace(F.replace("text", F.lit(". "), F.lit("; function ")), F.lit(", "), F.lit("(); "))
    kinds = t("documents").select("doc_id", F.coalesce(T.code_edges(code), F.array()).alias("e")).select("doc_id", F.col("e.kind").alias("k"))
    n = lambda kind: F.size(F.filter("k", lambda x: x == kind)).cast("long")
    return kinds.select("doc_id", n("calls").alias("calls"), n("reference").alias("refs"))


@query("s24_binary_pages", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'unknown' ELSE 'gz' END AS format, '# ' || name || chr(10) || chr(10) || 'Binary source retained externally.' || chr(10) || chr(10) || '- Format: ' || CASE page_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'unknown' ELSE 'gz' END || chr(10) || '- Bytes: ' || octet_length(encode(html)) AS markdown FROM (SELECT *, 'f' || page_id || CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '' ELSE '.tar.gz' END AS name FROM pages)")
def _(t):
    k = c("page_id")
    path = F.concat(F.lit("a.b/f"), k.cast("string"), F.when(k % 3 == 0, ".PNG").when(k % 3 == 1, "").otherwise(".tar.gz"))
    return t("pages").select("page_id", T.binary_page(path, F.octet_length("html")).alias("p")).select("page_id", "p.format", "p.markdown")
