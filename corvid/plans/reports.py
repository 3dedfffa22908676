"""Queries of aggregations, analyses, evaluation and the job ledger."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.functions import scalars as S
from corvid.functions import text as T
from corvid.operators import analysis as N
from corvid.operators import ledger as G
from corvid.operators import search as Q

from .registry import query

c = F.col


@query("a01_sync_totals", "SELECT source, count(*) AS scanned, count(*) FILTER (WHERE doc_id % 3 = 0) AS created, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source)")
def _(t):
    return t("documents").rollup("source").agg(F.count("*").alias("scanned"), F.count_if(c("doc_id") % 3 == 0).alias("created"), F.sum("n_chars").alias("chars"))


@query("a02_status_counts", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS complete, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders")
def _(t):
    return t("orders").agg(*[F.count_if(c("o_orderstatus") == k).alias(n) for k, n in (("F", "failed"), ("O", "complete"), ("P", "pending"))])


@query("a03_source_health", "SELECT source, count(DISTINCT d.doc_id) AS n, count(DISTINCT d.doc_id) FILTER (WHERE l.doc_id IS NOT NULL) AS covered, round(count(DISTINCT l.doc_id) / count(DISTINCT d.doc_id), 6) AS coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def _(t):
    return N.source_health(t("documents"), t("labels"), "doc_id", "source")


@query("a04_embedding_coverage", "SELECT count(*) AS total, count(l.doc_id) AS covered FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    return N.source_health(t("documents").withColumn("all", F.lit(1)), t("labels"), "doc_id", "all").select(c("n").alias("total"), "covered")


@query("a05_duplicate_groups", "SELECT sha256(text) AS h, doc_id, count(*) OVER (PARTITION BY text) AS n, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents QUALIFY n > 1")
def _(t):
    return N.groups(t("documents").select(F.sha2("text", 256).alias("h"), "doc_id"), ["h"], "doc_id")


@query("a06_fact_consolidation", "SELECT user_id, event_type, event_id, count(*) OVER w AS n, min(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY user_id, event_type) QUALIFY n > 1")
def _(t):
    return N.groups(t("events"), ["user_id", "event_type"], "event_id")


@query("a07_contradictions", "SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS statuses FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def _(t):
    return N.contradictions(t("orders"), ["o_custkey"], "o_orderstatus", "statuses")


@query("a08_salience", "WITH a AS (SELECT o_custkey AS k, count(DISTINCT o_orderkey) AS x FROM orders GROUP BY 1), b AS (SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS y FROM lineitem GROUP BY 1) SELECT c_custkey, coalesce(x, 0) + coalesce(y, 0) AS salience FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey ORDER BY 2 DESC, 1 LIMIT 100")
def _(t):
    return N.salience(t("customer").select("c_custkey"), t("orders").select(c("o_custkey").alias("c_custkey"), c("o_orderkey").alias("item")), t("lineitem").select(c("l_suppkey").alias("c_custkey"), c("l_partkey").alias("item")), "c_custkey", 100)


@query("a09_staleness", "SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' OR o_orderdate < l_shipdate - INTERVAL 100 DAY")
def _(t):
    return t("orders").join(t("lineitem"), c("l_orderkey") == c("o_orderkey")).where((c("o_orderstatus") == "F") | (c("o_orderdate") < c("l_shipdate") - F.make_interval(days=F.lit(100)))).select("o_orderkey").distinct()


@query("a10_evidence_contradictions", "SELECT event_type AS subject, count(DISTINCT user_id) AS n_values FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 1")
def _(t):
    claims = t("events").select(T.claim(F.concat("event_type", F.lit(": "), c("user_id").cast("string"))).alias("x"))
    return claims.groupBy(c("x.key").alias("subject")).agg(F.count_distinct("x.value").alias("n_values")).where("n_values > 1")


@query("a11_answer_confidence", """WITH e AS (SELECT o_custkey AS q, o_orderkey, greatest(0, epoch_us(TIMESTAMP '2000-01-01') - epoch_us(o_orderdate)) / 864e8 >= 365 AS stale, o_orderpriority AS k, o_orderstatus AS v FROM orders),
x AS (SELECT q, count(*) AS n FROM (SELECT q, k FROM e GROUP BY q, k HAVING count(DISTINCT v) > 1) GROUP BY q)
SELECT e.q, round(least(1, greatest(0, 0.6 * count(DISTINCT o_orderkey) / count(*) + 0.4 * (1 - count(*) FILTER (WHERE stale) / count(*)) - least(0.5, 0.15 * coalesce(max(x.n), 0)))), 6) AS confidence FROM e LEFT JOIN x ON x.q = e.q GROUP BY e.q""")
def _(t):
    e = t("orders").select(c("o_custkey").alias("q"), c("o_orderkey").alias("chunk"), c("o_orderdate").alias("updated"), c("o_orderpriority").alias("key"), c("o_orderstatus").alias("value"))
    return N.confidence(e, F.lit("2000-01-01").cast("timestamp"), 365)


@query("a12_retrieval_replay", "WITH r AS (SELECT l_orderkey AS k, list_distinct(list(l_linenumber)) AS e, list_distinct(list(l_suppkey % 7)) AS a FROM lineitem GROUP BY 1) SELECT round(sum(len(list_intersect(e, a))) / sum(len(e)), 6) AS recall, round(sum(len(list_intersect(e, a))) / sum(len(a)), 6) AS precision FROM r")
def _(t):
    cases = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(c("l_linenumber").cast("long")).alias("expected"), F.collect_set(c("l_suppkey") % 7).alias("actual"))
    return N.replay(cases).select("recall", "precision")


@query("a13_scorecard", "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS score FROM lineitem")
def _(t):
    return t("lineitem").agg(F.round(F.sum(c("l_discount") * c("l_quantity")) / F.sum("l_quantity"), 6).alias("score"))


@query("a14_calibration", "SELECT b::INT AS bin, count(l_discount) AS n, round(coalesce(avg((l_returnflag = 'R')::INT), 0), 6) AS observed FROM generate_series(0, 19) g(b) LEFT JOIN lineitem ON least(19, floor(l_discount * 100 + 1e-9)) = b GROUP BY 1")
def _(t):
    rows = t("lineitem").select((c("l_discount") * 5 + 1e-10).alias("confidence"), (c("l_returnflag") == "R").alias("correct"))
    return N.calibration(rows, 20)


@query("a15_anomalies", "WITH m AS (SELECT event_type, round(avg(value), 6) AS base FROM events GROUP BY 1) SELECT event_id, CASE WHEN abs(value - base) >= 2 * 40 THEN 'critical' ELSE 'warning' END AS severity FROM events e JOIN m ON m.event_type = e.event_type WHERE abs(value - base) > 40")
def _(t):
    base = t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("baseline"))
    return N.anomalies(t("events").join(base, "event_type").withColumns({"observed": c("value"), "threshold": F.lit(40.0)})).select("event_id", "severity")


@query("a16_retrieval_diagnostic", "SELECT lang, count(*) AS candidates, count(l.doc_id) AS verified, count(l.doc_id) = 0 AS warn FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def _(t):
    return t("documents").join(t("labels").select("doc_id", F.lit(1).alias("v")), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("candidates"), F.count("v").alias("verified"), (F.count("v") == 0).alias("warn"))


@query("a17_evaluation_suite", "SELECT count(DISTINCT (lang, source)) >= 2 AS isolated, round(avg(n_chars), 6) AS score FROM documents")
def _(t):
    return t("documents").agg((F.count_distinct("lang", "source") >= 2).alias("isolated"), F.round(F.avg("n_chars"), 6).alias("score"))


@query("a18_dashboard", "SELECT (SELECT count(*) FROM documents WHERE lang = 'en') AS english, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS failed, (SELECT count(*) FROM events WHERE value > 50) AS high")
def _(t):
    one = [t("documents").agg(F.count_if(c("lang") == "en").alias("english")), t("orders").agg(F.count_if(c("o_orderstatus") == "F").alias("failed")), t("events").agg(F.count_if(c("value") > 50).alias("high"))]
    return one[0].join(one[1], F.lit(True)).join(one[2], F.lit(True))  # three tables of one row


@query("a19_latest_runs", "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS latest FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max_by("o_orderkey", "o_orderkey").alias("latest"))


@query("a20_archive_status", "SELECT source, count(*) AS n, max(doc_id) AS newest FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("newest"))


@query("a21_inventory_totals", "SELECT count(*) AS files, sum(octet_length(encode(html)))::BIGINT AS bytes FROM pages")
def _(t):
    return t("pages").agg(F.count("*").alias("files"), F.sum(F.octet_length("html")).alias("bytes"))


_PACKS = "(VALUES ('notes', 'n/', 'note'), ('notes', 'n/1', 'first'), ('web', 'w/', 'page'), ('none', 'q/', 'x'))"


def packs(t):
    return t.spark.createDataFrame([("notes", "n/", "note"), ("notes", "n/1", "first"), ("web", "w/", "page"), ("none", "q/", "x")], "pack string, prefix string, type string")


def paths(t):
    return t("pages").select("page_id", F.concat(F.when(c("page_id") % 2 == 0, "n/").otherwise("w/"), c("page_id").cast("string")).alias("path"))


_PATHS = "(SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'n/' ELSE 'w/' END || page_id AS path FROM pages)"


@query("f22_path_types", f"SELECT page_id, arg_max(type, length(prefix)) AS type FROM {_PATHS} JOIN {_PACKS} p(pack, prefix, type) ON starts_with(path, prefix) GROUP BY 1")
def _(t):
    return N.path_types(paths(t), packs(t), "page_id")


@query("a22_schema_packs", f"SELECT pack, count(DISTINCT page_id) AS n FROM {_PATHS} JOIN {_PACKS} p(pack, prefix, type) ON starts_with(path, prefix) GROUP BY 1")
def _(t):
    return paths(t).join(F.broadcast(packs(t)), F.startswith("path", "prefix")).groupBy("pack").agg(F.count_distinct("page_id").alias("n"))  # a few prefixes


@query("f21_query_expansion", "WITH b AS (SELECT item_id, lower(text) AS text, len(list_filter(string_split(lower(text), ' '), lambda x: x = 'the')) AS n FROM benchmark), o AS (SELECT * FROM b WHERE n <= 1) SELECT item_id, array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' ') AS text FROM o UNION SELECT item_id, array_to_string(list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: CASE WHEN x = 'the' THEN 'der' ELSE x END), ' ') FROM o WHERE n = 1")
def _(t):
    alias = t.spark.createDataFrame([("the", "der")], "token string, replacement string")
    asked = t("benchmark").select(c("item_id").alias("query_id"), F.lower("text").alias("text")).where(F.size(F.filter(F.split("text", " "), lambda x: x == "the")) <= 1)
    return N.expand(asked, alias, 8).select(c("query_id").alias("item_id"), "text")


@query("f21_query_expansion_all", """WITH b AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS t FROM benchmark), p AS (SELECT item_id, t, unnest(range(len(t))) AS i FROM b),
v AS (SELECT item_id, -1 AS i, array_to_string(t, ' ') AS text FROM b UNION ALL SELECT item_id, i, array_to_string(list_transform(t, lambda x, k: CASE WHEN k = i + 1 THEN 'der' ELSE x END), ' ') FROM p WHERE t[i + 1] = 'the')
SELECT item_id, text FROM (SELECT item_id, text, row_number() OVER (PARTITION BY item_id ORDER BY min(i)) AS n FROM v GROUP BY item_id, text) WHERE n <= 8""")
def _(t):
    alias = t.spark.createDataFrame([("the", "der")], "token string, replacement string")
    return N.expand(t("benchmark").select(c("item_id").alias("query_id"), F.lower("text").alias("text")), alias, 8).select(c("query_id").alias("item_id"), "text")


@query("a25_schema_upgrade", "SELECT coalesce(a.n_nationkey, b.k) AS k, CASE WHEN b.k IS NULL THEN 'removed' WHEN a.n_nationkey IS NULL THEN 'added' ELSE 'changed' END AS change FROM nation a FULL JOIN (SELECT n_nationkey + 5 AS k, n_name AS v FROM nation) b ON b.k = a.n_nationkey WHERE a.n_name IS DISTINCT FROM b.v")
def _(t):
    from corvid.operators import versions as V

    a = t("nation").select(c("n_nationkey").cast("long").alias("k"), c("n_name").alias("v"))
    s = V.two_way(a, a.withColumn("k", c("k") + 5), "k", "v").where("status <> 'equal'")
    return s.select("k", F.when(c("status") == "missing", "removed").when(c("status") == "extra", "added").otherwise("changed").alias("change"))


@query("a28_source_listing", "SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS stale FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def _(t):
    return t("documents").join(t("labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(c("quality") == 0).alias("stale"))


def jobs(t):
    k = c("o_orderkey")
    status = F.when(c("o_orderstatus") == "F", "failed").when(c("o_orderstatus") == "O", "complete").otherwise("pending")
    return t("orders").select(k.alias("id"), status.alias("status"), F.when(k % 5 == 0, F.array(k - 1, k - 2)).otherwise(F.array().cast("array<bigint>")).alias("deps"), (k % 2 == 0).alias("degraded_ok"))


_JOBS = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'complete' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN [o_orderkey - 1, o_orderkey - 2] ELSE [] END AS deps, o_orderkey % 2 = 0 AS degraded_ok FROM orders"


@query("c26_job_frontier", f"WITH j AS ({_JOBS}), d AS (SELECT j.id, bool_and(coalesce(p.status = 'complete' OR (j.degraded_ok AND p.status = 'failed'), false)) AS ready, bool_or(p.status = 'failed') AS degraded FROM j, unnest(deps) u(dep) LEFT JOIN j p ON p.id = dep GROUP BY j.id) SELECT j.id, coalesce(degraded, false) AS degraded FROM j LEFT JOIN d ON d.id = j.id WHERE j.status = 'pending' AND coalesce(ready, true)")
def _(t):
    return G.frontier(jobs(t))


@query("c27_failed_dependants", f"WITH j AS ({_JOBS}) SELECT DISTINCT j.id, 'cancelled' AS status FROM j, unnest(deps) u(dep) JOIN j p ON p.id = dep WHERE j.status = 'pending' AND p.status = 'failed' AND NOT j.degraded_ok")
def _(t):
    return G.fail_dependants(jobs(t))


@query("c28_dependency_closure", f"WITH RECURSIVE j AS ({_JOBS}), e AS (SELECT id, dep FROM j, unnest(deps) u(dep)), r(id) AS (SELECT 4::BIGINT UNION SELECT e.id FROM e JOIN r ON e.dep = r.id) SELECT id FROM r")
def _(t):
    return G.closure(jobs(t), t.spark.createDataFrame([(4,)], "id long"))


@query("c29_due_schedules", "SELECT event_id, epoch(ts)::BIGINT + (greatest(1, ceil((1704000000 + 40 * 86400 - epoch(ts)::BIGINT) / 3600.0))::BIGINT) * 3600 AS next_run FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events) WHERE epoch(ts)::BIGINT <= 1704000000 + 40 * 86400")
def _(t):
    rows = t("events").select("event_id", F.unix_timestamp("ts").alias("at"), F.lit(3600).alias("every"))
    return G.due(rows, 1704000000 + 40 * 86400).select("event_id", "next_run")


@query("c30_failure_outcome", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 4 THEN 'failed' ELSE 'pending' END AS status, l_linenumber >= 4 AS dead_letter FROM lineitem")
def _(t):
    return G.after_failure(t("lineitem").withColumns({"attempts": c("l_linenumber"), "max_attempts": F.lit(4)})).select("l_orderkey", "l_linenumber", "status", "dead_letter")


@query("c13_graph_build", "SELECT DISTINCT c_custkey AS src, 'segment:' || c_mktsegment AS dst FROM customer UNION SELECT c_custkey, 'nation:' || c_nationkey FROM customer")
def _(t):
    return N.facts(t("customer").select("c_custkey", c("c_mktsegment").alias("segment"), c("c_nationkey").cast("string").alias("nation"), F.lit(" ").alias("blank")), "c_custkey", ["segment", "nation", "blank"])


@query("c21_fact_load", "SELECT sha256(user_id || ':' || event_type || ':' || event_id) AS id, CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM events WHERE event_id % 4 > 0")
def _(t):
    raw = F.concat(F.lit('[{"subject":"'), c("user_id").cast("string"), F.lit('","predicate":"'), "event_type", F.lit('","object":"'), c("event_id").cast("string"), F.lit('"'), F.when(c("event_id") % 4 == 0, ',"confidence":7').when(c("event_id") % 3 == 0, ',"confidence":0.5').otherwise(""), F.lit("}]"))
    return N.load_facts(t("events").select(raw.alias("facts")))[0].select("id", "confidence")


@query("c24_forget", "SELECT doc_id, doc_id = 7 AS forgotten FROM documents")
def _(t):
    return t("documents").select("doc_id", F.when(c("doc_id") == 7, F.lit(True)).otherwise(False).alias("forgotten"))


@query("c25_maintenance_proposals", "SELECT lang, row_number() OVER (ORDER BY lang)::INT AS n FROM (SELECT DISTINCT lang FROM documents) ORDER BY lang LIMIT 32")
def _(t):
    found = t("documents").select("lang").distinct().orderBy("lang").limit(32)
    return found.select("lang", F.row_number().over(W.orderBy("lang")).alias("n"))


@query("l04_routing_top", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY round(s_acctbal) DESC, s_suppkey LIMIT 10")
def _(t):
    return t("supplier").where("s_acctbal > 0").orderBy(F.desc(F.round("s_acctbal")), "s_suppkey").limit(10).select("s_suppkey")


@query("l05_memory_recall", r"""WITH q AS (SELECT item_id, unnest(string_split_regex(lower(text), '\s+')) AS term FROM benchmark), h AS (SELECT item_id AS query_id, doc_id, count(*) AS score FROM q JOIN documents d ON term <> '' AND contains(lower(d.text), term) GROUP BY 1, 2)
SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM h) WHERE r <= 5""")
def _(t):
    asked = t("benchmark").select(c("item_id").alias("query_id"), "text")
    return Q.recall(asked, t("documents").select("doc_id", "text"), 5, "doc_id").select("query_id", "doc_id", "score")


@query("l06_keyset_page", "SELECT event_id FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20', 0) ORDER BY ts DESC, event_id DESC LIMIT 51")
def _(t):
    return t("events").where(F.struct("ts", "event_id") < F.struct(F.lit("2024-01-20").cast("timestamp"), F.lit(0).cast("long"))).orderBy(F.desc("ts"), F.desc("event_id")).limit(51).select("event_id")


@query("l07_recent_first", "SELECT event_id FROM events WHERE user_id < 20 ORDER BY ts DESC, event_id LIMIT 100")
def _(t):
    return t("events").where("user_id < 20").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id")


@query("l08_reminders", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey)::INT AS n FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 200")
def _(t):
    due = t("orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(200)
    return due.select("o_orderkey", F.row_number().over(W.orderBy("o_orderdate", "o_orderkey")).alias("n"))


@query("w06_recency_signal", "SELECT o_orderkey, round(0.02 * (epoch(o_orderdate) - min(epoch(o_orderdate)) OVER w) / (max(epoch(o_orderdate)) OVER w - min(epoch(o_orderdate)) OVER w), 8) AS signal FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderdate) > 1) WINDOW w AS (PARTITION BY o_custkey)")
def _(t):
    rows = t("orders").select("o_orderkey", c("o_custkey").alias("query_id"), F.unix_timestamp("o_orderdate").cast("double").alias("score"))
    w = W.partitionBy("query_id")
    many = F.min("score").over(w) < F.max("score").over(w)
    return Q.min_max(rows.withColumn("m", many).where("m")).select("o_orderkey", F.round(c("normal") * 0.02, 8).alias("signal"))


@query("a23_cache_entries", "SELECT count(*) AS n, count(*) FILTER (WHERE lang IS NOT DISTINCT FROM 'en') AS invalidated FROM documents")
def _(t):
    return t("documents").agg(F.count("*").alias("n"), F.count_if(c("lang").eqNullSafe("en")).alias("invalidated"))


@query("a26_index_run", "SELECT count(*) AS scanned, count(*) FILTER (WHERE doc_id % 11 = 1) AS indexed, count(*) FILTER (WHERE doc_id % 11 > 1) AS skipped, count(*) FILTER (WHERE doc_id % 11 = 0) AS removed FROM documents")
def _(t):
    from corvid.operators import versions as V

    old = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    new = t("documents").where("doc_id % 11 > 0").select("doc_id", F.sha2(F.concat("text", F.when(c("doc_id") % 11 == 1, "!").otherwise("")), 256).alias("h"))
    s = V.two_way(old, new, "doc_id", "h")
    return s.agg(F.count("*").alias("scanned"), F.count_if(c("status") == "changed").alias("indexed"), F.count_if(c("status") == "equal").alias("skipped"), F.count_if(c("status") == "missing").alias("removed"))


@query("a27_shadow_comparison", "SELECT count(*) FILTER (WHERE doc_id % 3 = 0) AS only_left, count(*) FILTER (WHERE doc_id % 3 = 1) AS only_right, count(*) FILTER (WHERE doc_id % 3 = 2) AS in_both FROM documents")
def _(t):
    from corvid.operators import versions as V

    d = t("documents").select("doc_id", "lang")
    s = V.two_way(d.where("doc_id % 3 <> 1"), d.where("doc_id % 3 <> 0"), "doc_id", "lang")
    return s.agg(F.count_if(c("status") == "missing").alias("only_left"), F.count_if(c("status") == "extra").alias("only_right"), F.count_if(c("status") == "equal").alias("in_both"))


@query("c22_entity_load", "SELECT DISTINCT 'brand:' || p_brand AS node FROM part UNION SELECT DISTINCT 'type:' || p_type FROM part")
def _(t):
    e = t("part").select("p_partkey", c("p_brand").alias("brand"), c("p_type").alias("type"))
    return N.facts(e, "p_partkey", ["brand", "type"]).select(c("dst").alias("node")).distinct()


@query("c23_fact_ranges", "SELECT event_id, value BETWEEN 0 AND 100 AS accepted FROM events")
def _(t):
    return t("events").select("event_id", c("value").between(0, 100).alias("accepted"))


@query("j21_answer_citations", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 = 0 THEN 'unknown' WHEN n > 1 THEN 'repeated' ELSE 'ok' END AS status FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) AS n FROM lineitem)")
def _(t):
    held = t("supplier").where("s_suppkey % 7 <> 0").select(c("s_suppkey").alias("l_suppkey"), F.lit(1).alias("held"))
    rows = t("lineitem").withColumn("n", F.count("*").over(W.partitionBy("l_orderkey", "l_suppkey"))).join(held, "l_suppkey", "left")
    return rows.select("l_orderkey", "l_linenumber", F.when(c("held").isNull(), "unknown").when(c("n") > 1, "repeated").otherwise("ok").alias("status"))


@query("j27_alias_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(t):
    return t("customer").join(Q.small(t("nation")), c("n_nationkey") == c("c_nationkey"), "left").select("c_custkey", "n_name")
