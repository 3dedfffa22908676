"""Queries of joins, versions and set operations."""

from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.operators import access as A
from corvid.operators import search as Q
from corvid.operators import versions as V

from .registry import query

c = F.col

#: Links of FIXTURES.md: each document to one path, some of which don't exist.
_LINKS = "SELECT doc_id, 'notes/' || doc_id || '.md' AS path, 'notes/' || ((doc_id * 7 + 3) % 1200) || '.md' AS target FROM documents"


def path(id_):
    return F.concat(F.lit("notes/"), id_.cast("string"), F.lit(".md"))


def links(t):
    return t("documents").select("doc_id", path(c("doc_id")).alias("path"), path((c("doc_id") * 7 + 3) % 1200).alias("target"))


def snapshots(t):
    """The two manifests of FIXTURES.md."""
    d, n = t("documents"), c("doc_id") % 11
    one = d.select(c("doc_id").alias("id"), path(c("doc_id")).alias("path"), F.sha2("text", 256).alias("hash"), F.lit("r").alias("revision"), c("lang").alias("meta"), F.lit(None).cast("boolean").alias("deleted"))
    two = d.where(n > 0).select(c("doc_id").alias("id"), F.when(n == 2, F.concat(F.lit("x/"), path(c("doc_id")))).otherwise(path(c("doc_id"))).alias("path"), F.when(n == 1, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("hash"), F.lit("r").alias("revision"), F.when(n == 3, "zz").otherwise(c("lang")).alias("meta"), (n == 5).alias("deleted"))
    new = one.where("id % 11 = 4").withColumns({"id": c("id") + 1000000, "path": path(c("id") + 1000000)})
    return one, two.unionByName(new)


@query("j01_chunk_document", "SELECT c.l_orderkey, count(*) AS n, min(o_orderpriority) AS title FROM lineitem c JOIN orders d ON d.o_orderkey = c.l_orderkey GROUP BY 1")
def _(t):
    return t("lineitem").join(t("orders"), c("l_orderkey") == c("o_orderkey")).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("title"))


@query("j03_embedding_chunk_document", "SELECT e.vec_id, d.lang FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE len(e.embedding) = 64 AND e.label < 5")
def _(t):
    e = t("embeddings").where((F.size("embedding") == 64) & (c("label") < 5))
    return e.join(t("documents"), c("vec_id") == c("doc_id")).select("vec_id", "lang")


@query("j04_shared_facts", "WITH e AS (SELECT DISTINCT c_custkey AS doc, c_mktsegment || c_nationkey AS target FROM customer WHERE c_custkey % 10 = 0) SELECT a.doc, b.doc AS other, a.target FROM e a JOIN e b ON a.target = b.target AND a.doc <> b.doc")
def _(t):
    e = t("customer").select(c("c_custkey").alias("doc"), F.concat("c_mktsegment", c("c_nationkey").cast("string")).alias("target"))
    return Q.shared_facts(e, e.where("doc % 10 = 0").select("doc"))


@query("j04_shared_facts_all", "WITH e AS (SELECT DISTINCT c_custkey AS doc, c_mktsegment || c_nationkey AS target FROM customer) SELECT doc, target, count(*) OVER (PARTITION BY target) - 1 AS n_others FROM e")
def _(t):
    return Q.shared_fact_counts(t("customer").select(c("c_custkey").alias("doc"), F.concat("c_mktsegment", c("c_nationkey").cast("string")).alias("target")))


@query("j05_related", "SELECT b.l_orderkey AS doc, count(DISTINCT b.l_suppkey) AS n_shared FROM lineitem b WHERE b.l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey = 1) AND b.l_orderkey <> 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return Q.related(t("lineitem").select(c("l_orderkey").alias("doc"), c("l_suppkey").alias("target")), 1, 20)


@query("j06_linked_pages", f"WITH l AS ({_LINKS}) SELECT path, target AS other, 'out' AS way FROM l WHERE target IN (SELECT path FROM l) UNION ALL SELECT target, path, 'in' FROM l WHERE target IN (SELECT path FROM l)")
def _(t):
    live = links(t).join(links(t).select(c("path").alias("target")), "target", "left_semi")
    out = live.select("path", c("target").alias("other"), F.lit("out").alias("way"))
    return out.unionByName(live.select(c("target").alias("path"), c("path").alias("other"), F.lit("in").alias("way")))


@query("j07_broken_links", f"WITH l AS ({_LINKS}) SELECT doc_id, target FROM l WHERE target NOT IN (SELECT path FROM l)")
def _(t):
    return links(t).join(links(t).select(c("path").alias("target")), "target", "left_anti").select("doc_id", "target")


@query("j08_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0) AND c_custkey NOT IN (SELECT l_suppkey FROM lineitem)")
def _(t):
    no_out = t("customer").join(t("orders").where("o_orderkey % 9 = 0"), c("c_custkey") == c("o_custkey"), "left_anti")
    return no_out.join(t("lineitem"), c("c_custkey") == c("l_suppkey"), "left_anti").select("c_custkey")


@query("j09_missing_embeddings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


_TAGS = """SELECT doc_id AS id, tag FROM (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'deleted' WHEN 1 THEN 'updated' WHEN 2 THEN 'moved' WHEN 3 THEN 'metadata_only' WHEN 5 THEN 'deleted' END AS tag FROM documents) WHERE tag IS NOT NULL
UNION ALL SELECT doc_id + 1000000, 'created' FROM documents WHERE doc_id % 11 = 4"""


@query("j10_manifest_delta", _TAGS)
def _(t):
    return V.delta(*snapshots(t))


@query("j12_effective_membership", "SELECT c_custkey AS \"user\", 1 AS tenant, CASE WHEN c_nationkey < 5 THEN 'owner' ELSE 'member' END AS role FROM customer")
def _(t):
    u = t("customer").select(c("c_custkey").alias("user"), F.lit(1).alias("tenant"), F.lit(None).cast("int").alias("brain"), F.lit("member").alias("role"), "c_nationkey")
    own = u.where("c_nationkey < 5").withColumns({"brain": c("c_nationkey").cast("int"), "role": F.lit("owner")})
    return A.effective(u.unionByName(own)).select("user", "tenant", "role")


@query("j13_granted_labels", "SELECT DISTINCT c_custkey, label FROM (SELECT c_custkey, n_name AS label FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT c_custkey, c_mktsegment FROM customer)")
def _(t):
    u = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = u.join(t("nation"), c("n_nationkey") == c("c_nationkey"))
    parts = [n.select("c_custkey", c("n_name").alias("label")), n.join(t("region"), c("r_regionkey") == c("n_regionkey")).select("c_custkey", c("r_name").alias("label")), u.select("c_custkey", c("c_mktsegment").alias("label"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("j14_brain_listing", "SELECT DISTINCT n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3")
def _(t):
    n = t("nation").join(t("customer"), c("n_nationkey") == c("c_nationkey"), "left_semi")
    return n.join(t("region").where("r_regionkey < 3"), c("r_regionkey") == c("n_regionkey"), "left").select("n_name", "r_name").distinct()


@query("j15_renames", """WITH m AS (SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), u AS (SELECT 'z/' || doc_id AS path, sha256(text || CASE WHEN doc_id % 4 = 0 THEN '!' ELSE '' END) AS hash FROM documents WHERE doc_id % 2 = 0)
SELECT path, CASE WHEN n = 1 AND row_number() OVER (PARTITION BY u.hash ORDER BY path) = 1 THEN 'renamed' WHEN n > 1 THEN 'ambiguous' ELSE 'created' END AS action FROM u LEFT JOIN m ON m.hash = u.hash""")
def _(t):
    d = t("documents").where("doc_id % 2 = 0")
    missing = d.select(F.sha2("text", 256).alias("hash"), c("doc_id").alias("id"))
    unseen = d.select(F.concat(F.lit("z/"), c("doc_id").cast("string")).alias("path"), F.sha2(F.when(c("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(c("text")), 256).alias("hash"))
    return V.renames(missing, unseen).select("path", "action")


@query("j15_renames_all", """WITH m AS (SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS id FROM documents GROUP BY 1), u AS (SELECT 'z/' || doc_id AS path, sha256(text || CASE WHEN doc_id % 4 = 0 THEN '!' ELSE '' END) AS hash FROM documents)
SELECT path, CASE WHEN n = 1 AND row_number() OVER (PARTITION BY u.hash ORDER BY path) = 1 THEN 'renamed' WHEN n > 1 THEN 'ambiguous' ELSE 'created' END AS action FROM u LEFT JOIN m ON m.hash = u.hash""")
def _(t):
    d = t("documents")
    missing = d.select(F.sha2("text", 256).alias("hash"), c("doc_id").alias("id"))
    unseen = d.select(F.concat(F.lit("z/"), c("doc_id").cast("string")).alias("path"), F.sha2(F.when(c("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(c("text")), 256).alias("hash"))
    return V.renames(missing, unseen).select("path", "action")


@query("j16_source_sync", "SELECT doc_id AS id, CASE doc_id % 11 WHEN 0 THEN 'stale' WHEN 1 THEN 'updated' WHEN 2 THEN 'moved' WHEN 5 THEN 'stale' ELSE 'unchanged' END AS action FROM documents UNION ALL SELECT doc_id + 1000000, 'created' FROM documents WHERE doc_id % 11 = 4")
def _(t):
    return V.sync(*snapshots(t))


@query("j17_checkpoint_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE o_orderstatus END AS status FROM orders")
def _(t):
    old = t("orders").select("o_orderkey", F.sha2(c("o_orderkey").cast("string"), 256).alias("hash"), c("o_orderstatus").alias("held"))
    new = t("orders").select("o_orderkey", F.sha2(F.concat(c("o_orderkey").cast("string"), F.when(c("o_orderkey") % 3 == 0, "!").otherwise("")), 256).alias("now"))
    return new.join(old, "o_orderkey", "left").select("o_orderkey", F.when(c("hash").eqNullSafe(c("now")), c("held")).otherwise("pending").alias("status"))


@query("j18_incremental_upsert", "SELECT action, count(*) AS n FROM (SELECT CASE doc_id % 11 WHEN 0 THEN 'delete' WHEN 1 THEN 'index' ELSE 'skip' END AS action FROM documents UNION ALL SELECT 'index' FROM documents WHERE doc_id % 11 = 4) GROUP BY 1")
def _(t):
    one, two = snapshots(t)
    status = V.two_way(one, two, "id", "hash")
    action = F.when(c("status") == "missing", "delete").when(c("status") == "equal", "skip").otherwise("index")
    return status.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("j19_citation_resolution", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'verified' WHEN doc_id % 3 = 1 THEN 'hash differs' ELSE 'not found' END AS status FROM documents")
def _(t):
    d = t("documents")
    cites = d.select((c("doc_id") + F.when(c("doc_id") % 3 == 2, 5000000).otherwise(0)).alias("cited"), "doc_id", F.lit(1).alias("a"), F.lit(20).alias("n"), F.sha2(F.concat(F.substring("text", 2, 20), F.when(c("doc_id") % 3 == 1, "!").otherwise("")), 256).alias("h"))
    held = d.select(c("doc_id").alias("cited"), "text")
    slice_ = F.substring(c("text"), c("a") + 1, c("n"))
    status = F.when(c("text").isNull(), "not found").when(c("a") + c("n") > F.greatest(F.length("text"), c("a") + c("n")), "out of range").when(F.sha2(slice_, 256) == c("h"), "verified").otherwise("hash differs")
    return cites.join(held, "cited", "left").select("doc_id", status.alias("status"))


@query("j20_snapshot_verify", "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'missing page' WHEN doc_id % 7 = 1 THEN 'hash differs' END AS issue FROM documents WHERE doc_id % 7 < 2")
def _(t):
    pages = t("documents").where("doc_id % 7 > 0").select(c("doc_id").alias("id"), F.when(c("doc_id") % 7 == 1, "!").otherwise(c("text")).alias("content"))
    m = t("documents").select(c("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    issue = F.when(c("content").isNull(), "missing page").when(F.sha2("content", 256) != c("hash"), "hash differs")
    return m.join(pages, "id", "left").select("id", issue.alias("issue")).where("issue is not null")


@query("j22_citation_repair", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS valid FROM documents")
def _(t):
    held = t("labels").select("doc_id", F.lit(True).alias("hit")).distinct()
    return t("documents").join(held, "doc_id", "left").select("doc_id", c("hit").isNotNull().alias("valid"))


@query("j23_inventory_diff", "SELECT doc_id AS id, CASE doc_id % 11 WHEN 0 THEN 'missing' WHEN 1 THEN 'changed' ELSE 'equal' END AS status FROM documents UNION ALL SELECT doc_id + 1000000, 'extra' FROM documents WHERE doc_id % 11 = 4")
def _(t):
    return V.two_way(*snapshots(t), "id", "hash")


@query("j24_legacy_reconciliation", "SELECT status, count(*) AS n FROM (SELECT CASE doc_id % 11 WHEN 0 THEN 'imported' WHEN 1 THEN 'collision' ELSE 'already-present' END AS status FROM documents) GROUP BY 1")
def _(t):
    s = V.two_way(*snapshots(t), "id", "hash").where("status <> 'extra'")
    named = F.when(c("status") == "missing", "imported").when(c("status") == "changed", "collision").otherwise("already-present")
    return s.groupBy(named.alias("status")).agg(F.count("*").alias("n"))


@query("j25_code_mentions", r"""WITH s AS (SELECT p_name AS name FROM part UNION SELECT unnest(string_split_regex(text, '\s+')) FROM benchmark)
SELECT doc_id, name FROM documents JOIN s ON name <> '' AND contains(text, name)""")
def _(t):
    """Names of parts and words of all benchmark passages, wherever they stand in documents."""
    words = t("benchmark").select(F.explode(F.split("text", r"\s+", -1)).alias("pattern"))
    names = t("part").select(c("p_name").alias("pattern")).unionByName(words)
    return Q.contained(t("documents"), names, "doc_id").select("doc_id", c("pattern").alias("name"))


@query("j26_wiki_edges", f"WITH l AS ({_LINKS}) SELECT a.path AS src, b.path AS dst FROM l a JOIN l b ON a.target = b.path")
def _(t):
    linked = t("documents").select(path(c("doc_id")).alias("src"), F.explode(T.wiki_links(F.concat(F.lit("see [["), path((c("doc_id") * 7 + 3) % 1200), F.lit("]]")))).alias("dst"))
    return linked.join(t("documents").select(path(c("doc_id")).alias("dst")), "dst").select("src", "dst")


@query("x01_union_all", "SELECT doc_id, 'a' AS side FROM documents UNION ALL SELECT doc_id, 'b' FROM labels")
def _(t):
    return t("documents").select("doc_id", F.lit("a").alias("side")).unionByName(t("labels").select("doc_id", F.lit("b").alias("side")))


@query("x02_distinct", "SELECT DISTINCT lang, source FROM documents")
def _(t):
    return t("documents").select("lang", "source").distinct()


@query("x03_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(t):
    return t("documents").select("doc_id").intersect(t("labels").select("doc_id"))


@query("x04_difference", "SELECT text FROM documents EXCEPT SELECT text FROM documents WHERE doc_id % 11 > 0")
def _(t):
    return t("documents").select("text").distinct().join(t("documents").where("doc_id % 11 > 0").select("text").distinct(), "text", "left_anti")


@query("x05_two_way_difference", "WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 > 0), b AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END AS text FROM documents WHERE doc_id % 3 < 2) SELECT doc_id, 'only left' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT doc_id, 'only right' FROM (FROM b EXCEPT ALL FROM a)")
def _(t):
    a = t("documents").where("doc_id % 3 > 0").select("doc_id", "text")
    b = t("documents").where("doc_id % 3 < 2").select("doc_id", F.when(c("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(c("text")).alias("text"))
    return a.exceptAll(b).select("doc_id", F.lit("only left").alias("side")).unionByName(b.exceptAll(a).select("doc_id", F.lit("only right").alias("side")))


@query("c17_revision_log", "SELECT doc_id, 2 AS revision FROM documents WHERE doc_id % 2 = 0")
def _(t):
    log = t("documents").select("doc_id", F.lit(1).alias("revision"))
    new = t("documents").select("doc_id", F.when(c("doc_id") % 2 == 0, 2).otherwise(1).alias("revision"))
    return V.first_seen(log, new.unionByName(new), ["doc_id", "revision"])


@query("c35_guarded_append", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def _(t):
    new = t("orders").select("o_orderkey", "o_custkey")
    parents = t("customer").where("c_nationkey < 10").select(c("c_custkey").alias("o_custkey"))
    return V.first_seen(new.where("o_orderkey % 3 = 0"), new, ["o_orderkey"]).join(parents, "o_custkey", "left_semi").select("o_orderkey")


@query("c36_active_per_kind", "SELECT p_brand, max(p_partkey) AS active FROM part GROUP BY 1")
def _(t):
    return V.latest(t("part"), ["p_brand"], c("p_partkey")).select("p_brand", c("p_partkey").alias("active"))


@query("c14_full_projection", f"WITH l AS ({_LINKS}) SELECT doc_id, target, sha256(path) AS id FROM l")
def _(t):
    return links(t).select("doc_id", "target", F.sha2("path", 256).alias("id"))


@query("c16_incremental_projection", "SELECT doc_id AS id, doc_id % 11 = 1 AS rechunked FROM documents WHERE doc_id % 11 NOT IN (0, 5) UNION ALL SELECT doc_id + 1000000, true FROM documents WHERE doc_id % 11 = 4")
def _(t):
    one, two = snapshots(t)
    live = two.where("not coalesce(deleted, false)")
    changed = V.delta(one, two).where("tag in ('created', 'updated')").select("id", F.lit(True).alias("rechunked"))
    return live.select("id").join(changed, "id", "left").select("id", F.coalesce("rechunked", F.lit(False)).alias("rechunked"))
