"""Queries of the column functions."""

from pyspark.sql import functions as F

from corvid.functions import scalars as S
from corvid.functions import text as T

from .registry import query

c = F.col

#: Documents with planted secrets: what F06 and F07 look for, by doc_id.
_PLANTED = """CASE doc_id % 5 WHEN 0 THEN ' sk-' || repeat('a', 24) WHEN 1 THEN ' AKIA' || upper(substr(sha256(doc_id::VARCHAR), 1, 16)) WHEN 2 THEN ' export MY_TOKEN=' || repeat('b', 14) ELSE '' END"""


def planted(t):
    d = c("doc_id")
    tail = F.when(d % 5 == 0, F.concat(F.lit(" sk-"), F.repeat(F.lit("a"), 24))).when(d % 5 == 1, F.concat(F.lit(" AKIA"), F.upper(F.substring(F.sha2(d.cast("string"), 256), 1, 16)))).when(d % 5 == 2, F.concat(F.lit(" export MY_TOKEN="), F.repeat(F.lit("b"), 14))).otherwise("")
    return t("documents").select("doc_id", F.concat("text", tail).alias("text"))


@query("f01_timestamp", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT * 1000 AS epoch_ms FROM events")
def _(t):
    s = F.unix_timestamp("ts")
    raw = F.when(c("event_id") % 3 == 0, s.cast("string")).when(c("event_id") % 3 == 1, (s * 1000).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t("events").select("event_id", F.unix_millis(S.epoch_or_iso(raw)).alias("epoch_ms"))


@query("f02_first_text", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS first_text FROM part")
def _(t):
    return t("part").select("p_partkey", T.first_text(F.lit(" \t"), F.when(c("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_name", F.lit(" \n"))), c("p_brand")).alias("first_text"))


@query("f03_first_defined", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, source) AS v FROM documents")
def _(t):
    return t("documents").select("doc_id", F.coalesce(F.when(c("doc_id") % 2 == 0, c("lang")), c("source")).alias("v"))


@query("f04_message_text", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || chr(10) || 'more' ELSE text END AS text FROM conversations")
def _(t):
    kind = lambda k, f="text": F.struct(F.lit(k).alias("type"), c("text").alias(f))
    parts = F.to_json(F.struct(F.array(F.to_json(kind("text")), F.to_json(kind("tool_use")), F.to_json(F.struct(F.lit("more").alias("text")))).alias("x")))
    array = F.concat(F.lit("["), F.to_json(kind("text")), F.lit(","), F.to_json(kind("tool_use")), F.lit(',{"content":[{"type":"input_text","text":"more"}]}]'))
    raw = F.when(c("turn") % 3 == 0, F.to_json(F.struct(F.array(c("text")).alias("parts")))).when(c("turn") % 3 == 1, array).otherwise(F.to_json(kind("other", "content")))
    del parts
    return t("conversations").select("conv_id", "turn", T.message_text(F.parse_json(raw)).alias("text"))


@query("f04_deep_message_text", "SELECT conv_id, turn, text || chr(10) || chr(10) || 'level ' || (turn % 7) AS text FROM conversations")
def _(t):
    """Parts within parts, up to eight levels down, beside a part of a tool."""
    depth = (c("turn") % 7).cast("int")
    leaf = F.to_json(F.struct(F.concat(F.lit("level "), depth.cast("string")).alias("text")))
    raw = F.concat(F.repeat(F.lit('{"content":['), depth + 1), leaf, F.repeat(F.lit(',{"type":"thinking","text":"no"}]}'), depth + 1))
    whole = F.concat(F.lit("["), F.to_json(F.struct(c("text"))), F.lit(","), raw, F.lit("]"))
    return t("conversations").select("conv_id", "turn", T.message_text(F.parse_json(whole)).alias("text"))


@query("f05_strip_synthetic", "SELECT conv_id, turn, trim(text, ' ' || chr(10)) || chr(10) || chr(10) || 'end' AS text FROM conversations")
def _(t):
    raw = F.concat(F.lit("<System-Reminder a='1'>x\r\ny</system-reminder>"), c("text"), F.lit("\n\n\n\n<command-args></command-args><b> </b>end\n[PLAN MODE ACTIVE] on"))
    return t("conversations").withColumn("text", F.trim(c("text"))).select("conv_id", "turn", T.strip_synthetic(raw).alias("text"))


@query("f06_redact", "SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' [REDACTED_API_KEY]' WHEN 1 THEN ' [REDACTED_AWS_KEY]' WHEN 2 THEN ' export MY_TOKEN=[REDACTED_SECRET]' ELSE '' END AS text, CASE WHEN doc_id % 5 < 3 THEN 1 ELSE 0 END AS n FROM documents")
def _(t):
    return planted(t).withColumn("r", T.redact(c("text"))).select("doc_id", c("r.text").alias("text"), c("r.count").alias("n"))


@query("f07_certain_secret", "SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'AWS access key' END AS kind FROM documents")
def _(t):
    return planted(t).select("doc_id", T.certain_secret(c("text")).alias("kind"))


@query("f08_title", "SELECT p_partkey, substr(trim(regexp_replace(regexp_replace(regexp_replace('..' || p_name || ': a*b/' || p_brand || '  c?', '[\\\\/:*?\"<>|]', '-', 'g'), '\\s+', ' ', 'g'), '-+', '-', 'g'), '.-'), 1, 140) AS title FROM part")
def _(t):
    return t("part").select("p_partkey", T.title(F.concat(F.lit(".."), "p_name", F.lit(": a*b/"), "p_brand", F.lit("  c?"))).alias("title"))


@query("f09_role", "SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role END AS mapped FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", T.role(F.initcap("role")).alias("mapped"))


@query("f10_provider", "SELECT doc_id, ['claude', 'codex', 'cursor'][doc_id % 3 + 1] AS folder, ['Claude Code', 'Codex', 'Cursor'][doc_id % 3 + 1] AS name FROM documents")
def _(t):
    p = F.element_at(F.array(*map(F.lit, ("claude_code", "codex", "cursor"))), (c("doc_id") % 3 + 1).cast("int"))
    return t("documents").select("doc_id", T.provider(p).alias("folder"), T.provider(p, "name").alias("name"))


@query("f11_content_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("f12_uuid5", """WITH h AS (SELECT DISTINCT conv_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('chatgpt:' || conv_id)) AS h FROM conversations)
SELECT conv_id, upper(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS id FROM h""")
def _(t):
    return t("conversations").select("conv_id").distinct().select("conv_id", T.uuid5(F.concat(F.lit("chatgpt:"), c("conv_id").cast("string"))).alias("id"))


@query("f14_path_parts", "SELECT page_id, regexp_extract(url, '([^/]+)/*$', 1) AS segment FROM pages")
def _(t):
    return t("pages").select("page_id", T.last_segment(c("url")).alias("segment"))


@query("f15_frontmatter", "SELECT doc_id, lang AS title, source AS source, sha256(text) AS body FROM documents")
def _(t):
    raw = F.concat(F.lit("---\ntitle: \""), "lang", F.lit('"\nsource: '), "source", F.lit("\nempty: null\n---\n\n"), "text")
    return t("documents").withColumn("f", T.frontmatter(raw)).select("doc_id", c("f.header")["title"].alias("title"), c("f.header")["source"].alias("source"), F.sha2("f.body", 256).alias("body"))


@query("f16_substantive", "SELECT conv_id, count(*) FILTER (WHERE role = 'user' AND trim(text) <> '') AS n FROM conversations GROUP BY conv_id")
def _(t):
    return t("conversations").groupBy("conv_id").agg(F.count_if((c("role") == "user") & (T.strip_synthetic(c("text")) != "")).alias("n"))


@query("f17_markup_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '[\s\p{Z}]+', ' ', 'g')) AS text FROM pages""")
def _(t):
    return t("pages").select("page_id", T.markup_text(c("html")).alias("text"))


@query("f18_wiki_links", "SELECT doc_id, list_sort(list_distinct(['notes/' || ((doc_id * 7 + 3) % 1200) || '.md', 'a'])) AS links FROM documents")
def _(t):
    target = F.concat(F.lit("notes/"), ((c("doc_id") * 7 + 3) % 1200).cast("string"), F.lit(".md"))
    return t("documents").select("doc_id", T.wiki_links(F.concat(F.lit("[[ "), target, F.lit("]] "), "text", F.lit(" [[a]] [[a ]] [[no\nlink]] [[open"))).alias("links"))


@query("f19_query_terms", r"SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+') AS terms FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", T.query_terms(c("text")).alias("terms"))


@query("f20_snippet", """WITH d AS (SELECT doc_id, text, greatest(strpos(lower(text), 'the ') - 1 - 20, 0) AS a FROM documents)
SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(text, a + 1, 60) || CASE WHEN a + 60 < length(text) THEN '…' ELSE '' END AS snippet FROM d""")
def _(t):
    return t("documents").select("doc_id", T.snippet(c("text"), F.lit("The "), 60).alias("snippet"))


@query("f23_payload_hash", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS h FROM documents""")
def _(t):
    return t("documents").select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", F.lit(None).cast("string").alias("none"), "source")), 256).alias("h"))


@query("f24_escape_cell", r"SELECT p_partkey, p_name || '\|' || p_brand || ' x' AS cell FROM part")
def _(t):
    return t("part").select("p_partkey", T.escape_cell(F.concat("p_name", F.lit("|"), "p_brand", F.lit("\r\nx"))).alias("cell"))


@query("f25_claim", "SELECT event_id, event_type AS k, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE 'u=' || user_id END AS v FROM events")
def _(t):
    raw = F.when(c("event_id") % 2 == 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit(" =  "), c("user_id").cast("string"))).otherwise(F.concat(F.upper("event_type"), F.lit(": u="), c("user_id").cast("string"), F.lit(" ")))
    return t("events").withColumn("x", T.claim(raw)).select("event_id", c("x.key").alias("k"), c("x.value").alias("v"))


@query("f26_age_days", "SELECT o_orderkey, round(greatest(0, epoch_us(TIMESTAMP '1997-01-01') - epoch_us(o_orderdate)) / 864e8, 6) AS age FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.round(S.age_days(c("o_orderdate"), F.lit("1997-01-01").cast("timestamp")), 6).alias("age"))


@query("f27_backoff", "SELECT l_orderkey, l_linenumber, least(60000.0, floor(1000.0 * pow(2, least(l_linenumber - 1, 20)) * (0.5 + l_discount)))::DOUBLE AS ms FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", S.backoff(c("l_linenumber"), 1000.0, 60000.0, c("l_discount")).cast("double").alias("ms"))


@query("f28_quiet_hours", "SELECT event_id, hour(ts) >= 22 OR hour(ts) < 6 AS quiet FROM events")
def _(t):
    return t("events").select("event_id", S.quiet(c("ts"), 22, 6).alias("quiet"))


@query("f29_failure_kind", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'final' WHEN 1 THEN 'retryable' WHEN 2 THEN 'final' ELSE 'final' END AS kind FROM documents")
def _(t):
    said = F.element_at(F.array(*map(F.lit, ("Invalid timeout", "Connection lost", "quota", "odd"))), (c("doc_id") % 4 + 1).cast("int"))
    return t("documents").select("doc_id", T.failure_kind(said).alias("kind"))


@query("f30_unit_vector", "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS x1 FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", F.round(S.unit(c("embedding"))[0], 5).alias("x1"))


@query("f31_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    b = t("embeddings").select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("w"))
    return t("embeddings").join(b, "vec_id").select("vec_id", F.round(S.cosine(c("embedding"), c("w")), 5).alias("cos"))


@query("f33_model_fingerprint", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","dims":' || p_size || '}') AS h FROM part""")
def _(t):
    return t("part").select("p_partkey", F.sha2(F.to_json(F.struct(c("p_brand").alias("brand"), F.coalesce("p_size", F.lit(0)).alias("dims"))), 256).alias("h"))


@query("f34_ranking_signals", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0.02 WHEN doc_id % 4 = 1 THEN 0.02 WHEN doc_id % 4 = 2 THEN 0.015 ELSE 0.01 END::DOUBLE AS tier, round(least(0.01, length(text) / 1e5), 8)::DOUBLE AS strength FROM documents")
def _(t):
    kind = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("manual", "filesystem", "web"))), (c("doc_id") % 4 + 1).cast("int"))
    return t("documents").select("doc_id", S.source_tier(kind).alias("tier"), F.round(S.page_strength(F.length("text")), 8).alias("strength"))


@query("f35_safe_path", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN true ELSE false END AS safe FROM pages")
def _(t):
    path = F.concat(F.element_at(F.array(*map(F.lit, ("notes/", "../", "/", "a//"))), (c("page_id") % 4 + 1).cast("int")), c("page_id").cast("string"), F.lit(".md"))
    return t("pages").select("page_id", T.safe_path(path).alias("safe"))


@query("f38_event_redaction", "SELECT event_id, 'occurredAt' AS kept, 1 AS n FROM events")
def _(t):
    m = F.create_map(F.lit("occurredAt"), c("ts").cast("string"), F.lit("api_token"), F.lit("1"), F.lit("note"), F.lit("text"))
    kept = F.map_filter(m, lambda k, v: (k == "occurredAt") | (v.try_cast("double").isNotNull() & ~F.lower(k).rlike("token|secret|password|key")))
    return t("events").select("event_id", F.array_join(F.map_keys(kept), ",").alias("kept"), F.size(kept).alias("n"))


@query("f38_metadata_redacted", """SELECT event_id, '{"k":' || (props::JSON->>'k') || CASE WHEN event_id % 3 > 0 THEN ',"' || event_type || '":' || user_id ELSE '' END || ',"flag":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END || ',"occurredAt":"' || event_type || '"}' AS metadata FROM events""")
def _(t):
    name = F.concat("event_type", F.when(c("event_id") % 3 == 0, "_ToKen").otherwise(""))
    flag = F.when(c("event_id") % 2 == 0, "true").otherwise("null")
    rest = F.format_string(',"%s":%d,"flag":%s,"note":"%s","occurredAt":"%s","bodySize":4}', name, c("user_id"), flag, c("event_type"), c("event_type"))
    return t("events").select("event_id", T.redact_metadata(F.concat(F.rtrim(c("props"), F.lit("}")), rest)).alias("metadata"))


@query("f39_chunk_id", "SELECT doc_id, sha256(doc_id || ':0:' || sha256(text) || ':1') AS id FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2(F.concat_ws(":", "doc_id", F.lit(0), F.sha2("text", 256), F.lit(1)), 256).alias("id"))


@query("f40_trim_all", "SELECT p_partkey, p_name AS name FROM part")
def _(t):
    return t("part").select("p_partkey", T.trim_all(F.concat(F.lit(" \t\n"), "p_name", F.lit("  　"))).alias("name"))


@query("f42_code_symbols", r"""SELECT page_id, len(regexp_extract_all(html, '\b(?:function|class|const|let|var|interface|type)\s+([A-Za-z_$][\w$]*)', 1)) AS n, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '\b(?:function|class|const|let|var|interface|type)\s+([A-Za-z_$][\w$]*)', 1))), ',') AS names FROM pages""")
def _(t):
    found = F.regexp_extract_all("html", F.lit(r"\b(?:function|class|const|let|var|interface|type)\s+([A-Za-z_$][\w$]*)"), F.lit(1))
    return t("pages").select("page_id", F.size(found).cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("names"))


@query("f44_context_gate", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND quality + 0.1 * toxic >= 0.7 THEN 'push' WHEN doc_id % 3 = 0 THEN 'no citations' ELSE 'low confidence' END AS gate FROM labels")
def _(t):
    cites = F.array_distinct(F.filter(F.array(F.when(c("doc_id") % 3 > 0, "a"), F.lit("")), lambda x: x.isNotNull() & (x != "")))
    sure = c("quality") + F.lit(0.1) * c("toxic") >= 0.7
    return t("labels").select("doc_id", F.when(F.size(cites) == 0, "no citations").when(sure, "push").otherwise("low confidence").alias("gate"))


@query("f45_field_merge", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, source) AS a, coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, lang) AS b FROM documents")
def _(t):
    d = t("documents").select("doc_id", "lang", "source")
    records = d.select("doc_id", F.lit(0).alias("pos"), F.when(c("doc_id") % 2 == 0, c("lang")).alias("a"), F.when(c("doc_id") % 3 == 0, c("source")).alias("b")).unionByName(d.select("doc_id", F.lit(1).alias("pos"), c("source").alias("a"), c("lang").alias("b")))
    return records.groupBy("doc_id").agg(*[F.min_by(k, F.when(c(k).isNotNull(), c("pos"))).alias(k) for k in "ab"])


@query("f46_labels", "SELECT doc_id, list_sort(list_distinct([lang, source, 'z'])) AS labels FROM documents")
def _(t):
    return t("documents").select("doc_id", T.labels(F.array(F.concat(F.lit(" "), "lang"), c("source"), c("lang"), F.lit("z "), F.lit(" "), F.repeat(F.lit("x"), 200))).alias("labels"))
