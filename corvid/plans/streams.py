"""Queries of the batch twins of streaming operators."""

from pyspark.sql import functions as F

from corvid.operators import versions as V
from corvid.streaming import folds as S

from .registry import query

c = F.col
DAY, HOUR = 86_400_000, 3_600_000


def events(t):
    return t("events").select(c("user_id").alias("key"), "event_id", F.unix_millis("ts").alias("at"), F.lit(1).alias("units"), "ts")


_E = "e AS (SELECT user_id AS key, list({'i': event_id, 'a': epoch_ms(ts)} ORDER BY epoch_ms(ts), event_id) AS l FROM events GROUP BY 1)"


def _fold(step: str, first: str) -> str:
    """Accepted event ids of each key by an ordered fold in DuckDB; the state keeps them in ``ok``."""
    return f"WITH {_E}, s AS (SELECT key, list_reduce(l, lambda s, x: {step}, {first}) AS r FROM (SELECT key, list_transform(l, lambda x: {{'a': x.a, 'n': 0::BIGINT, 'ok': [x.i]}}) AS l FROM e)) SELECT key::VARCHAR AS key, unnest(r.ok) AS event_id FROM s"


_REPLAY = _fold("CASE WHEN x.a - s.a >= 86400000 THEN {'a': x.a, 'n': 0::BIGINT, 'ok': list_concat(s.ok, x.ok)} ELSE s END", "{'a': -100000000::BIGINT, 'n': 0::BIGINT, 'ok': []::BIGINT[]}")
_TUMBLING = "SELECT user_id::VARCHAR AS key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, epoch_ms(ts) // 86400000 ORDER BY epoch_ms(ts), event_id) AS r FROM events) WHERE r <= 2"
_ANCHORED = _fold("CASE WHEN x.a - s.a >= 86400000 THEN {'a': x.a, 'n': 1::BIGINT, 'ok': list_concat(s.ok, x.ok)} WHEN s.n < 2 THEN {'a': s.a, 'n': s.n + 1, 'ok': list_concat(s.ok, x.ok)} ELSE s END", "{'a': -100000000::BIGINT, 'n': 0::BIGINT, 'ok': []::BIGINT[]}")
_SESSION = _fold("CASE WHEN x.a - s.n >= 21600000 OR x.a - s.a >= 86400000 THEN {'a': x.a, 'n': x.a, 'ok': list_concat(s.ok, x.ok)} ELSE {'a': s.a, 'n': x.a, 'ok': s.ok} END", "{'a': -100000000::BIGINT, 'n': -100000000::BIGINT, 'ok': []::BIGINT[]}")


@query("st06_replay_guard", _REPLAY)
def _(t):
    return S.batch(events(t), S.replay_guard(DAY)).where("accepted").select("key", "event_id")


@query("st04_tumbling_quota", _TUMBLING)
def _(t):
    return S.batch(events(t), S.tumbling_quota(2, DAY)).where("accepted").select("key", "event_id")


@query("st04_usage_windows", "SELECT user_id AS key, epoch(ts)::BIGINT // 60 * 60 AS start, count(*) AS units FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY 1, 2")
def _(t):
    return S.usage(events(t), 60)


@query("st05_anchored_quota", _ANCHORED)
def _(t):
    return S.batch(events(t), S.anchored_quota(2, DAY)).where("accepted").select("key", "event_id")


@query("st07_sessions", _SESSION)
def _(t):
    return S.batch(events(t), S.session(6 * HOUR, DAY)).where("accepted").select("key", "event_id")


@query("st07_idle_sessions", "SELECT user_id, count(*) AS n FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) WHERE d IS NULL OR d > INTERVAL 30 MINUTE GROUP BY 1")
def _(t):
    return t("events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("k")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("st08_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def _(t):
    return V.latest(t("events"), ["user_id"], F.struct("ts", "event_id")).select("user_id", c("event_type").alias("state"))


_CURRENT = "SELECT doc_id, CASE WHEN doc_id % 11 = 1 THEN 2 ELSE 1 END AS version FROM documents WHERE doc_id % 11 > 0"


@query("st10_change_log", _CURRENT)
def _(t):
    d = t("documents").select("doc_id", F.lit(1).alias("version"), F.lit(False).alias("deleted"))
    log = d.unionByName(d.where("doc_id % 11 < 2").withColumns({"version": F.lit(2), "deleted": c("doc_id") % 11 == 0}))
    return V.latest(log, ["doc_id"], c("version")).where("not deleted").select("doc_id", "version")


@query("st10_compacted_view", _CURRENT)
def _(t):
    """The same log as a stream into a compacted view: two drops, of which the first has the second versions of odd documents."""
    from corvid.sinks import render
    from corvid.streaming.view import CompactedView

    root, d = render.shared_folder(t.spark, "view"), t("documents").select("doc_id")
    log = d.withColumns({"version": F.lit(1), "deleted": F.lit(False), "drop": c("doc_id") % 2})
    log = log.unionByName(d.where("doc_id % 11 < 2").withColumns({"version": F.lit(2), "deleted": c("doc_id") % 11 == 0, "drop": 1 - c("doc_id") % 2}))
    view, schema = CompactedView(t.spark, f"{root}/view", "doc_id", "version"), log.drop("drop").schema
    for drop in (0, 1):
        log.where(c("drop") == drop).drop("drop").write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(schema).parquet(f"{root}/in").writeStream.foreachBatch(view.commit)
        stream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return view.read().select("doc_id", "version")


@query("st09_due_work", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND least(60000, floor(1000 * pow(2, l_linenumber - 1))) <= 4000")
def _(t):
    from corvid.functions import scalars

    wait = scalars.backoff(c("l_linenumber"), 1000.0, 60000.0, F.lit(0.5))
    return t("lineitem").where((c("l_linestatus") == "O") & (wait <= 4000)).select("l_orderkey", "l_linenumber")


@query("st11_late_rows", "SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE ts <= m")
def _(t):
    from pyspark.sql import Window as W

    before = F.max("ts").over(W.partitionBy("user_id").orderBy("value", "event_id").rowsBetween(W.unboundedPreceding, -1))
    return t("events").withColumn("m", before).where("ts <= m").select("event_id")


@query("st08_lease_expiry", "SELECT user_id AS id, event_type AS worker, CASE WHEN event_id % 5 = 0 THEN 'complete' WHEN epoch(date_trunc('second', ts))::BIGINT + 86400 <= 1706000000 THEN 'expired' ELSE 'leased' END AS status, epoch(date_trunc('second', ts))::BIGINT + 86400 AS expires_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) DESC, event_type DESC, event_id % 5 = 0 DESC) = 1")
def _(t):
    from corvid.operators import ledger as G

    e = t("events").select(c("user_id").alias("id"), c("event_type").alias("worker"), F.unix_timestamp("ts").alias("at"), F.lit(86400).alias("lease_seconds"), (c("event_id") % 5 == 0).alias("done"))
    return G.leases(e, 1706000000)


@query("st09_work_ledger", "WITH w AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linestatus AS s, l_linenumber - 1 AS attempts, 1000 - l_partkey % 40 AS tried, 990 + l_suppkey % 30 AS deadline FROM lineitem), x AS (SELECT *, CASE WHEN attempts > 0 THEN tried + floor(least(60, pow(2, attempts - 1)))::BIGINT ELSE 1000 END AS next FROM w), y AS (SELECT *, CASE WHEN s = 'F' THEN 'complete' WHEN deadline <= 1000 THEN 'expired' WHEN next > 1000 THEN 'waiting' ELSE 'due' END AS status FROM x) SELECT id, status, CASE WHEN status IN ('due', 'waiting') THEN next END AS next_at FROM y")
def _(t):
    from corvid.operators import ledger as G

    k = c("l_orderkey") * 10 + c("l_linenumber")
    work = t("lineitem").select(k.alias("id"), F.when(c("l_linestatus") == "F", "complete").otherwise("pending").alias("state"), (c("l_linenumber") - 1).alias("attempts"), (1000 - c("l_partkey") % 40).alias("tried_at"), (990 + c("l_suppkey") % 30).alias("deadline"))
    return G.pending_work(work, 1000)


@query("st11_late_apart", "WITH m AS (SELECT max(doc_id) AS m FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, doc_id <= m AS late FROM documents, m WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, false FROM documents WHERE doc_id % 3 = 0")
def _(t):
    """Two drops as a stream: of the second, what isn't newer than all of the first is set apart."""
    from corvid.sinks import render
    from corvid.streaming import ingest

    root, rows = render.shared_folder(t.spark, "late"), t("documents").select("doc_id", c("doc_id").alias("updated_at"))
    for drop in (0, 1):
        rows.where(c("doc_id") % 3 == drop).write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        stream.writeStream.foreachBatch(ingest.apart(root)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    read = lambda name, late: t.spark.read.schema(rows.schema).parquet(f"{root}/{name}").select("doc_id", F.lit(late).alias("late"))
    return read("fresh", False).unionByName(read("late", True))


_WATERMARK = """WITH e AS (SELECT event_id, ts, event_id % 3 AS drop_ FROM events), m AS (SELECT drop_, max(ts) AS m FROM e GROUP BY 1),
w AS (SELECT a.drop_, max(b.m) - INTERVAL 10 DAY AS passed FROM m a LEFT JOIN m b ON b.drop_ < a.drop_ GROUP BY 1)
SELECT event_id, coalesce(ts <= passed, false) AS late FROM e JOIN w USING (drop_)"""


@query("st11_watermark_apart", _WATERMARK)
def _(t):
    """All events in three drops, three runs from one checkpoint: what is over ten days behind the newest event is set apart."""
    from corvid.sinks import render
    from corvid.streaming import ingest

    root, rows = render.shared_folder(t.spark, "watermark"), t("events").select("event_id", "ts")
    for drop in range(3):
        rows.where(c("event_id") % 3 == drop).write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        write = ingest.apart(root, "ts", F.expr("INTERVAL 10 DAYS"))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    read = lambda name, late: t.spark.read.schema(rows.schema).parquet(f"{root}/{name}").select("event_id", F.lit(late).alias("late"))
    return read("fresh", False).unionByName(read("late", True))


def streamed(t, step, hold_ms: int):
    """What ``step`` accepts of all events as a stream: two drops in time order, two runs from one checkpoint."""
    from corvid.sinks import render

    root, rows = render.shared_folder(t.spark, "folds"), events(t).drop("ts")
    middle = rows.agg(F.percentile_approx("at", 0.5)).first()[0]
    for drop in (c("at") < middle, c("at") >= middle):
        rows.where(drop).write.mode("append").parquet(f"{root}/in")
        source = t.spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        out = S.stream(source, step, hold_ms, "1 second").writeStream.format("parquet").option("path", f"{root}/out")
        out.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(S.VERDICT).parquet(f"{root}/out").where("accepted").select("key", "event_id")


@query("st04_tumbling_quota_stream", _TUMBLING)
def _(t):
    return streamed(t, S.tumbling_quota(2, DAY), DAY)


@query("st05_anchored_quota_stream", _ANCHORED)
def _(t):
    return streamed(t, S.anchored_quota(2, DAY), DAY)


@query("st06_replay_guard_stream", _REPLAY)
def _(t):
    return streamed(t, S.replay_guard(DAY), DAY)


@query("st07_sessions_stream", _SESSION)
def _(t):
    return streamed(t, S.session(6 * HOUR, DAY), 6 * HOUR)


#: Jobs are users: two workers claim, renew and complete them; a lease lasts six hours and a job is remembered for three days.
_LEASES = f"""WITH RECURSIVE a AS (SELECT user_id::VARCHAR AS id, event_id, epoch_us(ts) // 1000 AS tm, 'w' || event_id % 2 AS worker, CASE WHEN event_id % 5 = 0 THEN 'complete' WHEN event_id % 5 < 3 THEN 'claim' ELSE 'renew' END AS action FROM events),
u AS (SELECT max(tm) - 1000 AS until FROM a), e AS (SELECT a.*, row_number() OVER (PARTITION BY id ORDER BY tm, event_id) AS rn FROM a, u WHERE tm <= until),
s AS (SELECT DISTINCT id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::BIGINT AS tm, NULL::VARCHAR AS who, NULL::VARCHAR AS outcome, NULL::VARCHAR AS worker, NULL::BIGINT AS ends, 0::BIGINT AS attempts, NULL::VARCHAR AS status FROM e
UNION ALL SELECT id, rn, event_id, tm, who, outcome, CASE WHEN outcome IN ('claimed', 'renewed', 'completed') THEN who ELSE worker END, CASE WHEN outcome IN ('claimed', 'renewed') THEN tm + {6 * HOUR} WHEN outcome = 'completed' THEN tm ELSE ends END,
attempts + (outcome = 'claimed')::BIGINT, CASE WHEN outcome IN ('claimed', 'renewed') THEN 'running' WHEN outcome = 'completed' THEN 'completed' ELSE status END FROM (
SELECT *, CASE WHEN action = 'claim' AND (status IS NULL OR status = 'expired') THEN 'claimed' WHEN action = 'renew' AND status IN ('running', 'expired') AND worker = who THEN 'renewed' WHEN action = 'complete' AND status IN ('running', 'expired') AND worker = who THEN 'completed' ELSE 'refused' END AS outcome FROM (
SELECT id, rn, event_id, tm, who, action, CASE WHEN NOT gone THEN worker END AS worker, CASE WHEN NOT gone THEN ends END AS ends, CASE WHEN gone THEN 0 ELSE attempts END AS attempts, CASE WHEN NOT gone THEN st END AS status FROM (
SELECT *, coalesce(st <> 'running' AND tm - ends >= {3 * DAY}, false) AS gone FROM (
SELECT s.id, e.rn, e.event_id, e.tm, e.worker AS who, e.action, s.worker, s.ends, s.attempts, CASE WHEN s.status = 'running' AND s.ends < e.tm THEN 'expired' ELSE s.status END AS st FROM s JOIN e ON e.id = s.id AND e.rn = s.rn + 1))))),
n AS (SELECT *, lead(tm) OVER (PARTITION BY id ORDER BY rn) AS next FROM s)
SELECT id, event_id, tm AS "at", who AS worker, outcome, attempts FROM s WHERE rn > 0 UNION ALL SELECT id, NULL, ends, worker, 'expired', attempts FROM n, u WHERE status = 'running' AND CASE WHEN next IS NULL THEN ends <= until ELSE ends < next END"""


def lease_events(t):
    action = F.when(c("event_id") % 5 == 0, "complete").when(c("event_id") % 5 < 3, "claim").otherwise("renew")
    return t("events").select(c("user_id").cast("string").alias("id"), "event_id", F.unix_millis("ts").alias("at"), F.concat(F.lit("w"), c("event_id") % 2).alias("worker"), action.alias("action"), F.lit(6 * HOUR).cast("long").alias("lease_ms"))


@query("st08_lease_outcomes", _LEASES)
def _(t):
    from corvid.streaming import leases

    rows = lease_events(t)
    return leases.batch(rows, (rows.agg(F.max("at")).first()[0] or 0) - 1000, 3 * DAY)


@query("st08_lease_timers_stream", _LEASES)
def _(t):
    """The same by timers over a stream: two drops in time order, two runs from one checkpoint."""
    from corvid.sinks import render
    from corvid.streaming import leases

    root, rows, provider = render.shared_folder(t.spark, "leases"), lease_events(t), "spark.sql.streaming.stateStore.providerClass"
    middle, before = rows.agg(F.percentile_approx("at", 0.5)).first()[0], t.spark.conf.get(provider)
    t.spark.conf.set(provider, leases.ROCKSDB)
    try:
        for drop in (c("at") < middle, c("at") >= middle):
            rows.where(drop).write.mode("append").parquet(f"{root}/in")
            source = t.spark.readStream.schema(rows.schema).parquet(f"{root}/in")
            out = leases.stream(source, 3 * DAY, "1 second").writeStream.format("parquet").option("path", f"{root}/out")
            out.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        t.spark.conf.set(provider, before)
    return t.spark.read.schema(leases.OUTCOME).parquet(f"{root}/out")
