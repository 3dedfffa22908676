"""Transcript sources. A source is a table of records (file, line, record VARIANT); each reader returns messages
(conv_id, ord, role, text, ts STRING) of one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.sinks import render as R


def get(v, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines(raw) with ``record``, null unless the line is a JSON object, and ``blank``, true if it holds white space alone."""
    clean = F.regexp_replace("raw", "\r$", "")
    return lines.withColumns({"record": F.when(clean.rlike(r"^\s*\{"), F.try_parse_json(clean)), "blank": ~clean.rlike(r"(?U)\S")})


def jsonl_lines(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, warnings and failures of files(file, value), one JSON object a line.

    A malformed last line without a line end is left out with a warning; a malformed line elsewhere fails its file.
    """
    lines = files.select("file", F.size(F.split("value", "\n", -1)).alias("n"), F.posexplode(F.split("value", "\n", -1)).alias("line", "raw"))
    lines = _parsed(lines).where("not blank")
    bad = F.col("record").isNull()
    last = F.col("line") == F.col("n") - 1
    failed = lines.where(bad & ~last).select("file").distinct()
    warned = lines.where(bad & last).select("file").distinct().join(failed, "file", "left_anti")
    return lines.where(~bad).select("file", "line", "record").join(failed, "file", "left_anti"), warned, failed


def read_jsonl(spark: SparkSession, root: str, suffix: str = "*.jsonl") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same over all files under ``root``, read by ranges, so a file of any size is many tasks. A leading byte order mark is
    skipped; files must not be compressed.

    A first pass leaves a row for each range: its lines and bytes, the malformed ones, and whether its last line is one.
    From these come the number of a range's first line, whether a file's last line has an end, and which files fail.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).option("lineSep", "\n").text(root)
    # Rows of a range are numbered one after another, in a numbering by task.
    at = {"file": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start"), "bytes": F.col("_metadata.file_size"), "row": F.monotonically_increasing_id(), "raw": F.col("value")}
    rows = text.select(*[v.alias(k) for k, v in at.items()])
    parsed = _parsed(rows)
    bad = ~F.col("blank") & F.col("record").isNull()
    ranges = parsed.groupBy("file", "start").agg(
        F.first("bytes").alias("bytes"), F.count("*").alias("n"), F.min("row").alias("first"), F.sum(F.octet_length("raw") + 1).alias("read"),
        F.count_if(bad).alias("n_bad"), F.max_by(bad, "row").alias("last_bad"),
    )
    folder = R.shared_folder(spark, "ranges")
    ranges.write.parquet(folder)
    ranges = spark.read.schema(ranges.schema).parquet(folder)
    # A line without end counts one byte that isn't there; a byte order mark is three that weren't counted.
    no_end = (F.sum("read") - F.first("bytes")).isin(1, -2)
    cut = no_end & F.max_by("last_bad", "start")
    files = ranges.groupBy("file").agg((F.sum("n_bad") - cut.cast("int") > 0).alias("failed"), cut.alias("cut"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = ranges.withColumn("before", before).join(files.where("not failed").select("file"), "file").select("file", "start", "first", "before")
    kept = parsed.where(~F.col("blank") & F.col("record").isNotNull()).join(places, ["file", "start"])
    return kept.select("file", (F.col("row") - F.col("first") + F.col("before")).alias("line"), "record"), files.where("cut and not failed").select("file"), files.where("failed").select("file")


def list_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Paths, sizes and times of the files under ``root`` that end in ``suffix``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path", "length", "modificationTime")


def _messages(rows: DataFrame, conv: Column, role: Column, content: Column, ts: Column) -> DataFrame:
    out = rows.select("file", "line", conv.alias("conv"), T.role(role).alias("role"), T.message_text(content).alias("text"), ts.alias("ts"))
    return out.where("role is not null")


def _ids(records: DataFrame, value: Column) -> DataFrame:
    """(file, conv_id): the first id that a file's records give, else the file's stem."""
    stem = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    return records.groupBy("file").agg(F.min_by(value, F.when(value.isNotNull(), F.col("line"))).alias("id")).select("file", F.coalesce("id", stem).alias("conv_id"))


def _finish(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids, "file").select("conv_id", F.col("line").alias("ord"), "role", "text", "ts")


def coding_agent_a(records: DataFrame) -> DataFrame:
    """User and assistant records that are neither meta nor side chains; the session id is the first one given."""
    flag = lambda p: F.coalesce(get("record", p, "boolean"), F.lit(False))
    kept = records.where(get("record", "$.type").isin("user", "assistant") & ~flag("$.isMeta") & ~flag("$.isSidechain"))
    role = F.coalesce(get("record", "$.message.role"), get("record", "$.type"))
    return _finish(_messages(kept, F.lit(None), role, get("record", "$.message.content", "variant"), get("record", "$.timestamp")), _ids(records, get("record", "$.sessionId")))


def coding_agent_b(records: DataFrame) -> DataFrame:
    """Records with a payload: messages and events; developer and system roles go, and assistants' commentary."""
    body = F.when(get("record", "$.type").isin("response_item", "event_msg"), get("record", "$.payload", "variant")).otherwise(F.col("record"))
    rows = records.withColumn("body", body)
    kind = get("body", "$.type")
    role = F.when(kind == "user_message", "user").when(kind == "agent_message", "assistant").otherwise(get("body", "$.role"))
    phase = get("body", "$.phase")
    kept = rows.withColumn("r", role).where(kind.isin("message", "user_message", "agent_message") & ((F.col("r") != "assistant") | phase.isNull() | (phase == "final_answer")))
    content = F.coalesce(get("body", "$.content", "variant"), get("body", "$.message", "variant"))
    ids = _ids(records, F.when(get("record", "$.type") == "session_meta", get("record", "$.payload.id")))
    return _finish(_messages(kept, F.lit(None), F.col("r"), content, get("record", "$.timestamp")), ids)


def coding_agent_c(records: DataFrame) -> DataFrame:
    """A session header, then message records."""
    kept = records.where(get("record", "$.type") == "message")
    ids = _ids(records, F.when(get("record", "$.type") == "session", get("record", "$.id")))
    return _finish(_messages(kept, F.lit(None), get("record", "$.message.role"), get("record", "$.message.content", "variant"), get("record", "$.timestamp")), ids)


def summary_updates(summaries: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and warnings: summaries(file, record) with the updates of the same folder; none is a warning."""
    folder = F.regexp_replace("file", "/[^/]*$", "")
    s = summaries.select(folder.alias("folder"), get("record", "$.info.id").alias("conv_id"))
    u = updates.withColumn("folder", folder).withColumn("u", get("record", "$.params.update", "variant"))
    kind = get("u", "$.sessionUpdate")
    role = F.when(kind == "user_message_chunk", "user").when(kind == "agent_message_chunk", "assistant")
    rows = s.join(u.select("folder", "line", role.alias("role"), T.message_text(get("u", "$.content", "variant")).alias("text"), get("record", "$.timestamp").alias("ts")), "folder", "left")
    lost = rows.groupBy("conv_id").agg(F.count("line").alias("n")).where("n = 0").select("conv_id")
    return rows.where("role is not null").select("conv_id", F.col("line").alias("ord"), "role", "text", "ts"), lost


#: Members of a record that hold no messages.
NO_MESSAGES = ("toolCall", "toolResult", "toolCalls", "toolResults", "thinking", "reasoning")


def _named(*names: str) -> Column:
    """The first of a record's members that is a text and not blank."""
    return T.first_text(*(get("record", f"$.{n}") for n in names))


def _key_value_id() -> Column:
    return F.coalesce(_named("conversationId", "composerId", "sessionId", "agentId", "id"), F.regexp_extract("key", r"([^:/]+)$", 1))


def key_value_heads(stores: DataFrame) -> DataFrame:
    """(conv_id, title, folder) of stores(store, key, record); a record without an id goes by its key's last part."""
    return stores.select(_key_value_id().alias("conv_id"), _named("title", "name", "conversationTitle").alias("title"), _named("workspacePath", "workspace", "cwd", "projectPath", "folderPath").alias("folder"))


def key_values(stores: DataFrame, folder: str, depth: int | None = None) -> DataFrame:
    """stores(store, key, record): every nested object with a role and a text that isn't blank is a message of the record's
    id, else of the key's last part; NO_MESSAGES are not entered; a (role, time, text) seen before is dropped.

    Objects are looked for level by level until none is left, or down to ``depth`` levels. Each level is written to
    ``folder``, so none is parsed twice. Members of an object come by name, as VARIANT keeps them.
    """
    spark, skipped = stores.sparkSession, ", ".join(f"'{k}'" for k in NO_MESSAGES)
    level = stores.select(_key_value_id().alias("conv_id"), "store", F.array(F.lit(0)).alias("at"), F.col("record").alias("v"))
    levels = [level]
    while depth is None or len(levels) <= depth:
        down = spark.sql(f"SELECT conv_id, store, concat(at, array(e.pos)) AS at, e.value AS v FROM {{level}}, LATERAL variant_explode_outer(v) e WHERE e.value IS NOT NULL AND coalesce(e.key NOT IN ({skipped}), true) AND schema_of_variant(e.value) RLIKE '^(OBJECT|ARRAY)'", level=level)
        down.write.parquet(f"{folder}/level={len(levels)}")
        level = spark.read.schema(down.schema).parquet(f"{folder}/level={len(levels)}")
        if level.isEmpty():
            break
        levels.append(level)
    first_of = lambda kind, *names: F.coalesce(*(get("v", f"$.{n}", kind) for n in names))
    found = reduce(DataFrame.unionByName, levels).select("conv_id", "store", "at", T.role(first_of("string", "role", "sender", "author")).alias("role"), T.message_text(first_of("variant", "text", "content", "message", "parts")).alias("text"), first_of("string", "timestamp", "createdAt", "created_at").alias("ts"))
    first = found.where("role is not null").where(T.trim_all(F.col("text")) != "").groupBy("conv_id", "role", "ts", "text").agg(F.min(F.struct("store", "at")).alias("place"))
    return first.select("conv_id", "place", "role", "text", "ts")


def tree_export(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """(conv_id, node, depth) from each current node up to the root: nodes(conv_id, node, parent), current(conv_id, node).
    A parent seen before ends the walk, as does one that isn't among the nodes; a conversation without a current node has
    all its nodes at depth 0. The ids of one conversation come together in a task, not their contents."""
    conv, id_ = (nodes.schema[c].dataType.simpleString() for c in ("conv_id", "node"))

    def walk(key, table):
        import pyarrow as pa

        parents = dict(zip(table.column("node").to_pylist(), table.column("parent").to_pylist(), strict=True))
        path, node = {}, table.column("current")[0].as_py()
        while node is not None and node not in path:
            path[node] = len(path)
            node = parents.get(node)
        kinds = table.schema
        return pa.table({"conv_id": pa.array([key[0].as_py()] * len(path), kinds.field("conv_id").type), "node": pa.array(list(path), kinds.field("node").type), "depth": pa.array(list(path.values()), pa.int32())})

    at = current.where("node is not null").select("conv_id", F.col("node").alias("current"))
    ids = nodes.select("conv_id", "node", "parent")
    walked = ids.join(at, "conv_id").groupBy("conv_id").applyInArrow(walk, f"conv_id {conv}, node {id_}, depth int")
    rest = ids.join(at, "conv_id", "left_anti").select("conv_id", "node", F.lit(0).alias("depth"))
    return walked.unionByName(rest)


def list_export(conversations: DataFrame) -> DataFrame:
    """Messages of exported conversations(record) that hold a list of messages."""
    conv = F.coalesce(get("record", "$.uuid"), get("record", "$.id"))
    list_ = F.coalesce(get("record", "$.chat_messages", "array<variant>"), get("record", "$.messages", "array<variant>"))
    rows = conversations.select(conv.alias("conv_id"), F.posexplode(list_).alias("ord", "m")).where("conv_id is not null")
    content = F.coalesce(F.when(T.first_text(get("m", "$.text")).isNotNull(), get("m", "$.text", "variant")), get("m", "$.content", "variant"))
    return rows.select("conv_id", "ord", T.role(F.coalesce(get("m", "$.sender"), get("m", "$.role"))).alias("role"), T.message_text(content).alias("text"), get("m", "$.created_at").alias("ts")).where("role is not null")


def export_heads(conversations: DataFrame) -> DataFrame:
    """(conv_id, title, created, updated) of exported conversations(record) that have an id."""
    pick = lambda *paths: T.first_text(*[get("record", p) for p in paths])
    return conversations.select(pick("$.id", "$.uuid", "$.conversation_id").alias("conv_id"), pick("$.title", "$.name").alias("title"), pick("$.create_time", "$.created_at").alias("created"), pick("$.update_time", "$.updated_at").alias("updated")).where("conv_id is not null")
