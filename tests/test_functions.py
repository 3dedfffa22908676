from pyspark.sql import functions as F

from corvid.functions import scalars as S
from corvid.functions import text as T
from corvid.operators import chunks, models, search, versions
from corvid.sinks import render
from corvid.sources import documents, transcripts
from corvid.streaming import folds, ingest


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_identifiers_and_titles(spark):
    assert one(spark, T.uuid5(F.lit("chatgpt:conversation-1"))) == "0B328D5C-C824-54BE-B594-C5F216B02E3E"
    assert one(spark, T.title(F.col("c0")), '../A: title? *with* "secrets"') == "A- title- -with- -secrets"
    assert one(spark, T.title(F.col("c0")), "ｆｕｌｌ\twidth") == "full width"
    assert one(spark, T.title(F.lit(None).cast("string"))) == "Untitled conversation"


def test_redaction_counts_and_is_idempotent(spark):
    text = "token sk-" + "a" * 24 + " and AKIA" + "B" * 16 + " export API_TOKEN=" + "c" * 14
    got = one(spark, T.redact(F.col("c0")), text)
    assert got["count"] == 3 and "sk-a" not in got.text and "AKIAB" not in got.text and "ccc" not in got.text
    again = one(spark, T.redact(F.col("c0")), got.text)
    assert (again.text, again["count"]) == (got.text, 0)


def test_synthetic_blocks(spark):
    assert one(spark, T.strip_synthetic(F.col("c0")), "<environment_context>x\ny</environment_context>\r\n\r\n\r\nHi  ") == "Hi"
    assert one(spark, T.strip_synthetic(F.col("c0")), "# AGENTS.md instructions for x\n<INSTRUCTIONS>a</INSTRUCTIONS>\nDo it") == "Do it"


def test_message_text_of_nested_parts(spark):
    raw = '[{"type":"text","text":"a"},{"type":"tool_result","content":"no"},{"content":[{"text":"b"},"c"]},"d"]'
    assert one(spark, T.message_text(F.parse_json(F.col("c0"))), raw) == "a\n\nb\n\nc\n\nd"


def test_times(spark):
    for value, want in (("1700000000", 1700000000000), ("1700000000000", 1700000000000), ("2023-11-14T22:13:20Z", 1700000000000), ("soon", None)):
        assert one(spark, F.unix_millis(S.epoch_or_iso(F.col("c0"))), value) == want


def test_chunks_slice_back(spark):
    text = "intro words\n\n# One\nalpha beta\n\n## Two\n" + "gamma delta " * 300
    got = chunks.markdown(spark.createDataFrame([(1, text), (2, None), (3, "  \n")], "doc_id long, text string"), 200).orderBy("start_off").collect()
    assert {r.doc_id for r in got} == {"1"} and [r.text.split()[0] for r in got[:3]] == ["intro", "#", "##"]
    assert all(text[r.start_off : r.end_off] == r.text and len(r.text) <= 200 for r in got)
    body = "user: Hi\n\nassistant: " + "long sentence. " * 100 + "\n\nuser: Bye"
    got = chunks.transcript(spark.createDataFrame([(1, body)], "doc_id long, text string"), 300, 600).collect()
    assert got[0].role == "user" and all(len(r.text) <= 600 for r in got)


def test_mail_calendar_meeting(spark):
    frame = lambda s: spark.createDataFrame([(s,)], "text string")
    got = documents.mailbox(frame("From a\nSubject: One\nMessage-ID: <one@x>\n\nHi\nFrom b\nMessage-ID: <two@x>\n\nYo\n")).orderBy("mail").collect()
    assert [(r.external_id, r.title, r.content) for r in got] == [("<one@x>", "One", "# One\n\nHi\n"), ("<two@x>", "Untitled email", "# Untitled email\n\nYo\n")]
    assert documents.mailbox(frame(" \n")).count() == 0
    assert documents.calendar(frame("BEGIN:VEVENT\nUID:event-1\nSUMMARY:S\nEND:VEVENT")).first().external_id == "event-1"
    assert documents.meeting(frame('{"id":"meeting-1","title":"T","transcript":"x"}')).first().content == "# T\n\nx\n"


def test_files_of_jsonl(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/s1.jsonl").write_text('{"type":"user","sessionId":"s","message":{"role":"user","content":"Question"}}\n\n{"type":"assistant","message":{"content":[{"type":"text","text":"Answer"}]}}\n{"cut')
    (tmp_path / "bad.jsonl").write_text("{bad\n{}\n")
    records, warned, failed = transcripts.read_jsonl(spark, str(tmp_path))
    got = transcripts.coding_agent_a(records).orderBy("ord").collect()
    assert [(r.conv_id, r.role, r.text) for r in got] == [("s", "user", "Question"), ("s", "assistant", "Answer")]
    assert warned.count() == 1 and failed.first().file.endswith("bad.jsonl")
    assert transcripts.list_files(spark, str(tmp_path), ".jsonl").count() == 2


def test_extraction_quarantines_keys(spark):
    files = spark.createDataFrame([("a.txt", bytearray(b"hello")), ("k.txt", bytearray(b"AKIA" + b"A" * 16)), ("p.pdf", bytearray(b"%PDF-1 (Hello) (from PDF)")), ("i.png", bytearray(b"\x89PNG\r\n\x1a\n"))], "path string, content binary")
    got = {r.path: r for r in documents.extract(files).collect()}
    assert got["k.txt"].status == "quarantined" and got["k.txt"].text is None
    assert got["p.pdf"].text == "Hello from PDF" and got["i.png"].text == "# i.png\n\nimage/png, 8 bytes\n"


def test_publish_and_dry_run(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert render.publish(spark.range(3), root, dry_run=True) is None and not (tmp_path / "t").exists()
    render.publish(spark.range(3), root)
    render.publish(spark.range(5), root)
    assert render.current(spark, root).count() == 5


def test_streams_match_their_batch_twins(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("key"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.lit(1).alias("units"))
    events.orderBy("at").repartitionByRange(3, "at").write.parquet(str(tmp_path / "in"))
    step = folds.replay_guard(86_400_000)
    want = sorted(map(tuple, folds.batch(events, step).collect()))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = folds.stream(source, step, 86_400_000).writeStream.format("memory").queryName("guarded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("guarded").collect())) == want


def test_bad_batches_are_set_aside(spark, tmp_path):
    import hashlib

    import pytest
    from pyspark.errors import StreamingQueryException

    schema = "external_id string, path string, content string, content_hash string, source_type string, updated_at string"
    row = lambda i, p="a/b.md": (i, p, i, hashlib.sha256(i.encode()).hexdigest(), "web", "1")
    spark.createDataFrame([row("x"), row("y")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert ingest.start(read(), str(tmp_path / "out")).awaitTermination(120)
    spark.createDataFrame([row("z"), row("w", "../up")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException):
        ingest.start(read(), str(tmp_path / "out")).awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "out/log"))
    assert ingest.current(log).count() == 2 and spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 1


def test_delta_tags(spark):
    schema = "id string, path string, hash string, revision string, meta string, deleted boolean"
    before = spark.createDataFrame([("a", "p", "h", "r", "m", None), ("b", "p", "h", "r", "m", None), ("c", "p", "h", "r", "m", None), ("e", "p", "h", "r", "m", True)], schema)
    after = spark.createDataFrame([("a", "q", "h", "r", "m", False), ("b", "p", "H", "r", "m", None), ("c", "p", "h", "r", "M", None), ("d", "p", "h", "r", "m", None), ("e", "p", "h", "r", "m", None)], schema)
    assert {tuple(r) for r in versions.delta(before, after).collect()} == {("a", "moved"), ("b", "updated"), ("c", "metadata_only"), ("d", "created"), ("e", "restored")}


def test_cover_density_counts_minimal_covers(spark):
    texts = spark.createDataFrame([(1, "a x b a"), (2, "a a b"), (3, "b only"), (4, None), (5, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "A b"), (8, "  "), (9, None)], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in search.cover_density(asked, texts, "doc_id").collect()}
    assert got == {(7, 1): round(1 / 3 + 1 / 2, 6), (7, 2): 0.5}
    assert search.cover_density(asked, texts.limit(0), "doc_id").count() == 0


def test_hybrid_puts_linked_pages_last(spark):
    ranks = lambda *rows: spark.createDataFrame(list(rows), "query_id long, doc_id long, rank int")
    links = spark.createDataFrame([(1, 2), (1, 9), (3, 8)], "src long, dst long")
    signals = spark.createDataFrame([(1, 0.02), (2, 0.01), (8, 0.01)], "doc_id long, signal double")
    got = search.hybrid(ranks((1, 1, 1), (1, 2, 2)), ranks((1, 2, 1), (1, 3, 2)), links, signals, "doc_id", cut=False).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 1, 3, 9, 8]
    assert [r.score for r in got] == [round(1 / 62 + 1 / 61, 6) + 0.035, round(1 / 61, 6) + 0.02, round(1 / 62, 6), 0.025, 0.035]


def test_citations_resolve_or_say_why(spark):
    import hashlib

    h = hashlib.sha256(b"ell").hexdigest()
    hits = spark.createDataFrame([(1, 1, 4, h), (1, 0, 3, h), (1, 3, 9, h), (2, 1, 4, h)], "doc_id long, start_off int, end_off int, text_hash string")
    got = search.resolve(hits, spark.createDataFrame([(1, "hello")], "doc_id long, text string"), "doc_id").orderBy("doc_id", "start_off").collect()
    assert [(r.status, r.verified_text) for r in got] == [("hash differs", None), ("verified", "ell"), ("out of range", None), ("not found", None)]


def test_models_are_checked(spark, tmp_path):
    import pytest
    from pyspark.errors import PySparkException

    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "doc_id long, text string")
    got = models.embed(docs, "doc_id", lambda texts: [[float(len(t)), 1.0] for t in texts], 2, batch=2).orderBy("doc_id").collect()
    assert [r.v for r in got] == [[3.0, 1.0], [0.0, 1.0], [1.0, 1.0]]
    with pytest.raises(PySparkException):
        models.embed(docs, "doc_id", lambda texts: [[1.0] for _ in texts], 2).collect()
    assert all(sum(r.v) == n for r, n in zip(models.hashed_vectors(docs, "doc_id", dimensions=8).orderBy("doc_id").collect(), (2, 0, 1), strict=True))
    root = f"file://{tmp_path}/v"
    render.replace_model(docs, models.hashed_vectors(docs, "doc_id", dimensions=8), root, "doc_id")
    for wrong in (docs.where("doc_id < 3"), docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10))):
        with pytest.raises(ValueError):
            render.replace_model(docs, models.hashed_vectors(wrong, "doc_id", dimensions=4), root, "doc_id")
    assert len(render.current(spark, root).first().v) == 8


def test_filesystem_documents(spark, tmp_path):
    for name, text in (("a/n.TXT", "hi"), ("b.markdown", "# B\n"), (".hidden/c.md", "no"), ("d.csv", "no")):
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(text)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    got = {r.path: r.content for r in documents.filesystem(files, str(tmp_path)).collect()}
    assert got == {"files/a/n.md": "# n.TXT\n\nhi", "files/b.markdown": "# B\n"}


def test_metadata_redaction(spark):
    rows = ['{"a":1,"b":"x","Cookies":2,"occurredAt":"now","d":{"text":"kept inside"},"e":[1],"f":null}', "[1]", "no", "{}", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, m string")
    got = [r.m for r in df.select("i", T.redact_metadata(F.col("m")).alias("m")).orderBy("i").collect()]
    assert got == ['{"a":1,"occurredAt":"now","d":{"text":"kept inside"},"e":[1],"f":null}', None, None, "{}", None]
