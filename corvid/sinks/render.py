"""Documents, listings, managed sections and manifests as text columns; versions published behind a pointer."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.functions import text as T


def _scalar(value: Column) -> Column:
    """A header value as JSON writes it."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), r'(?s)\A\{"v":(.*)\}\z', "$1")


def document(header: dict[str, Column], body: Column) -> Column:
    """A header of fixed order between --- lines, then the body."""
    lines = [F.concat(F.lit(f"{k}: "), _scalar(v)) for k, v in header.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), body)


def new_body(existing: Column, body: Column) -> Column:
    """The old header with another body."""
    return F.concat(F.regexp_extract(existing, r"(?s)\A(---\n.*?\n---)(?:\n|\z)", 1), F.lit("\n\n"), body)


def archive_path(provider: Column, title: Column, doc_id: Column) -> Column:
    return F.concat(T.provider(provider), F.lit("/"), T.title(title), F.lit("--"), doc_id, F.lit(".md"))


def index(rows: DataFrame, group: str) -> DataFrame:
    """(group, line_no, line) of rows(group, title, path): table lines by title, then path. Lines stay rows, so that a
    group's listing needn't fit in memory."""
    line = F.concat(F.lit("| "), T.escape_cell(F.col("title")), F.lit(" | "), F.col("path").cast("string"), F.lit(" |"))
    return rows.select(group, F.row_number().over(W.partitionBy(group).orderBy("title", "path")).alias("line_no"), line.alias("line"))


def managed(existing: Column, section: Column, start: str, end: str) -> Column:
    """``existing`` with the text between the markers replaced; without both markers the section goes before it."""
    a, b = F.instr(existing, start), F.instr(existing, end)
    put = F.concat(F.lit(start + "\n"), section, F.lit("\n" + end))
    kept = F.concat(F.substring(existing, F.lit(1), a - 1), put, F.substring(existing, b + len(end), F.length(existing)))
    return F.when((a > 0) & (b > a), kept).when(F.coalesce(existing, F.lit("")) == "", put).otherwise(F.concat(put, F.lit("\n\n"), existing))


def note_path(text: Column, now: Column) -> Column:
    return F.concat(F.lit("inbox/"), F.date_format(now, "yyyy-MM-dd"), F.lit("-"), F.substring(F.sha2(text, 256), 1, 8), F.lit(".md"))


MANIFEST = "id string, path string, contentHash string, revision string, deleted boolean, stale boolean, accessLabels array<string>, source struct<type:string,id:string>"


def manifest_issues(rows: DataFrame, value: str = "value") -> DataFrame:
    """Manifest lines parsed, each with the list of what is wrong with it."""
    known = [x.split()[0] for x in MANIFEST.split(", ")]
    e = rows.withColumn("entry", F.from_json(value, MANIFEST)).withColumn("keys", F.json_object_keys(value))
    say = lambda cond, what: F.when(cond, F.lit(what))
    issues = F.array(
        say(F.col("keys").isNull(), "not an object"), say(F.coalesce(F.col("entry.id"), F.lit("")) == "", "no id"), say(~T.safe_path(F.coalesce(F.col("entry.path"), F.lit(""))), "bad path"),
        say(~F.coalesce(F.col("entry.contentHash"), F.lit("")).rlike(r"\A[0-9a-f]{64}\z"), "bad hash"), say(F.coalesce(F.col("entry.revision"), F.lit("")) == "", "no revision"),
        say(F.size(F.array_except("keys", F.array(*map(F.lit, known)))) > 0, "unknown key"),
    )
    return e.withColumn("issues", F.filter(issues, lambda x: x.isNotNull()))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see. A local session may name none; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), f'corvid-{os.getuid()}')}"
    return f"{root.rstrip('/')}/corvid-{name}-{uuid.uuid4().hex}"


def publish(df: DataFrame, root: str, dry_run: bool = False, check=None) -> str | None:
    """Writes a new version under ``root``, then moves the pointer to it; a failed write leaves the old one current.

    ``check`` gets the written version before the pointer moves and raises if it must not become current.
    """
    if dry_run:
        return None
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{version}")
    if check is not None:
        check(spark.read.parquet(f"{root}/versions/{version}"))
    point(spark, root, version)
    return version


def point(spark: SparkSession, root: str, version: str) -> None:
    """Writes the pointer beside the current one and renames it over that, so it is never half written."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT.{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    out = at.getFileSystem(conf).create(draft, False)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(draft, at, how)


def rollback(spark: SparkSession, root: str, version: str) -> None:
    """Makes a version that was written before current again."""
    spark.read.parquet(f"{root}/versions/{version}")
    point(spark, root, version)


def replace_model(chunks: DataFrame, vectors: DataFrame, root: str, key: str) -> str:
    """Publishes ``vectors(key, v)`` as current only if every one of ``chunks(key)`` has a vector and no other row has."""

    def check(written: DataFrame) -> None:
        gap = chunks.select(key).join(written.select(key, F.lit(True).alias("__held")), key, "full_outer").agg(F.count("*").alias("n"), F.count("__held").alias("held"), F.count_distinct(key).alias("keys")).first()
        if not gap.n == gap.held == gap.keys or chunks.count() != gap.n:
            raise ValueError("not every chunk has one vector")

    return publish(vectors, root, check=check)


def current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.text(f"{root}/CURRENT").first().value
    return spark.read.parquet(f"{root}/versions/{version}")


def rename_key(text: Column, old: str, new: str) -> Column:
    """``text`` with a key of its header renamed; the body and texts without header stay."""
    head = F.regexp_extract(text, r"(?s)\A(---\n.*?\n---)(?:\n|\z)", 1)
    return F.when(head != "", F.concat(F.regexp_replace(head, rf"(?m)^{old}:", f"{new}:"), F.substring(text, F.length(head) + 1, F.length(text)))).otherwise(text)
