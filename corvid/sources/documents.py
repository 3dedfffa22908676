"""Mail, mailboxes, calendars, meetings, files and archives as documents(external_id, title, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions import text as T


def header(text: Column, name: str) -> Column:
    return F.nullif(T.trim_all(F.regexp_extract(text, rf"(?im)^{name}:([^\r\n]*)", 1)), F.lit(""))


def mail(rows: DataFrame, text: str = "text") -> DataFrame:
    """One mail a row: headers up to the first blank line; without a message id, a hash of the mail stands in."""
    parts = F.split(F.col(text), r"\r?\n\r?\n", 2)
    head, body = parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    subject = F.coalesce(header(head, "Subject"), F.lit("Untitled email"))
    return rows.withColumns({
        "external_id": F.coalesce(header(head, "Message-ID"), F.sha2(text, 256)), "title": subject,
        "sender": header(head, "From"), "recipient": header(head, "To"), "sent": header(head, "Date"),
        "content": F.concat(F.lit("# "), subject, F.lit("\n\n"), T.trim_all(body), F.lit("\n")),
    })


def mailbox(rows: DataFrame, text: str = "text") -> DataFrame:
    """Mails of mailboxes: a line that begins with ``From `` opens one; without such a line the whole is one mail."""
    whole = F.regexp_replace(text, "\r\n", "\n")
    parts = F.split(whole, r"(?m)^From [^\n]*(?:\n|\z)", -1)
    mails = F.when(whole.rlike(r"(?m)^From "), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).when(T.trim_all(whole) == "", F.array().cast("array<string>")).otherwise(F.array(whole))
    split = rows.select(*[c for c in rows.columns if c != text], F.posexplode(mails).alias("mail", text))
    return mail(split.withColumn(text, F.regexp_replace(text, r"\s+\z", "")), text)


def calendar(rows: DataFrame, text: str = "text") -> DataFrame:
    """Events of calendars."""
    parts = F.split(text, "BEGIN:VEVENT", -1)
    events = rows.select(*[c for c in rows.columns if c != text], F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("event", "__e"))
    e = F.split("__e", "END:VEVENT", 2)[0]
    name, start = F.coalesce(header(e, "SUMMARY"), F.lit("Untitled event")), header(e, "DTSTART")
    content = F.concat(F.lit("# "), name, F.lit("\n\n"), F.when(start.isNotNull(), F.concat(F.lit("When: "), start, F.lit("\n\n"))).otherwise(""), F.regexp_replace(F.coalesce(header(e, "DESCRIPTION"), F.lit("")), r"\\n", "\n"), F.lit("\n"))
    return events.withColumns({"external_id": F.coalesce(header(e, "UID"), F.sha2("__e", 256)), "title": name, "starts": start, "content": content}).drop("__e")


def meeting(rows: DataFrame, text: str = "text") -> DataFrame:
    """Meetings as JSON {id, title, transcript}, or Markdown whose first heading is the title."""
    j = F.try_parse_json(F.col(text))
    get = lambda k: F.try_variant_get(j, f"$.{k}", "string")
    name = F.coalesce(F.when(j.isNotNull(), F.coalesce(get("title"), F.lit("Meeting"))), F.nullif(F.regexp_extract(text, r"(?m)^# ([^\n]*)", 1), F.lit("")), F.lit("Meeting"))
    return rows.withColumns({"external_id": F.coalesce(get("id"), F.sha2(text, 256)), "title": name, "content": F.concat(F.lit("# "), name, F.lit("\n\n"), F.coalesce(get("transcript"), F.col(text)), F.lit("\n"))})


def plain_text(files: DataFrame) -> DataFrame:
    """files(path, content BINARY): text of valid UTF-8 without NUL bytes; what isn't Markdown gets its name as heading."""
    good = F.is_valid_utf8(F.col("content").cast("string"))
    raw = F.col("content").cast("string")
    named = F.when(F.lower("path").rlike(r"\.(md|markdown)$"), raw).otherwise(F.concat(F.lit("# "), T.last_segment(F.col("path")), F.lit("\n\n"), raw))
    return files.withColumn("text", F.when(good & (F.instr(raw, "\x00") == 0), named))


def extract(files: DataFrame, max_bytes: int = 10_000_000) -> DataFrame:
    """files(path, content) with mime, status (ok, too-large, unsupported, quarantined), text and what was quarantined."""
    mime = T.sniff_mime(F.col("content"), F.col("path"))
    raw = F.col("content").cast("string")
    text = (
        F.when(F.col("mime") == "application/pdf", T.pdf_literals(F.col("content")))
        .when(F.col("mime").isin("text/plain", "application/json") & F.is_valid_utf8(raw) & (F.instr(raw, "\x00") == 0), raw)
        .when(F.col("mime").rlike("^(image|audio)/"), F.concat(F.lit("# "), T.last_segment(F.col("path")), F.lit("\n\n"), F.col("mime"), F.lit(", "), F.length("content").cast("string"), F.lit(" bytes\n")))
    )
    rows = files.withColumn("mime", mime).withColumn("text", F.when(F.length("content") <= max_bytes, text)).withColumn("secret", T.certain_secret(F.col("text")))
    status = F.when(F.length("content") > max_bytes, "too-large").when(F.col("text").isNull(), "unsupported").when(F.col("secret").isNotNull(), "quarantined").otherwise("ok")
    return rows.withColumn("status", status).withColumn("text", F.when(F.col("status") == "ok", F.col("text")))


def archive(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and warnings of Markdown files(path, value) with a header: the first path of an id, and of a
    (provider, source id), counts; hidden and report files are passed over."""
    rows = files.where(~T.last_segment(F.col("path")).rlike(r"^(\.|INDEX\.md$|REPORT\.md$)")).withColumn("f", T.frontmatter(F.col("value")))
    rows = rows.select("path", F.col("f.header").alias("header"), F.col("f.body").alias("body"), F.col("f.header")["id"].alias("id"), F.concat_ws("/", F.col("f.header")["provider"], F.col("f.header")["source_id"]).alias("source"))
    from pyspark.sql import Window as W

    def rank(k: str):
        """Place of a path in its group; rows without a value are groups of their own, or one task would sort them all."""
        held = F.col(k).isNotNull() & (F.col(k) != "")
        return F.when(held, F.row_number().over(W.partitionBy(k, F.when(~F.coalesce(held, F.lit(False)), F.col("path"))).orderBy("path"))).otherwise(1)

    rows = rows.withColumns({"n_id": rank("id"), "n_source": rank("source")})
    issue = F.when(F.col("header").isNull(), "no header").when(F.col("id").isNull(), "no id").when(F.col("n_id") > 1, "duplicate id").when(F.col("n_source") > 1, "duplicate source")
    rows = rows.withColumn("issue", issue)
    return rows.where("issue is null").select("path", "id", "source", "header", "body"), rows.where("issue is not null").select("path", "issue")


def filesystem(files: DataFrame, root: str) -> DataFrame:
    """Text files(path, modificationTime, content) below ``root``, as ``binaryFile`` reads them, as documents.

    Files of .md, .markdown and .txt count, no others; names that begin with a dot, and folders of such names, don't. The id is a hash of
    root and relative path; a .txt gets its name as heading and an .md path. Invalid UTF-8 is replaced. Order by path.
    """
    base = root.rstrip("/") + "/"
    at = F.regexp_replace("path", r"^file:/+", "/")
    rel = F.substring(at, F.lit(len(base) + 1), F.length(at))
    rows = files.where(F.startswith(at, F.lit(base)) & F.lower("path").rlike(r"\.(md|markdown|txt)$") & ~rel.rlike(r"(^|/)\."))
    raw, is_text = F.make_valid_utf8(F.col("content").cast("string")), F.lower(rel).rlike(r"\.txt$")
    content = F.when(is_text, F.concat(F.lit("# "), T.last_segment(rel), F.lit("\n\n"), raw)).otherwise(raw)
    return rows.select(
        F.sha2(F.concat(F.lit(root), F.lit("\0"), rel), 256).alias("external_id"), F.concat(F.lit("files/"), F.regexp_replace(rel, r"(?i)\.txt$", ".md")).alias("path"),
        content.alias("content"), F.sha2(content, 256).alias("content_hash"), F.lit("filesystem").alias("source_type"), F.col("path").alias("source_path"),
        F.col("modificationTime").alias("updated_at"), F.lit(False).alias("deleted"),
    )


def pick_export(entries: DataFrame, export: str = "export") -> DataFrame:
    """(export, path, warning): of the entries(export, path, pos) of each export the first named conversation(s).json, else
    the first; with several entries a warning tells which one was read."""
    named = F.col("path").rlike(r"(?i)conversations?\.json$")
    best = entries.groupBy(export).agg(F.min_by("path", F.struct(~named, F.col("pos"))).alias("path"), F.count("*").alias("n"))
    return best.select(export, "path", F.when(F.col("n") > 1, F.format_string("read %d JSON entries; selected %s", "n", "path")).alias("warning"))
