"""Secret scan in DataFrame operations: fixed patterns, then character Markov models by log-likelihood ratio."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base scan, in the order their kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run of AKIA[A-Z0-9]+ with 16 characters or more
HEX = r"[0-9a-f]{32,}"  # a whole run, of 32 characters or more
KINDS = ("assign", "access", "hex", "markov")

#: What the models look at: runs that no blank, quote or bracket ends.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
N = len(SYMBOLS) + 1


def _matches(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, kind, end, value) of the leftmost non-overlapping matches, in code points; empty for none.

    Lengths of the parts between matches and of the matches give the places. ``keep``: a pattern to array of booleans.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(found, F.length)
    start = F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), sizes.alias("size"), found.alias("value")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (acc["at"] + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    start = F.filter(start, keep) if keep else start
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), start).otherwise(none)


def _value(match: Column) -> Column:
    """What an assignment assigns: group 2, found again in the match alone."""
    return F.regexp_extract(match, ASSIGN, 2)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    found = F.concat(
        _matches(text, ASSIGN, "assign", lambda m: F.length(_value(m["value"])) >= 8),
        _matches(text, ACCESS, "access"),
        _matches(text, HEX, "hex"),
    )
    return F.array_sort(found)


def _symbol(c: Column) -> Column:
    """The number of a character: its place among SYMBOLS, or the last number."""
    at = F.position(c, F.lit(SYMBOLS))
    return F.when(at == 0, F.lit(N - 1)).otherwise(at - 1)


def _bigrams(word: Column) -> Column:
    """Numbers of the pairs of neighbouring characters."""
    return F.transform(
        F.sequence(F.lit(1), F.length(word) - 1),
        lambda i: _symbol(F.substring(word, i, F.lit(1))) * N + _symbol(F.substring(word, i + 1, F.lit(1))),
    )


def train(docs: DataFrame, sample_docs: int = 2000, smoothing: float = 0.5, text_col: str = "text") -> list[float]:
    """Log-likelihood ratios, random against ordinary, of each pair of characters (row by row, N * N numbers).

    Labelled samples: what the fixed patterns find in all documents is random; identifiers and words of about
    ``sample_docs`` documents, taken by a hash of the text, with the fixed patterns' finds cut out, are ordinary. Spark
    counts the pairs; N * N sums for each label come to the driver.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.count()
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("h"))
    one_in = max(1, total // sample_docs)
    random = rows.where(F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX))
    random = random.select(F.explode(base_spans(F.col("text"))).alias("m")).select(
        F.lit(1).alias("label"), F.when(F.col("m.kind") == 0, _value(F.col("m.value"))).otherwise(F.col("m.value")).alias("word")
    )
    cut = reduce(lambda t, p: F.regexp_replace(t, p, " "), (ASSIGN, ACCESS, HEX), F.col("text"))
    plain = rows.where(F.pmod("h", F.lit(one_in)) == 0).select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all(cut, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("word"))
    pairs = random.unionByName(plain).where(F.length("word") >= 2).select("label", F.explode(_bigrams(F.col("word"))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["count"] for r in pairs.groupBy("label", "pair").count().collect()}

    def log_rows(label: int) -> list[float]:
        out = []
        for i in range(N):
            row = [counts.get((label, i * N + j), 0) for j in range(N)]
            out += [math.log((x + smoothing) / (sum(row) + smoothing * N)) for x in row]
        return out

    return [a - b for a, b in zip(log_rows(1), log_rows(0), strict=True)]


def _ratio(word: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a word's pairs."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    total = F.aggregate(_bigrams(word), F.lit(0.0), lambda a, p: a + F.get(table, p))
    return total / (F.length(word) - 1)


def spans(text: Column, model: list[float], threshold: float = 1.0) -> Column:
    """Base spans, and spans of candidates that hold a letter and a digit, touch no base span, and whose mean
    log-likelihood ratio is over ``threshold``."""
    text = F.coalesce(text, F.lit(""))
    base = base_spans(text)
    mixed = r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])"
    more = _matches(text, CANDIDATE, "markov", lambda m: m["value"].rlike(mixed) & (_ratio(m["value"], model) > threshold))
    apart = F.filter(more, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return F.array_sort(F.concat(base, apart))


def _said(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")


def scan(docs: DataFrame, threshold: float = 1.0, sample_docs: int = 2000, text_col: str = "text") -> DataFrame:
    """``docs`` with ``found``: array of (start, kind, end, value). Ends are exclusive, places are code points. A column of
    ``docs`` named found gives way to it.

    A null or empty text has no spans; an empty table gives an empty result; rows don't affect each other but through
    the models.
    """
    return docs.withColumn("found", spans(F.col(text_col), train(docs, sample_docs, text_col=text_col), threshold))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the digest of base spans, and all spans as text."""
    base = F.filter(F.col("found"), lambda m: m["kind"] < KINDS.index("markov"))
    n = {f"n_{k}": F.size(F.expr(f"filter(found, m -> m.kind = {i})")).cast("long") for i, k in enumerate(KINDS)}
    return scanned.select("doc_id", *[c.alias(k) for k, c in n.items() if k != "n_markov"], F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("found")).alias("spans"), n["n_markov"].alias("n_markov"))


def redact(docs: DataFrame, mask: str = "[SECRET]", threshold: float = 1.0, sample_docs: int = 2000, text_col: str = "text") -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``mask``; texts without spans stay as they are."""
    scanned = docs.withColumn("__found", spans(F.col(text_col), train(docs, sample_docs, text_col=text_col), threshold))
    done = F.aggregate(
        F.col("__found"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, m: F.when(m["end"] <= acc["at"], acc).otherwise(
            F.struct(
                m["end"].alias("at"),
                F.when(m["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, m["start"] - acc["at"]), F.lit(mask))).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))),
    )
    return scanned.withColumn(text_col, F.when(F.size("__found") > 0, done).otherwise(F.col(text_col))).drop("__found")
