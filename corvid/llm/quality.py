"""Quality rules under weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_digits long"


def measures(docs: DataFrame, window: int = 5, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with MEASURES of the whole text, in place of the text column unless ``keep_text``. A null text measures
    as an empty one; columns of ``docs`` that have a measure's name give way to it."""
    own = [m.split()[0] for m in MEASURES.split(", ")]
    rest = [c for c in docs.columns if (keep_text or c != text_col) and c not in own]

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, *range(3, 2 * window, 2)][:window], np.uint64)
        for batch in batches:
            rows = []
            for text in batch.column(len(rest)).to_pylist():
                text = text or ""
                raw = text.encode("utf-8", "replace")
                words = raw.split()
                seen: set[bytes] = set()
                lines = dups = 0
                for line in raw.split(b"\n"):
                    if line and not line.isspace():
                        lines += 1
                        if line in seen:
                            dups += 1
                        else:
                            seen.add(line)
                n, repeated = len(words), 0
                if n > window:
                    h = np.array(list(map(hash, words)), np.int64).astype(np.uint64)
                    m = n - window + 1
                    w = np.zeros(m, np.uint64)
                    for k in range(window):
                        w += h[k : k + m] * mix[k]
                        w ^= w >> np.uint64(29)
                    order = np.sort(w)
                    again = order[1:][order[1:] == order[:-1]]
                    if len(again):
                        at = np.flatnonzero(np.isin(w, again))
                        cover = np.zeros(n + 1, np.int64)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                        repeated = int((np.cumsum(cover)[:n] > 0).sum())
                blanks = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
                rows.append((n, len(text) - blanks, len(raw) - len(raw.translate(None, b"#*$%&|<>")), dups, repeated, lines, len(raw) - len(raw.translate(None, b"0123456789"))))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(rest))] + columns, names=[*rest, *own])

    schema = T.StructType([*docs.select(*rest).schema.fields, *T._parse_datatype_string(MEASURES).fields])
    return docs.select(*rest, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Each rule votes -1 (poor), 1 (good) or 0 (abstains) from the measures."""
    n, each = F.col("n_words"), F.greatest(F.col("n_words"), F.lit(1))
    size = F.col("word_chars") / each
    return {
        "length": _vote(n < 20, n >= 50),
        "word_size": _vote((size < 2.2) | (size > 15), size.between(3, 11)),
        "symbols": _vote(F.col("n_symbols") / each > 0.1, F.col("n_symbols") / each <= 0.02),
        "dup_lines": _vote(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)) > 0.3, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)) <= 0.05),
        "repeats": _vote(F.col("n_repeat_words") / each > 0.15, F.col("n_repeat_words") / each <= 0.05),
        "digits": _vote(F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1)) > 0.25, F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1)) <= 0.08),
    }


def fit(patterns: Sequence[tuple[Sequence[int], int]], rounds: int = 200, smoothing: float = 1.0) -> dict[tuple[int, ...], float]:
    """Posterior probability of good for each vote pattern, by EM over (votes, count) pairs.

    Latent class good or poor; each rule has its own vote distribution per class. EM starts from the share of good
    votes, which also names the classes. Patterns without any vote keep the prior.
    """
    patterns = [(tuple(v), c) for v, c in patterns]
    if not patterns:
        return {}
    k = len(patterns[0][0])
    post = {v: (1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for v, _ in patterns}
    for _ in range(rounds):
        mass = [smoothing, smoothing]
        seen = [[[smoothing] * 3 for _ in range(k)] for _ in range(2)]
        for v, c in patterns:
            for y, p in ((1, post[v]), (0, 1 - post[v])):
                mass[y] += c * p
                for j, x in enumerate(v):
                    seen[y][j][x + 1] += c * p
        for y in (0, 1):
            for j in range(k):
                total = sum(seen[y][j])
                seen[y][j] = [math.log(x / total) for x in seen[y][j]]
        moved = 0.0
        for v, _ in patterns:
            odds = math.log(mass[1] / mass[0]) + sum(seen[1][j][x + 1] - seen[0][j][x + 1] for j, x in enumerate(v) if x)
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            moved, post[v] = max(moved, abs(p - post[v])), p
        if moved < 1e-9:
            break
    return post


def with_votes(measured: DataFrame) -> DataFrame:
    return measured.withColumns({f"vote_{k}": v for k, v in rules().items()})


def posteriors(voted: DataFrame) -> list[float]:
    """EM over all rows of ``voted``: the posterior of each vote pattern, at the pattern's number in base 3.

    Spark counts the patterns; at most 3 to the number of rules of them come to the driver.
    """
    names = [f"vote_{k}" for k in rules()]
    counted = [(tuple(r[n] for n in names), r["count"]) for r in voted.groupBy(*names).count().collect()]
    table = [0.0] * 3 ** len(names)
    for v, p in fit(sorted(counted)).items():
        table[reduce(lambda a, x: a * 3 + x + 1, v, 0)] = p
    return table


def decide(voted: DataFrame, table: list[float], threshold: float = 0.5) -> DataFrame:
    """Adds ``posterior``, ``base_failed`` and ``kept``."""
    code = reduce(lambda a, k: a * 3 + F.col(f"vote_{k}") + 1, rules(), F.lit(0))
    looked = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return (
        voted.withColumn("posterior", F.get(looked, code)).withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def judge(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without text, with measures, votes, ``posterior``, ``base_failed`` and ``kept``.

    ``base_failed``: under 10 words, or over a fifth of the words in repeated windows. ``kept`` is false then, else
    posterior >= threshold. Each row is judged by itself, so null or repeated ids do no harm; an empty table gives an
    empty result.
    """
    voted = materialize(with_votes(measures(docs, text_col=text_col)), "quality")
    return decide(voted, posteriors(voted), threshold)


def keep_good(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns; measured twice rather than joined."""
    table = posteriors(with_votes(measures(docs, text_col=text_col)))
    renamed = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    voted = with_votes(measures(renamed, keep_text=False))
    return decide(voted, table, threshold).where("kept").select("row.*")
