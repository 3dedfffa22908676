"""Who may see which rows, and checks on rows before they are let in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.functions import text as T

#: Roles from least to greatest.
ROLES = ("member", "admin", "owner")


def metadata(rows: DataFrame, equal: dict[str, list[str]], updated: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows with one of the values given for each column, and a date as text within the bounds; no date compares as empty."""
    for name, values in equal.items():
        rows = rows.where(F.col(name).isin(*values))
    day = F.coalesce(F.col(updated), F.lit(""))
    if since is not None:
        rows = rows.where(day >= since)
    return rows if until is None else rows.where(day <= until)


def scope(rows: DataFrame, tenant, brain=None) -> DataFrame:
    rows = rows.where((F.col("tenant") == tenant) & ~F.coalesce(F.col("deleted"), F.lit(False)))
    return rows if brain is None else rows.where(F.col("brain") == brain)


def labels_allow(labels: Column, allowed: list[str] | None) -> Column:
    """True if all of a row's labels are allowed; without a list all are, with an empty one only unlabelled rows."""
    if allowed is None:
        return F.lit(True)
    given = F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(labels, F.array().cast("array<string>")), given)) == 0


def visible(rows: DataFrame, members: DataFrame, least: str) -> DataFrame:
    """rows(tenant, row_labels) for each member of the tenant with the role ``least`` or above; a member's labels bind if there are any."""
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    granted = members.where(rank >= ROLES.index(least) + 1)
    both = rows.join(granted, "tenant")
    return both.where(F.col("labels").isNull() | (F.size(F.array_except("row_labels", F.coalesce("labels", F.array().cast("array<string>")))) == 0))


def effective(memberships: DataFrame) -> DataFrame:
    """One membership (user, tenant, brain, role) of each user and tenant: a brain's own goes before the tenant's."""
    w = W.partitionBy("user", "tenant").orderBy(F.col("brain").isNull(), "brain")
    return memberships.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def after_checkpoint(rows: DataFrame, updated: str, checkpoint: Column) -> DataFrame:
    return rows.where(F.col(updated).isNull() | (F.col(updated) > checkpoint))


def conformance(docs: DataFrame) -> DataFrame:
    """``docs`` with the first reason each is refused for, or null. A batch with any is refused whole by the caller."""
    repeated = F.count("*").over(W.partitionBy("external_id")) > 1
    issue = (
        F.when(F.col("external_id").isNull(), "no id").when(~T.safe_path(F.col("path")), "unsafe path")
        .when(F.sha2("content", 256) != F.col("content_hash"), "hash differs").when(F.coalesce("source_type", F.lit("")) == "", "no provenance").when(F.col("__repeated"), "repeated id")
    )
    return docs.withColumn("__repeated", repeated).withColumn("issue", issue).drop("__repeated")


def verify(docs: DataFrame) -> DataFrame:
    """``docs(id, path, content)`` with an array of issues."""
    say = lambda cond, what: F.when(cond, F.lit(what))
    repeated = F.count("*").over(W.partitionBy("id")) > 1
    checks = F.array(say(F.col("__r"), "repeated id"), say(T.certain_secret(F.col("content")).isNotNull(), "credential"), say(~F.contains("path", F.col("id")), "name without id"), say(~F.endswith("content", F.lit("\n")), "no final newline"))
    return docs.withColumn("__r", repeated).withColumn("issues", F.filter(checks, lambda x: x.isNotNull())).drop("__r")


def expired(rows: DataFrame, now: Column, days: int) -> DataFrame:
    """Deleted rows whose deletion is ``days`` or more ago (1 to 3650)."""
    if not 1 <= days <= 3650:
        raise ValueError("days must be from 1 to 3650")
    return rows.where(F.col("deleted") & (F.col("deleted_at") <= now - F.make_interval(days=F.lit(days))))


def bad_transitions(events: DataFrame, keys: list[str], order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Events whose state may not follow the one before: allowed(before, state) is a small table."""
    before = F.lag(state).over(W.partitionBy(*keys).orderBy(*order))
    rows = events.withColumn("before", before).where("before is not null")
    return rows.join(allowed, ["before", state], "left_anti")


def isolated(rows: DataFrame, memberships: DataFrame, tenant: str, user: str | None) -> DataFrame:
    """rows(tenant, brain) of one tenant that ``user`` may see: those of a tenant whose member they are, or of a brain whose
    member they are. Without a user only the tenant binds. Memberships without a brain are the tenant's."""
    own = rows.where(F.col("tenant") == tenant)
    if not user:
        return own
    held = memberships.where((F.col("user") == user) & (F.col("tenant") == tenant))
    m, r = held.alias("m"), own.alias("r")
    return r.join(m, (F.col("m.tenant") == F.col("r.tenant")) & (F.col("m.brain").isNull() | (F.col("m.brain") == F.col("r.brain"))), "left_semi")


def stable_hash(docs: DataFrame, leave_out: tuple[str, ...] = ("retrieved_at",)) -> Column:
    """A hash of a document's columns by name, without those that differ from scan to scan; nulls count as values."""
    names = sorted(n for n in docs.columns if n not in leave_out)
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


def nondeterministic(scan, key: str, leave_out: tuple[str, ...] = ("retrieved_at",)) -> DataFrame:
    """(key, n): rows in which two scans differ, as often as they do. A deterministic source gives none. ``scan()`` returns a DataFrame."""
    one, two = (d.select(key, stable_hash(d, leave_out).alias("hash")) for d in (scan(), scan()))
    both = one.withColumn("n", F.lit(1)).unionByName(two.withColumn("n", F.lit(-1)))
    return both.groupBy(key, "hash").agg(F.sum("n").alias("n")).where("n <> 0").groupBy(key).agg(F.sum(F.abs("n")).alias("n"))
