"""Incremental catalog scans with a cursor for each client and scope. Events: (client_id, scope_id, counter, commit_id, resource_id); cursors and coverage: (client_id, scope_id, counter)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.planner import in_scopes

AT = ["client_id", "scope_id"]
EVENT = [*AT, "counter", "commit_id", "resource_id"]
#: Events of a scope after which its catalog is due for a snapshot.
SNAPSHOT_AFTER = 10_000


def events_of(commits: DataFrame) -> DataFrame:
    return commits.select(F.col("author").alias("client_id"), "scope_id", "counter", F.col("id").alias("commit_id"), "resource_id")


def _after(events: DataFrame, *bounds: tuple[DataFrame, str]) -> DataFrame:
    """Events whose counter is above every bound of their client and scope."""
    for df, name in bounds:
        events = events.join(df.select(*AT, F.col("counter").alias(name)), AT, "left")
    least = F.lit(0)
    for _, name in bounds:
        least = F.greatest(least, F.coalesce(name, F.lit(0)))
    return events.where(F.col("counter") > least).select(EVENT)


def catalog_delta(snapshot: DataFrame, segments: DataFrame, cursors: DataFrame, coverage: DataFrame, scopes: list[str] = ()) -> DataFrame:
    """Events that the cursors haven't seen: those of the snapshots, and those of segments beyond the snapshots' coverage. Order: (client_id, counter)."""
    old = _after(in_scopes(snapshot, list(scopes)), (cursors, "_seen"))
    new = _after(in_scopes(segments, list(scopes)), (cursors, "_seen"), (coverage, "_covered"))
    return old.unionByName(new)


def next_cursors(cursors: DataFrame, *seen: DataFrame) -> DataFrame:
    """The greatest counter of each client and scope, over the cursors and all that was seen."""
    out = cursors.select(*AT, "counter")
    for s in seen:
        out = out.unionByName(s.select(*AT, "counter"))
    return out.groupBy(*AT).agg(F.max("counter").alias("counter"))


def missing_commits(delta: DataFrame, known: DataFrame) -> DataFrame:
    return delta.select("commit_id").distinct().join(known.select(F.col("id").alias("commit_id")), "commit_id", "left_anti")


def segment_summary(commits: DataFrame) -> DataFrame:
    """(client_id, scope_id, first_counter, last_counter, events) of the segment that each author and scope of a batch writes."""
    return events_of(commits).groupBy(*AT).agg(F.min("counter").alias("first_counter"), F.max("counter").alias("last_counter"), F.count("*").alias("events"))


def snapshot_due(delta: DataFrame, coverage: DataFrame, after: int = SNAPSHOT_AFTER) -> DataFrame:
    """(scope_id, events, due): events beyond the last snapshot."""
    return _after(delta, (coverage, "_covered")).groupBy("scope_id").agg(F.count("*").alias("events"), (F.count("*") >= after).alias("due"))


def latest_generation(snapshots: DataFrame) -> DataFrame:
    """Rows of each scope's newest snapshot."""
    newest = snapshots.groupBy("scope_id").agg(F.max("generation").alias("generation"))
    return snapshots.join(newest, ["scope_id", "generation"], "left_semi")


def latest_acks(acks: DataFrame) -> DataFrame:
    """One acknowledgement for each client and resource: the last written (greatest seq)."""
    rest = [c for c in acks.columns if c not in ("client_id", "scope_id", "resource_id")]
    return acks.groupBy("client_id", "scope_id", "resource_id").agg(F.max_by(F.struct(*rest), "seq").alias("x")).select("client_id", "scope_id", "resource_id", "x.*")
