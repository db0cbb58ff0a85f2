"""What may be forgotten: retention, acknowledgement quorum, obsolete commits, maintenance phases. acks: (client_id, scope_id, resource_id, observed_heads[, pinned_commits])."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import dag
from tidemark.operators.dag import KEY


def newest(commits: DataFrame, n: int) -> DataFrame:
    """The newest n commits of each resource, by millis, then id."""
    order = Window.partitionBy(*KEY).orderBy(F.col("millis").desc(), F.col("id").desc())
    return commits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def retained(commits: DataFrame, n: int, checkpoints: DataFrame, pinned: DataFrame) -> DataFrame:
    """(scope_id, resource_id, id): the newest n, the checkpoint (scope_id, resource_id, id), and what clients pinned."""
    out = newest(commits, n).select(*KEY, "id")
    for more in (checkpoints, pinned):
        out = out.unionByName(more.select(*KEY, "id"))
    return out.distinct()


def obsolete(commits: DataFrame, keep: DataFrame) -> DataFrame:
    return commits.select(*KEY, "id").join(keep, [*KEY, "id"], "left_anti")


def active_clients(commits: DataFrame, retired: DataFrame, own: str | None = None) -> DataFrame:
    """(scope_id, resource_id, client_id): the authors that aren't retired, and the own client."""
    out = commits.select(*KEY, F.col("author").alias("client_id")).distinct().join(retired.select("client_id"), "client_id", "left_anti").select(*KEY, "client_id")
    if own is not None:
        out = out.unionByName(commits.select(*KEY, F.lit(own).alias("client_id")).distinct()).distinct()
    return out


def quorum(commits: DataFrame, checkpoints: DataFrame, acks: DataFrame, active: DataFrame) -> DataFrame:
    """(scope_id, resource_id, active, acknowledged, quorum): how many active clients observed a head that descends from the resource's checkpoint."""
    seen = acks.select("client_id", *KEY, F.explode("observed_heads").alias("start"))
    found = dag.ancestors(commits, seen.select("resource_id", "start").distinct())
    good = seen.join(found, ["resource_id", "start"]).join(checkpoints.select(*KEY, F.col("id").alias("ancestor")), [*KEY, "ancestor"], "left_semi").select(*KEY, "client_id", F.lit(1).alias("ok")).distinct()
    met = active.join(checkpoints.select(*KEY), KEY, "left_semi").join(good, [*KEY, "client_id"], "left")
    return met.groupBy(*KEY).agg(F.count("*").alias("active"), F.count("ok").alias("acknowledged"), (F.count("*") == F.count("ok")).alias("quorum"))


def phases(commits: DataFrame, n: int, kinds: DataFrame, conflicts: DataFrame, checkpoints: DataFrame, quorums: DataFrame) -> DataFrame:
    """(scope_id, resource_id, phase) of a maintenance pass: Skip (n commits at most), Deferred (text, several heads or a conflict, or no quorum), Checkpoint (to be published), Reclaim. n = 0 does nothing."""
    size = commits.groupBy(*KEY).agg(F.count("*").alias("commits"))
    heads = dag.heads(commits).groupBy(*KEY).agg(F.count("*").alias("heads"))
    met = size.join(heads, KEY, "left").join(kinds.select(*KEY, "kind"), KEY, "left").join(conflicts.select(*KEY, F.lit(True).alias("conflict")).distinct(), KEY, "left")
    met = met.join(checkpoints.select(*KEY, F.lit(True).alias("checkpoint")), KEY, "left").join(quorums.select(*KEY, "quorum"), KEY, "left")
    blocked = (F.col("heads") != 1) | F.col("conflict").isNotNull() | (F.coalesce("kind", F.lit("Binary")) == "Text")
    phase = F.when((F.lit(n) == 0) | (F.col("commits") <= n), "Skip").when(blocked, "Deferred").when(F.col("checkpoint").isNull(), "Checkpoint").when(F.coalesce("quorum", F.lit(False)), "Reclaim").otherwise("Deferred")
    return met.select(*KEY, phase.alias("phase"))
