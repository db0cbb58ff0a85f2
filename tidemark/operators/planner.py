"""The three-way planner and what follows from a plan: reports, conflicts, acknowledgements, conditional writes.

Inventories have a row for each resource key: local (state, content_id, version_token), base (state, content_id, local_version), remote (state, content_id, heads). A key that an inventory lacks is Missing there, or has no baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dag import KEY


def operation() -> Column:
    """Operation, or Conflict: and its kind, from local_, base_ and remote_ columns; base_state is null without a baseline. The sixteen arms are tried from top to bottom; null content ids equal nothing."""
    here = F.col("local_state") == "Present"
    remote, base = F.col("remote_state"), F.coalesce("base_state", F.lit("None"))
    local_is_base, remote_is_base = (base == "Present") & (F.col("local_id") == F.col("base_id")), (base == "Present") & (F.col("remote_id") == F.col("base_id"))
    both = here & (remote == "Present")
    fetch, dead = ~here & (remote == "Present"), here & (remote == "Deleted")
    return (
        F.when(remote == "Forked", "Conflict:RemoteFork")
        .when(both & (F.col("local_id") == F.col("remote_id")), "EstablishBaseline")
        .when(here & (remote == "Missing"), "Upload")
        .when(fetch & base.isin("None", "Deleted"), "Download")
        .when(both & (base == "None"), "Conflict:InitialDivergence")
        .when(both & local_is_base, "Download")
        .when(both & remote_is_base, "Upload")
        .when(both, "Conflict:ContentVsContent")
        .when(fetch & remote_is_base, "PublishDelete")
        .when(fetch, "Conflict:DeleteVsModify")
        .when(dead & local_is_base, "ApplyDelete")
        .when(dead & (base == "Deleted"), "Upload")
        .when(dead, "Conflict:ModifyVsDelete")
        .when(remote == "Deleted", "EstablishDeletedBaseline")
        .otherwise("Noop")
    )


def side(df: DataFrame, name: str, *more: str) -> DataFrame:
    """An inventory's columns under a side's name."""
    return df.select(*KEY, F.col("state").alias(f"{name}_state"), F.col("content_id").alias(f"{name}_id"), *more)


def plan_inventory(local: DataFrame, base: DataFrame, remote: DataFrame) -> DataFrame:
    """(scope_id, resource_id, operation, conflict_kind, local_id, base_id, remote_id, heads) for the union of the keys; conflict_kind is null but for operation Conflict."""
    heads = F.col("heads") if "heads" in remote.columns else F.lit(None).cast("array<string>")
    met = side(local, "local").join(side(base, "base"), KEY, "full").join(side(remote.withColumn("heads", heads), "remote", "heads"), KEY, "full")
    met = met.fillna("Missing", ["local_state", "remote_state"]).withColumn("op", operation())
    return met.select(*KEY, F.substring_index("op", ":", 1).alias("operation"), F.when(F.col("op").startswith("Conflict"), F.substring_index("op", ":", -1)).alias("conflict_kind"), "local_id", "base_id", "remote_id", "heads")


def merge_texts(plan: DataFrame, kinds: DataFrame) -> DataFrame:
    """Texts merge by themselves: a content conflict of a resource of kind Text becomes an upload. kinds: (scope_id, resource_id, kind)."""
    met = plan.join(kinds.select(*KEY, F.col("kind").alias("_kind")), KEY, "left")
    text = (F.col("conflict_kind") == "ContentVsContent") & (F.col("_kind") == "Text")
    out = met.withColumn("operation", F.when(text, "Upload").otherwise(F.col("operation"))).withColumn("conflict_kind", F.when(~F.coalesce(text, F.lit(False)), F.col("conflict_kind")))
    return out.select(plan.columns)


def in_order(plan: DataFrame, priority: Column | None = None) -> DataFrame:
    """By key; with priorities by scope, priority, resource."""
    return plan.orderBy("scope_id", *([priority] if priority is not None else []), "resource_id")


def lazy_inventory(local: DataFrame, base: DataFrame, content: DataFrame) -> DataFrame:
    """(scope_id, resource_id, content_id, source): local rows without a content id take the baseline's if the version token is still the same; only the others' bytes are read and hashed. content: (scope_id, resource_id, data). source: inventory, baseline, hashed, or missing (no bytes found: an error)."""
    own = base.where("state = 'Present'").select(*KEY, F.col("local_version").alias("version_token"), F.col("content_id").alias("base_id"))
    met = local.join(own, [*KEY, "version_token"], "left").select(*KEY, "content_id", "base_id")
    known = met.where("content_id IS NOT NULL OR base_id IS NOT NULL").select(*KEY, F.coalesce("content_id", "base_id").alias("content_id"), F.when(F.col("content_id").isNotNull(), "inventory").otherwise("baseline").alias("source"))
    open_ = met.where("content_id IS NULL AND base_id IS NULL").select(*KEY).join(content.select(*KEY, "data"), KEY, "left")
    return known.unionByName(open_.select(*KEY, F.sha2("data", 256).alias("content_id"), F.when(F.col("data").isNull(), "missing").otherwise("hashed").alias("source")))


def run_counts(plan: DataFrame, failed: DataFrame) -> DataFrame:
    """One row of counts. failed: keys whose operation didn't succeed."""
    met = plan.join(failed.select(*KEY, F.lit(True).alias("failed")), KEY, "left").withColumn("ok", F.col("failed").isNull())
    op = F.col("operation")
    n = lambda *ops: F.count_if(op.isin(*ops) & F.col("ok"))
    return met.agg(
        n("Upload").alias("uploaded"), n("Download").alias("downloaded"), n("ApplyDelete").alias("deleted_local"), n("PublishDelete").alias("deleted_remote"),
        n("EstablishBaseline", "EstablishDeletedBaseline", "Noop").alias("unchanged"), F.count_if(op == "Conflict").alias("conflicts"), F.count_if(~F.col("ok") & (op != "Conflict")).alias("failures"),
    )


def scope_reports(requested: DataFrame, plan: DataFrame, failed: DataFrame) -> DataFrame:
    """(scope_id, status, conflicts, failures) for each requested scope, those without rows too."""
    conflicts = plan.where("operation = 'Conflict'").groupBy("scope_id").agg(F.count("*").alias("conflicts"))
    failures = failed.groupBy("scope_id").agg(F.count("*").alias("failures"))
    met = requested.select("scope_id").distinct().join(conflicts, "scope_id", "left").join(failures, "scope_id", "left").fillna(0)
    return met.select("scope_id", F.when(F.col("failures") > 0, "Failed").when(F.col("conflicts") > 0, "Partial").otherwise("Complete").alias("status"), "conflicts", "failures")


def conflict_records(plan: DataFrame) -> DataFrame:
    """(conflict_id, scope_id, resource_id, kind): the id depends on what conflicts, not on when."""
    text = F.concat_ws("|", "scope_id", F.col("resource_id").cast("string"), "conflict_kind", F.coalesce("local_id", F.lit("-")), F.coalesce("remote_id", F.lit("-")), F.array_join(F.transform(F.coalesce(F.col("heads").cast("array<string>"), F.array().cast("array<string>")), lambda h: h), ","))
    return plan.where("operation = 'Conflict'").select(F.sha2(text, 256).alias("conflict_id"), *KEY, F.col("conflict_kind").alias("kind"))


def replace_conflicts(old: DataFrame, new: DataFrame, scopes: list[str]) -> DataFrame:
    """Old conflicts outside the run's scopes (none: all scopes are in it), and the run's own."""
    return (old.where(~F.col("scope_id").isin(scopes)).unionByName(new) if scopes else new)


def conflicts_in(conflicts: DataFrame, scope: str | None = None) -> DataFrame:
    return conflicts if scope is None else conflicts.where(F.col("scope_id") == scope)


def acknowledgements(plan: DataFrame, client: str, failed: DataFrame) -> DataFrame:
    """(client_id, scope_id, resource_id, observed_heads) for what was applied; not for conflicts and failures."""
    return plan.where("operation != 'Conflict'").join(failed, KEY, "left_anti").select(F.lit(client).alias("client_id"), *KEY, F.coalesce("heads", F.array()).alias("observed_heads"))


def apply_preconditions(mutations: DataFrame, local: DataFrame) -> DataFrame:
    """mutations (scope_id, resource_id, expected) with a status: Applied if the resource still has the expected version token (null: doesn't exist), else PreconditionFailed."""
    met = mutations.join(local.select(*KEY, "version_token", F.lit(True).alias("there")), KEY, "left")
    ok = F.when(F.col("expected").isNull(), F.col("there").isNull()).otherwise(F.coalesce(F.col("version_token") == F.col("expected"), F.lit(False)))
    return met.withColumn("status", F.when(ok, "Applied").otherwise("PreconditionFailed")).select(*mutations.columns, "status")


def in_scopes(df: DataFrame, scopes: list[str]) -> DataFrame:
    """No scopes means all."""
    return df.where(F.col("scope_id").isin(scopes)) if scopes else df
