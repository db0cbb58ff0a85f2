"""The commit graph of each resource: heads, states, forks, ancestry. commits: (id, scope_id, resource_id, parents, author, counter, millis, change_type, content_id, size)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored, work_dir

KEY = ["scope_id", "resource_id"]


def heads(commits: DataFrame) -> DataFrame:
    """Commits that no commit of their resource has as a parent."""
    parents = commits.select(*KEY, F.explode("parents").alias("id")).distinct()
    return commits.join(parents, [*KEY, "id"], "left_anti")


def first_head(commits: DataFrame) -> DataFrame:
    return heads(commits).groupBy(*KEY).agg(F.min("id").alias("id"))


def remote_state(commits: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(scope_id, resource_id, state, content_id, size, heads) per resource. texts: (scope_id, resource_id, text) of merged text resources, needed where all heads are text changes."""
    kind = F.col("change_type")
    all_of = lambda k: F.every(kind == k)
    value = F.struct("content_id", "size")
    out = heads(commits).groupBy(*KEY).agg(
        F.when(all_of("Delete"), "Deleted").when(all_of("TextDelta"), "Text").when(all_of("BinarySnapshot") & (F.min(value) == F.max(value)), "Present").otherwise("Forked").alias("state"),
        F.min("content_id").alias("content_id"),
        F.min("size").alias("size"),
        F.array_sort(F.collect_list("id")).alias("heads"),
    )
    known = F.col("state") == "Present"
    out = out.select(*KEY, "state", F.when(known, F.col("content_id")).alias("content_id"), F.when(known, F.col("size")).alias("size"), "heads")
    if texts is None:
        return out.withColumn("state", F.when(F.col("state") == "Text", "Present").otherwise(F.col("state")))
    text = F.col("state") == "Text"
    met = out.join(texts.select(*KEY, "text"), KEY, "left")
    return met.select(*KEY, F.when(text, "Present").otherwise(F.col("state")).alias("state"), F.when(text, F.sha2("text", 256)).otherwise(F.col("content_id")).alias("content_id"), F.when(text, F.octet_length("text").cast("long")).otherwise(F.col("size")).alias("size"), "heads")


def forks(commits: DataFrame) -> DataFrame:
    """(scope_id, resource_id, head_count, heads) of resources with several heads."""
    return heads(commits).groupBy(*KEY).agg(F.count("*").alias("head_count"), F.array_sort(F.collect_list("id")).alias("heads")).where("head_count > 1")


def reachable(parents: dict, start) -> set:
    """start and all its ancestors."""
    seen, stack = {start}, [start]
    while stack:
        for p in parents.get(stack.pop(), ()):
            if p not in seen:
                seen.add(p)
                stack.append(p)
    return seen


def ancestors(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """(resource_id, start, ancestor), start itself included, for starts (resource_id, start). A parent lies in its commit's resource, so that each resource is searched by itself."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        graph = dict(zip(left.column("id").to_pylist(), left.column("parents").to_pylist()))
        rows = [(s, a) for s in dict.fromkeys(right.column("start").to_pylist()) if s in graph for a in reachable(graph, s)]
        resource, kind = left.column("resource_id"), left.schema.field("id").type
        same = pa.array([resource[0].as_py()] * len(rows) if rows else [], resource.type)
        return pa.table({"resource_id": same, "start": pa.array([r[0] for r in rows], kind), "ancestor": pa.array([r[1] for r in rows], kind)})

    graph = commits.select("resource_id", "id", "parents").groupBy("resource_id")
    of = lambda c: commits.schema[c].dataType.simpleString()
    return graph.cogroup(starts.select(F.col("resource_id").alias("r"), "start").groupBy("r")).applyInArrow(run, f"resource_id {of('resource_id')}, start {of('id')}, ancestor {of('id')}")


def ancestors_by_doubling(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """As ancestors, by joins alone: for a resource too large for one worker. Each turn doubles the length of the paths; every turn is a written table."""
    work = work_dir(commits.sparkSession, "closure")
    step = commits.select("resource_id", F.col("id").alias("b"), F.explode("parents").alias("c"))
    step = stored(step.union(commits.select("resource_id", "id", "id")).distinct(), f"{work}/0")
    size, turn = step.count(), 0
    while True:
        turn += 1
        step = stored(step.select("resource_id", F.col("b").alias("a"), F.col("c").alias("b")).join(step, ["resource_id", "b"]).select("resource_id", F.col("a").alias("b"), "c").distinct(), f"{work}/{turn}")
        if (now := step.count()) == size:
            break
        size = now
    return starts.select("resource_id", "start").distinct().join(step.withColumnRenamed("b", "start"), ["resource_id", "start"]).select("resource_id", "start", F.col("c").alias("ancestor"))


def is_descendant(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (resource_id, commit, ancestor) with a column descendant; a commit descends from itself."""
    found = ancestors(commits, pairs.select("resource_id", F.col("commit").alias("start")))
    met = found.select("resource_id", F.col("start").alias("commit"), "ancestor", F.lit(True).alias("descendant"))
    return pairs.join(met, ["resource_id", "commit", "ancestor"], "left").withColumn("descendant", F.coalesce("descendant", F.lit(False)))


def history(commits: DataFrame) -> DataFrame:
    """(scope_id, resource_id, id, author, millis, deleted) of every version; in a resource's history they go by millis, then id."""
    return commits.select(*KEY, "id", "author", "millis", (F.col("change_type") == "Delete").alias("deleted"))
