"""The linear log of a file: forks, as-of reads, folds, cuts. log: (file_id, sequence, client_id, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("Manual", "KeepLocal", "KeepRemote", "KeepBoth")


def forked_sequences(log: DataFrame) -> DataFrame:
    """(file_id, sequence, clients) that several clients hold."""
    return log.groupBy("file_id", "sequence").agg(F.count_distinct("client_id").alias("clients")).where("clients > 1")


def forked_by_neighbours(log: DataFrame) -> DataFrame:
    """As forked_sequences (without the number), by comparing neighbours in (sequence, client) order."""
    order = Window.partitionBy("file_id").orderBy("sequence", "client_id")
    met = log.select("file_id", "sequence", "client_id", F.lag("sequence").over(order).alias("s"), F.lag("client_id").over(order).alias("c"))
    return met.where("s = sequence AND c != client_id").select("file_id", "sequence").distinct()


def tips(log: DataFrame) -> DataFrame:
    """(file_id, head, entries, forked): the greatest sequence, and how many entries it has."""
    out = log.groupBy("file_id", "sequence").agg(F.count("*").alias("n")).groupBy("file_id").agg(F.max(F.struct("sequence", "n")).alias("x"))
    return out.select("file_id", F.col("x.sequence").alias("head"), F.col("x.n").alias("entries"), (F.col("x.n") > 1).alias("forked"))


def as_of(log: DataFrame, at: int, *value: str) -> DataFrame:
    """Each file's last state up to a sequence; of clients at one sequence the first counts."""
    row = F.struct("sequence", "client_id", *value)
    return log.where(F.col("sequence") <= at).groupBy("file_id", "sequence").agg(F.min(row).alias("row")).groupBy("file_id").agg(F.max("row").alias("row")).select("file_id", "row.*")


def between(log: DataFrame, after: int, to: int) -> DataFrame:
    return log.where((F.col("sequence") > after) & (F.col("sequence") <= to))


def low_watermark(status: DataFrame) -> DataFrame:
    """(watermark): the least sequence that any client has reached; null without clients."""
    return status.agg(F.min("last_sequence").alias("watermark"))


def truncation_cuts(log: DataFrame, status: DataFrame, keep: int) -> DataFrame:
    """(file_id, latest, cut, deferred): entries up to cut can go; the last keep entries and what a client hasn't reached stay."""
    latest = log.groupBy("file_id").agg(F.max("sequence").alias("latest"))
    met = latest.crossJoin(F.broadcast(low_watermark(status)))  # one row
    cut = F.least(F.greatest(F.col("latest") - keep, F.lit(0)), F.coalesce("watermark", "latest"))
    return met.select("file_id", "latest", cut.alias("cut"), (cut == 0).alias("deferred"))


def truncation_report(cuts: DataFrame, log: DataFrame) -> DataFrame:
    """One row over the distinct files: files, deferred, entries_deleted."""
    gone = log.join(cuts, "file_id").where("sequence <= cut").agg(F.count("*").alias("entries_deleted"))
    return cuts.agg(F.count_distinct("file_id").alias("files"), F.count_if("deferred").alias("deferred")).crossJoin(gone)


def cached(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """listing with the cached bytes; entries of forked sequences never come from the cache."""
    met = listing.join(cache.select("file_id", "sequence", "bytes"), ["file_id", "sequence"], "left")
    forked = forked_sequences(listing).select("file_id", "sequence", F.lit(True).alias("fork"))
    return met.join(forked, ["file_id", "sequence"], "left").withColumn("bytes", F.when(F.col("fork").isNull(), F.col("bytes"))).drop("fork")


def merge_manifests(base: Column, local: Column, remote: Column, policy: str = "Manual") -> Column:
    """struct<outcome, resolved, needs_copy> of manifests (arrays, or any values that compare)."""
    if policy not in POLICIES:
        raise ValueError(policy)
    here, there = local != base, remote != base
    clash = here & there & (local != remote)
    outcome = F.when(clash, "NeedsResolution" if policy == "Manual" else "Conflict").when(here & there | ~here & ~there, "Unchanged").otherwise("FastForward")
    chosen = {"Manual": F.lit(None), "KeepLocal": local, "KeepRemote": remote, "KeepBoth": local}[policy]
    return F.struct(outcome.alias("outcome"), F.when(clash, chosen).when(here, local).otherwise(remote).alias("resolved"), (clash & F.lit(policy == "KeepBoth")).alias("needs_copy"))


def fold_manifests(log: DataFrame, policy: str = "KeepLocal") -> DataFrame:
    """(file_id, head, manifest, deleted, conflicted) from a log with a column manifest (string; null: deleted).

    Entries are folded in order of sequence. At a fork the clients' states are merged in order of client, each with what the ones before gave; a deletion against a present state goes to the policy; a state that equals the one before the fork gives way. conflicted says whether the policy had to decide; with Manual such a file needs a resolution.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    sides = log.groupBy("file_id", "sequence").agg(F.array_sort(F.collect_list(F.struct("client_id", "manifest"))).alias("sides"))
    steps = sides.groupBy("file_id").agg(F.max("sequence").alias("head"), F.array_sort(F.collect_list(F.struct("sequence", "sides"))).alias("steps"))

    def merge(before: Column, acc: Column, s: Column) -> Column:
        left, right = acc["m"], s["manifest"]
        same = left.eqNullSafe(right)
        gone = left.isNull() | right.isNull()
        clash = ~same & (gone | ~left.eqNullSafe(before) & ~right.eqNullSafe(before))
        chosen = right if policy == "KeepRemote" else left
        m = F.when(same, left).when(gone, chosen).when(left.eqNullSafe(before), right).when(right.eqNullSafe(before), left).otherwise(chosen)
        return F.struct(m.alias("m"), (acc["c"] | clash).alias("c"))

    start = F.struct(F.lit(None).cast("string").alias("m"), F.lit(False).alias("c"))

    def step(acc: Column, x: Column) -> Column:
        first = F.struct(x["sides"][0]["manifest"].alias("m"), acc["c"].alias("c"))
        rest = F.slice(x["sides"], 2, F.greatest(F.size(x["sides"]) - 1, F.lit(0)))
        return F.aggregate(rest, first, lambda a, s: merge(acc["m"], a, s))

    done = steps.withColumn("r", F.aggregate("steps", start, step))
    return done.select("file_id", "head", F.col("r.m").alias("manifest"), F.col("r.m").isNull().alias("deleted"), F.col("r.c").alias("conflicted"))


def convergence(log: DataFrame, policy: str = "KeepLocal") -> DataFrame:
    """(file_id, sequence, manifest): the entry at head + 1 that republishes the merged state of each file whose tip is forked."""
    return fold_manifests(log, policy).join(tips(log).where("forked").select("file_id"), "file_id", "left_semi").select("file_id", (F.col("head") + 1).alias("sequence"), "manifest")


def free_slots(entries: DataFrame, log: DataFrame) -> DataFrame:
    """Entries whose sequence nobody holds yet: what a compare-and-set append may write."""
    return entries.join(log.select("file_id", "sequence"), ["file_id", "sequence"], "left_anti")
