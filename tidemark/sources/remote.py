"""The remote storage: commits, packs, catalog and acknowledgements as versioned tables."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import CorruptError, IoError
from tidemark.operators import catalog, packs
from tidemark.sources.tables import Folder, Table

KEY = "scope_id string, resource_id string"
COMMITS = f"id string, {KEY}, parents array<string>, author string, counter long, millis long, change_type string, content_id string, size long, chunk_hashes array<string>, delta binary"
EVENTS = "client_id string, scope_id string, counter long, commit_id string, resource_id string"
CURSORS = "client_id string, scope_id string, counter long"
PACKS = "pack_id string, data binary"
INDEX = "pack_id string, hash string, offset long, length long"
ACKS = f"client_id string, {KEY}, observed_heads array<string>, pinned_commits array<string>, seq long"
SNAPSHOT_EVENTS = f"generation long, {EVENTS}"
SNAPSHOT_CURSORS = f"generation long, {CURSORS}"


class Remote(Protocol):
    """What the engine needs of a remote; a host may bring its own."""

    def scan_catalog(self, cursors: DataFrame, scopes: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]: ...
    def load_commits(self, ids: DataFrame) -> DataFrame: ...
    def commit_batch(self, commits: DataFrame, new_packs: DataFrame | None, index: DataFrame | None) -> None: ...
    def lookup_chunks(self, hashes: DataFrame) -> DataFrame: ...
    def read_ranges(self, where: DataFrame) -> DataFrame: ...
    def write_acknowledgements(self, acks: DataFrame) -> None: ...
    def list_acknowledgements(self, keys: DataFrame | None = None) -> DataFrame: ...
    def list_pack_ids(self) -> DataFrame: ...
    def delete_packs(self, ids: DataFrame) -> None: ...
    def compact_catalog(self, generation: int, scope: str, events: DataFrame, cursors: DataFrame, obsolete: DataFrame | None) -> None: ...


class FolderRemote:
    """A remote in a folder that all clients share."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.folder = spark, Folder(spark, uri)
        t = lambda name, schema: Table(spark, f"{self.folder.uri}/{name}", schema)
        self.commits, self.events, self.packs, self.index = t("commits", COMMITS), t("catalog", EVENTS), t("packs", PACKS), t("pack-indexes", INDEX)
        self.acks, self.snapshots, self.snapshot_cursors = t("acknowledgements", ACKS), t("snapshots", SNAPSHOT_EVENTS), t("snapshot-cursors", SNAPSHOT_CURSORS)

    def scan_catalog(self, cursors: DataFrame, scopes: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(new events, next cursors, the snapshots' coverage)."""
        coverage = catalog.latest_generation(self.snapshot_cursors.read()).drop("generation")
        snapshot = catalog.latest_generation(self.snapshots.read()).drop("generation")
        events = catalog.catalog_delta(snapshot, self.events.read(), cursors, coverage, scopes)
        seen = catalog.in_scopes(coverage, scopes)
        return events, catalog.next_cursors(cursors.limit(0), events, seen), coverage

    def load_commits(self, ids: DataFrame) -> DataFrame:
        """The commits of ids (commit_id); one that is missing is an error."""
        wanted = ids.select(F.col("commit_id").alias("id")).distinct()
        out = self.commits.read().join(wanted, "id", "left_semi")
        lost = wanted.join(self.commits.read().select("id"), "id", "left_anti").limit(1).collect()
        if lost:
            raise IoError(f"missing commit {lost[0].id}")
        return out

    def commit_batch(self, commits: DataFrame, new_packs: DataFrame | None = None, index: DataFrame | None = None) -> None:
        """Packs, then their index, then commits; the catalog's events come last: until then nobody sees the batch."""
        if new_packs is not None:
            self.packs.append_new(new_packs, ["pack_id"])
            self.index.append_new(index, ["pack_id", "hash", "offset"])
        self.commits.append_new(commits, ["id"])
        self.events.append_new(catalog.events_of(commits), ["commit_id"])

    def lookup_chunks(self, hashes: DataFrame) -> DataFrame:
        return packs.locations(self.index.read(), hashes)

    def read_ranges(self, where: DataFrame) -> DataFrame:
        """(hash, bytes); bytes that don't hash to their name are an error."""
        out = packs.read_ranges(where, self.packs.read())
        bad = out.where("NOT intact").limit(1).collect()
        if bad:
            raise CorruptError(bad[0]["hash"])
        return out.select("hash", "bytes")

    def write_acknowledgements(self, acks: DataFrame) -> None:
        """acks without seq: the last written counts."""
        pinned = F.col("pinned_commits") if "pinned_commits" in acks.columns else F.array().cast("array<string>")
        self.acks.compare_and_append(lambda now: acks.withColumn("pinned_commits", pinned).crossJoin(now.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))))

    def list_acknowledgements(self, keys: DataFrame | None = None) -> DataFrame:
        out = catalog.latest_acks(self.acks.read())
        return out if keys is None else out.join(keys.select("scope_id", "resource_id"), ["scope_id", "resource_id"], "left_semi")

    def list_pack_ids(self) -> DataFrame:
        return self.index.read().select("pack_id").distinct()

    def delete_packs(self, ids: DataFrame) -> None:
        """First the index, so that nobody is sent to a pack that is gone."""
        ids = self.spark.createDataFrame(ids.collect(), "pack_id string")
        for t in (self.index, self.packs):
            t.replace(lambda now: now.join(ids, "pack_id", "left_anti"))

    def compact_catalog(self, generation: int, scope: str, events: DataFrame, cursors: DataFrame, obsolete: DataFrame | None = None) -> None:
        """The snapshot of a scope under a new generation, then its segments' covered events and the obsolete commits go."""
        self.snapshots.append(events.withColumn("generation", F.lit(generation).cast("long")))
        self.snapshot_cursors.append(cursors.withColumn("generation", F.lit(generation).cast("long")))
        old = lambda now: now.where((F.col("scope_id") != scope) | (F.col("generation") == generation))
        self.snapshots.replace(old)
        self.snapshot_cursors.replace(old)
        covered = self.snapshot_cursors.read().select("client_id", "scope_id", F.col("counter").alias("covered"))
        mine = covered.where(F.col("scope_id") == scope)
        self.events.replace(lambda now: now.join(mine, ["client_id", "scope_id"], "left").where("covered IS NULL OR counter > covered").drop("covered"))
        if obsolete is not None:
            self.commits.replace(lambda now: now.join(obsolete.select("id"), "id", "left_anti"))

    def vacuum(self, keep: int = 10) -> int:
        return sum(t.vacuum(keep) for t in (self.commits, self.events, self.packs, self.index, self.acks, self.snapshots, self.snapshot_cursors))

    def files(self) -> list[str]:
        return self.folder.walk()
