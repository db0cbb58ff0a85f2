"""The local side: resources with version tokens, and conditional writes. A host may bring its own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import planner
from tidemark.sources.tables import Table

KEY = ["scope_id", "resource_id"]
RESOURCES = "scope_id string, resource_id string, kind string, data binary, version_token string"


class Replica(Protocol):
    def list_resources(self) -> DataFrame:
        """(scope_id, resource_id, kind, content_id, size, version_token); a null content_id is found by hashing."""

    def read_resources(self, keys: DataFrame) -> DataFrame:
        """(scope_id, resource_id, data, version_token)"""

    def apply_mutations(self, mutations: DataFrame) -> DataFrame:
        """mutations (scope_id, resource_id, kind, data, expected); null data deletes. Returns them with a status."""


class MergePolicy(Protocol):
    """Merges texts, and ranks resources; must give the same result each time."""

    def merge_text(self, key: tuple[str, str], base: str | None, local: str, remote: str) -> tuple[str, str | None]:
        """("NotHandled", None), ("Merged", text) or ("Conflict", reason)"""

    def resource_priority(self, key: tuple[str, str]) -> int: ...


EventListener = Callable[[list[dict]], None]


class TableReplica:
    """A replica in a versioned table."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.table = spark, Table(spark, uri, RESOURCES)

    def list_resources(self) -> DataFrame:
        return self.table.read().select(*KEY, "kind", F.lit(None).cast("string").alias("content_id"), F.octet_length("data").cast("long").alias("size"), "version_token")

    def read_resources(self, keys: DataFrame) -> DataFrame:
        return self.table.read().join(keys.select(*KEY), KEY, "left_semi").select(*KEY, "data", "version_token")

    def write(self, rows: DataFrame) -> None:
        """rows (scope_id, resource_id, kind, data) without conditions; null data deletes."""
        rows = rows.select(*KEY, "kind", F.col("data").cast("binary").alias("data"))
        token = F.sha2(F.concat(F.coalesce("data", F.lit(b"")), F.lit(self.table.version()).cast("string").cast("binary")), 256)
        new = rows.where("data IS NOT NULL").withColumn("version_token", F.substring(token, 1, 16))
        self.table.replace(lambda now: now.join(rows.select(*KEY), KEY, "left_anti").unionByName(new))

    def apply_mutations(self, mutations: DataFrame) -> DataFrame:
        judged = self.spark.createDataFrame(planner.apply_preconditions(mutations, self.table.read()).collect(), "scope_id string, resource_id string, kind string, data binary, expected string, status string")
        self.write(judged.where("status = 'Applied'"))
        return judged
