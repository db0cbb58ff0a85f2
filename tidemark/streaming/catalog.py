"""Ingestion of catalog segments as a stream: each commit once, cursors as state, progress as events."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.session import remove, stored

SCHEMA = "client_id long, scope_id string, counter long, commit_id long, resource_id long"


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The stream of segment files below a folder; files are immutable and may come in any order."""
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Takes up what is new, and ends. A commit that comes again, in this run or a later one, is written once: the state that knows the ids is in the checkpoint. There is no watermark: late events are never dropped."""
    new = segments(spark, path).dropDuplicates(["commit_id"])
    new.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def _latest(spark: SparkSession, out: str) -> str | None:
    """The newest complete table below out; names begin with the batch's number."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    done = [n for n in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS"))]
    return f"{out}/{max(done)}" if done else None


def cursors_of(spark: SparkSession, path: str, out: str, checkpoint: str) -> DataFrame:
    """The greatest counter of each client and scope. Each batch's changed cursors are merged with the newest table before into a new one; as the greatest counter counts, a batch that is run again changes nothing."""
    schema = "client_id long, scope_id string, counter long"
    changed = segments(spark, path).groupBy("client_id", "scope_id").agg(F.max("counter").alias("counter"))

    def merge(batch: DataFrame, number: int) -> None:
        before = _latest(batch.sparkSession, out)
        rows = batch if before is None else batch.unionByName(batch.sparkSession.read.schema(schema).parquet(before))
        stored(rows.groupBy("client_id", "scope_id").agg(F.max("counter").alias("counter")), f"{out}/{number:012d}-{uuid.uuid4().hex}")
        if before is not None:
            remove(batch.sparkSession, before)

    changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start().awaitTermination()
    at = _latest(spark, out)
    return spark.read.schema(schema).parquet(at) if at else spark.createDataFrame([], schema)


class ProgressEvents(StreamingQueryListener):
    """Keeps an engine event (run, stage, detail as JSON) for each start, progress and end of a stream."""

    def __init__(self):
        self.events: list[dict] = []

    def _add(self, run, stage: str, **detail) -> None:
        self.events.append({"run_id": str(run), "stage": stage, "detail_json": json.dumps(detail)})

    def onQueryStarted(self, event) -> None:
        self._add(event.runId, "run.start")

    def onQueryProgress(self, event) -> None:
        self._add(event.progress.runId, "remote.scan.complete", rows=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add(event.runId, "error" if event.exception else "run.complete", exception=event.exception)
