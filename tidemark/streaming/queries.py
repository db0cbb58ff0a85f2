"""Streaming ingestion of the catalog, as bounded queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import fixtures as fx
from tidemark.session import stored, work_dir
from tidemark.streaming import catalog


def streaming_catalog(spark, sf):
    """The catalog's segment files, taken up by a stream in two runs that overlap; equal to the batch's result."""
    work = work_dir(spark, "stream")
    segments = fx.segments(spark, sf)
    stored(segments.where("counter <= 20"), f"{work}/in/a")
    catalog.ingest(spark, f"{work}/in", f"{work}/out", f"{work}/checkpoint")
    stored(segments.where("counter > 10"), f"{work}/in/b")
    catalog.ingest(spark, f"{work}/in", f"{work}/out", f"{work}/checkpoint")
    return spark.read.schema(catalog.SCHEMA).parquet(f"{work}/out")


def streaming_cursors(spark, sf):
    """The cursors that a stream's state holds after all segments."""
    work = work_dir(spark, "cursors")
    stored(fx.segments(spark, sf), f"{work}/in/a")
    return catalog.cursors_of(spark, f"{work}/in", f"{work}/out", f"{work}/checkpoint").select("client_id", "scope_id", F.col("counter").alias("counter"))


QUERIES = {f.__name__: f for f in (streaming_catalog, streaming_cursors)}
ORACLE_SQL = {"streaming_catalog": fx.oracle("SELECT * FROM seg"), "streaming_cursors": fx.oracle("SELECT client_id, scope_id, max(counter) AS counter FROM seg GROUP BY ALL")}
