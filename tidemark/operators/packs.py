"""Chunks and packs. pack_index: (pack_id, hash, offset, length)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import tune

#: Bytes at which a pack is sealed; share of dead bytes from which it is rewritten (in percent).
PACK_SIZE, REPACK_PERCENT = 4 << 20, 50


def first_occurrences(chunks: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Of chunks with equal by columns the first in order."""
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def greedy_packs(chunks: DataFrame, size: int = PACK_SIZE) -> DataFrame:
    """(group_id, position, hash, length, pack): chunks (group_id string, position long, hash, length) in order go to the open pack, which is sealed once it holds size bytes. Equal hashes of a group are packed once. The fold streams over the sorted partition and keeps one counter."""

    def run(batches):
        now, pack, held = None, 0, 0
        for b in batches:
            out = []
            for g, n in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if g != now:
                    now, pack, held = g, 0, 0
                out.append(pack)
                held += n
                if held >= size:
                    pack, held = pack + 1, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=["group_id", "position", "hash", "length", "pack"])

    tune(chunks.sparkSession)
    once = first_occurrences(chunks, ["position"], ["group_id", "hash"]).select("group_id", F.col("position").cast("long").alias("position"), "hash", F.col("length").cast("long").alias("length"))
    return once.repartition("group_id").sortWithinPartitions("group_id", "position").mapInArrow(run, "group_id string, position long, hash string, length long, pack long")


def with_offsets(packed: DataFrame, pack: list[str], order: list[str]) -> DataFrame:
    """Each chunk's offset in its pack: the lengths before it."""
    before = Window.partitionBy(*pack).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return packed.withColumn("offset", F.sum("length").over(before) - F.col("length"))


def locations(index: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(hash, pack_id, offset, length): one place for each hash, in the least pack."""
    rows = index if hashes is None else index.join(hashes.select("hash").distinct(), "hash", "left_semi")
    return rows.groupBy("hash").agg(F.min(F.struct("pack_id", "offset", "length")).alias("x")).select("hash", "x.*")


def new_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks that no pack holds."""
    return chunks.join(index.select("hash"), "hash", "left_anti")


def read_ranges(where: DataFrame, packs: DataFrame) -> DataFrame:
    """(hash, bytes, intact) from places (hash, pack_id, offset, length) and packs (pack_id, data)."""
    met = where.join(packs.select("pack_id", "data"), "pack_id", "left")
    met = met.withColumn("bytes", F.expr("substring(data, cast(offset + 1 AS int), cast(length AS int))"))
    return met.select("hash", "bytes", F.coalesce(F.sha2("bytes", 256) == F.col("hash"), F.lit(False)).alias("intact"))


def reassemble(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """(resource_id, data, n_chunks, ok) from manifest (resource_id, position, hash) and chunks (hash, bytes): order and repeated chunks kept. ok is false if a chunk is missing or doesn't hash to its name; data is null then."""
    met = manifest.join(chunks.select("hash", "bytes"), "hash", "left")
    met = met.withColumn("fine", F.coalesce(F.sha2("bytes", 256) == F.col("hash"), F.lit(False)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "bytes"))), lambda x: x["bytes"])
    out = met.groupBy("resource_id").agg(parts.alias("parts"), F.count("*").alias("n_chunks"), F.every("fine").alias("ok"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return out.select("resource_id", F.when(F.col("ok"), joined).alias("data"), "n_chunks", "ok")


def ranges_by_pack(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """(pack_id, ranges, bytes) of a download."""
    hashes = manifest.select("hash").distinct()
    return locations(index, hashes).groupBy("pack_id").agg(F.count("*").alias("ranges"), F.sum("length").alias("bytes"))


def upload_totals(chunks: DataFrame, packed: DataFrame) -> DataFrame:
    """One row: resources, packs, bytes, chunks."""
    a = chunks.agg(F.count_distinct("resource_id").alias("resources"))
    b = packed.agg(F.count_distinct("group_id", "pack").alias("packs"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("chunks"))
    return a.crossJoin(b)


def live_hashes(manifests: DataFrame) -> DataFrame:
    return manifests.select("hash").distinct()


def classify(index: DataFrame, live: DataFrame) -> DataFrame:
    """(pack_id, live_bytes, dead_bytes, action): Keep, Delete, Repack or KeepMixed."""
    met = index.join(live.select("hash", F.lit(True).alias("live")).distinct(), "hash", "left")
    alive = F.col("live").isNotNull()
    zero = F.lit(0)
    sums = met.groupBy("pack_id").agg(F.sum(F.when(alive, F.col("length")).otherwise(zero)).alias("live_bytes"), F.sum(F.when(~alive, F.col("length")).otherwise(zero)).alias("dead_bytes"))
    dead, all_ = F.col("dead_bytes"), F.col("dead_bytes") + F.col("live_bytes")
    return sums.withColumn("action", F.when(dead == 0, "Keep").when(F.col("live_bytes") == 0, "Delete").when(dead * 100 >= all_ * REPACK_PERCENT, "Repack").otherwise("KeepMixed"))


def survivors(index: DataFrame, live: DataFrame) -> DataFrame:
    """(pack_id, hash, offset, length) of the live chunks of packs that are to be rewritten."""
    rewrite = classify(index, live).where("action = 'Repack'").select("pack_id")
    return index.join(rewrite, "pack_id", "left_semi").join(live.select("hash"), "hash", "left_semi").select("pack_id", "hash", "offset", "length")


def dead_packs(index: DataFrame, live: DataFrame) -> DataFrame:
    """Packs without a live chunk."""
    used = locations(index, live).select("pack_id").distinct()
    return index.select("pack_id").distinct().join(used, "pack_id", "left_anti")


def reclaimed(classes: DataFrame) -> DataFrame:
    """(action, packs, bytes) freed by deleting and rewriting."""
    return classes.where("action IN ('Delete', 'Repack')").groupBy("action").agg(F.count("*").alias("packs"), F.sum("dead_bytes").alias("bytes"))
