"""The linear-log engine: files as sequences of entries that all clients append to; forks are sequences that several clients hold."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import ConflictNeedsResolution, CorruptError, IoError, SyncError
from tidemark.functions.cdc import chunk_rows
from tidemark.functions.crdt import TextDoc
from tidemark.operators import oplog, packs
from tidemark.session import shared_dir, stored, work_dir
from tidemark.sources.remote import INDEX, PACKS
from tidemark.sources.tables import Table

LOG = "file_id string, sequence long, client_id string, millis long, change_type string, delta binary, manifest string"
BASELINES = "file_id string, sequence long, kind string, data binary, manifest string"
STATUS = "client_id string, file_id string, last_sequence long"


class LogRemote:
    """The tables that all clients share."""

    def __init__(self, spark: SparkSession, uri: str):
        t = lambda name, schema: Table(spark, f"{uri.rstrip('/')}/{name}", schema)
        self.log, self.baselines, self.status, self.packs, self.index = t("oplogs", LOG), t("baselines", BASELINES), t("clients-status", STATUS), t("packs", PACKS), t("pack-indexes", INDEX)

    def files(self) -> DataFrame:
        return self.log.read().select("file_id").union(self.baselines.read().select("file_id")).distinct()

    def append(self, rows: DataFrame) -> None:
        """Without looking who else wrote: forks may arise."""
        self.log.append(rows)


class LogEngine:
    """One client."""

    def __init__(self, spark: SparkSession, client: str, remote: LogRemote, policy: str = "Manual", listener=None):
        if policy not in oplog.POLICIES:
            raise SyncError(f"no policy {policy}")
        self.spark, self.client, self.remote, self.policy, self.listener = spark, client, remote, policy, listener
        self._busy: set[str] = set()
        self._closed = False

    def close(self) -> None:
        self._closed = True

    @contextmanager
    def _guard(self, file: str):
        """One operation on a file at a time."""
        if self._closed:
            raise SyncError("the engine is closed")
        if file in self._busy:
            raise SyncError(f"{file} is being synced")
        self._busy.add(file)
        try:
            yield
        finally:
            self._busy.discard(file)
        if self.listener:
            self.listener(file)

    def is_syncing(self, file: str) -> bool:
        return file in self._busy

    # ---- reading

    def _log(self, file: str) -> DataFrame:
        return self.remote.log.read().where(F.col("file_id") == file)

    def _baselines(self, file: str) -> DataFrame:
        return self.remote.baselines.read().where(F.col("file_id") == file)

    def head(self, file: str) -> int:
        rows = self._log(file).select("sequence").union(self._baselines(file).select("sequence"))
        return rows.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]

    def _doc(self, file: str, to: int | None = None) -> TextDoc:
        """All baselines, then the deltas after the last of them."""
        base = self._baselines(file).where("kind = 'Text'")
        base = base if to is None else base.where(F.col("sequence") <= to)
        rows = base.orderBy("sequence").collect()
        after = max((r.sequence for r in rows), default=0)
        log = oplog.between(self._log(file), after, to if to is not None else 1 << 62).where("change_type = 'TextDelta'").orderBy("sequence", "client_id").collect()
        return TextDoc.rebuild([bytes(r.data) for r in rows], [bytes(r.delta) for r in log], f"{self.client}#{self.head(file)}")

    def get_text(self, file: str) -> str:
        return self._doc(file).text()

    def _states(self, file: str) -> DataFrame:
        """The log of states with the last baseline as its first entry; a null manifest is a deletion."""
        base = self._baselines(file).where("kind = 'Binary'").select("file_id", "sequence", F.lit("").alias("client_id"), "manifest")
        base = base.orderBy(F.col("sequence").desc()).limit(1)
        return base.unionByName(self._log(file).where("change_type IN ('BinarySnapshot', 'Delete')").select("file_id", "sequence", "client_id", F.when(F.col("change_type") != "Delete", F.col("manifest")).alias("manifest")))

    def get_binary_state(self, file: str) -> dict:
        """head, manifest (hashes in order), deleted, conflicted."""
        rows = oplog.fold_manifests(self._states(file), "KeepLocal" if self.policy in ("Manual", "KeepBoth") else self.policy).collect()
        if not rows:
            raise IoError(f"no file {file}")
        if rows[0].conflicted and self.policy == "Manual":
            raise ConflictNeedsResolution(file)
        m = rows[0].manifest
        return {"head": rows[0].head, "manifest": m.split(",") if m else [], "deleted": rows[0].deleted, "needs_copy": rows[0].conflicted and self.policy == "KeepBoth"}

    def get_manifest(self, file: str) -> list[str]:
        return self.get_binary_state(file)["manifest"]

    def read_binary(self, file: str) -> bytes:
        manifest = self.get_manifest(file)
        if not manifest:
            return b""
        rows = self.spark.createDataFrame([(0, k, h) for k, h in enumerate(manifest)], "resource_id long, position int, hash string")
        chunks = packs.read_ranges(packs.locations(self.remote.index.read(), rows), self.remote.packs.read())
        if not chunks.where("NOT intact").isEmpty():
            raise CorruptError(file)
        out = packs.reassemble(rows, chunks).first()
        if not out.ok:
            raise IoError(f"missing chunks of {file}")
        return bytes(out.data)

    # ---- writing

    def _entry(self, file: str, kind: str, delta: bytes | None = None, manifest: str | None = None, millis: int = 0) -> int:
        """Appends after the head that it finds; if someone else was faster, after theirs."""

        def make(now: DataFrame) -> DataFrame:
            top = max(now.where(F.col("file_id") == file).agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0], self.head(file))
            row = [(file, top + 1, self.client, millis, kind, bytearray(delta) if delta is not None else None, manifest)]
            return oplog.free_slots(self.spark.createDataFrame(row, LOG), now)

        self.remote.log.compare_and_append(make)
        return self.head(file)

    def modify_text(self, file: str, text: str, millis: int = 0) -> int:
        with self._guard(file):
            return self._entry(file, "TextDelta", self._doc(file).set_text(text), millis=millis)

    def modify_binaries(self, files: dict[str, bytes], millis: int = 0) -> dict[str, int]:
        """One upload of the chunks that no pack has, then an entry for each file."""
        names = list(files)
        rows = self.spark.createDataFrame([(k, bytearray(files[n])) for k, n in enumerate(names)], "resource_id long, data binary")
        chunks = stored(chunk_rows(rows, with_bytes=True), work_dir(self.spark, "chunks"))
        self._upload(packs.new_chunks(chunks, self.remote.index.read()))
        hashes: dict[int, list[str]] = {k: [] for k in range(len(names))}
        for r in chunks.select("resource_id", "position", "hash").orderBy("resource_id", "position").toLocalIterator():
            hashes[r.resource_id].append(r["hash"])
        out = {}
        for k, n in enumerate(names):
            with self._guard(n):
                out[n] = self._entry(n, "BinarySnapshot", manifest=",".join(hashes[k]), millis=millis)
        return out

    def modify_binary(self, file: str, data: bytes, millis: int = 0) -> int:
        return self.modify_binaries({file: data}, millis)[file]

    def delete_binary(self, file: str, millis: int = 0) -> int:
        """Deleting what is deleted adds nothing."""
        if self.get_binary_state(file)["deleted"]:
            return self.head(file)
        with self._guard(file):
            return self._entry(file, "Delete", millis=millis)

    def _upload(self, chunks: DataFrame, size: int = packs.PACK_SIZE) -> None:
        """chunks (resource_id, position, hash, length, bytes) as packs: bytes first, then the index."""
        placed = chunks.select(F.lit("u").alias("group_id"), (F.col("resource_id") * (1 << 32) + F.col("position")).alias("position"), "hash", "length", "bytes")
        packed = packs.with_offsets(packs.greedy_packs(placed.drop("bytes"), size), ["group_id", "pack"], ["position"])
        packed = stored(packed.join(placed.select("hash", "bytes").dropDuplicates(["hash"]), "hash"), work_dir(self.spark, "packs"))
        parts = packed.groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "bytes"))), lambda x: x["bytes"]).alias("parts"))
        data = stored(parts.select("pack", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x)).alias("data")).withColumn("pack_id", F.sha2("data", 256)), work_dir(self.spark, "packs"))
        self.remote.packs.append_new(data, ["pack_id"])
        self.remote.index.append_new(packed.join(data.select("pack", "pack_id"), "pack"), ["pack_id", "hash", "offset"])

    def sync(self, file: str) -> int:
        """Reads what there is, converges a forked tip, and tells the others how far this client is."""
        with self._guard(file):
            self._converge(file)
            head = self.head(file)
            row = self.spark.createDataFrame([(self.client, file, head)], STATUS)
            self.remote.status.replace(lambda now: now.where((F.col("client_id") != self.client) | (F.col("file_id") != file)).unionByName(row))
            return head

    def _converge(self, file: str) -> None:
        tip = oplog.tips(self._log(file)).collect()
        if not tip or not tip[0].forked:
            return
        kinds = {r.change_type for r in self._log(file).where(F.col("sequence") == tip[0].head).select("change_type").collect()}
        if kinds == {"TextDelta"}:
            self._entry(file, "TextDelta", self._doc(file).state())
        else:
            state = self.get_binary_state(file)
            self._entry(file, "Delete" if state["deleted"] else "BinarySnapshot", manifest=",".join(state["manifest"]))

    def publish_convergence(self, file: str) -> int:
        with self._guard(file):
            self._converge(file)
            return self.head(file)

    def rollback(self, file: str, sequence: int, millis: int = 0) -> int:
        """A new entry with the state as of a sequence; the log stays."""
        with self._guard(file):
            if not self._states(file).isEmpty():
                row = oplog.as_of(self._states(file), sequence, "manifest").collect()
                if not row:
                    raise IoError(f"{file} has no state at {sequence}")
                m = row[0].manifest
                return self._entry(file, "Delete" if m is None else "BinarySnapshot", manifest=m, millis=millis)
            text = self._doc(file, sequence).text()
            return self._entry(file, "TextDelta", self._doc(file).set_text(text), millis=millis)

    # ---- upkeep

    def truncate_many(self, files: list[str], keep: int) -> dict:
        """Folds all but the newest keep entries that every client has reached into a baseline; then one collection of garbage."""
        report = {"files": 0, "deferred": 0, "entries_deleted": 0}
        for file in dict.fromkeys(files):
            with self._guard(file):
                [cut] = oplog.truncation_cuts(self._log(file), self.remote.status.read(), keep).collect() or [None]
                report["files"] += 1
                if cut is None or cut.deferred:
                    report["deferred"] += 1
                    continue
                to, here = cut.cut, F.col("file_id") == file
                if self._states(file).where(F.col("client_id") != "").isEmpty():
                    base = (file, to, "Text", bytearray(self._doc(file, to).state()), None)
                else:
                    old = oplog.fold_manifests(self._states(file).where(F.col("sequence") <= to), "KeepLocal" if self.policy == "Manual" else self.policy).first()
                    base = (file, to, "Binary", None, old.manifest if old else None)
                self.remote.baselines.append(self.spark.createDataFrame([base], BASELINES))
                report["entries_deleted"] += self._log(file).where(F.col("sequence") <= to).count()
                self.remote.log.replace(lambda now, here=here, to=to: now.where(~here | (F.col("sequence") > to)))
        return report | self._collect()

    def truncate(self, file: str, keep: int) -> dict:
        return self.truncate_many([file], keep)

    def _collect(self) -> dict:
        """Deletes packs without live chunks; rewrites those that are mostly dead, the new ones first."""
        used = self.remote.log.read().select("manifest").union(self.remote.baselines.read().select("manifest"))
        live = stored(used.where("manifest != ''").select(F.explode(F.split("manifest", ",")).alias("hash")).distinct(), work_dir(self.spark, "live"))
        index = stored(self.remote.index.read(), work_dir(self.spark, "index"))
        classes = stored(packs.classify(index, live), work_dir(self.spark, "classes"))
        saved = packs.read_ranges(packs.survivors(index, live), self.remote.packs.read())
        if not saved.where("NOT intact").isEmpty():
            raise CorruptError("a pack that was to be rewritten")
        saved = saved.dropDuplicates(["hash"]).select(F.lit(0).cast("long").alias("resource_id"), F.row_number().over(Window.orderBy("hash")).cast("long").alias("position"), "hash", F.octet_length("bytes").cast("long").alias("length"), "bytes")
        gone = classes.where("action IN ('Delete', 'Repack')")
        if not saved.isEmpty():
            self._upload(saved)
        totals = {r.action: r for r in packs.reclaimed(classes).collect()}
        for t in (self.remote.index, self.remote.packs):
            if totals:
                t.replace(lambda now: now.join(gone.select("pack_id"), "pack_id", "left_anti"))
        n = lambda a: totals[a].packs if a in totals else 0
        return {"packs_deleted": n("Delete"), "packs_repacked": n("Repack"), "bytes_reclaimed": sum(r.bytes for r in totals.values())}


def new_engine(spark: SparkSession, client: str, uri: str | None = None, policy: str = "Manual", listener=None) -> LogEngine:
    return LogEngine(spark, client, LogRemote(spark, uri or f"{shared_dir(spark)}/log"), policy, listener)
