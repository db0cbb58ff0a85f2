"""The engine as a client uses it: preview, reconcile, history, rollback, conflict resolution, maintenance.

The computations are DataFrame operators; this module orders them and writes their results. State (commits that were seen, cursors, baselines, conflicts, run journal) are versioned tables. Nothing here reads a clock: the caller says what time it is.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import ConflictError, IoError, SyncError
from tidemark.functions.cdc import chunk_rows
from tidemark.functions.crdt import TextDoc
from tidemark.functions.scalar import snapshot_generation
from tidemark.operators import catalog, dag, packs, planner, retention
from tidemark.operators.dag import KEY
from tidemark.session import shared_dir, stored, work_dir
from tidemark.sources.remote import COMMITS, CURSORS, EVENTS, Remote
from tidemark.sources.replica import EventListener, MergePolicy, Replica
from tidemark.sources.tables import Table

_KEYS = "scope_id string, resource_id string"
BASELINES = f"{_KEYS}, state string, content_id string, local_version string, remote_heads array<string>"
CONFLICTS = f"conflict_id string, {_KEYS}, kind string, created_at long"
KINDS = f"{_KEYS}, kind string"
CHECKPOINTS = f"{_KEYS}, id string"
JOURNAL = "run_id string, stage string, operations long"
CLIENTS = "client_id string"
MUTATIONS = f"{_KEYS}, kind string, data binary, expected string"


class Runtime:
    """One client's engine."""

    def __init__(self, spark: SparkSession, client: str, remote: Remote, local: Replica, state_uri: str, policy: MergePolicy | None = None, listener: EventListener | None = None):
        self.spark, self.client, self.remote, self.local, self.policy, self.listener = spark, client, remote, local, policy, listener
        t = lambda name, schema: Table(spark, f"{state_uri.rstrip('/')}/{name}", schema)
        self.commits, self.cursors, self.baselines, self.conflicts = t("commits", COMMITS), t("cursors", CURSORS), t("baselines", BASELINES), t("conflicts", CONFLICTS)
        self.kinds, self.checkpoints, self.journal, self.retired, self.since = t("kinds", KINDS), t("checkpoints", CHECKPOINTS), t("journal", JOURNAL), t("retired", CLIENTS), t("events-since-snapshot", EVENTS)
        self._closed = False

    # ---- plumbing

    def _open(self) -> None:
        if self._closed:
            raise SyncError("the runtime is closed")

    def close(self) -> None:
        """Later calls fail; closing twice is fine."""
        self._closed = True

    def _emit(self, run: str, stage: str, **detail) -> None:
        if self.listener:
            self.listener([{"run_id": run, "stage": stage, "detail_json": json.dumps(detail)}])

    def _fixed(self, df: DataFrame) -> DataFrame:
        """Written once, so that later steps see the same rows whatever they change below them."""
        return stored(df, work_dir(self.spark, "run"))

    def _keys(self, *keys: tuple[str, str]) -> DataFrame:
        return self.spark.createDataFrame(list(keys), _KEYS)

    # ---- reading

    def _refresh(self, scopes: Sequence[str]) -> None:
        """Takes up the catalog's new events and their commits, each once."""
        cursors = self.cursors.read()
        events, seen, coverage = self.remote.scan_catalog(cursors, list(scopes))
        events = self._fixed(events)
        missing = catalog.missing_commits(events, self.commits.read())
        self.commits.append_new(self.remote.load_commits(missing), ["id"])
        self.since.append_new(events.join(coverage.withColumnRenamed("counter", "covered"), catalog.AT, "left").where("covered IS NULL OR counter > covered").drop("covered"), ["commit_id"])
        self.cursors.replace(lambda now: catalog.next_cursors(now, seen))

    def _snapshot_large_catalogs(self, now: int) -> None:
        counts = self.since.read().groupBy("scope_id").count().where(F.col("count") >= catalog.SNAPSHOT_AFTER).collect()
        for r in counts:
            here = F.col("scope_id") == r.scope_id
            self.remote.compact_catalog(snapshot_generation(now, self.client), r.scope_id, catalog.events_of(self.commits.read().where(here)), self.cursors.read().where(here))
            self.since.replace(lambda x: x.where(~here))

    def _texts(self, commits: DataFrame) -> DataFrame:
        """(scope_id, resource_id, text): the merge of all deltas of each text resource."""
        deltas = commits.where("change_type = 'TextDelta'").select(*KEY, "delta")

        def run(t: pa.Table) -> pa.Table:
            return pa.table({c: t.column(c).slice(0, 1) for c in KEY} | {"text": pa.array([TextDoc.rebuild([], t.column("delta").to_pylist()).text()])})

        return deltas.groupBy(*KEY).applyInArrow(run, f"{_KEYS}, text string")

    def _commits(self, scopes: Sequence[str]) -> DataFrame:
        return planner.in_scopes(self.commits.read(), list(scopes))

    def _inventory(self, scopes: Sequence[str]) -> DataFrame:
        """(scope_id, resource_id, state, content_id, version_token, kind): only what is new is read and hashed."""
        rows = planner.in_scopes(self.local.list_resources(), list(scopes))
        base = self.baselines.read()
        open_ = rows.where("content_id IS NULL").join(base.select(*KEY, F.col("local_version").alias("version_token")), [*KEY, "version_token"], "left_anti")
        ids = planner.lazy_inventory(rows, base, self.local.read_resources(open_))
        lost = ids.where("source = 'missing'").limit(1).collect()
        if lost:
            raise IoError(f"no content: {lost[0].scope_id}/{lost[0].resource_id}")
        return rows.drop("content_id").join(ids.select(*KEY, "content_id"), KEY).withColumn("state", F.lit("Present"))

    def _plan(self, scopes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """(plan with kind and expected version token, remote states)."""
        local = self._fixed(self._inventory(scopes))
        commits = self._commits(scopes)
        remote = self._fixed(dag.remote_state(commits, self._texts(commits)))
        base = planner.in_scopes(self.baselines.read(), list(scopes))
        known = commits.groupBy(*KEY).agg(F.when(F.max((F.col("change_type") == "TextDelta").cast("int")) == 1, "Text").otherwise("Binary").alias("remote_kind"))
        plan = planner.plan_inventory(local, base, remote)
        met = plan.join(local.select(*KEY, "version_token", "kind"), KEY, "left").join(known, KEY, "left").withColumn("kind", F.coalesce("kind", "remote_kind")).drop("remote_kind")
        return self._fixed(planner.merge_texts(met, met)), remote

    def preview(self, scopes: Sequence[str] = ()) -> DataFrame:
        """The plan, and nothing else: neither state nor remote change but for what was newly read."""
        self._open()
        self._refresh(scopes)
        return planner.in_order(self._plan(scopes)[0].select(*KEY, "operation", "conflict_kind"))

    def list_conflicts(self, scope: str | None = None) -> DataFrame:
        self._open()
        return planner.conflicts_in(self.conflicts.read(), scope)

    def history(self, scope: str, resource: str) -> DataFrame:
        """A resource's versions by time, then id."""
        self._open()
        here = (F.col("scope_id") == scope) & (F.col("resource_id") == resource)
        return dag.history(self.commits.read().where(here)).orderBy("millis", "id")

    def _deltas_below(self, starts: DataFrame) -> DataFrame:
        """(scope_id, resource_id, change_type, delta) of the text changes among the ancestors of starts (scope_id, resource_id, start)."""
        name = F.concat_ws("\0", "scope_id", "resource_id")
        graph = self.commits.read().select(name.alias("resource_id"), "id", "parents", "delta", *(F.col(c).alias(f"k{i}") for i, c in enumerate(KEY)))
        reach = dag.ancestors(graph, starts.select(name.alias("resource_id"), "start"))
        own = graph.select(F.col("id").alias("ancestor"), F.col("k0").alias("scope_id"), F.col("k1").alias("resource_id"), "delta").where("delta IS NOT NULL")
        return reach.select("ancestor").distinct().join(own, "ancestor").select(*KEY, F.lit("TextDelta").alias("change_type"), "delta")

    def _content(self, keys: DataFrame, commits: DataFrame) -> DataFrame:
        """(scope_id, resource_id, data, kind) of commits (one for each key): chunks put together, or the text that the commit's ancestors make."""
        chosen = self._fixed(commits.join(keys.select(*KEY), KEY, "left_semi").select(*KEY, "id", "change_type", "chunk_hashes"))
        name = F.concat_ws("\0", "scope_id", "resource_id")
        binary = chosen.where("change_type = 'BinarySnapshot'")
        manifest = binary.select(name.alias("resource_id"), F.posexplode("chunk_hashes").alias("position", "hash"))
        chunks = self.remote.read_ranges(self.remote.lookup_chunks(manifest.select("hash")))
        whole = packs.reassemble(manifest, chunks)
        bad = whole.where("NOT ok").limit(1).collect()
        if bad:
            raise IoError(f"missing chunks of {bad[0].resource_id!r}")
        out = binary.select(*KEY, name.alias("name")).join(whole.select(F.col("resource_id").alias("name"), "data"), "name", "left").select(*KEY, F.coalesce("data", F.lit(b"")).alias("data"), F.lit("Binary").alias("kind"))
        text = chosen.where("change_type = 'TextDelta'")
        deltas = self._deltas_below(text.select(*KEY, F.col("id").alias("start")))
        return out.unionByName(self._texts(deltas).select(*KEY, F.col("text").cast("binary").alias("data"), F.lit("Text").alias("kind")))

    # ---- writing

    def _commit_rows(self, changes: DataFrame, now: int) -> DataFrame:
        """Commits of changes (scope_id, resource_id, parents, change_type, content_id, size, chunk_hashes, delta), numbered after this client's last one."""
        last = self.commits.read().where(F.col("author") == self.client).agg(F.coalesce(F.max("counter"), F.lit(0)).alias("last"))
        order = Window.orderBy(*KEY)  # one client's changes of one run
        rows = changes.crossJoin(last).withColumn("counter", F.col("last") + F.row_number().over(order)).drop("last")
        rows = rows.withColumns({"author": F.lit(self.client), "millis": F.lit(now).cast("long"), "parents": F.array_sort(F.array_distinct("parents"))})
        body = F.to_json(F.struct(*KEY, "parents", "author", "counter", "millis", "change_type", "content_id", "size", "chunk_hashes", F.base64("delta").alias("delta")))
        return self._fixed(rows.withColumn("id", F.concat_ws(":", "author", F.col("counter").cast("string"), F.sha2(body, 256))))

    def _publish(self, changes: DataFrame, now: int, new_packs: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
        rows = self._commit_rows(changes, now)
        self.remote.commit_batch(rows, new_packs, index)
        self.commits.append_new(rows, ["id"])
        return rows

    def _binary_changes(self, content: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(changes, packs, index) of content (scope_id, resource_id, data, parents): chunked, without the chunks that are stored, packed across resources."""
        rows = self._fixed(content.withColumn("n", F.row_number().over(Window.orderBy(*KEY)).cast("long")))
        chunks = self._fixed(chunk_rows(rows.select(F.col("n").alias("resource_id"), "data"), with_bytes=True))
        new = packs.new_chunks(chunks, self.remote.lookup_chunks(chunks.select("hash")))
        placed = new.withColumn("position", (F.col("resource_id") * (1 << 32)) + F.col("position"))
        packed = packs.greedy_packs(placed.select(F.lit("upload").alias("group_id"), "position", "hash", "length"))
        packed = self._fixed(packs.with_offsets(packed, ["group_id", "pack"], ["position"]))
        bytes_ = placed.select("hash", "bytes").dropDuplicates(["hash"])
        parts = packed.join(bytes_, "hash").groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "bytes"))), lambda x: x["bytes"]).alias("parts"))
        data = self._fixed(parts.select("pack", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x)).alias("data")).withColumn("pack_id", F.sha2("data", 256)))
        index = packed.join(data.select("pack", "pack_id"), "pack").select("pack_id", "hash", "offset", "length")
        hashes = chunks.groupBy("resource_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "hash"))), lambda x: x["hash"]).alias("chunk_hashes"))
        changes = rows.join(hashes, rows["n"] == hashes["resource_id"], "left").select(
            rows["scope_id"], rows["resource_id"], "parents", F.lit("BinarySnapshot").alias("change_type"), F.sha2("data", 256).alias("content_id"),
            F.octet_length("data").cast("long").alias("size"), F.coalesce("chunk_hashes", F.array().cast("array<string>")).alias("chunk_hashes"), F.lit(None).cast("binary").alias("delta"),
        )
        return changes, data.select("pack_id", "data"), index

    def _text_changes(self, content: DataFrame, now: int, heads: DataFrame) -> DataFrame:
        """The delta from the text at heads (scope_id, resource_id, remote_heads) to each new one. content: (scope_id, resource_id, data, parents). What others changed since then isn't undone."""
        client = f"{self.client}@{now}"
        wanted = content.select(*KEY).join(heads.select(*KEY, F.explode("remote_heads").alias("start")), KEY)
        old = self._deltas_below(wanted).groupBy(*KEY)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return pa.table({c: pa.array([], t) for c, t in (("scope_id", pa.string()), ("resource_id", pa.string()), ("delta", pa.binary()))})
            doc = TextDoc.rebuild([], left.column("delta").to_pylist(), client)
            return pa.table({"scope_id": right.column("scope_id").slice(0, 1), "resource_id": right.column("resource_id").slice(0, 1), "delta": pa.array([doc.set_text((right.column("data")[0].as_py() or b"").decode())], pa.binary())})

        new = content.select(F.col("scope_id"), F.col("resource_id"), "data").groupBy(*KEY)
        deltas = old.cogroup(new).applyInArrow(run, f"{_KEYS}, delta binary")
        met = content.join(deltas, KEY)
        return met.select(*KEY, "parents", F.lit("TextDelta").alias("change_type"), F.sha2("data", 256).alias("content_id"), F.octet_length("data").cast("long").alias("size"), F.lit(None).cast("array<string>").alias("chunk_hashes"), "delta")

    def _deletions(self, keys: DataFrame) -> DataFrame:
        """keys with their parents."""
        null = lambda t: F.lit(None).cast(t)
        return keys.select(*KEY, "parents", F.lit("Delete").alias("change_type"), null("string").alias("content_id"), null("long").alias("size"), null("array<string>").alias("chunk_hashes"), null("binary").alias("delta"))

    def _merge_texts(self, content: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(content after the merge policy, keys that it leaves in conflict) for texts that both sides changed. The policy is the host's code and runs per row in the workers."""
        policy = self.policy
        if policy is None:
            return content, self._keys()
        remote = self._texts(self.commits.read()).withColumnRenamed("text", "remote_text")
        met = content.join(remote, KEY, "left")

        def run(batches):
            for b in batches:
                out = []
                for r in b.to_pylist():
                    verdict, text = ("NotHandled", None)
                    if r["remote_text"] is not None and r["remote_text"].encode() != r["data"]:
                        verdict, text = policy.merge_text((r["scope_id"], r["resource_id"]), None, r["data"].decode(), r["remote_text"])
                    out.append((r["scope_id"], r["resource_id"], text.encode() if verdict == "Merged" else r["data"], r["parents"], verdict == "Conflict"))
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.bool_()))], names=[*KEY, "data", "parents", "clash"])

        done = self._fixed(met.select(*KEY, "data", "parents", "remote_text").mapInArrow(run, f"{_KEYS}, data binary, parents array<string>, clash boolean"))
        return done.where("NOT clash").drop("clash"), done.where("clash").select(*KEY)

    def _set_baselines(self, rows: DataFrame) -> None:
        rows = self._fixed(rows.select("scope_id", "resource_id", "state", "content_id", "local_version", "remote_heads"))
        self.baselines.replace(lambda now: now.join(rows.select(*KEY), KEY, "left_anti").unionByName(rows))

    def _heads(self) -> DataFrame:
        return dag.heads(self.commits.read()).groupBy(*KEY).agg(F.array_sort(F.collect_list("id")).alias("remote_heads"))

    def _tokens(self) -> DataFrame:
        return self.local.list_resources().select(*KEY, F.col("version_token").alias("local_version"))

    # ---- a run

    def reconcile(self, scopes: Sequence[str] = (), run_id: str = "run", now: int = 0) -> dict:
        """Brings both sides together. A resource that fails or conflicts doesn't stop the others."""
        self._open()
        stale = self.journal.read().collect()
        if stale:
            self._emit(stale[0].run_id, "recovery", stage=stale[0].stage)
        self._emit(run_id, "remote.scan.start")
        self._refresh(scopes)
        self._snapshot_large_catalogs(now)
        self._emit(run_id, "remote.scan.complete")
        plan, _ = self._plan(scopes)
        self._emit(run_id, "plan.complete", operations=plan.count())
        self.journal.replace(lambda _: plan.agg(F.lit(run_id).alias("run_id"), F.lit("planned").alias("stage"), F.count("*").alias("operations")))
        failed, clashes = self._upload(plan, now)
        failed = self._fixed(failed.unionByName(self._apply(plan)).distinct())
        late = self.spark.createDataFrame([(r.scope_id, r.resource_id, "Conflict", "ContentVsContent") for r in clashes.collect()], f"{_KEYS}, operation string, conflict_kind string")
        met = plan.join(late.select(*KEY, F.lit(True).alias("late")), KEY, "left")
        plan = self._fixed(met.withColumns({"operation": F.when(F.col("late"), "Conflict").otherwise(F.col("operation")), "conflict_kind": F.when(F.col("late"), "ContentVsContent").otherwise(F.col("conflict_kind"))}).drop("late"))
        records = self._fixed(planner.conflict_records(plan).withColumn("created_at", F.lit(now).cast("long")))
        self.conflicts.replace(lambda old: planner.replace_conflicts(old, records, list(scopes)))
        seen = planner.acknowledgements(plan.drop("heads").join(self._heads().withColumnRenamed("remote_heads", "heads"), KEY, "left"), self.client, failed)
        self.remote.write_acknowledgements(self._fixed(seen.where("size(observed_heads) > 0").withColumn("observed_heads", F.col("observed_heads").cast("array<string>"))))
        counts = planner.run_counts(plan, failed).first().asDict()
        wanted = self.spark.createDataFrame([(s,) for s in scopes], "scope_id string")
        reports = {r.scope_id: r.asDict() for r in planner.scope_reports(wanted, plan, failed).collect()}
        self.journal.replace(lambda now_: now_.limit(0))
        self._emit(run_id, "run.complete", **counts)
        return {"run_id": run_id, **counts, "scopes": reports}

    def _upload(self, plan: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
        """(keys that failed, keys that the merge policy left in conflict)."""
        heads = self._heads()
        wanted = plan.where("operation = 'Upload'")
        content = self.local.read_resources(wanted).withColumnRenamed("version_token", "now_token")
        met = self._fixed(wanted.join(content, KEY, "left").join(heads, KEY, "left").withColumn("parents", F.coalesce("remote_heads", F.array().cast("array<string>"))))
        same = F.col("data").isNotNull() & (F.col("now_token") == F.col("version_token"))
        failed = met.where(~F.coalesce(same, F.lit(False))).select(*KEY)
        good = met.where(same).select(*KEY, "kind", "data", "parents")
        text, clashes = self._merge_texts(good.where("kind = 'Text'").drop("kind"))
        changes, new_packs, index = self._binary_changes(good.where("kind != 'Text'").drop("kind"))
        gone = plan.where("operation = 'PublishDelete'").join(heads, KEY, "left").withColumn("parents", F.coalesce("remote_heads", F.array().cast("array<string>")))
        everything = changes.unionByName(self._text_changes(text, now, self.baselines.read())).unionByName(self._deletions(gone))
        rows = self._publish(everything, now, new_packs, index)
        # a text upload merges: what others wrote comes back
        back = self._texts(self.commits.read()).join(rows.where("change_type = 'TextDelta'").select(*KEY, "content_id"), KEY).where("sha2(text, 256) != content_id")
        tokens = wanted.select(*KEY, F.col("version_token").alias("expected"))
        done = self.local.apply_mutations(self._fixed(back.join(tokens, KEY).select(*KEY, F.lit("Text").alias("kind"), F.col("text").cast("binary").alias("data"), "expected")))
        bad = done.where("status != 'Applied'").select(*KEY)
        ok = rows.join(bad, KEY, "left_anti").select(*KEY, F.when(F.col("change_type") == "Delete", "Deleted").otherwise("Present").alias("state"), "content_id")
        merged = done.where("status = 'Applied'").select(*KEY, F.sha2("data", 256).alias("merged_id"))
        ok = ok.join(merged, KEY, "left").withColumn("content_id", F.coalesce("merged_id", "content_id")).join(self._tokens(), KEY, "left").join(self._heads(), KEY)
        self._set_baselines(ok)
        return failed.unionByName(bad), clashes

    def _apply(self, plan: DataFrame) -> DataFrame:
        """Downloads, local deletions and baselines; returns the keys that failed."""
        commits, heads = self.commits.read(), self._heads()
        down = plan.where("operation = 'Download'")
        first = commits.join(dag.first_head(commits), [*KEY, "id"], "left_semi")
        text = self._texts(commits).select(*KEY, F.col("text").cast("binary").alias("data"), F.lit("Text").alias("kind"))
        binary = self._content(down.where("kind != 'Text'"), first.where("change_type = 'BinarySnapshot'"))
        content = binary.unionByName(text.join(down.where("kind = 'Text'").select(*KEY), KEY, "left_semi"))
        got = down.select(*KEY, F.col("version_token").alias("expected")).join(content, KEY, "left")
        gone = plan.where("operation = 'ApplyDelete'").select(*KEY, F.col("version_token").alias("expected"), F.lit(None).cast("binary").alias("data"), "kind")
        wanted = self._fixed(got.where("data IS NOT NULL").unionByName(gone).select(*KEY, "kind", "data", "expected"))
        done = self._fixed(self.local.apply_mutations(wanted))
        lost = got.where("data IS NULL").select(*KEY)
        ok = done.where("status = 'Applied'").select(*KEY, F.when(F.col("data").isNull(), "Deleted").otherwise("Present").alias("state"), F.sha2("data", 256).alias("content_id"))
        same = plan.where("operation IN ('EstablishBaseline', 'EstablishDeletedBaseline')").select(*KEY, F.when(F.col("operation") == "EstablishBaseline", "Present").otherwise("Deleted").alias("state"), F.col("remote_id").alias("content_id"))
        self._set_baselines(ok.unionByName(same).join(self._tokens(), KEY, "left").join(heads, KEY, "left"))
        return done.where("status != 'Applied'").select(*KEY).unionByName(lost)

    # ---- decisions

    def rollback(self, scope: str, resource: str, commit: str, now: int = 0) -> dict:
        """A new commit with an old version's content; the history stays as it is."""
        self._open()
        key = self._keys((scope, resource))
        old = self.commits.read().where(F.col("id") == commit).join(key, KEY, "left_semi")
        if old.isEmpty():
            raise IoError(f"{commit} is no commit of {scope}/{resource}")
        row = old.first()
        if row.change_type == "Delete":
            content = self.spark.createDataFrame([(scope, resource, "Binary", None)], f"{_KEYS}, kind string, data binary")
        else:
            content = self._fixed(self._content(key, old).select(*KEY, "kind", "data"))
        self._write_through(content, now)
        return self.reconcile([scope], f"rollback-{now}", now)

    def _write_through(self, content: DataFrame, now: int) -> None:
        """content (scope_id, resource_id, kind, data; null deletes) on both sides, on top of all heads."""
        content = self._fixed(content)
        tokens = self.local.list_resources().select(*KEY, F.col("version_token").alias("expected"))
        done = self.local.apply_mutations(content.join(tokens, KEY, "left").select(*KEY, "kind", "data", "expected"))
        if not done.where("status != 'Applied'").isEmpty():
            raise ConflictError("the local resource changed")
        met = self._fixed(content.join(self._heads(), KEY, "left").withColumn("parents", F.coalesce("remote_heads", F.array().cast("array<string>"))))
        there = met.where("data IS NOT NULL")
        changes, new_packs, index = self._binary_changes(there.where("kind != 'Text'").select(*KEY, "data", "parents"))
        text = self._text_changes(there.where("kind = 'Text'").select(*KEY, "data", "parents"), now, self._heads())
        rows = self._publish(changes.unionByName(text).unionByName(self._deletions(met.where("data IS NULL"))), now, new_packs, index)
        state = F.when(F.col("change_type") == "Delete", "Deleted").otherwise("Present")
        self._set_baselines(rows.select(*KEY, state.alias("state"), "content_id").join(self._tokens(), KEY, "left").join(self._heads(), KEY))

    def resolve(self, conflict_id: str, choice: str, copies: dict[str, str] | None = None, now: int = 0) -> dict:
        """Ends a conflict. choice: Local, Delete, or a remote head's id. copies: other versions (Local or a head) to keep, by the name of their new resource. A conflict that no longer is as recorded is an error."""
        self._open()
        found = self.conflicts.read().where(F.col("conflict_id") == conflict_id).collect()
        if not found:
            raise IoError(f"no conflict {conflict_id}")
        scope, resource = found[0].scope_id, found[0].resource_id
        self._refresh([scope])
        if planner.conflict_records(self._plan([scope])[0]).where(F.col("conflict_id") == conflict_id).isEmpty():
            raise ConflictError(f"{scope}/{resource} changed since the conflict was recorded")
        key = self._keys((scope, resource))

        def version(which: str, name: str) -> DataFrame:
            if which == "Delete":
                return self.spark.createDataFrame([(scope, name, "Binary", None)], f"{_KEYS}, kind string, data binary")
            if which == "Local":
                out = self.local.read_resources(key).join(self.local.list_resources().select(*KEY, "kind"), KEY).select(*KEY, "kind", "data")
            else:
                out = self._content(key, self.commits.read().where(F.col("id") == which)).select(*KEY, "kind", "data")
            if out.isEmpty():
                raise IoError(f"no version {which} of {scope}/{resource}")
            return self._fixed(out.withColumn("resource_id", F.lit(name)))

        rows = [version(which, name) for name, which in (copies or {}).items()]
        for content in [*rows, version(choice, resource)]:  # copies first, so that nothing is lost
            self._write_through(content, now)
        return self.reconcile([scope], f"resolve-{now}", now)

    # ---- upkeep

    def retire_client(self, client: str) -> None:
        """The client's acknowledgements are no longer waited for."""
        self._open()
        self.retired.append_new(self.spark.createDataFrame([(client,)], CLIENTS), ["client_id"])

    def maintain(self, keep: int, scopes: Sequence[str] = (), now: int = 0) -> dict:
        """Forgets old versions, in two passes: the first publishes a checkpoint, a later one, when every active client has acknowledged it, reclaims what is older than the newest keep."""
        self._open()
        report = {"resources": 0, "deferred": 0, "commits_deleted": 0, "packs_deleted": 0}
        if keep == 0:
            return report
        self._refresh(())
        commits = self._fixed(self._commits(scopes))
        points = self.checkpoints.read()
        acks = self._fixed(self.remote.list_acknowledgements())  # before checkpoints are published: these can't be satisfied in this pass
        quorums = retention.quorum(commits, points, acks, retention.active_clients(commits, self.retired.read(), self.client))
        texts = commits.groupBy(*KEY).agg(F.when(F.max((F.col("change_type") == "TextDelta").cast("int")) == 1, "Text").otherwise("Binary").alias("kind"))
        phases = self._fixed(retention.phases(commits, keep, texts, self.conflicts.read(), points, quorums))
        report |= {"resources": phases.count(), "deferred": phases.where("phase IN ('Deferred', 'Checkpoint')").count()}
        self.checkpoints.replace(lambda x: x.join(phases.where("phase = 'Skip'").select(*KEY), KEY, "left_anti"))
        self._publish_checkpoints(phases.where("phase = 'Checkpoint'"), commits, now)
        due = self._fixed(commits.join(phases.where("phase = 'Reclaim'").select(*KEY), KEY, "left_semi"))
        pinned = acks.select(*KEY, F.explode("pinned_commits").alias("id"))
        old = self._fixed(retention.obsolete(due, retention.retained(due, keep, points.join(due.select(*KEY).distinct(), KEY, "left_semi"), pinned)))
        for r in old.select("scope_id").distinct().collect():
            here = F.col("scope_id") == r.scope_id
            left = self._fixed(self.commits.read().where(here).join(old.select("id"), "id", "left_anti"))
            self.remote.compact_catalog(snapshot_generation(now, self.client), r.scope_id, catalog.events_of(left), self.cursors.read().where(here), old.where(here))
            self.checkpoints.replace(lambda x, here=here: x.where(~here))
        report["commits_deleted"] = old.count()
        self.commits.replace(lambda x: x.join(old.select("id"), "id", "left_anti"))
        live = self.commits.read().select(F.explode("chunk_hashes").alias("hash")).distinct()
        used = self.remote.lookup_chunks(live).select("pack_id").distinct()
        dead = self._fixed(self.remote.list_pack_ids().join(used, "pack_id", "left_anti"))
        report["packs_deleted"] = dead.count()
        if report["packs_deleted"]:
            self.remote.delete_packs(dead)
        return report

    def _publish_checkpoints(self, keys: DataFrame, commits: DataFrame, now: int) -> None:
        head = commits.join(dag.first_head(commits).join(keys.select(*KEY), KEY, "left_semi"), [*KEY, "id"], "left_semi")
        again = head.select(*KEY, F.array("id").alias("parents"), "change_type", "content_id", "size", "chunk_hashes", "delta")
        rows = self._publish(again, now)
        self.checkpoints.append(rows.select(*KEY, "id"))
        self.remote.write_acknowledgements(rows.select(F.lit(self.client).alias("client_id"), *KEY, F.array("id").alias("observed_heads")))


def new_runtime(spark: SparkSession, client: str, remote: Remote, local: Replica, state_uri: str | None = None, **more) -> Runtime:
    return Runtime(spark, client, remote, local, state_uri or f"{shared_dir(spark)}/state-{client}", **more)
