"""The engine's queries over the derived tables, each with its SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cdc, scalar
from tidemark.operators import catalog, dag, oplog, packs, planner, retention
from tidemark.plans import fixtures as fx
from tidemark.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = fx.oracle(sql)
        return f

    return add


def _joined(array) -> F.Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


def _plan(spark, sf) -> DataFrame:
    return planner.plan_inventory(fx.local_inventory(spark, sf), fx.baselines(spark, sf), fx.remote_resources(spark, sf))


# ---- planning


@query("SELECT op AS operation, count(*) AS resources FROM planned GROUP BY 1")
def k1_preview_counts(spark, sf):
    label = F.concat_ws(":", "operation", "conflict_kind")
    return _plan(spark, sf).groupBy(label.alias("operation")).agg(F.count("*").alias("resources"))


@query("SELECT scope_id, resource_id, split_part(op, ':', 1) AS operation, nullif(split_part(op, ':', 2), '') AS conflict_kind FROM planned")
def plan_detail(spark, sf):
    return _plan(spark, sf).select("scope_id", "resource_id", "operation", "conflict_kind")


@query("SELECT scope_id, split_part(op, ':', 1) AS operation, count(*) AS resources FROM planned GROUP BY ALL")
def plan_counts_by_scope(spark, sf):
    return _plan(spark, sf).groupBy("scope_id", "operation").agg(F.count("*").alias("resources"))


@query("""
WITH wanted AS (SELECT resource_id, arg_max(content_id, counter) AS local_id, max(CASE WHEN k = 2 THEN content_id END) AS base_id, max(CASE WHEN k = 2 THEN change_type END) AS base_type, arg_max(change_type, counter) AS local_type
  FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY counter DESC) AS k FROM commits) GROUP BY 1),
 l AS (SELECT 's' || (resource_id % 5) AS scope_id, resource_id, CASE WHEN local_type = 'Delete' THEN 'Deleted' ELSE 'Present' END AS state, CASE WHEN local_type <> 'Delete' THEN CASE WHEN resource_id % 3 = 0 THEN sha256(local_id || '#L') ELSE local_id END END AS content_id FROM wanted WHERE resource_id % 7 <> 0),
 b AS (SELECT 's' || (resource_id % 5) AS scope_id, resource_id, CASE WHEN base_type = 'Delete' THEN 'Deleted' ELSE 'Present' END AS state, CASE WHEN base_type <> 'Delete' THEN base_id END AS content_id FROM wanted WHERE base_type IS NOT NULL),
 r AS (SELECT scope_id, resource_id, state, CASE WHEN state = 'Present' THEN any_id END AS content_id FROM states)
SELECT scope_id, resource_id, split_part(op, ':', 1) AS operation, nullif(split_part(op, ':', 2), '') AS conflict_kind FROM (SELECT scope_id, resource_id, """ + fx.case_sql("l.state", "l.content_id", "b.state", "b.content_id", "r.state", "r.content_id") + """ AS op FROM l FULL JOIN b USING (scope_id, resource_id) FULL JOIN r USING (scope_id, resource_id))""")
def plan_preview(spark, sf):
    """From commits to a plan: heads, remote states, then the three-way join with a local side that edited every third resource and lacks every seventh."""
    commits = fx.commits(spark, sf)
    last = commits.groupBy(*dag.KEY).agg(F.array_sort(F.collect_list(F.struct("counter", "change_type", "content_id")), lambda a, b: (b["counter"] - a["counter"]).cast("int")).alias("c"))

    def state(x):
        gone = x["change_type"] == "Delete"
        return F.when(gone, "Deleted").otherwise("Present").alias("state"), F.when(~gone, x["content_id"])

    s, c = state(F.col("c")[0])
    local = last.where("resource_id % 7 != 0").select(*dag.KEY, s, F.when(F.col("resource_id") % 3 == 0, F.sha2(F.concat(c, F.lit("#L")), 256)).otherwise(c).alias("content_id"))
    s, c = state(F.get("c", F.lit(1)))
    base = last.where("size(c) > 1").select(*dag.KEY, s, c.alias("content_id"))
    return planner.plan_inventory(local, base, dag.remote_state(commits)).select("scope_id", "resource_id", "operation", "conflict_kind")


@query("""SELECT scope_id, resource_id, CASE WHEN op = 'Conflict:ContentVsContent' AND resource_id % 2 = 0 THEN 'Upload' ELSE split_part(op, ':', 1) END AS operation,
 CASE WHEN op = 'Conflict:ContentVsContent' AND resource_id % 2 = 0 THEN NULL ELSE nullif(split_part(op, ':', 2), '') END AS conflict_kind FROM planned""")
def plan_text_merge(spark, sf):
    return planner.merge_texts(_plan(spark, sf), fx.resource_kinds(spark, sf)).select("scope_id", "resource_id", "operation", "conflict_kind")


@query("""WITH ok AS (SELECT split_part(op, ':', 1) AS o, f.resource_id IS NULL AS ok FROM planned p LEFT JOIN failed_t f USING (scope_id, resource_id))
SELECT count(*) FILTER (ok AND o = 'Upload') AS uploaded, count(*) FILTER (ok AND o = 'Download') AS downloaded, count(*) FILTER (ok AND o = 'ApplyDelete') AS deleted_local, count(*) FILTER (ok AND o = 'PublishDelete') AS deleted_remote,
 count(*) FILTER (ok AND o IN ('EstablishBaseline', 'EstablishDeletedBaseline', 'Noop')) AS unchanged, count(*) FILTER (o = 'Conflict') AS conflicts, count(*) FILTER (NOT ok AND o <> 'Conflict') AS failures FROM ok""")
def run_counts(spark, sf):
    return planner.run_counts(_plan(spark, sf), fx.failed_keys(spark, sf))


@query("""WITH wanted AS (SELECT DISTINCT source AS scope_id FROM documents UNION SELECT 'no such scope'),
 c AS (SELECT scope_id, count(*) AS n FROM planned WHERE op LIKE 'Conflict%' GROUP BY 1), f AS (SELECT scope_id, count(*) AS n FROM failed_t GROUP BY 1)
SELECT scope_id, CASE WHEN f.n > 0 THEN 'Failed' WHEN c.n > 0 THEN 'Partial' ELSE 'Complete' END AS status, coalesce(c.n, 0) AS conflicts, coalesce(f.n, 0) AS failures FROM wanted LEFT JOIN c USING (scope_id) LEFT JOIN f USING (scope_id)""")
def scope_report(spark, sf):
    wanted = table(spark, sf, "documents").select(F.col("source").alias("scope_id")).distinct().union(spark.createDataFrame([("no such scope",)], "scope_id string"))
    return planner.scope_reports(wanted, _plan(spark, sf), fx.failed_keys(spark, sf))


@query("SELECT sha256(concat_ws('|', scope_id, resource_id, split_part(op, ':', 2), coalesce(local_id, '-'), coalesce(remote_id, '-'), '')) AS conflict_id, scope_id, resource_id, split_part(op, ':', 2) AS kind FROM planned WHERE op LIKE 'Conflict:%'")
def conflicts_by_scope(spark, sf):
    return planner.conflicts_in(planner.conflict_records(_plan(spark, sf)))


@query("""SELECT source AS scope_id, doc_id AS resource_id, sha256(text) AS content_id, CASE WHEN doc_id % 3 <> 0 THEN 'inventory' WHEN doc_id % 5 > 1 AND doc_id % 4 = doc_id % 8 THEN 'baseline' ELSE 'hashed' END AS source FROM documents WHERE doc_id % 7 NOT IN (0, 1, 2)""")
def lazy_hash_inventory(spark, sf):
    """Every third local row has no content id yet."""
    token = lambda by: F.concat(F.lit("v"), (F.col("resource_id") % by).cast("string"))
    local = fx.local_inventory(spark, sf).where("resource_id % 7 NOT IN (1, 2)").select(*dag.KEY, F.when(F.col("resource_id") % 3 != 0, F.col("content_id")).alias("content_id"), token(4).alias("version_token"))
    base = fx.baselines(spark, sf).select(*dag.KEY, "state", "content_id", token(8).alias("local_version"))
    content = table(spark, sf, "documents").select(F.col("source").alias("scope_id"), F.col("doc_id").alias("resource_id"), F.col("text").alias("data"))
    return planner.lazy_inventory(local, base, content)


@query("""SELECT scope_id, resource_id, l.token IS NOT DISTINCT FROM m.expected AS applied FROM (SELECT source AS scope_id, doc_id AS resource_id, CASE WHEN doc_id % 6 <> 0 THEN 'v' || (doc_id % 4) END AS expected FROM documents) m
 LEFT JOIN (SELECT scope_id, resource_id, 'v' || (resource_id % 8) AS token FROM local_t) l USING (scope_id, resource_id)""")
def apply_precondition(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("scope_id"), F.col("doc_id").alias("resource_id"))
    token = lambda by: F.concat(F.lit("v"), (F.col("resource_id") % by).cast("string"))
    wanted = docs.withColumn("expected", F.when(F.col("resource_id") % 6 != 0, token(4)))
    local = fx.local_inventory(spark, sf).withColumn("version_token", token(8))
    return planner.apply_preconditions(wanted, local).select("scope_id", "resource_id", (F.col("status") == "Applied").alias("applied"))


@query("SELECT 'me' AS client_id, scope_id, resource_id FROM planned ANTI JOIN failed_t USING (scope_id, resource_id) WHERE op NOT LIKE 'Conflict%'")
def ack_emission(spark, sf):
    return planner.acknowledgements(_plan(spark, sf), "me", fx.failed_keys(spark, sf)).drop("observed_heads")


# ---- the commit graph


@query("SELECT scope_id, resource_id, id FROM heads")
def remote_heads(spark, sf):
    return dag.heads(fx.commits(spark, sf)).select("scope_id", "resource_id", "id")


@query("SELECT scope_id, resource_id, min(id) AS id FROM heads GROUP BY ALL")
def first_heads(spark, sf):
    return dag.first_head(fx.commits(spark, sf))


@query("SELECT scope_id, resource_id, state, CASE WHEN state = 'Present' THEN any_id END AS content_id, CASE WHEN state = 'Present' THEN any_size ELSE -1 END AS size, heads FROM states")
def remote_state(spark, sf):
    return dag.remote_state(fx.commits(spark, sf)).withColumns({"heads": _joined(F.col("heads")), "size": F.coalesce("size", F.lit(-1))})


@query("SELECT scope_id, resource_id, count(*) AS head_count, string_agg(id, ',' ORDER BY id) AS heads FROM heads GROUP BY ALL HAVING count(*) > 1")
def fork_report(spark, sf):
    return dag.forks(fx.commits(spark, sf)).withColumn("heads", _joined(F.col("heads")))


_REACH = """WITH RECURSIVE reach AS (SELECT resource_id, id AS start, id AS ancestor FROM commits WHERE id % 50 = 0 UNION SELECT r.resource_id, r.start, e.parent FROM reach r JOIN edges e ON e.resource_id = r.resource_id AND e.id = r.ancestor)"""


@query(f"{_REACH} SELECT resource_id, start, ancestor FROM reach")
def ancestors(spark, sf):
    commits = fx.commits(spark, sf)
    return dag.ancestors(commits, commits.where("id % 50 = 0").select("resource_id", F.col("id").alias("start")))


@query(f"{_REACH} SELECT c.resource_id, c.id AS commit, k.id AS ancestor, r.start IS NOT NULL AS descendant FROM commits c JOIN checkpoint k USING (resource_id) LEFT JOIN reach r ON r.start = c.id AND r.ancestor = k.id WHERE c.id % 50 = 0")
def is_descendant(spark, sf):
    commits = fx.commits(spark, sf)
    points = fx.checkpoints(spark, sf).select("resource_id", F.col("id").alias("ancestor"))
    return dag.is_descendant(commits, commits.where("id % 50 = 0").select("resource_id", F.col("id").alias("commit")).join(points, "resource_id"))


@query("SELECT scope_id, resource_id, id, author, millis, change_type = 'Delete' AS deleted FROM commits")
def history(spark, sf):
    return dag.history(fx.commits(spark, sf))


# ---- the catalog


def _delta(spark, sf, scopes=()):
    return catalog.catalog_delta(fx.snapshot_events(spark, sf), fx.segments(spark, sf), fx.cursors(spark, sf), fx.coverage(spark, sf), list(scopes))


@query("SELECT * FROM delta")
def catalog_delta(spark, sf):
    return _delta(spark, sf)


@query(f"SELECT * FROM delta WHERE scope_id IN {tuple(fx.WANTED)}")
def catalog_delta_scoped(spark, sf):
    return _delta(spark, sf, fx.WANTED)


@query("SELECT client_id, scope_id, max(counter) AS counter FROM seg GROUP BY ALL")
def next_cursors(spark, sf):
    return catalog.next_cursors(fx.cursors(spark, sf), fx.coverage(spark, sf), fx.segments(spark, sf))


@query("SELECT DISTINCT commit_id FROM delta WHERE commit_id % 3 <> 0")
def missing_commits(spark, sf):
    return catalog.missing_commits(_delta(spark, sf), fx.commits(spark, sf).where("id % 3 = 0"))


@query("SELECT author AS client_id, scope_id, min(counter) AS first_counter, max(counter) AS last_counter, count(*) AS events FROM commits GROUP BY ALL")
def segment_summary(spark, sf):
    return catalog.segment_summary(fx.commits(spark, sf))


@query(f"SELECT scope_id, count(*) AS events, count(*) >= {catalog.SNAPSHOT_AFTER} AS due FROM delta d LEFT JOIN cov v USING (client_id, scope_id) WHERE d.counter > coalesce(v.counter, 0) GROUP BY 1")
def snapshot_due(spark, sf):
    return catalog.snapshot_due(_delta(spark, sf), fx.coverage(spark, sf))


@query("SELECT scope_id, 'c' || (id % 3) AS client_id, resource_id, max(id) AS head FROM commits GROUP BY ALL")
def latest_acks(spark, sf):
    acks = fx.commits(spark, sf).select(F.col("author").alias("client_id"), "scope_id", "resource_id", F.col("id").alias("seq"), F.col("id").alias("head"))
    return catalog.latest_acks(acks).drop("seq")


# ---- retention


@query("SELECT scope_id, resource_id, id FROM commits QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY millis DESC, id DESC) <= 5 UNION SELECT * FROM checkpoint UNION SELECT scope_id, resource_id, id FROM commits WHERE id % 40 = 7")
def retained_commits(spark, sf):
    return retention.retained(fx.commits(spark, sf), 5, fx.checkpoints(spark, sf), fx.pinned(spark, sf))


@query("SELECT scope_id, resource_id, id FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY millis DESC, id DESC) AS n FROM commits) WHERE n > 5 AND id % 40 <> 7 AND id NOT IN (SELECT id FROM checkpoint)")
def obsolete_commits(spark, sf):
    return retention.obsolete(fx.commits(spark, sf), retained_commits(spark, sf))


_QUORUM = """WITH RECURSIVE reach AS (SELECT DISTINCT resource_id, head AS start, head AS ancestor FROM acks UNION SELECT r.resource_id, r.start, e.parent FROM reach r JOIN edges e ON e.resource_id = r.resource_id AND e.id = r.ancestor),
 good AS (SELECT DISTINCT a.client_id, a.resource_id FROM acks a JOIN checkpoint k USING (resource_id) JOIN reach r ON r.start = a.head AND r.ancestor = k.id),
 votes AS (SELECT DISTINCT c.scope_id, c.resource_id, c.author AS client_id FROM commits c JOIN checkpoint USING (resource_id) WHERE c.author <> 'c2'),
 quorums AS (SELECT scope_id, resource_id, count(*) AS active, count(g.client_id) AS acknowledged, count(*) = count(g.client_id) AS quorum FROM votes v LEFT JOIN good g USING (resource_id, client_id) GROUP BY ALL)"""


@query(f"{_QUORUM} SELECT * FROM quorums")
def ack_quorum(spark, sf):
    """Client c2 has retired."""
    commits = fx.commits(spark, sf)
    active = retention.active_clients(commits, spark.createDataFrame([("c2",)], "client_id string"))
    return retention.quorum(commits, fx.checkpoints(spark, sf), fx.acks(spark, sf), active)


@query(f"""{_QUORUM} SELECT c.scope_id, c.resource_id, CASE WHEN count(*) <= 5 THEN 'Skip' WHEN any_value(h.n) <> 1 OR c.resource_id % 9 = 0 OR c.resource_id % 10 = 0 THEN 'Deferred' WHEN any_value(k.id) IS NULL OR c.resource_id % 8 = 0 THEN 'Checkpoint' WHEN any_value(q.quorum) THEN 'Reclaim' ELSE 'Deferred' END AS phase
FROM commits c JOIN (SELECT resource_id, count(*) AS n FROM heads GROUP BY 1) h USING (resource_id) LEFT JOIN checkpoint k USING (resource_id) LEFT JOIN quorums q USING (resource_id) GROUP BY c.scope_id, c.resource_id""")
def maintenance_phases(spark, sf):
    """Every ninth resource is in conflict, every tenth a text, every eighth has no checkpoint yet."""
    commits = fx.commits(spark, sf)
    keys = commits.select(*dag.KEY).distinct()
    kinds = keys.withColumn("kind", F.when(F.col("resource_id") % 10 == 0, "Text").otherwise("Binary"))
    return retention.phases(commits, 5, kinds, keys.where("resource_id % 9 = 0"), fx.checkpoints(spark, sf).where("resource_id % 8 != 0"), ack_quorum(spark, sf))


# ---- chunks and packs


@query("SELECT DISTINCT hash FROM manifest")
def live_chunks(spark, sf):
    return packs.live_hashes(fx.manifests(spark, sf))


@query("SELECT DISTINCT pack_id FROM packed WHERE pack_id NOT IN (SELECT pack_id FROM packed JOIN live USING (hash))")
def dead_packs(spark, sf):
    return packs.dead_packs(fx.pack_index(spark, sf), fx.live_chunks(spark, sf))


@query("SELECT pack_id, live_bytes, dead_bytes, action FROM classes")
def pack_gc_class(spark, sf):
    return packs.classify(fx.pack_index(spark, sf), fx.live_chunks(spark, sf))


@query("SELECT action, count(*) AS packs, CAST(sum(dead_bytes) AS BIGINT) AS bytes FROM classes WHERE action IN ('Delete', 'Repack') GROUP BY 1")
def bytes_reclaimed(spark, sf):
    return packs.reclaimed(packs.classify(fx.pack_index(spark, sf), fx.live_chunks(spark, sf)))


@query("SELECT pack_id, hash, length FROM packed JOIN classes USING (pack_id) SEMI JOIN live USING (hash) WHERE action = 'Repack'")
def repack_survivors(spark, sf):
    return packs.survivors(fx.pack_index(spark, sf), fx.live_chunks(spark, sf)).drop("offset")


@query("SELECT pack_id, hash, length, CAST(sum(length) OVER (PARTITION BY pack_id ORDER BY slot) - length AS BIGINT) AS \"offset\" FROM packed")
def chunk_offsets(spark, sf):
    return fx.pack_index(spark, sf).drop("slot")


@query("""WITH RECURSIVE piece AS (SELECT source AS group_id, doc_id AS position, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1),
 fold AS (SELECT group_id, position, n, k, CAST(0 AS BIGINT) AS pack, n AS held FROM piece WHERE k = 1
  UNION ALL SELECT p.group_id, p.position, p.n, p.k, CASE WHEN f.held >= 20000 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.held >= 20000 THEN p.n ELSE f.held + p.n END FROM fold f JOIN piece p ON p.group_id = f.group_id AND p.k = f.k + 1)
SELECT group_id, pack, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS size FROM fold GROUP BY ALL""")
def greedy_packs(spark, sf):
    """Documents as chunks, packed by source; a pack is sealed at 20,000 characters."""
    rows = table(spark, sf, "documents").select(F.col("source").alias("group_id"), F.col("doc_id").alias("position"), F.sha2("text", 256).alias("hash"), F.char_length("text").alias("length"))
    return packs.greedy_packs(rows, 20_000).groupBy("group_id", "pack").agg(F.count("*").alias("chunks"), F.sum("length").alias("size"))


@query("SELECT DISTINCT hash FROM manifest WHERE hash NOT IN (SELECT hash FROM packed WHERE pack_id % 2 = 0)")
def chunk_dedup(spark, sf):
    return packs.new_chunks(packs.live_hashes(fx.manifests(spark, sf)), fx.pack_index(spark, sf).where("pack_id % 2 = 0"))


@query("SELECT hash, min(pack_id) AS pack_id FROM (SELECT hash, pack_id FROM packed UNION ALL SELECT hash, pack_id - 1 FROM packed WHERE slot % 3 = 0) SEMI JOIN live USING (hash) GROUP BY 1")
def chunk_lookup(spark, sf):
    """Every third chunk is in two packs."""
    index = fx.pack_index(spark, sf)
    twice = index.where("slot % 3 = 0").withColumn("pack_id", F.col("pack_id") - 1)
    return packs.locations(index.unionByName(twice), fx.live_chunks(spark, sf)).select("hash", "pack_id")


@query("SELECT pack_id, count(*) AS ranges, CAST(sum(length) AS BIGINT) AS bytes FROM packed WHERE hash IN (SELECT hash FROM manifest WHERE resource_id % 10 = 0) GROUP BY 1")
def download_plan_by_pack(spark, sf):
    return packs.ranges_by_pack(fx.manifests(spark, sf).where("resource_id % 10 = 0"), fx.pack_index(spark, sf))


@query("SELECT doc_id AS resource_id, CASE WHEN NOT bad THEN sha256(text) END AS content_id, CAST(ceil(length(text) / 1000) AS BIGINT) AS n_chunks, NOT bad AS ok FROM (SELECT *, starts_with(sha256(substring(text, 1, 1000)), '0') AS bad FROM documents) WHERE text <> ''")
def reassemble_verify(spark, sf):
    """Documents cut every 1,000 characters, stored once for each hash, put together again. First pieces whose hash begins with 0 are stored damaged; documents that hold them are not ok."""
    docs = table(spark, sf, "documents").where("text != ''").select(F.col("doc_id").alias("resource_id"), "text")
    n = F.ceil(F.char_length("text") / 1000).cast("int")
    pieces = docs.select("resource_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("text").substr(i * 1000 + 1, F.lit(1000)))).alias("position", "piece"))
    rows = pieces.select("resource_id", "position", F.sha2("piece", 256).alias("hash"), F.encode("piece", "UTF-8").alias("bytes"))
    damaged = F.col("hash").startswith("0") & (F.col("position") == 0)
    stored = rows.groupBy("hash").agg(F.max(damaged).alias("bad"), F.first("bytes").alias("bytes")).select("hash", F.when(F.col("bad"), F.concat("bytes", F.lit(b"!"))).otherwise(F.col("bytes")).alias("bytes"))
    out = packs.reassemble(rows.select("resource_id", "position", "hash"), stored)
    return out.select("resource_id", F.sha2("data", 256).alias("content_id"), "n_chunks", "ok")


@query()
def cdc_chunks(spark, sf):
    """Pages in content-defined chunks, an eighth of the usual sizes as pages are short."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("resource_id"), F.encode("html", "UTF-8").alias("data"))
    return cdc.chunk_rows(pages, cdc.MIN_SIZE // 8, cdc.AVG_SIZE // 8, cdc.MAX_SIZE // 8)


# ---- the linear log


@query(r"""WITH name AS (SELECT CASE file_id % 9 WHEN 1 THEN 'nope.txt' WHEN 2 THEN 'nounderscore.oplog' WHEN 3 THEN 'x_' || client_id || '.oplog' WHEN 4 THEN sequence || '_.oplog' WHEN 5 THEN sequence || '_a_' || client_id || '.oplog' ELSE sequence || '_' || client_id || '.oplog' END AS name FROM own_log)
SELECT name, CASE WHEN regexp_matches(name, '^\d+_.+\.oplog$') THEN CAST(split_part(name, '_', 1) AS BIGINT) ELSE -1 END AS sequence, CASE WHEN regexp_matches(name, '^\d+_.+\.oplog$') THEN regexp_extract(name, '^\d+_(.+)\.oplog$', 1) END AS client_id FROM name""")
def oplog_parse(spark, sf):
    log = table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("sequence"), F.col("role").alias("client_id"))
    case, s = F.col("file_id") % 9, F.col("sequence").cast("string")
    name = F.when(case == 1, "nope.txt").when(case == 2, "nounderscore.oplog").when(case == 3, F.concat(F.lit("x_"), "client_id", F.lit(".oplog"))).when(case == 4, F.concat(s, F.lit("_.oplog")))
    name = name.when(case == 5, scalar.oplog_name(F.col("sequence"), F.concat(F.lit("a_"), "client_id"))).otherwise(scalar.oplog_name(F.col("sequence"), F.col("client_id")))
    return log.select(name.alias("name")).withColumn("p", scalar.parse_oplog_name(F.col("name"))).select("name", F.coalesce("p.sequence", F.lit(-1)).alias("sequence"), F.col("p.client").alias("client_id"))


@query("SELECT file_id, sequence, count(DISTINCT client_id) AS clients FROM oplog GROUP BY ALL HAVING count(DISTINCT client_id) > 1")
def forked_sequences(spark, sf):
    return oplog.forked_sequences(fx.oplog(spark, sf))


@query("SELECT file_id, sequence FROM oplog GROUP BY ALL HAVING min(client_id) <> max(client_id)")
def forks_by_neighbours(spark, sf):
    return oplog.forked_by_neighbours(fx.oplog(spark, sf))


@query("SELECT file_id, sequence AS head, count(*) AS entries, count(*) > 1 AS forked FROM oplog o WHERE sequence = (SELECT max(sequence) FROM oplog x WHERE x.file_id = o.file_id) GROUP BY ALL")
def tip_fork(spark, sf):
    return oplog.tips(fx.oplog(spark, sf))


@query("SELECT file_id, sequence, client_id, text FROM oplog WHERE sequence <= 3 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY sequence DESC, client_id, text) = 1")
def asof_state(spark, sf):
    return oplog.as_of(fx.oplog(spark, sf), 3, "text")


@query("SELECT file_id, max(sequence) AS latest, least(greatest(max(sequence) - 2, 0), (SELECT min(last_sequence) FROM status_t)) AS cut, least(greatest(max(sequence) - 2, 0), (SELECT min(last_sequence) FROM status_t)) = 0 AS deferred FROM oplog GROUP BY 1")
def truncation_cut(spark, sf):
    return oplog.truncation_cuts(fx.oplog(spark, sf), fx.client_status(spark, sf), 2)


@query("""WITH cuts AS (SELECT file_id, least(greatest(max(sequence) - 2, 0), 3) AS cut FROM oplog GROUP BY 1)
SELECT count(*) AS files, count(*) FILTER (cut = 0) AS deferred, (SELECT count(*) FROM oplog JOIN cuts USING (file_id) WHERE sequence <= cut) AS entries_deleted FROM cuts""")
def truncation_report(spark, sf):
    """All clients have reached sequence 3."""
    log = fx.oplog(spark, sf)
    return oplog.truncation_report(oplog.truncation_cuts(log, spark.createDataFrame([(3,)], "last_sequence long"), 2), log)


@query("""WITH RECURSIVE side AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sequence, client_id) AS n, row_number() OVER (PARTITION BY file_id, sequence ORDER BY client_id) AS r FROM mlog),
 fold AS (SELECT file_id, n, sequence, CAST(NULL AS VARCHAR) AS before, manifest AS now, false AS c FROM side WHERE n = 1
  UNION ALL SELECT s.file_id, s.n, s.sequence, CASE WHEN s.r = 1 THEN f.now ELSE f.before END,
   CASE WHEN s.r = 1 THEN s.manifest WHEN f.now IS NOT DISTINCT FROM s.manifest THEN f.now WHEN f.now IS NULL OR s.manifest IS NULL THEN f.now WHEN f.now IS NOT DISTINCT FROM f.before THEN s.manifest ELSE f.now END,
   f.c OR (s.r > 1 AND f.now IS DISTINCT FROM s.manifest AND (f.now IS NULL OR s.manifest IS NULL OR (f.now IS DISTINCT FROM f.before AND s.manifest IS DISTINCT FROM f.before)))
  FROM fold f JOIN side s ON s.file_id = f.file_id AND s.n = f.n + 1)
SELECT file_id, sequence AS head, now AS manifest, now IS NULL AS deleted, c AS conflicted FROM fold QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC) = 1""")
def manifest_fold(spark, sf):
    return oplog.fold_manifests(fx.manifest_log(spark, sf))


_SIDES = "sides AS (SELECT resource_id, m AS base, CASE WHEN resource_id % 4 < 2 THEN m ELSE m || '+' END AS l, CASE resource_id % 3 WHEN 0 THEN m WHEN 1 THEN m || '+' ELSE m || '-' END AS r FROM (SELECT resource_id, string_agg(part, ',' ORDER BY position) AS m FROM manifest GROUP BY 1))"


@query(f"""WITH {_SIDES} SELECT resource_id, CASE WHEN l = base AND r = base OR l = r THEN 'Unchanged' WHEN l = base OR r = base THEN 'FastForward' ELSE 'Conflict' END AS outcome, sha256(CASE WHEN l = base THEN r ELSE l END) AS resolved, l <> base AND r <> base AND l <> r AS needs_copy FROM sides""")
def manifest_merge(spark, sf):
    """The policy is to keep both; resolved is shown by its hash."""
    m = fx.manifests(spark, sf).groupBy("resource_id").agg(_joined(F.transform(F.array_sort(F.collect_list(F.struct("position", "part"))), lambda x: x["part"])).alias("m"))
    r, more = F.col("resource_id"), lambda c: F.concat("m", F.lit(c))
    local = F.when(r % 4 < 2, F.col("m")).otherwise(more("+"))
    remote = F.when(r % 3 == 0, F.col("m")).when(r % 3 == 1, more("+")).otherwise(more("-"))
    out = m.select("resource_id", oplog.merge_manifests(F.col("m"), local, remote, "KeepBoth").alias("x"))
    return out.select("resource_id", "x.outcome", F.sha2("x.resolved", 256).alias("resolved"), "x.needs_copy")


# ---- scalar functions


_STEPS = "[0, " + ", ".join(str(1 << k) for k in range(30, -1, -1)) + "]"


@query(f"""WITH pair AS (SELECT doc_id, text AS old, substring(text, 1, length(text) // 3) || 'edited ' || substring(text, length(text) // 3 * 2 + 1) AS new FROM documents),
 head AS (SELECT *, list_reduce({_STEPS}::BIGINT[], lambda a, p: CASE WHEN a + p <= least(length(old), length(new)) AND left(old, a + p) = left(new, a + p) THEN a + p ELSE a END) AS s FROM pair),
 tail AS (SELECT *, list_reduce({_STEPS}::BIGINT[], lambda a, p: CASE WHEN a + p <= least(length(old), length(new)) - s AND substring(old, length(old) - a - p + 1) = substring(new, length(new) - a - p + 1) THEN a + p ELSE a END) AS t FROM head)
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(length(old) - s - t AS INTEGER) AS delete_len, substring(new, s + 1, length(new) - s - t) AS "insert", true AS round_trip FROM tail""")
def text_diff(spark, sf):
    """Documents whose middle third was edited."""
    third = F.expr("char_length(text) div 3").cast("int")
    new = F.concat(F.col("text").substr(F.lit(1), third), F.lit("edited "), F.col("text").substr(third * 2 + 1, F.char_length("text")))
    pairs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("old"), new.alias("new")).withColumn("d", scalar.diff_middle(F.col("old"), F.col("new")))
    return pairs.select("doc_id", "d.*", (scalar.apply_diff(F.col("old"), F.col("d")) == F.col("new")).alias("round_trip"))


@query("SELECT doc_id, sha256(text) AS content_id, source || chr(0) || doc_id AS key, sha256(CAST(doc_id AS VARCHAR)) || '.json' AS object_name, (doc_id << 16) | CAST('0x' || substring(sha256(source), 1, 4) AS BIGINT) AS generation FROM documents")
def identities(spark, sf):
    """Content addresses, composite keys, object names and snapshot generations."""
    docs, key = table(spark, sf, "documents"), F.col("doc_id").cast("string")
    return docs.select("doc_id", scalar.digest(F.col("text")).alias("content_id"), scalar.encode_key(F.col("source"), key).alias("key"), scalar.object_name(key).alias("object_name"), scalar.snapshot_generation_of(F.col("doc_id"), F.col("source")).alias("generation"))
