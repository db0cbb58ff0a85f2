"""Inputs of the queries, derived from the given tables: as DataFrames, and as SQL for the oracle (SQL, in order of dependence)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import table

SQL: dict[str, str] = {}


def oracle(sql: str) -> str:
    """The query after the derived tables that it needs."""
    need: set[str] = set()

    def add(text: str) -> None:
        for name in SQL:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                add(SQL[name])

    add(sql)
    body = ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in need)
    sql = sql.strip()
    recursive = "WITH RECURSIVE" if "RECURSIVE" in sql else "WITH"
    if not body:
        return sql
    if sql.startswith("WITH "):
        return f"{recursive} {body}, {sql.removeprefix('WITH RECURSIVE ').removeprefix('WITH ')}"
    return f"{recursive} {body} {sql}"


# ---- three inventories from documents


def _inventory(docs: DataFrame, by: int, gone: int, states: dict[int, str], edits: dict[int, str]) -> DataFrame:
    """Rows with doc_id % by = gone are left out; Present and unchanged where nothing else is said."""
    slot = F.col("doc_id") % by
    state, content = F.lit("Present"), F.sha2("text", 256)
    for i, s in states.items():
        state, content = F.when(slot == i, s).otherwise(state), F.when(slot == i, F.lit(None)).otherwise(content)
    for i, mark in edits.items():
        content = F.when(slot == i, F.sha2(F.concat("text", F.lit(mark)), 256)).otherwise(content)
    return docs.where(slot != gone).select(F.col("source").alias("scope_id"), F.col("doc_id").alias("resource_id"), state.alias("state"), content.alias("content_id"))


def local_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return _inventory(table(spark, sf, "documents"), 7, 0, {2: "Deleted"}, {1: "#L"})


def baselines(spark: SparkSession, sf: str) -> DataFrame:
    return _inventory(table(spark, sf, "documents"), 5, 0, {1: "Deleted"}, {})


def remote_resources(spark: SparkSession, sf: str) -> DataFrame:
    return _inventory(table(spark, sf, "documents"), 11, 0, {1: "Deleted", 2: "Forked"}, {3: "#R", 4: "#L"})


def failed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Resources whose operation fails."""
    return table(spark, sf, "documents").where("doc_id % 97 = 5").select(F.col("source").alias("scope_id"), F.col("doc_id").alias("resource_id"))


def resource_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("scope_id"), F.col("doc_id").alias("resource_id"), F.when(F.col("doc_id") % 2 == 0, "Text").otherwise("Binary").alias("kind"))


SQL["local_t"] = "SELECT source AS scope_id, doc_id AS resource_id, CASE WHEN doc_id % 7 = 2 THEN 'Deleted' ELSE 'Present' END AS state, CASE doc_id % 7 WHEN 1 THEN sha256(text || '#L') WHEN 2 THEN NULL ELSE sha256(text) END AS content_id FROM documents WHERE doc_id % 7 <> 0"
SQL["base_t"] = "SELECT source AS scope_id, doc_id AS resource_id, CASE WHEN doc_id % 5 = 1 THEN 'Deleted' ELSE 'Present' END AS state, CASE WHEN doc_id % 5 = 1 THEN NULL ELSE sha256(text) END AS content_id FROM documents WHERE doc_id % 5 <> 0"
SQL["remote_t"] = "SELECT source AS scope_id, doc_id AS resource_id, CASE doc_id % 11 WHEN 1 THEN 'Deleted' WHEN 2 THEN 'Forked' ELSE 'Present' END AS state, CASE doc_id % 11 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN sha256(text || '#R') WHEN 4 THEN sha256(text || '#L') ELSE sha256(text) END AS content_id FROM documents WHERE doc_id % 11 <> 0"
SQL["failed_t"] = "SELECT source AS scope_id, doc_id AS resource_id FROM documents WHERE doc_id % 97 = 5"


def case_sql(l_state: str, l_id: str, b_state: str, b_id: str, r_state: str, r_id: str) -> str:
    """The planner as a decision by remote state; a side that is absent has a null state."""
    return f"""CASE coalesce({r_state}, 'Missing')
  WHEN 'Forked' THEN 'Conflict:RemoteFork'
  WHEN 'Missing' THEN CASE WHEN {l_state} = 'Present' THEN 'Upload' ELSE 'Noop' END
  WHEN 'Deleted' THEN CASE WHEN {l_state} IS DISTINCT FROM 'Present' THEN 'EstablishDeletedBaseline' WHEN {b_state} = 'Deleted' THEN 'Upload' WHEN {b_state} = 'Present' AND {l_id} = {b_id} THEN 'ApplyDelete' ELSE 'Conflict:ModifyVsDelete' END
  ELSE CASE WHEN {l_state} IS DISTINCT FROM 'Present' THEN CASE WHEN {b_state} IS NULL OR {b_state} = 'Deleted' THEN 'Download' WHEN {r_id} = {b_id} THEN 'PublishDelete' ELSE 'Conflict:DeleteVsModify' END
   WHEN {l_id} = {r_id} THEN 'EstablishBaseline' WHEN {b_state} IS NULL THEN 'Conflict:InitialDivergence'
   WHEN {b_state} = 'Present' AND {l_id} = {b_id} THEN 'Download' WHEN {b_state} = 'Present' AND {r_id} = {b_id} THEN 'Upload' ELSE 'Conflict:ContentVsContent' END END"""


SQL["planned"] = f"""SELECT scope_id, resource_id, l.content_id AS local_id, b.content_id AS base_id, r.content_id AS remote_id, {case_sql('l.state', 'l.content_id', 'b.state', 'b.content_id', 'r.state', 'r.content_id')} AS op
 FROM local_t l FULL JOIN base_t b USING (scope_id, resource_id) FULL JOIN remote_t r USING (scope_id, resource_id)"""

# ---- commits from events


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """A resource for each user: its events in order, each the child of the one before; every 97th skips one (a fork), every 17th merges with an older one."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf, "events").withColumn("rn", F.row_number().over(order).cast("long"))
    one, two, three = (F.lag("event_id", k).over(order) for k in (1, 2, 3))
    i = F.col("event_id")
    parents = F.array(F.when((i % 97 == 0) & (F.col("rn") > 2), two).otherwise(one), F.when((i % 17 == 0) & (F.col("rn") > 3), three))
    deleted = i % 11 == 0
    return ev.select(
        i.alias("id"), F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("scope_id"), F.col("user_id").alias("resource_id"), F.array_distinct(F.array_compact(parents)).alias("parents"),
        F.concat(F.lit("c"), (i % 3).cast("string")).alias("author"), F.col("rn").alias("counter"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("millis"),
        F.when(deleted, "Delete").otherwise("BinarySnapshot").alias("change_type"), F.when(~deleted, F.sha2((i % 3).cast("string"), 256)).alias("content_id"), F.when(~deleted, i % 3 * 100).alias("size"),
    )


SQL["numbered"] = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"
SQL["commits"] = """SELECT event_id AS id, 's' || (user_id % 5) AS scope_id, user_id AS resource_id, CASE WHEN event_id % 97 = 0 AND rn > 2 THEN lag(event_id, 2) OVER w ELSE lag(event_id) OVER w END AS p1, CASE WHEN event_id % 17 = 0 AND rn > 3 THEN lag(event_id, 3) OVER w END AS p2,
 'c' || (event_id % 3) AS author, rn AS counter, epoch_us(ts) // 1000 AS millis, CASE WHEN event_id % 11 = 0 THEN 'Delete' ELSE 'BinarySnapshot' END AS change_type, CASE WHEN event_id % 11 <> 0 THEN sha256(CAST(event_id % 3 AS VARCHAR)) END AS content_id, CASE WHEN event_id % 11 <> 0 THEN event_id % 3 * 100 END AS size
 FROM numbered WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
SQL["edges"] = "SELECT resource_id, id, p1 AS parent FROM commits WHERE p1 IS NOT NULL UNION SELECT resource_id, id, p2 FROM commits WHERE p2 IS NOT NULL"
SQL["heads"] = "SELECT c.* FROM commits c ANTI JOIN (SELECT resource_id, parent AS id FROM edges) e USING (resource_id, id)"
SQL["states"] = """SELECT scope_id, resource_id, CASE WHEN bool_and(change_type = 'Delete') THEN 'Deleted' WHEN bool_and(change_type <> 'Delete') AND count(DISTINCT content_id || ':' || size) = 1 THEN 'Present' ELSE 'Forked' END AS state,
 min(content_id) AS any_id, min(size) AS any_size, string_agg(id, ',' ORDER BY id) AS heads FROM heads GROUP BY ALL"""


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """The newest commit but two of each resource."""
    order = Window.partitionBy("scope_id", "resource_id").orderBy(F.col("counter").desc())
    return commits(spark, sf).withColumn("k", F.row_number().over(order)).where("k = 3").select("scope_id", "resource_id", "id")


def acks(spark: SparkSession, sf: str) -> DataFrame:
    """Every author of a resource observed its newest commit; client c0 is late for every fourth resource, and has seen its first commit only."""
    own = commits(spark, sf).groupBy("scope_id", "resource_id", F.col("author").alias("client_id")).agg(F.lit(1).alias("one"))
    ends = commits(spark, sf).groupBy("scope_id", "resource_id").agg(F.max_by("id", "counter").alias("last"), F.min_by("id", "counter").alias("first"))
    late = (F.col("client_id") == "c0") & (F.col("resource_id") % 4 == 0)
    return own.join(ends, ["scope_id", "resource_id"]).select("client_id", "scope_id", "resource_id", F.array(F.when(late, F.col("first")).otherwise(F.col("last"))).alias("observed_heads"))


def pinned(spark: SparkSession, sf: str) -> DataFrame:
    return commits(spark, sf).where("id % 40 = 7").select("scope_id", "resource_id", "id")


SQL["checkpoint"] = "SELECT scope_id, resource_id, id FROM commits QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY counter DESC) = 3"
SQL["acks"] = "SELECT DISTINCT author AS client_id, scope_id, resource_id, CASE WHEN author = 'c0' AND resource_id % 4 = 0 THEN first ELSE last END AS head FROM commits JOIN (SELECT resource_id, arg_max(id, counter) AS last, arg_min(id, counter) AS first FROM commits GROUP BY 1) USING (resource_id)"

# ---- the catalog from events

WANTED = ["click", "purchase", "view"]


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Counters go up by client and scope."""
    order = Window.partitionBy("client_id", "scope_id").orderBy("ts", "event_id")
    ev = table(spark, sf, "events").select((F.col("user_id") % 50).alias("client_id"), F.col("event_type").alias("scope_id"), "ts", "event_id", "user_id")
    return ev.withColumn("counter", F.row_number().over(order).cast("long")).select("client_id", "scope_id", "counter", F.col("event_id").alias("commit_id"), F.col("user_id").alias("resource_id"))


def _part(spark: SparkSession, sf: str, by: int) -> DataFrame:
    return segments(spark, sf).groupBy("client_id", "scope_id").agg((F.max("counter") / by).cast("long").alias("counter"))


def cursors(spark: SparkSession, sf: str) -> DataFrame:
    """A third was seen; every fourth client is new."""
    return _part(spark, sf, 3).where("client_id % 4 != 0")


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots cover half of the even clients' events."""
    return _part(spark, sf, 2).where("client_id % 2 = 0")


def snapshot_events(spark: SparkSession, sf: str) -> DataFrame:
    met = segments(spark, sf).join(coverage(spark, sf).withColumnRenamed("counter", "covered"), ["client_id", "scope_id"])
    return met.where("counter <= covered").drop("covered")


SQL["seg"] = "SELECT user_id % 50 AS client_id, event_type AS scope_id, row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY ts, event_id) AS counter, event_id AS commit_id, user_id AS resource_id FROM events"
SQL["cur"] = "SELECT client_id, scope_id, max(counter) // 3 AS counter FROM seg WHERE client_id % 4 <> 0 GROUP BY ALL"
SQL["cov"] = "SELECT client_id, scope_id, max(counter) // 2 AS counter FROM seg WHERE client_id % 2 = 0 GROUP BY ALL"
SQL["delta"] = "SELECT s.* FROM seg s LEFT JOIN cur c USING (client_id, scope_id) WHERE s.counter > coalesce(c.counter, 0)"

# ---- packs from parts, manifests from line items


def pack_index(spark: SparkSession, sf: str) -> DataFrame:
    """Forty parts a pack."""
    from tidemark.operators.packs import with_offsets

    rows = table(spark, sf, "part").select(F.expr("p_partkey div 40").alias("pack_id"), F.col("p_partkey").alias("slot"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("hash"), F.col("p_size").cast("long").alias("length"))
    return with_offsets(rows, ["pack_id"], ["slot"]).select("pack_id", "slot", "hash", "offset", "length")


def live_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Of the parts that are ordered: all of every fourth pack, none, 34, or 10 of the next ones."""
    pack, slot = F.expr("p_partkey div 40 % 4"), F.col("p_partkey") % 40
    ok = F.when(pack == 0, True).when(pack == 1, False).when(pack == 2, slot < 34).otherwise(slot < 10)
    ordered = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf, "part").where(ok).join(ordered, "p_partkey", "left_semi").select(F.sha2(F.col("p_partkey").cast("string"), 256).alias("hash"))


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """A resource for each order: its parts in order, repeats kept."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("resource_id"), (F.row_number().over(order) - 1).alias("position"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("hash"), F.col("l_partkey").alias("part"))


SQL["packed"] = "SELECT p_partkey // 40 AS pack_id, p_partkey AS slot, sha256(CAST(p_partkey AS VARCHAR)) AS hash, CAST(p_size AS BIGINT) AS length FROM part"
SQL["live"] = "SELECT sha256(CAST(p_partkey AS VARCHAR)) AS hash FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND CASE p_partkey // 40 % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN p_partkey % 40 < 34 ELSE p_partkey % 40 < 10 END"
SQL["classes"] = "SELECT *, CASE WHEN dead_bytes = 0 THEN 'Keep' WHEN live_bytes = 0 THEN 'Delete' WHEN 2 * dead_bytes >= dead_bytes + live_bytes THEN 'Repack' ELSE 'KeepMixed' END AS action FROM (SELECT pack_id, CAST(coalesce(sum(length) FILTER (hash IN (SELECT hash FROM live)), 0) AS BIGINT) AS live_bytes, CAST(coalesce(sum(length) FILTER (hash NOT IN (SELECT hash FROM live)), 0) AS BIGINT) AS dead_bytes FROM packed GROUP BY 1)"
SQL["manifest"] = "SELECT l_orderkey AS resource_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS position, sha256(CAST(l_partkey AS VARCHAR)) AS hash, l_partkey AS part FROM lineitem"

# ---- the linear log from conversations


def oplog(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each conversation; in every third one each turn's author also wrote the turn before."""
    own = table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("sequence"), F.col("role").alias("client_id"), "text")
    again = own.where("file_id % 3 = 0 AND sequence > 0").withColumn("sequence", F.col("sequence") - 1)
    return own.unionByName(again)


def client_status(spark: SparkSession, sf: str) -> DataFrame:
    """The least of the last turns of each role."""
    last = oplog(spark, sf).groupBy("client_id", "file_id").agg(F.max("sequence").alias("s"))
    return last.groupBy("client_id").agg(F.min("s").alias("last_sequence"))


def manifest_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log with a manifest for each entry: a short hash of its text, or a deletion."""
    text = F.substring(F.sha2("text", 256), 1, 1)
    return oplog(spark, sf).select("file_id", "sequence", "client_id", F.when(F.char_length("text") % 7 != 0, text).alias("manifest")).groupBy("file_id", "sequence", "client_id").agg(F.max("manifest").alias("manifest"))


SQL["own_log"] = "SELECT conv_id AS file_id, turn AS sequence, role AS client_id, text FROM conversations"
SQL["oplog"] = "SELECT * FROM own_log UNION ALL SELECT file_id, sequence - 1, client_id, text FROM own_log WHERE file_id % 3 = 0 AND sequence > 0"
SQL["status_t"] = "SELECT client_id, min(s) AS last_sequence FROM (SELECT client_id, file_id, max(sequence) AS s FROM oplog GROUP BY ALL) GROUP BY 1"
SQL["mlog"] = "SELECT file_id, sequence, client_id, max(CASE WHEN length(text) % 7 <> 0 THEN substring(sha256(text), 1, 1) END) AS manifest FROM oplog GROUP BY ALL"
