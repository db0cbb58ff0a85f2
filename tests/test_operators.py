import itertools
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.errors import CorruptError, IoError, RetryExhausted
from tidemark.functions import cdc, scalar
from tidemark.functions.crdt import TextDoc, merged_texts
from tidemark.operators import catalog, dag, oplog, packs, planner
from tidemark.plans import fixtures as fx
from tidemark.sources.remote import COMMITS, FolderRemote
from tidemark.sources.tables import Table
from tidemark.streaming.catalog import ProgressEvents, ingest

SF = "/root/testdata/sf0.001"


# ---- the planner


def arm(local, base, remote):
    """The planner's table, arm by arm. Sides: (state, content id); base and remote may be None."""
    (ls, li), (bs, bi), (rs, ri) = (x or ("None", None) for x in (local, base, remote))
    here, gone = ls == "Present", ls in ("None", "Deleted")
    lb, rb = bs == "Present" and li is not None and li == bi, bs == "Present" and ri is not None and ri == bi
    rules = [
        (1, rs == "Forked", "Conflict:RemoteFork"),
        (2, here and rs == "Present" and li is not None and li == ri, "EstablishBaseline"),
        (3, here and rs == "None", "Upload"),
        (4, gone and rs == "Present" and bs == "None", "Download"),
        (5, gone and rs == "Present" and bs == "Deleted", "Download"),
        (6, here and rs == "Present" and bs == "None", "Conflict:InitialDivergence"),
        (7, here and rs == "Present" and lb, "Download"),
        (8, here and rs == "Present" and rb, "Upload"),
        (9, here and rs == "Present", "Conflict:ContentVsContent"),
        (10, gone and rs == "Present" and rb, "PublishDelete"),
        (11, gone and rs == "Present", "Conflict:DeleteVsModify"),
        (12, here and rs == "Deleted" and lb, "ApplyDelete"),
        (13, here and rs == "Deleted" and bs == "Deleted", "Upload"),
        (14, here and rs == "Deleted", "Conflict:ModifyVsDelete"),
        (15, gone and rs == "Deleted", "EstablishDeletedBaseline"),
        (16, True, "Noop"),
    ]
    return next((n, op) for n, ok, op in rules if ok)


def test_all_sixteen_arms(spark):
    ids = ("a", "b", None)
    locals_ = [None, ("Deleted", None), *(("Present", i) for i in ids)]
    bases = [None, ("Deleted", None), *(("Present", i) for i in ids)]
    remotes = [None, ("Deleted", None), ("Forked", None), *(("Present", i) for i in ids)]
    cases = list(itertools.product(locals_, bases, remotes))
    schema = "scope_id string, resource_id long, state string, content_id string"
    sides = [spark.createDataFrame([("s", k, *c[j]) for k, c in enumerate(cases) if c[j]], schema) for j in range(3)]
    got = {r.resource_id: ":".join(x for x in (r.operation, r.conflict_kind) if x) for r in planner.plan_inventory(*sides).collect()}
    want = {k: arm(*c) for k, c in enumerate(cases) if any(c)}
    assert got == {k: op for k, (_, op) in want.items()}
    assert {n for n, _ in want.values()} == set(range(1, 17))


def test_conflict_ids_and_replacement(spark):
    schema = "scope_id string, resource_id string, operation string, conflict_kind string, local_id string, base_id string, remote_id string, heads array<string>"
    plan = spark.createDataFrame([("s", "r", "Conflict", "RemoteFork", "a", "b", None, ["h1", "h2"]), ("t", "r", "Conflict", "RemoteFork", "a", "b", None, ["h1", "h2"]), ("t", "q", "Noop", None, None, None, None, None)], schema)
    ids = {r.conflict_id for r in planner.conflict_records(plan).collect()}
    assert len(ids) == 2 and ids == {r.conflict_id for r in planner.conflict_records(plan).collect()}
    old = planner.conflict_records(plan)
    assert {r.scope_id for r in planner.replace_conflicts(old, old.limit(0), ["s"]).collect()} == {"t"}
    assert planner.replace_conflicts(old, old.limit(0), []).count() == 0
    assert [r.resource_id for r in planner.in_order(plan).collect()] == ["r", "q", "r"]
    assert [r.resource_id for r in planner.in_order(plan, F.when(F.col("resource_id") == "q", 1).otherwise(0)).collect()] == ["r", "r", "q"]


# ---- scalar functions


texts = st.text(alphabet="abé😀😁\n", max_size=12)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=20, max_size=40))
def test_diff_and_apply(spark, pairs):
    df = spark.createDataFrame(pairs, "old string, new string").withColumn("d", scalar.diff_middle(F.col("old"), F.col("new")))
    for r in df.withColumn("back", scalar.apply_diff(F.col("old"), F.col("d"))).collect():
        assert r.back == r.new
        a, b = r.old, r.new
        start = 0
        while start < min(len(a), len(b)) and a[start] == b[start]:
            start += 1
        assert r.d.start == start and len(r.d.insert) - r.d.delete_len == len(b) - len(a)


@pytest.mark.parametrize("old, new, want", [("abef", "abcdef", (2, 0, "cd")), ("abcdef", "abef", (2, 2, "")), ("ab", "abc", (2, 0, "c")), ("abc", "xyz", (0, 3, "xyz")), ("😀", "😁", (0, 1, "😁")), ("", "", (0, 0, ""))])
def test_diff_cases(spark, old, new, want):
    assert tuple(spark.createDataFrame([(old, new)], "a string, b string").select(scalar.diff_middle(F.col("a"), F.col("b")).alias("d")).first().d) == want


def test_names_and_generations(spark):
    r = spark.range(1).select(scalar.segment_name(F.lit(7), F.lit(12), F.lit("ab")).alias("s"), scalar.snapshot_generation_of(F.lit(1234567890123), F.lit("client")).alias("g"), scalar.decoded(F.lit(b"\xff")).alias("bad"), scalar.decoded(F.lit(b"ok")).alias("ok"), scalar.saturating_subtract(F.lit(2), F.lit(5)).alias("z")).first()
    assert r.s == f"{7:020d}-{12:020d}-ab.json" and r.g == scalar.snapshot_generation(1234567890123, "client") and (r.bad, r.ok, r.z) == (None, "ok", 0)


# ---- chunks


def noise(n):
    s, out = 0x9E3779B97F4A7C15, bytearray()
    for _ in range(n):
        s = (s * 6364136223846793005 + 1442695040888963407) & (1 << 64) - 1
        out.append(s >> 33 & 0xFF)
    return bytes(out)


NOISE = noise(500_000)


def test_chunk_sizes_and_round_trip():
    for data in (b"", b"x", NOISE[:5000], NOISE, bytes(300_000)):
        c = cdc.chunks(data)
        assert b"".join(data[a : a + n] for _, a, n in c) == data
        assert all(cdc.MIN_SIZE <= n <= cdc.MAX_SIZE for _, _, n in c[:-1]) and all(n <= cdc.MAX_SIZE for _, _, n in c)
        assert c == cdc.chunks(data)


def test_an_edit_changes_few_chunks():
    own = {h for h, _, _ in cdc.chunks(NOISE)}
    edited = NOISE[:250_000] + bytes(b ^ 0xFF for b in NOISE[250_000:251_024]) + NOISE[251_024:]
    assert len({h for h, _, _ in cdc.chunks(edited)} - own) <= 2
    moved = {h for h, _, _ in cdc.chunks(b"\xab" + NOISE)}
    assert len(moved & own) > len(own) / 2


def test_greedy_packs_reset_after_overshoot(spark):
    rows = spark.createDataFrame([("g", k, f"h{k}", 9) for k in range(5)] + [("g", 9, "h0", 9)], "group_id string, position long, hash string, length long")
    assert [r.pack for r in packs.greedy_packs(rows, 10).orderBy("position").collect()] == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("lengths, live, want", [([10, 20, 10], [0], "Repack"), ([15, 15, 10], [0, 1], "KeepMixed"), ([10, 10], [0], "Repack"), ([10], [], "Delete"), ([5, 5], [0, 1], "Keep")])
def test_pack_classes(spark, lengths, live, want):
    index = spark.createDataFrame([(1, f"h{k}", 0, n) for k, n in enumerate(lengths)], "pack_id long, hash string, offset long, length long")
    alive = spark.createDataFrame([(f"h{k}",) for k in live], "hash string")
    assert packs.classify(index, alive).first().action == want


# ---- texts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab c", max_size=8)), max_size=8), st.randoms())
def test_replicas_agree_in_any_order(edits, r):
    docs = [TextDoc(f"c{k}") for k in range(3)]
    deltas = []
    for who, text in edits:
        deltas.append(docs[who].set_text(text))
        assert docs[who].text() == text
        if r.random() < 0.5:
            docs[(who + 1) % 3].apply(deltas[-1])
    results = set()
    for _ in range(3):
        some = deltas * 2
        r.shuffle(some)
        results.add(TextDoc.rebuild([], some).text())
    whole = TextDoc.rebuild([], deltas)
    results.add(TextDoc.rebuild([whole.state()], []).text())
    results.add(TextDoc.rebuild([whole.state()], deltas).text())
    assert len(results) == 1


def test_concurrent_edits_both_stay(spark):
    a = TextDoc("a")
    first = a.set_text("the quick fox")
    b = TextDoc.rebuild([], [first], "b")
    deltas = [first, a.set_text("the quick brown fox"), b.set_text("the quick fox jumps")]
    df = spark.createDataFrame([(1, bytearray(d)) for d in reversed(deltas)], "resource_id long, delta binary")
    assert merged_texts(df).first().text == "the quick brown fox jumps"


# ---- graph, log, catalog


def test_closure_by_joins_is_the_same(spark):
    commits = fx.commits(spark, SF)
    starts = commits.where("id % 50 = 0").select("resource_id", F.col("id").alias("start"))
    assert sorted(map(tuple, dag.ancestors_by_doubling(commits, starts).collect())) == sorted(map(tuple, dag.ancestors(commits, starts).collect()))


def test_text_heads_have_the_merged_text(spark):
    schema = "id string, scope_id string, resource_id string, parents array<string>, change_type string, content_id string, size long"
    commits = spark.createDataFrame([("1", "s", "r", [], "TextDelta", None, None), ("2", "s", "r", [], "TextDelta", None, None), ("3", "s", "q", [], "Delete", None, None), ("4", "s", "q", [], "TextDelta", None, None)], schema)
    got = {r.resource_id: (r.state, r.size, len(r.heads)) for r in dag.remote_state(commits, spark.createDataFrame([("s", "r", "né")], "scope_id string, resource_id string, text string")).collect()}
    assert got == {"r": ("Present", 3, 2), "q": ("Forked", None, 2)}


@pytest.mark.parametrize("policy, want", [("KeepLocal", ("l", True)), ("KeepRemote", ("r", True))])
def test_fold_of_a_fork(spark, policy, want):
    log = spark.createDataFrame([("f", 1, "a", "b"), ("f", 2, "a", "l"), ("f", 2, "b", "r"), ("g", 1, "a", "b"), ("g", 2, "a", "b"), ("g", 2, "b", "r"), ("g", 2, "c", "r")], "file_id string, sequence long, client_id string, manifest string")
    got = {r.file_id: (r.manifest, r.conflicted) for r in oplog.fold_manifests(log, policy).collect()}
    assert got == {"f": want, "g": ("r", False)}
    assert [tuple(r) for r in oplog.convergence(log, policy).where("file_id = 'f'").collect()] == [("f", 3, want[0])]


def test_forked_sequences_never_come_from_the_cache(spark):
    listing = spark.createDataFrame([("f", 1, "a"), ("f", 2, "a"), ("f", 2, "b")], "file_id string, sequence long, client_id string")
    cache = spark.createDataFrame([("f", 1, bytearray(b"x")), ("f", 2, bytearray(b"y"))], "file_id string, sequence long, bytes binary")
    assert [(r.sequence, r.bytes and bytes(r.bytes)) for r in oplog.cached(listing, cache).orderBy("sequence", "client_id").collect()] == [(1, b"x"), (2, None), (2, None)]


def test_newest_generation_counts(spark):
    rows = spark.createDataFrame([("s", 1, "old"), ("s", 2, "new"), ("t", 1, "only")], "scope_id string, generation long, v string")
    assert sorted(r.v for r in catalog.latest_generation(rows).collect()) == ["new", "only"]


# ---- tables and the remote


def test_versions_and_collisions(spark, tmp_path):
    t = Table(spark, (tmp_path / "t").as_uri(), "k long")
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    assert t.read().count() == 0 and t.version() == 0
    t.append(rows(1))
    other = Table(spark, t.uri, "k long")

    def slow(now):
        if other.version() == 1:
            other.append(rows(2))  # someone is faster, once
        return rows(now.count() + 10)

    assert t.compare_and_append(slow) == 2
    assert sorted(r.k for r in t.read().collect()) == [1, 2, 12]
    assert sorted(r.k for r in t.read(1).collect()) == [1]
    t.append_new(rows(2, 3, 3), ["k"])
    t.replace(lambda now: now.where("k > 2"))
    assert sorted(r.k for r in t.read().collect()) == [3, 12] and len(t.batches()) == 1

    assert t.vacuum(100) == 0 and t.vacuum(1) == 4 and sorted(r.k for r in t.read().collect()) == [3, 12]

    def always_late(now):
        other.append(rows(0))
        return rows(9)

    with pytest.raises(RetryExhausted):
        t.compare_and_append(always_late, 2)


def test_remote_catalog(spark, tmp_path):
    remote = FolderRemote(spark, tmp_path.as_uri())
    commit = spark.createDataFrame([("client:1:x", "scope", "r", [], "client", 1, 5, "Delete", None, None, None, None)], COMMITS)
    remote.commit_batch(commit)
    remote.commit_batch(commit)
    none = spark.createDataFrame([], "client_id string, scope_id string, counter long")
    events, cursors, _ = remote.scan_catalog(none, [])
    assert events.count() == 1 and remote.load_commits(events).first().id == "client:1:x"
    assert remote.scan_catalog(cursors, [])[0].count() == 0 and remote.scan_catalog(none, ["other"])[0].count() == 0
    with pytest.raises(IoError):
        remote.load_commits(spark.createDataFrame([("nobody",)], "commit_id string"))
    remote.compact_catalog(3, "scope", events, cursors)
    assert remote.events.read().count() == 0 and remote.scan_catalog(none, [])[0].count() == 1
    assert remote.scan_catalog(cursors, [])[0].count() == 0 and any(f.startswith("catalog/versions/") for f in remote.files())


def test_damaged_packs_are_noticed(spark, tmp_path):
    remote = FolderRemote(spark, tmp_path.as_uri())
    remote.packs.append(spark.createDataFrame([("p", bytearray(b"abcdef"))], "pack_id string, data binary"))
    index = spark.createDataFrame([("p", cdc.hashlib.sha256(b"cd").hexdigest(), 2, 2), ("p", cdc.hashlib.sha256(b"xx").hexdigest(), 0, 2)], "pack_id string, hash string, offset long, length long")
    remote.index.append(index)
    assert bytes(remote.read_ranges(remote.lookup_chunks(index.limit(1))).first().bytes) == b"cd"
    with pytest.raises(CorruptError):
        remote.read_ranges(remote.lookup_chunks(index))


def test_acknowledgements_last_write_counts(spark, tmp_path):
    remote = FolderRemote(spark, tmp_path.as_uri())
    for heads in (["a"], ["b"]):
        remote.write_acknowledgements(spark.createDataFrame([("c", "s", "r", heads)], "client_id string, scope_id string, resource_id string, observed_heads array<string>"))
    assert [r.observed_heads for r in remote.list_acknowledgements().collect()] == [["b"]]
    assert remote.list_acknowledgements(spark.createDataFrame([("s", "q")], "scope_id string, resource_id string")).count() == 0


def test_stream_takes_up_each_commit_once_and_tells_of_it(spark, tmp_path):
    listener = ProgressEvents()
    spark.streams.addListener(listener)
    at = tmp_path.as_uri()
    rows = [(1, "s", k, k, 1) for k in range(10)]
    schema = "client_id long, scope_id string, counter long, commit_id long, resource_id long"
    for part in (rows[:6], rows[3:], rows):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{at}/in")
        ingest(spark, f"{at}/in", f"{at}/out", f"{at}/check")
    spark.streams.removeListener(listener)
    assert sorted(r.commit_id for r in spark.read.parquet(f"{at}/out").collect()) == list(range(10))
    assert all(json.loads(x["detail_json"]) is not None for x in listener.events)
    assert random.Random(1)
