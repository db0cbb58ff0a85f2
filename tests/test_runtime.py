import sys

import pytest
from pyspark import cloudpickle

from tidemark.errors import ConflictError, IoError, SyncError
from tidemark.runtime import new_runtime
from tidemark.sources.remote import FolderRemote
from tidemark.sources.replica import TableReplica

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import the policy below


class World:
    """Clients with a replica each, and one remote folder."""

    def __init__(self, spark, tmp_path):
        self.spark, self.at, self.events = spark, tmp_path.as_uri(), []
        self.remote = FolderRemote(spark, f"{self.at}/remote")
        self.now = 0

    def client(self, name, **more):
        local = TableReplica(self.spark, f"{self.at}/local-{name}")
        return new_runtime(self.spark, name, self.remote, local, f"{self.at}/state-{name}", listener=self.events.extend, **more)

    def write(self, runtime, **files):
        rows = [("s", n.replace("__", "."), "Text" if n.startswith("t") else "Binary", None if d is None else bytearray(d)) for n, d in files.items()]
        runtime.local.write(self.spark.createDataFrame(rows, "scope_id string, resource_id string, kind string, data binary"))

    def files(self, runtime):
        return {r.resource_id: bytes(r.data) for r in runtime.local.table.read().collect()}

    def sync(self, runtime):
        self.now += 1
        return runtime.reconcile(["s"], f"run-{self.now}", self.now)


@pytest.fixture
def world(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # many small jobs
    yield World(spark, tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_upload_download_edit_merge_delete(world):
    a, b = world.client("a"), world.client("b")
    big = bytes(i * i % 251 for i in range(200_000))
    world.write(a, x__bin=b"hello", y__bin=big, z__bin=b"", t__txt=b"the quick fox")
    r = world.sync(a)
    assert (r["uploaded"], r["conflicts"], r["failures"], r["scopes"]["s"]["status"]) == (4, 0, 0, "Complete")
    assert [(p.resource_id, p.operation) for p in b.preview(["s"]).collect()] == [("t.txt", "Download"), ("x.bin", "Download"), ("y.bin", "Download"), ("z.bin", "Download")]
    r = world.sync(b)
    assert r["downloaded"] == 4 and world.files(b) == {"x.bin": b"hello", "y.bin": big, "z.bin": b"", "t.txt": b"the quick fox"}
    # both edit the text, one deletes and edits
    world.write(a, t__txt=b"the quick brown fox")
    world.write(b, t__txt=b"the quick fox jumps", x__bin=b"hello you", z__bin=None)
    r = world.sync(b)
    assert (r["uploaded"], r["deleted_remote"], r["conflicts"]) == (2, 1, 0)
    r = world.sync(a)
    assert (r["uploaded"], r["downloaded"], r["deleted_local"], r["conflicts"]) == (1, 1, 1, 0)
    assert world.files(a) == {"x.bin": b"hello you", "y.bin": big, "t.txt": b"the quick brown fox jumps"}
    assert [h.deleted for h in a.history("s", "z.bin").collect()] == [False, True]
    # an old version comes back as a new commit
    first = a.history("s", "x.bin").first().id
    assert a.rollback("s", "x.bin", first, 50)["failures"] == 0
    assert world.files(a)["x.bin"] == b"hello" and a.history("s", "x.bin").count() == 3
    with pytest.raises(IoError):
        a.rollback("s", "y.bin", first)
    assert {"remote.scan.start", "plan.complete", "run.complete"} <= {e["stage"] for e in world.events}
    a.close()
    a.close()
    with pytest.raises(SyncError):
        a.preview()


def test_conflict_stays_alone_and_is_resolved(world):
    a, b = world.client("a"), world.client("b")
    world.write(a, c__bin=b"from a", n__bin=b"new a", d__bin=b"from a")
    world.sync(a)
    world.write(b, c__bin=b"from b", m__bin=b"new b", d__bin=b"from b")
    r = world.sync(b)
    assert (r["conflicts"], r["uploaded"], r["downloaded"], r["scopes"]["s"]["status"]) == (2, 1, 1, "Partial")
    c, d = b.list_conflicts("s").orderBy("resource_id").collect()
    assert c.kind == "InitialDivergence" and b.list_conflicts("other").count() == 0
    # what changed since is refused
    world.write(b, d__bin=b"changed since")
    with pytest.raises(ConflictError):
        b.resolve(d.conflict_id, "Local")
    head = b.history("s", "c.bin").first().id
    b.resolve(c.conflict_id, "Local", {"c copy.bin": head}, 60)
    assert world.files(b) == {"c.bin": b"from b", "c copy.bin": b"from a", "n.bin": b"new a", "m.bin": b"new b", "d.bin": b"changed since"}
    assert [x.resource_id for x in b.list_conflicts().collect()] == ["d.bin"]
    with pytest.raises(IoError):
        b.resolve(c.conflict_id, "Local")


def test_maintenance_takes_two_passes(world):
    a = world.client("a")
    for v in range(3):
        world.write(a, x__bin=b"v%d" % v)
        world.sync(a)
    assert a.maintain(0)["resources"] == 0
    first = a.maintain(2, ["s"], 70)
    assert (first["commits_deleted"], first["deferred"]) == (0, 1)
    second = a.maintain(2, ["s"], 71)
    assert second["commits_deleted"] >= 1 and second["packs_deleted"] >= 1
    fresh = world.client("fresh")
    world.sync(fresh)
    assert world.files(fresh) == {"x.bin": b"v2"}
    a.retire_client("b")
    a.retire_client("b")
    assert a.retired.read().count() == 1


class Policy:
    def merge_text(self, key, base, local, remote):
        return ("Conflict", "mine") if "stop" in local else ("Merged", local.upper())

    def resource_priority(self, key):
        return 0


def test_merge_policy(world):
    a, b = world.client("a"), world.client("b", policy=Policy())
    world.write(a, t1=b"start", t2=b"start")
    world.sync(a)
    world.sync(b)
    world.write(b, t1=b"stop here", t2=b"go on")
    r = world.sync(b)
    assert (r["conflicts"], r["uploaded"]) == (1, 1) and [c.resource_id for c in b.list_conflicts().collect()] == ["t1"]
    assert b._texts(b.commits.read()).where("resource_id = 't2'").first().text == "GO ON"
