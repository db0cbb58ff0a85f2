import pytest

from tidemark.errors import ConflictNeedsResolution, IoError, SyncError
from tidemark.log_engine import LogEngine, LogRemote


@pytest.fixture
def remote(spark, tmp_path):
    return LogRemote(spark, tmp_path.as_uri())


def fork(spark, remote, file, sequence, states):
    rows = [(file, sequence, c, 0, "Delete" if m is None else "BinarySnapshot", None, m) for c, m in states]
    remote.append(spark.createDataFrame(rows, "file_id string, sequence long, client_id string, millis long, change_type string, delta binary, manifest string"))


def test_texts_of_two_clients(spark, remote):
    told = []
    a, b = LogEngine(spark, "a", remote, listener=told.append), LogEngine(spark, "b", remote)
    assert a.modify_text("t", "the fox") == 1
    assert b.get_text("t") == "the fox"
    assert b.modify_text("t", "the quick fox") == 2 and a.get_text("t") == "the quick fox"
    assert a.rollback("t", 1) == 3 and b.get_text("t") == "the fox"
    a.modify_text("t", "the end")
    a.sync("t"), b.sync("t")
    r = a.truncate("t", 1)
    assert r["entries_deleted"] == 3 and LogEngine(spark, "new", remote).get_text("t") == "the end"
    assert told.count("t") >= 3 and not a.is_syncing("t") and a.head("t") == 4
    a.close()
    with pytest.raises(SyncError):
        a.modify_text("t", "x")


def test_binaries(spark, remote):
    a = LogEngine(spark, "a", remote)
    data = bytes(i * 7 % 256 for i in range(80_000))
    assert a.modify_binaries({"x": data, "y": data + b"!"}) == {"x": 1, "y": 1}
    assert a.read_binary("x") == data and a.read_binary("y") == data + b"!"
    assert a.modify_binary("x", b"small") == 2 and a.read_binary("x") == b"small"
    assert a.delete_binary("x") == 3 == a.delete_binary("x") and a.get_binary_state("x")["deleted"]
    assert a.rollback("x", 2) == 4 and a.read_binary("x") == b"small"
    for f in ("x", "y"):
        a.sync(f)
    r = a.truncate_many(["x", "x"], 1)
    assert r["files"] == 1 and a.read_binary("x") == b"small" and a.read_binary("y") == data + b"!"
    assert sorted(r.file_id for r in remote.files().collect()) == ["x", "y"]
    with pytest.raises(IoError):
        a.read_binary("nothing")


@pytest.mark.parametrize("policy, want", [("KeepLocal", "l"), ("KeepRemote", "r"), ("KeepBoth", "l")])
def test_forks(spark, remote, policy, want):
    fork(spark, remote, "f", 1, [("a", "b")])
    fork(spark, remote, "f", 2, [("a", "l"), ("b", "r")])
    with pytest.raises(ConflictNeedsResolution):
        LogEngine(spark, "m", remote).get_manifest("f")
    e = LogEngine(spark, "a", remote, policy)
    assert e.get_binary_state("f") == {"head": 2, "manifest": [want], "deleted": False, "needs_copy": policy == "KeepBoth"}
    assert e.publish_convergence("f") == 3 == e.publish_convergence("f") and e.get_manifest("f") == [want]
