"""Lasting tables: merge and read back, buckets that stay, lost and late writers; uploaded files with errors in quarantine."""

import json
from pathlib import Path

import pytest

from kgloom.operators import snapshots, store
from kgloom.sources import uploads


def test_merge(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    base = spark.createDataFrame([(f"K{i}", f"n{i}", "s") for i in range(40)], "kp_id string, name string, section string")
    rows = spark.createDataFrame([("K3", "new", 1), ("K3", "newer", 2), ("K99", "added", 1), ("K4", None, 1)], "kp_id string, name string, ord int")
    first = snapshots.create(base, path, ["kp_id"], 16)
    second = snapshots.merge_nodes(path, rows, ["name"])
    want = sorted(map(tuple, store.merge_nodes(base, rows, "kp_id", ["name"]).collect()), key=str)
    assert sorted(map(tuple, snapshots.read(spark, path).collect()), key=str) == want
    assert sorted(map(tuple, snapshots.read(spark, path, 0).collect())) == sorted(map(tuple, base.collect()))
    changed = {b for b in first.folders | second.folders if first.folders.get(b) != second.folders.get(b)}
    assert second.version == 1 and 1 <= len(changed) <= 3  # three keys are touched
    snapshots.delete(path, spark.createDataFrame([("K5",), ("none",)], "kp_id string"))
    assert {r["kp_id"] for r in snapshots.read(spark, path).collect()} == {r[0] for r in want} - {"K5"}
    snapshots.merge_nodes(path, rows.limit(0), ["name"])
    assert snapshots.latest(spark, path).version == 3


def test_edges(spark, tmp_path):
    path, edge = f"file://{tmp_path}/e", "src string, dst string, type string, description string"
    base = spark.createDataFrame([("a", "b", "R", "old"), ("b", "c", "R", "old")], edge)
    rows = spark.createDataFrame([("a", "b", "R", "new", 1), ("c", "a", "R", "x", 1)], edge + ", ord int")
    snapshots.create(base, path, ["src", "dst", "type"], 4)
    snapshots.merge_edges(path, rows)
    assert {tuple(r) for r in snapshots.read(spark, path).collect()} == {("a", "b", "R", "new"), ("b", "c", "R", "old"), ("c", "a", "R", "x")}
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, f"file://{tmp_path}/none")


def test_lost_writer(spark, tmp_path, monkeypatch):
    """A writer that is lost before its last step leaves the old version; one that comes late raises and changes nothing."""
    path = f"file://{tmp_path}/t"
    snapshots.create(spark.createDataFrame([("a", "1"), ("b", "1")], "k string, v string"), path, ["k"], 2)
    rows = spark.createDataFrame([("a", "2", 1)], "k string, v string, ord int")
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            snapshots.merge_nodes(path, rows, ["v"])
    assert {tuple(r) for r in snapshots.read(spark, path).collect()} == {("a", "1"), ("b", "1")}
    stale = snapshots.latest(spark, path)
    snapshots.merge_nodes(path, rows, ["v"])
    stale.version += 1
    with pytest.raises(snapshots.Conflict):
        snapshots._commit(spark, path, stale)
    assert {tuple(r) for r in snapshots.read(spark, path).collect()} == {("a", "2"), ("b", "1")}
    assert not [f for f in Path(tmp_path, "t").iterdir() if f.name.startswith(".draft")]


def test_uploads(spark, tmp_path):
    given = {
        "my_chapters.csv": b"\xef\xbb\xbfchapter_id,title\nC1,one\nC2,two\n",
        "kp_relations.csv": b"kp_id,name\nK1,\"a, b\"\nK2,\"two\nlines\"\n",  # a name with kp holds nodes
        "contains.csv": b"source,target_kp_id,type\nK1,K2,\n,K3,EXTENDS\n",
        "broken_kp.csv": b"kp_id,name\nK9,\xff\xfe\n",
        "other.csv": b"a,b\n1,2\n",
        "list.json": json.dumps([{"kp_id": "K1", "level": 2, "status": "x"}, {"chapter_id": "C9"}, {"else": 1}, "text", [1], {"kp_id": None}]).encode(),
        "half.json": b'[{"kp_id": "K7"}, 5, {"kp_id": "K8"}]',
        "bad.json": b'[{"kp_id": ', "one.json": b'{"kp_id": "K5"}', "latin.json": b'["\xe9"]', "note.txt": b"kp_id",
    }
    for name, content in given.items():
        (tmp_path / name).write_bytes(content)
    items, errors = uploads.parse(uploads.binary(spark, f"file://{tmp_path}/*"))
    name = lambda r: r["file"].rsplit("/", 1)[-1]
    assert {name(r) for r in errors.collect()} == {"broken_kp.csv", "half.json", "bad.json", "latin.json"}
    got = uploads.kps(items, spark.createDataFrame([("K1",)], "kp_id string")).collect()
    assert sorted((name(r), r["pos"], r["data"]["kp_id"], r["data"]["status"]) for r in got if r["data"]["kp_id"]) == [
        ("half.json", 0, "K7", "new"), ("kp_relations.csv", 0, "K1", "update"), ("kp_relations.csv", 1, "K2", "new"), ("list.json", 0, "K1", "new")]
    assert {r["data"].get("name") for r in got} >= {"a, b", "two\nlines"} and {r["data"].get("level") for r in got} >= {"2"}
    assert {tuple(r)[2:] for r in uploads.relations(items).collect()} == {("K1", "K2", "RELATED", ""), ("", "K3", "EXTENDS", "")}
    assert {r["kind"]: r["n"] for r in uploads.counts(items).collect()} == {"chapter": 3, "kp": 5, "relation": 2}
