"""The incremental repository source: batches, restarts and late deletions."""

import hashlib
import os

from loomgraph.sources import changes as c


def put(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if text is None:
            os.remove(path)
        else:
            with open(path, "wb") as f:
                f.write(text if isinstance(text, bytes) else text.encode())


def got(frame):
    return {r["path"]: (r["state"], r["text"]) for r in frame.collect()}


def test_changes(spark, tmp_path):
    root, state = str(tmp_path / "repo"), f"file://{tmp_path}/state"
    put(root, {"a.py": "one", "pkg/b.py": "two", ".git/x": "no", "pkg/build/y": "no", "big": "x" * 300_000, "u.txt": "é".encode("utf-16")})
    first = c.changes(spark, f"file://{root}", state)
    assert got(first) == {"a.py": ("new", "one"), "pkg/b.py": ("new", "two"), "u.txt": ("new", "é")}
    assert {r["path"]: r["hash"] for r in first.collect()}["a.py"] == hashlib.sha256(b"one").hexdigest()[:16]
    assert got(c.changes(spark, f"file://{root}", state)) == {}
    # A new time alone is no change; content is.
    put(root, {"a.py": "one", "pkg/b.py": "2", "new.md": "", "u.txt": None})
    assert got(c.changes(spark, f"file://{root}", state)) == {"pkg/b.py": ("changed", "2"), "new.md": ("new", ""), "u.txt": ("deleted", None)}
    # Late deletion, and a path that comes back.
    put(root, {"a.py": None, "u.txt": "again"})
    assert got(c.changes(spark, f"file://{root}", state)) == {"a.py": ("deleted", None), "u.txt": ("new", "again")}
    assert got(c.files_of(spark, root)) == {"pkg/b.py": ("new", "2"), "new.md": ("new", ""), "u.txt": ("new", "again")}
    assert got(c.files_of(spark, str(tmp_path / "nothing"))) == {}


def test_a_batch_that_failed_is_done_again(spark, tmp_path):
    """A run that dies within a batch has planned it; the next one does the same files, and then what changed since."""
    import pytest

    root, state = str(tmp_path / "repo"), f"file://{tmp_path}/state"
    put(root, {"a": "1", "b": "1"})
    spark.dataSource.register(c.RepositorySource)

    def broken(batch, number):
        raise RuntimeError("lost")

    rows = spark.readStream.format("repository").options(path=root, state=f"{state}/manifests").load()
    with pytest.raises(Exception, match="lost"):
        rows.writeStream.foreachBatch(broken).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    put(root, {"b": "2", "c": "1"})
    seen = c.changes(spark, root, state).collect()
    assert {(r["path"], r["state"]) for r in seen} == {("a", "new"), ("b", "new"), ("b", "changed"), ("c", "new")} and len(seen) == 4
    assert got(c.changes(spark, root, state)) == {}


def test_partitions_by_size(monkeypatch):
    monkeypatch.setattr(c, "PARTITION_BYTES", 10_000)
    parts = c.dealt([(f"f{k}", "new") for k in range(9)], {f"f{k}": 100 for k in range(9)})
    assert [len(p.names) for p in parts] == [2, 2, 2, 2, 1]


def test_a_state_that_comes_back(spark, tmp_path):
    """The older manifest of the same files goes when the next one is committed; the batch has its own."""
    root, state = str(tmp_path / "repo"), f"file://{tmp_path}/state"
    for text, want in (("1", "new"), ("2", "changed"), ("1", "changed")):
        put(root, {"a": text})
        assert got(c.changes(spark, root, state)) == {"a": (want, text)}


def test_manifests_are_made_in_tasks(spark, tmp_path):
    """The plan of a batch holds numbers of buckets, not files; what is as it was is neither read nor written again."""
    root, state = str(tmp_path / "repo"), f"file://{tmp_path}/manifests"
    assert c.manifest(spark, root, state) == ""
    put(root, {f"p{k % 7}/f{k}": str(k) for k in range(400)})
    long_ago = 1_000_000_000_000_000_000
    for k in range(400):
        os.utime(f"{root}/p{k % 7}/f{k}", ns=(long_ago, long_ago))
    first = c.manifest(spark, root, state)
    reader = c.Changes(root, 100, state, first)
    assert reader.latestOffset() == {"manifest": first}
    parts = reader.partitions({"manifest": ""}, {"manifest": first})
    assert sum(len(p.numbers) for p in parts) == len(c.Manifests(state).head(first)) and not any(hasattr(p, "names") for p in parts)
    rows = [r for p in parts for r in reader.read(p)]
    assert sorted((r[0], r[1], r[3]) for r in rows) == sorted((f"p{k % 7}/f{k}", "new", str(k)) for k in range(400))
    # Size and time as before: not read. A new time alone: the same manifest, with that time.
    put(root, {"p0/f0": "7"})
    os.utime(f"{root}/p0/f0", ns=(long_ago, long_ago))
    os.utime(f"{root}/p1/f1", ns=(long_ago, long_ago + 1))
    assert c.manifest(spark, root, state) == first
    # Planned without a manifest: the same one, then a later one of what changed.
    assert c.Changes(root, 100, state).latestOffset() == {"manifest": first}
    put(root, {"p1/f1": "x", "p2/f2": None})
    later = c.manifest(spark, root, state)
    assert later > first
    parts = reader.partitions({"manifest": first}, {"manifest": later})
    assert sorted(r[:2] for p in parts for r in reader.read(p)) == [("p1/f1", "changed"), ("p2/f2", "deleted")]
    reader.commit({"manifest": later})
    assert c.Manifests(state)._names() == [later] and os.listdir(tmp_path / "manifests") == [later]
