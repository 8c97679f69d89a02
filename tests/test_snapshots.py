"""Differences of snapshots against comparing every hash."""

import random

from loamworks.sources import snapshots, trees


def _compared(old, new):
    return sorted((p, "added" if p not in old else "removed" if p not in new else "modified") for p in old.keys() | new.keys() if old.get(p) != new.get(p))


def test_differences_equal_a_full_comparison(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    folders = ["", "a/", "a/b/", "a/b/c/d/", "e/", "e/f/", "gé/"]
    old = {f"{rng.choice(folders)}f{i}.txt": f"text {i}" for i in range(80)}
    new = dict(old)
    for p in rng.sample(sorted(old), 6):
        new[p] = "other"
    for p in rng.sample(sorted(old), 5):
        new.pop(p)
    new |= {"a/b/new.txt": "n", "h/i/j/k.txt": "deep", "e": "now a file"}
    new = {p: t for p, t in new.items() if not p.startswith("e/")}
    two = [snapshots.written_snapshot(spark, trees.texts_as_files(spark, x), f"{tmp_path}/{i}") for i, x in enumerate((old, new))]
    for most in (1000, 0):
        monkeypatch.setattr(snapshots, "NAMED", most)
        found, _ = snapshots.difference(*two)
        assert sorted(tuple(r) for r in found.collect()) == _compared(old, new)


def test_equal_folders_are_not_looked_at(spark):
    old = {f"d{i}/e/f{j}.txt": "x" for i in range(20) for j in range(10)}
    new = old | {"d3/e/f4.txt": "y"}
    a, b = (snapshots.snapshot(trees.texts_as_files(spark, x)) for x in (old, new))
    found, looked = snapshots.difference(a, b)
    assert [tuple(r) for r in found.collect()] == [("d3/e/f4.txt", "modified")]
    assert looked == 2 * (20 + 1 + 10)  # the folders of the root, that of d3, and the files of d3/e
    same, looked = snapshots.difference(a, a)
    assert same.collect() == [] and looked == 40


def test_empty_null_and_repeated(spark):
    some = spark.createDataFrame([("a/x", "1"), ("a/x", "1"), (None, "2"), ("b", None), ("c", "3")], "path string, version_hash string")
    none = some.limit(0)
    found, _ = snapshots.difference(snapshots.snapshot(none), snapshots.snapshot(some))
    assert sorted(tuple(r) for r in found.collect()) == [("a/x", "added"), ("c", "added")]
    assert snapshots.difference(snapshots.snapshot(none), snapshots.snapshot(none))[0].collect() == []
