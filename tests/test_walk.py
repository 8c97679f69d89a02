"""The walk in tasks against the driver's."""

import os
import random
import re

from pyspark.sql import functions as F

from loamworks.sources import trees, walk


def _tree(root, files):
    for p, text in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)


def test_walk_equals_the_drivers(spark, tmp_path):
    rng = random.Random(3)
    files = {f"{'/'.join(rng.choice(['a', 'b', '.c', '_d', 'node_modules', 'é x']) for _ in range(rng.randint(0, 4)))}/f{i}.{rng.choice(['py', 'log', 'txt'])}".lstrip("/"): f"text {i}" for i in range(120)}
    files |= {".gitignore": "*.log\n/top.txt\n# note\n", "a/.gitignore": "!f1*.log\nb/\n/only.txt\n", "a/b/hidden/deep.py": "x", "a/.ignore": "x.txt\n", "b/x.txt": "1", "a/x.txt": "2", "top.txt": "", "a/only.txt": "", "a/a/only.txt": ""}
    _tree(tmp_path, files)
    os.symlink(tmp_path / "b", tmp_path / "loop")
    for options in ({}, {"ignore": ["*.txt", "!a/x.txt"]}, {"ignore_files": ()}, {"hidden": False}):
        mine = {r["path"]: (r["ignored"], r["text"], r["size"], r["mtime"]) for r in trees.read_tree(spark, str(tmp_path), in_tasks=True, **options).collect()}
        whole = {r["path"]: (r["ignored"], r["text"], r["size"], r["mtime"]) for r in trees.read_tree(spark, str(tmp_path), **options).collect()}
        below = [] if options.get("ignore_files") == () else [p for p in whole if re.match("a/(.*/)?b/", p)]
        assert {p: x for p, x in whole.items() if p not in below} == mine and len(mine) > 60, options
    names = {r["path"] for r in trees.read_tree(spark, f"file://{tmp_path}", in_tasks=True, contents=False).collect()}
    assert names == {r["path"] for r in trees.read_tree(spark, str(tmp_path), in_tasks=True).collect()}


def test_hidden_folders_are_told_of_and_not_listed(spark, tmp_path):
    _tree(tmp_path, {".gitignore": "gen/\n", "gen/x/y.py": "", "src/gen/z.py": "", "src/a.py": "", "target/t.rs": ""})
    got = walk.walked(spark, str(tmp_path))
    assert {r["path"] for r in got.filter("kind = 'pruned'").collect()} == {"gen", "src/gen"}
    assert {r["path"] for r in got.filter("kind <> 'pruned'").collect()} == {".gitignore", "src", "src/a.py"}


def test_empty_trees_and_files_gone_since(spark, tmp_path):
    assert walk.walked(spark, str(tmp_path)).collect() == []
    _tree(tmp_path, {"a.py": "x"})
    d = walk.files_of(walk.walked(spark, str(tmp_path))).select("path", F.lit(1).alias("k"))
    more = d.unionByName(spark.createDataFrame([("gone.py", 2)], "path string, k int"))
    assert {tuple(r) for r in walk.with_contents(more, str(tmp_path)).collect()} == {("a.py", 1, b"x"), ("gone.py", 2, None)}
