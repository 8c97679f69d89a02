"""Saved versions of an index, and names near to one."""

import random

import pytest

from loamworks.operators import budget, index
from loamworks.plans.tools import Corpus
from loamworks.sources import trees, versions

OLD = {"a.py": "def f():\n    g()\n    h()\n", "b.py": "def g(): pass\n", "c.py": "def h(): pass\n\ndef k():\n    g()\n", "d.py": "def g(): pass\n"}
NEW = {**OLD, "b.py": "def x():\n    h()\n", "e.py": "# note\ndef q():\n    k()\n"}


def test_refreshed_index_equals_a_rebuild(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    assert Corpus(trees.texts_as_files(spark, OLD)).save(folder) == 1
    before = Corpus.open_saved(spark, folder)
    c, told = Corpus.refresh(spark, folder, trees.texts_as_files(spark, NEW))
    whole = Corpus(trees.texts_as_files(spark, NEW))
    for name in ("symbols", "tokens", "edges"):
        rows = [sorted(map(str, getattr(x, name).collect())) for x in (c, whole)]
        assert rows[0] == rows[1] and rows[0], name
    assert told == {"files_parsed": 2, "calls_resolved": 4, "calls": 5}  # those of b and e, and two of g
    assert versions.published(spark, folder) == [1, 2]
    assert {r["path"] for r in before.symbols.collect()} == {"a.py", "b.py", "c.py", "d.py"}  # an older version is still read
    assert {r["path"] for r in Corpus.open_saved(spark, folder, version=1).files.collect()} == set(OLD)
    assert c.trace("c.py::k").stats["incoming"] == 1
    _, told = Corpus.refresh(spark, folder, trees.texts_as_files(spark, NEW))
    assert told["files_parsed"] == 0 and told["calls_resolved"] == 0


def test_a_version_half_written_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "v")
    one = spark.createDataFrame([(1,)], "x int")
    versions.write(spark, folder, {"t": one})
    one.write.parquet(f"{folder}/v00000002/t")  # its writer was lost before the marker
    assert versions.published(spark, folder) == [1]
    assert versions.write(spark, folder, {"t": one.union(one)}) == 2
    assert versions.read(spark, folder, ("t",))["t"].count() == 2
    assert versions.published(spark, str(tmp_path / "none")) == []
    with pytest.raises(IndexError):
        versions.read(spark, str(tmp_path / "none"), ("t",))


def test_near_names_by_grams_equal_all_names(spark):
    rng = random.Random(8)
    parts = ["get", "set", "user", "name", "Auth", "Service", "login", "log", "out", "é", "_id", "Index"]
    names = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(400)] + ["ab", "a", ""]
    near = ["AuthServicelogin", "getusernameIndexes", "userAuthnameServiceset_id", "loginoutloginout"]
    names += [x for t in near for x in (t + "x", t[:-1], t[1:], t[:5] + "Q" + t[6:])]
    d = spark.createDataFrame(list(enumerate(names)), "symbol_id int, semantic_path string").cache()
    grams = budget.name_grams(d).cache()
    fewer = 0
    for target in ["AuthServicelogin", "AuthServcelogin", "getusernameIndexes", "getusernameIndex", "loginoutloginout", names[3], "setIndxnam", "xyz", "ab", "loginloginlogin", "userAuthnameServiceset_id", ""]:
        got, compared = budget.near_names(grams, d, target)
        want = budget.did_you_mean(d, target)
        assert [(r["semantic_path"], r["distance"], r["rank"]) for r in got.orderBy("rank").collect()] == [(r["semantic_path"], r["distance"], r["rank"]) for r in want.orderBy("rank").collect()], target
        fewer += compared < len(names) // 2
    assert fewer >= 4
    assert index.symbols(trees.texts_as_files(spark, {"a.py": ""})).count() == 0
