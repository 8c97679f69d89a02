"""Sweeps, automata and edges against plain loops."""

import random
import re

from pyspark.sql import functions as F

from loamworks.operators import index, occurrences, relate
from loamworks.plans import catalogue
from loamworks.sources import trees


def test_enclosing_equals_all_pairs(spark):
    rng = random.Random(7)
    symbols, rows = [], []
    for p in ("a", "b", "c"):
        for i in range(60):
            start = rng.randrange(60)
            symbols.append((p, i, f"{p}{i}", "Function", start, start + rng.choice([0, 0, 1, 3, 9, 30])))
        rows += [(p, rng.randrange(1, 75), k) for k in range(80)]
    rows += [("none", 3, 0), (None, 3, 1), ("a", None, 2)]
    s = spark.createDataFrame(symbols, "path string, symbol_id int, semantic_path string, kind string, start_line int, end_line int")
    got = {(r["path"], r["line"], r["k"]): r["enclosing_semantic_path"] for r in relate.enclosing(spark.createDataFrame(rows, "path string, line long, k int"), s).collect()}
    assert len(got) == len(set(rows))
    for p, line, k in rows:
        around = [(e - b, -i, name) for q, i, name, _, b, e in symbols if q == p and line is not None and b < line <= e + 1]
        assert got[p, line, k] == (min(around)[2] if around else None), (p, line)


def test_node_types_equal_all_pairs(spark):
    rng = random.Random(9)
    tokens, at = [], 0
    for _ in range(40):
        start = at + rng.randrange(1, 30)
        at = start + rng.randrange(1, 40)
        tokens.append((start, at, rng.choice(["comment", "string"])))
    place = lambda n: (n // 25 + 1, n % 25 + 1)
    t = spark.createDataFrame([("f.rs", *place(s), *place(e), k) for s, e, k in tokens], "path string, start_line int, start_col int, end_line int, end_col int, node_type string")
    rows = [("f.rs", *place(n)) for n in range(0, at + 30)] + [("f.txt", 1, 1), ("g.rs", 1, 1), ("f.rs", None, 1)]
    got = {(r["path"], r["line"], r["column"]): r["node_type"] for r in relate.node_types(spark.createDataFrame(rows, "path string, line long, column long"), t).collect()}
    for n in range(0, at + 30):
        assert got["f.rs", *place(n)] == next((k for s, e, k in tokens if s <= n < e), "code"), n
    assert got["f.txt", 1, 1] is None and got["g.rs", 1, 1] == "code" and got["f.rs", None, 1] == "code"


def test_occurrences_equal_plain_search(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab_é1") for _ in range(rng.randint(1, 4)))
    patterns = sorted({word() for _ in range(40)}) + ["", None, "a b", "éé é"]
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", None, "a b", "a b"]
    t = spark.createDataFrame([(i if i % 7 else None, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, pattern string")
    p = spark.createDataFrame([(x,) for x in patterns + patterns[:5]], "pattern string")
    some = [x for x in patterns if x]
    for size in (occurrences.SLICE_BYTES, 20):
        held = sorted((r["doc_id"] or -1, r["pattern"]) for r in occurrences.occurrences(t, p, ["doc_id"], size=size).collect())
        assert held == sorted(((i if i % 7 else 0) or -1, x) for i, text in enumerate(texts) for x in some if text and x in text)
    places = sorted((r["doc_id"] or -1, r["pattern"], r["at"]) for r in occurrences.occurrences(t, p, ["doc_id"], places=True, whole_words=True).collect())
    joined = lambda a, b: bool(re.match(r"\w", a)) and bool(re.match(r"\w", b))
    want = []
    for i, text in enumerate(texts):
        for x in some:
            for k in range(len(text or "")):
                if text.startswith(x, k) and not (k and joined(text[k - 1], x[0])) and not (k + len(x) < len(text) and joined(text[k + len(x)], x[-1])):
                    want.append(((i if i % 7 else 0) or -1, x, k + 1))
    assert places == sorted(want) and want
    assert occurrences.occurrences(t, p.limit(0), ["doc_id"]).collect() == [] and occurrences.occurrences(t.limit(0), p, ["doc_id"]).collect() == []


def test_passages_of_null_and_repeated_documents_stay(spark, tmp_path):
    spark.createDataFrame([(None, "xx the passage yy"), (None, "xx the passage yy"), (3, "the passage")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the passage"), (2, "the passage"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r["doc_id"], r["item_id"]) for r in catalogue.QUERIES["known_passage_hits"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(d, i) for d in (None, None, 3) for i in (1, 2, 3)], key=str)


def _rows(d):
    return sorted(tuple(r["call_sites"] if c == "call_sites" else r[c] for c in ("src_path", "src_symbol", "dst_path", "dst_symbol", "call_sites")) for r in d.collect())


def test_every_call_has_an_edge_and_a_cut_is_told(spark):
    body = "".join(f"    g{i}()\n" for i in range(25))
    f = trees.texts_as_files(spark, {"a.py": f"def main():\n    main()\n{body}", **{f"g{i:02}.py": f"def g{i}(): pass\n" for i in range(25)}}).cache()
    s = index.symbols(f).cache()
    assert index.edges(f, s).filter("src_symbol = 'main'").count() == 25
    cut = index.calls(f, s, most_calls=20).filter("src_symbol = 'main'").collect()
    assert len(cut) == 20 and all(r["truncated"] for r in cut) and not any(r["truncated"] for r in index.calls(f, s).collect())


def test_a_common_name_costs_calls_and_definitions_not_their_product(spark):
    f = trees.texts_as_files(spark, {f"f{i:03}.py": "def common(): pass\n\ndef other():\n    common()\n" for i in range(60)} | {"z.py": "def last():\n    common()\n"}).cache()
    s = index.symbols(f).cache()
    got = index.edges(f, s).collect()
    assert len(got) == 61 and all(r["dst_path"] == r["src_path"] for r in got if r["src_symbol"] == "other")
    assert [r["dst_path"] for r in got if r["src_symbol"] == "last"] == ["f000.py"]
    called = index.calls(f, s).withColumn("seen", F.lit(1))
    assert called.join(index.definitions(s), ["family", "name"]).count() == 61  # one definition for each call


def test_refreshed_edges_equal_a_rebuild(spark):
    old = {"a.py": "def f():\n    g()\n    h()\n", "b.py": "def g(): pass\n", "c.py": "def h(): pass\n\ndef k():\n    g()\n", "d.py": "def g(): pass\n", "e.py": "def q():\n    k()\n"}
    new = {**old, "b.py": "def x():\n    h()\n", "f.py": "def h():\n    q()\n"}
    del new["e.py"]
    states = []
    for files in (old, new):
        f = trees.texts_as_files(spark, files).cache()
        states.append((f, index.symbols(f).cache()))
    (f0, s0), (f1, s1) = states
    c0 = index.calls(f0, s0).cache()
    e0 = index.resolved(c0, s0).cache()
    called, edges, again = index.refreshed_edges(f1, s1, f0, s0, c0, e0)
    assert _rows(edges) == _rows(index.edges(f1, s1)) and _rows(edges) != _rows(index.edges(f0, s0))
    # the calls of the changed files, and those of g, whose first definition moved, and k's callers' file is gone
    assert {(r["src_path"], r["name"]) for r in again.collect()} == {("b.py", "h"), ("f.py", "q"), ("a.py", "g"), ("c.py", "g")}
    assert sorted(map(str, called.select("src_path", "name").collect())) == sorted(map(str, index.calls(f1, s1).select("src_path", "name").collect()))
