"""Extraction, line search, relations, budgets, graphs and the query API over a small corpus."""

import hashlib
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from loamworks.model import AccessDenied, BinaryFile, FileNotFound, InvalidParams, InvalidSemanticPath, PathTraversal, SymbolNotFound
from loamworks.operators import budget, extract, graph, index, lines, quality, relate
from loamworks.plans import catalogue
from loamworks.plans.tools import Corpus
from loamworks.sources import trees

RUST = "use std::io;\n\npub struct Foo { a: i32 }\nimpl Foo {\n    pub fn new() -> Self { let s = \"}\"; Foo { a: 1 } }\n    fn helper(&self) { validate(1); }\n}\n\npub fn validate(x: i32) -> bool { x > 0 } // checks\n#[test]\nfn works() { Foo::new(); }\nimpl Other { fn a() {} }\n"
TS = "import { a } from 'x'\nexport class AuthService {\n  login() { check() }\n  login(u: string) { }\n  _hide() { }\n}\nexport const check = () => { return 1 }\nfunction _p() {}\n"
PY = "import os\nfrom a import b\n\nclass A:\n    def go(self):\n        return helper()\n\n    def _hidden(self): pass\n\ndef helper():\n    # a needle in a comment\n    return 'needle'\n\ndef needle(): return helper()\n"
GO = 'package main\nimport (\n\t"fmt"\n\t"os"\n)\nimport "x"\nfunc main() { fmt.Println(")") }\n'
JAVA = "package p;\nimport java.util.List;\npublic class Box<T> {\n  private int x;\n  public Box() {}\n  protected List<T> items() { return null; }\n  void pack() {}\n  interface Q { int m(); }\n}\nrecord Point(int x, int y) {}\n"
VUE = "<script setup>\nfunction go() {}\n</script>\n<template>\n<div><MyComp/><p><span><b>x</b></span></p></div>\n</template>\n<style>.a {} .a {} @media x { .b {} }</style>\n"
FILES = {"src/lib.rs": RUST, "src/auth.ts": TS, "app/a.py": PY, "main.go": GO, "j/Box.java": JAVA, "c.vue": VUE, "README.md": "needle\nno\nneedle two\n", "bin/x.png": b"\x89PNG", "raw.txt": b"\xff\xfe", ".env": "k=1", "Cargo.toml": "[package]\nname='x'\n", "empty.py": ""}


@pytest.fixture(scope="module")
def corpus(spark):
    c = Corpus(trees.texts_as_files(spark, FILES).cache())
    for name in ("symbols", "tokens", "edges"):
        c.__dict__[name] = getattr(c, name).cache()
    return c


def names(text, lang):
    return [(r[5], r[6], r[7]) for r in extract.flattened(text, lang)]


def test_rust_symbols():
    got = names(RUST, "rust")
    assert got == [
        ("Foo", "Struct", "Public"), ("Foo.new", "Method", "Public"), ("Foo.helper", "Method", "Public"), ("validate", "Function", "Public"), ("works", "Test", "Private"), ("Other", "Impl", "Private"), ("Other.a", "Method", "Public"),
    ]


def test_typescript_overloads_and_access():
    got = names(TS, "typescript")
    assert ("AuthService.login", "Method", "Public") in got and ("AuthService.login#2", "Method", "Public") in got
    assert ("check", "Function", "Public") in got and ("_p", "Function", "Private") in got
    assert not any(p.endswith("#3") for p, _, _ in got)


def test_java_symbols():
    assert names(JAVA, "java") == [("Box", "Class", "Public"), ("Box.Box", "Function", "Public"), ("Box.items", "Function", "Protected"), ("Box.pack", "Function", "Package"), ("Box.Q", "Interface", "Package"), ("Box.Q.m", "Function", "Package"), ("Point", "Struct", "Package")]


def test_python_symbols_and_tolerance():
    assert names(PY, "python")[:3] == [("A", "Class", "Public"), ("A.go", "Function", "Public"), ("A._hidden", "Function", "Protected")]
    assert [x[0] for x in names("def f(:\n  def g():\n    pass\nclass C:\n  pass\n", "python")] == ["f", "f.g", "C"]
    assert names("class A:\n  def __init__(s): pass\n  def __x(s): pass\n", "python")[1:] == [("A.__init__", "Function", "Public"), ("A.__x", "Function", "Private")]


def test_go_and_vue_symbols():
    assert names(GO, "go") == [("main", "Function", "Package")]
    got = [p for p, _, _ in names(VUE, "vue")]
    assert got[0] == "go" and "template.MyComp" in got and "template.b" not in got and r"style.\.a[2]" in got and "style.@media" in got


def test_extraction_survives_anything():
    rng = random.Random(3)
    for lang in ("rust", "go", "java", "typescript", "tsx", "javascript", "vue", "python"):
        for _ in range(30):
            base = rng.choice([RUST, TS, PY, GO, JAVA, VUE])
            cut = base[rng.randrange(len(base)) :] + "".join(rng.choice("{}()'\"`<>/*#\n é😀") for _ in range(20))
            for r in extract.flattened(cut, lang):
                assert 0 <= r[9] <= r[10] <= len(cut.encode())
            list(extract.token_rows(cut, lang))


def test_what_nests_hides_no_code_and_shows_none():
    assert [p for p, _, _ in names("/* a /* b */ fn hidden() {} */ fn seen() {}", "rust")] == ["seen"]
    text = "let a = `x ${ `y ${ {z: `}`} }` + '}' } w`; f('q'); // `\nfunction g() {}"
    assert extract.token_spans(text, "typescript") == [(8, text.index("; f"), "string"), (text.index("'q'"), text.index("'q'") + 3, "string"), (text.index("//"), text.index("\nf"), "comment")]
    assert [p for p, _, _ in names(text, "javascript")][-1] == "g"
    assert extract.token_spans('let r = r##"a "# b"##; let l: &\'a str = b\'x\';', "rust") == [(8, 21, "string"), (40, 44, "string")]
    assert [p for p, _, _ in names('class A { String s = """\n } void no() {}\n """; void yes() {} }', "java")] == ["A", "A.yes"]


def test_twenty_thousand_functions_and_deep_nesting():
    one = {"rust": "fn f%d() { a(1); }\n", "go": "func f%d() { a(1) }\n", "java": "class f%d { int a = b(1); }\n", "typescript": "function f%d() { a(`${1}`) }\n", "python": "def f%d(): pass\n"}
    for lang, code in one.items():
        assert sum(1 for _ in extract.flattened("".join(code % i for i in range(20_000)), lang)) == 20_000, lang
    line = "".join(f"function f{i}(){{}};" for i in range(20_000))
    assert len(names(line, "javascript")) == 20_000  # all in one line
    deep = "mod m { " * 3000 + "fn f() {}" + " }" * 3000
    assert names(deep, "rust")[-1][0] == "m." * 3000 + "f"
    assert len(names("é" * 9 + "\nfn a() {}\n" * 2000, "rust")) == 2000


def test_faults_are_told_and_the_rest_is_read(spark):
    got = names("fn a() {\n  if x {\n}\nfn b() {}\nimpl S {\n  fn c(&self) {}\n}\n", "rust")
    assert [p for p, _, _ in got] == ["a", "b", "S", "S.c"]
    files = trees.texts_as_files(spark, {"a.rs": "fn a() {\n  if x {\n}\nfn b() {}\n", "b.py": "def f(:\n  pass\n", "c.go": "package c\nfunc f() {}\n", "d.ts": "f(]\nlet s = 'x\n/* end", "e.java": "class A { } }"})
    rows = {(r["path"], r["line"], r["column"], r["fault"]) for r in index.faults(files).collect()}
    assert rows == {("a.rs", 1, 8, "unclosed {"), ("b.py", 1, 7, "invalid syntax"), ("d.ts", 1, 2, "unclosed ("), ("d.ts", 1, 3, "unexpected ]"), ("d.ts", 2, 9, "unclosed string"), ("d.ts", 3, 1, "unclosed comment"), ("e.java", 1, 13, "unexpected }")}


def test_declarations_of_many_forms():
    rust = "pub(crate) const fn k() {}\nunion U { a: u8 }\nfn union(union: u8) {}\nmacro_rules! m { () => { fn no() {} } }\nstatic mut G: X = Y { a: 1 };\ntype Al = Vec<u8>;\ntrait T { fn r(&self); type A; }\nimpl<T: Fn() -> u8> Tr for Q where T: X { fn w() {} }\nextern \"C\" fn e() {}\n"
    assert [(p, k) for p, k, _ in names(rust, "rust")] == [("k", "Function"), ("U", "Struct"), ("union", "Function"), ("G", "Constant"), ("Al", "Class"), ("T", "Interface"), ("T.r", "Method"), ("Q", "Impl"), ("Q.w", "Method"), ("e", "Function")]
    go = "package p\ntype (\n A struct { x int }\n B interface {\n M()\n }\n)\ntype L[T any] struct { a T }\nfunc (a *A) Do(x struct{}) struct{} { type In struct{}\n return x }\nconst (\n X = iota\n Y\n)\nvar q, r = 1 +\n 2\nfunc TestA(t *T) {}\n"
    assert [(p, k) for p, k, _ in names(go, "go")] == [("A", "Struct"), ("B", "Interface"), ("L", "Struct"), ("Do", "Method"), ("Do.In", "Struct"), ("X", "Constant"), ("q", "Constant"), ("TestA", "Test")]
    java = "@A(x=1) public abstract class K<T> {\n  Map<String, List<Integer>> m = new HashMap<>(3);\n  K(int x) { super(x); }\n  abstract <U> U gen(U u);\n  enum E { X(1) { void z() {} }; E(int i) {} }\n  @interface N { int value() default 3; }\n  int last() { return x < y ? f(1) : 2; }\n}"
    assert [p for p, _, _ in names(java, "java")] == ["K", "K.K", "K.gen", "K.E", "K.E.E", "K.N", "K.N.value", "K.last"]
    ts = "export default class K<T> extends B<{x: 1}> {\n  #p() {}\n  static async *gen(): G<{a: 1}> { }\n  x = foo(1)\n  m<T>(a: T): { b: string } { if (a) { c() } }\n  abs(): void;\n}\nlet f = x => x\ntype U = { a: string } | {\n b: number }\nnamespace N.M { export function q() {} }\nconst enum CE { A }\nconst re = /[\"'`{]/g, o = a / b / c\nfoo.class = 1; it('x', () => { function nested() {} })\nfunction last(a = {}): x is string {}"
    assert [(p, k) for p, k, _ in names(ts, "typescript")] == [("K", "Class"), ("K.#p", "Method"), ("K.gen", "Method"), ("K.m", "Method"), ("f", "Function"), ("U", "Class"), ("N", "Module"), ("N.q", "Function"), ("CE", "Enum"), ("re", "Constant"), ("last", "Function")]


def test_overlapping_context(spark):
    f = trees.texts_as_files(spark, {"a.txt": "l1\nl2\nhit\nl4\nhit\nl6\nl7\nhit\n"})
    got = [(r["line"], r["context_before"], r["context_after"]) for r in lines.find(f, "hit").orderBy("line").collect()]
    assert got == [(3, ["l1", "l2"], ["l4"]), (5, ["hit", "l4"], ["l6", "l7"]), (8, ["l6", "l7"], [])]


def test_find_edge_cases(spark):
    f = trees.texts_as_files(spark, {"e": "", "c": "a\r\nx hit\r\n", "two": "hit hit\n", "first": "hit", "n": b"\xff hit"})
    got = {(r["path"], r["line"], r["column"], r["content"]) for r in lines.find(f, "hit").collect()}
    assert got == {("c", 2, 3, "x hit"), ("two", 1, 1, "hit hit"), ("first", 1, 1, "hit")}
    with pytest.raises(InvalidParams):
        lines.find(f, "")


def test_regular_expressions_find_the_same_lines_with_the_whole_text_tested_first(spark, monkeypatch):
    rng = random.Random(17)
    texts = {f"f{i:03}": rng.choice(["\n", "\r\n"]).join("".join(rng.choice("ab. \t\u2028\u0085é") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 5))) for i in range(150)}
    f = trees.texts_as_files(spark, texts).cache()
    patterns = ["^a", "b$", "^$", r"\bab\b", "a.b", "[^a]b", r"\Aa", r"b\z", "(a|^b)\\s*$", "(?i)A$", "^.*é", r"\\A|a"]
    rows = lambda q: [(r["path"], r["line"], r["column"]) for r in lines.find(f, q, regex=True).orderBy("path", "line").collect()]
    with_test = [rows(q) for q in patterns]
    monkeypatch.setattr(lines.X, "may_match", lambda *_: F.lit(True))
    assert with_test == [rows(q) for q in patterns] and all(with_test)


def test_pages_are_disjoint_and_whole(spark):
    f = trees.texts_as_files(spark, {f"{c}.rs": "needle\n" for c in "abcdefghij"})
    m = lines.find(f, "needle")
    pages = [[r["path"] for r in lines.page(m, o, 3).orderBy("rank").collect()] for o in (0, 3, 6, 9)]
    assert [len(p) for p in pages] == [3, 3, 3, 1] and sorted(sum(pages, [])) == [f"{c}.rs" for c in "abcdefghij"]
    assert lines.page(m, 10, 3).count() == 0


def test_search_has_no_shuffle(spark):
    f = trees.texts_as_files(spark, {"a": "hit"})
    plan = lines.find(f, "hit")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_counters(spark):
    f = trees.texts_as_files(spark, FILES).withColumn("ignored", F.col("path") == "README.md")
    r = lines.counters(f).first()
    assert (r["binary_skipped"], r["gitignored_skipped"], r["other_skipped"]) == (1, 1, 1)
    assert r["files_in_scope"] == 11 and r["files_searched"] == 9 and r["coverage_percent"] == 81
    assert lines.counters(f.limit(0)).first()["coverage_percent"] == 100


def test_imports(spark):
    got = {}
    for r in lines.imports(trees.texts_as_files(spark, FILES)).orderBy("path", "line").collect():
        got.setdefault(r["path"], []).append(r["content"].strip())
    assert got["main.go"] == ["import (", '"fmt"', '"os"', ")", 'import "x"']
    assert got["app/a.py"] == ["import os", "from a import b"] and got["src/lib.rs"] == ["use std::io;"] and got["j/Box.java"] == ["package p;", "import java.util.List;"]


def test_enclosing_is_innermost_and_equi(spark, corpus):
    rows = spark.createDataFrame([("app/a.py", 6), ("app/a.py", 4), ("app/a.py", 1), ("nope", 1)], "path string, line long")
    d = relate.with_definition_flag(relate.enclosing(rows, corpus.symbols))
    got = {(r["path"], r["line"]): (r["enclosing_semantic_path"], r["is_definition"]) for r in d.collect()}
    assert got == {("app/a.py", 6): ("A.go", False), ("app/a.py", 4): ("A", True), ("app/a.py", 1): (None, None), ("nope", 1): (None, None)}
    assert "NestedLoop" not in d._jdf.queryExecution().executedPlan().toString()


def test_visibility_drops_children_of_hidden(spark, corpus):
    got = {r["semantic_path"] for r in relate.visible(corpus.symbols.filter("path = 'src/auth.ts'")).collect()}
    assert "AuthService.login" in got and "AuthService._hide" in got and "_p" not in got
    assert relate.visible(corpus.symbols, "all").count() == corpus.symbols.count()


def test_greedy_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(w, f"p{i:03}", rng.randint(1, 60)) for w in "ab" for i in range(80)] + [("c", "p0", 500)]
    got = {(r["w"], r["path"]): (r["admitted"], r["marked"]) for r in budget.greedy(spark.createDataFrame(rows, "w string, path string, cost int"), 300, ["w"]).collect()}
    want, used = {}, {}
    for w, p, c in sorted(rows):
        u = used.get(w, 0)
        fits = u + c <= 300
        marks = not fits and u + 50 <= 300
        used[w] = u + (c if fits else 50 if marks else 0)
        want[w, p] = (fits, marks)
    assert got == want


def _looped(rows, budget, omission):
    out, left = [], budget
    for p, c in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        fits = c is not None and c <= left
        marks = not fits and 0 < omission <= left
        left -= c if fits else omission if marks else 0
        out.append((p, fits, marks))
    return sorted(out)


def test_greedy_by_blocks_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(budget, "OPEN_BLOCKS", 2)
    rng = random.Random(4)
    for costs, most, omission in (((1, 60), 900, 50), ((1, 60), 900, 0), ((30, 40), 400, 7), ((0, 3), 10_000, 50), ((1, 2000), 3000, 100), ((5, 5), 203, 3)):
        rows = [(f"p{rng.randrange(400):03}", None if rng.random() < 0.02 else rng.randint(*costs)) for _ in range(700)]
        d = spark.createDataFrame(rows, "path string, cost int")
        got = sorted(tuple(r) for r in budget.greedy(d, most, omission=omission, block_rows=16).collect())
        assert got == _looped(rows, most, omission), (costs, most, omission)
    keyed = [(w, *r) for w in ("a", None, "c") for r in rows[: 500 if w is None else 60]]
    got = budget.greedy(spark.createDataFrame(keyed, "w string, path string, cost int"), 203, ["w"], omission=3, block_rows=16, large=400).collect()
    for w in ("a", None, "c"):
        assert sorted((r["path"], r["admitted"], r["marked"]) for r in got if r["w"] == w) == _looped([r[1:] for r in keyed if r[0] == w], 203, 3)


def test_greedy_opens_few_blocks(spark, monkeypatch):
    opened = []
    cut = budget._Fold.block
    monkeypatch.setattr(budget._Fold, "block", lambda self, *a: opened.append(cut(self, *a)) or opened[-1])
    n = 200_000
    d = spark.range(n).select(F.format_string("%08d", "id").alias("path"), (F.col("id") % 7 + 10).alias("cost"))
    got = budget.greedy(d, 50_000, omission=50, block_rows=500).agg(F.count_if("admitted"), F.count_if("marked")).first()
    want = _looped([(f"{i:08}", i % 7 + 10) for i in range(n)], 50_000, 50)
    assert tuple(got) == (sum(x[1] for x in want), sum(x[2] for x in want))
    assert opened.count(False) <= 3 and len(opened) > 350


def test_greedy_is_linear_and_counts_nothing_for_null_costs(spark):
    n = 300_000
    d = spark.range(n).select(F.format_string("%08d", "id").alias("path"), F.when(F.col("id") % 1000 == 7, None).otherwise(F.lit(3)).cast("long").alias("cost"))
    got = budget.greedy(d, 30_000, omission=0).filter("admitted").agg(F.count("*"), F.max("path"), F.count_if(F.col("marked"))).first()
    assert tuple(got) == (10_000, "00010010", 0)  # 11 of the first 10,011 have no cost
    assert budget.greedy(d.limit(0), 10).count() == 0


def test_one_file_is_parsed_for_one_file(spark, corpus, monkeypatch):
    asked, symbols = [], index.symbols
    monkeypatch.setattr(index, "symbols", lambda f: asked.append(sorted(r["path"] for r in f.select("path").collect())) or symbols(f))
    c = Corpus(corpus.files)
    assert c.read("app/a.py").rows.first()["total_lines"] == 14
    c.locate(locations=[("main.go", 7)])
    assert asked and all(x in (["app/a.py"], ["main.go"]) for x in asked)


def test_passages_are_found_glued_and_short(spark, tmp_path):
    docs = ["x alpha beta gamma, y", "alpha beta gamma", "a solo, b", "absolom", "", None, "two words, more", "one two three four five six seven eight nine", "(one two three four five six seven eight nine)"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = ["alpha beta gamma", "solo", "two words", "one two three four five six seven eight nine", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["known_passage_hits"](spark, str(tmp_path)).collect()}
    assert got == {(i, j) for i, d in enumerate(docs) for j, p in enumerate(items) if d and p and p in d} and len(got) == 7


def test_budgets():
    assert budget.scaled_budget(16_000, 10) == 16_000 and budget.scaled_budget(16_000, 30) == 24_000 and budget.scaled_budget(16_000, 1000) == 48_000
    assert budget.scaled_budget(100, 1000) == 500 and budget.scaled_budget(10**6, 1) == 100_000 and budget.suggested_budget(4001) == 8000


def test_did_you_mean(spark):
    d = spark.createDataFrame([(i, n) for i, n in enumerate(["login", "logout", "log", "AuthService.login", "unrelatedname", "logon"])], "symbol_id int, semantic_path string")
    assert [r["semantic_path"] for r in budget.did_you_mean(d, "login").collect()] == ["login"]
    assert [r["semantic_path"] for r in budget.did_you_mean(d, "logim").orderBy("rank").collect()] == ["login", "log", "logon"]


def test_graph_cycle_diamond_isolated(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("f", "g"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.reach(e, start, max_depth=3).collect()} == {("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    assert {tuple(r) for r in graph.reach(e, start, max_depth=50).collect()} == {("b", 1), ("c", 1), ("d", 2), ("e", 3), ("f", 4), ("g", 5)}
    assert graph.reach(e, spark.createDataFrame([("y",)], "node string")).count() == 0


def test_reasons_and_status(spark):
    assert quality.reasons(spark).count() == 13
    d = spark.createDataFrame([(1, "degraded", "complete"), (1, "ready", "in_progress"), (2, "starting", None)], "k int, status string, indexing_status string")
    assert {tuple(r) for r in quality.overall_status(d, "k").collect()} == {(1, "ready", False), (2, "starting", True)}
    b = lambda v: F.lit(v).cast("boolean")
    tools = lambda *xs: [tuple(t) for t in spark.range(1).select(quality.degraded_tools(*map(b, xs))).first()[0]]
    assert tools(True, True, True, True) == [] and len(tools(False, True, True, True)) == 4 and tools(None, None, True, True)[0] == ("locate", "warming_up") and len(tools(True, True, None, None)) == 3
    r = spark.range(1).select(quality.merged_reason(F.lit(None), F.lit("no_lsp"), F.lit("lsp_warmup_grep_fallback"))).first()[0]
    assert r == "lsp_warmup_grep_fallback"


def test_manifests(spark):
    f = trees.texts_as_files(spark, {"Cargo.toml": "[x]\n", "a/Cargo.toml": "[package]\n", "go.mod": "// c\nmodule m\n", "b/go.mod": "x", "tsconfig.json": '{"a":1,} // c', "pom.xml": "<p/>", "pyproject.toml": "a=", "build.gradle": "x"})
    faults = {r["path"]: r["fault"] for r in trees.manifest_faults(f).collect()}
    assert faults["a/Cargo.toml"] is None and "neither" in faults["Cargo.toml"] and faults["go.mod"] is None and faults["b/go.mod"] and faults["tsconfig.json"] is None and faults["pom.xml"] and faults["pyproject.toml"] and faults["build.gradle"] is None
    roots = {r["language"]: (r["n_markers"], r["root"]) for r in trees.language_roots(f).collect()}
    assert roots["rust"] == (2, "") and roots["typescript"] == (1, "")


def test_tree_scan_config_and_git(spark, tmp_path, monkeypatch):
    for p, c in {"src/a.py": "x = 1\n", "node_modules/m.js": "1", "b.png": "p", "k.pem": "s", ".hidden/h.py": "1", "src/__init__.py": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    got = {r["path"]: r["text"] for r in trees.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": "x = 1\n", "b.png": None, ".hidden/h.py": "1", "src/__init__.py": ""}
    assert {r["path"] for r in trees.read_tree(spark, str(tmp_path), hidden=False, contents=False).collect()} == {"src/a.py", "b.png", "src/__init__.py"}
    for p, c in {".gitignore": "*.log\n/top.txt\n# note\n", "src/.gitignore": "gen/\n!keep.log\n/only.py\n", "src/.ignore": "x.txt\n"}.items():
        (tmp_path / p).write_text(c)
    for p in ("a.log", "top.txt", "src/top.txt", "src/keep.log", "src/gen/b.py", "gen/b.py", "src/only.py", "src/d/only.py", "x.txt", "src/d/x.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    hidden = lambda **k: {r["path"] for r in trees.read_tree(spark, str(tmp_path), contents=False, **k).filter("ignored").collect()}
    assert hidden() == {"a.log", "top.txt", "src/gen/b.py", "src/only.py", "src/d/x.txt"}
    assert hidden(ignore=["!a.log", "gen/"]) == {"top.txt", "src/gen/b.py", "gen/b.py", "src/only.py", "src/d/x.txt"}
    assert hidden(ignore_files=()) == set()
    monkeypatch.setattr(trees, "RULES_LIMIT", 10)
    with pytest.raises(InvalidParams):
        hidden()
    assert trees.read_config(str(tmp_path / "none.json")).max_results == 50
    (tmp_path / "c.json").write_text('{"max_results": 0}')
    with pytest.raises(InvalidParams):
        trees.read_config(str(tmp_path / "c.json"))
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    (tmp_path / "src/a.py").write_text("x = 2\n")
    assert [r[0] for r in trees.changed_since(spark, str(tmp_path), "HEAD").collect()] == ["src/a.py"]
    with pytest.raises(InvalidParams):
        trees.changed_since(spark, str(tmp_path), "--output=x")


def test_index_refresh_parses_only_changes(spark):
    old = trees.texts_as_files(spark, {"a.py": "def f(): pass\n", "b.py": "def g(): pass\n"})
    rows = index.symbols(old).cache()
    new = trees.texts_as_files(spark, {"a.py": "def f(): pass\n", "b.py": "def h(): pass\n"})
    seen = []
    got = index.refreshed(new, old, rows, lambda d: seen.append(sorted(r["path"] for r in d.collect())) or index.symbols(d))
    assert sorted(r["name"] for r in got.collect()) == ["f", "h"] and seen == [["b.py"]]


def test_udtf_in_sql(spark):
    index.register(spark)
    trees.texts_as_files(spark, {"a.py": "def f(): pass\n"}).createOrReplaceTempView("some_files")
    assert spark.sql("SELECT path, s.semantic_path FROM some_files, LATERAL extract_symbols('python', text) s").collect()[0]["semantic_path"] == "f"


# --- the query API


def test_search_filters_before_pages(corpus):
    a = corpus.search("needle", group_by_file=False)
    got = [(r["path"], r["line"]) for r in a.rows.collect()]
    assert got == [("README.md", 1), ("README.md", 3), ("app/a.py", 14)] and a.stats["degraded_reason"] == "unsupported_language_filter_bypassed"
    c = corpus.search("needle", filter_mode="comments_only", path_glob="**/*.py", group_by_file=False)
    assert [r["line"] for r in c.rows.collect()] == [11, 12] and c.stats["total_matches"] == 3
    n = corpus.search("zzz")
    assert n.rows.count() == 0 and n.stats["hint"].startswith("No match")
    k = corpus.search("needle", known_files=["./README.md"], filter_mode="all")
    g = {r["path"]: (len(r["matches"]), len(r["known_matches"])) for r in k.rows.collect()}
    assert g == {"README.md": (0, 2), "app/a.py": (3, 0)}
    p2 = corpus.search("needle", max_results=2, offset=2, filter_mode="all", group_by_file=False)
    assert [r["rank"] for r in p2.rows.collect()] == [3, 4] and p2.stats["next_offset"] == 4 and p2.stats["total_matches"] == 5
    with pytest.raises(InvalidParams):
        corpus.search("(?=x)", mode="regex")


def test_symbol_search(corpus):
    r = corpus.search("login", mode="symbol").rows.collect()
    assert [x["semantic_path"] for x in r] == ["src/auth.ts::AuthService.login", "src/auth.ts::AuthService.login#2"] and r[0]["line"] == 3
    assert corpus.search("Box", mode="symbol", kind="class").rows.count() == 1
    assert corpus.search("logim", mode="symbol").stats["did_you_mean"]
    for bad in ("a/b", "..", ""):
        with pytest.raises(InvalidParams):
            corpus.search(bad, mode="symbol")
    with pytest.raises(InvalidParams):
        corpus.search("x", mode="symbol", kind="gizmo")


def test_read(corpus):
    r = corpus.read("app/a.py", start_line=4, end_line=5).rows.first()
    assert r["lines"] == ["class A:", "    def go(self):"] and r["truncated"] and [s["semantic_path"] for s in r["symbols"]] == ["A", "A.go"]
    b = corpus.read(paths=["nope", "README.md", ".env", "raw.txt"], detail_level="source_only")
    assert [x["error"] for x in b.rows.collect()] == ["FILE_NOT_FOUND", None, "ACCESS_DENIED", "BINARY_FILE"] and b.stats == {"succeeded": 1, "failed": 3}
    for call, err in ((dict(filepath="nope"), FileNotFound), (dict(filepath="raw.txt"), BinaryFile), (dict(filepath="../x"), PathTraversal), (dict(filepath=".env"), AccessDenied), (dict(), InvalidParams), (dict(filepath="a", start_line=0), InvalidParams), (dict(paths=["a"] * 11), InvalidParams)):
        with pytest.raises(err):
            corpus.read(**call)


def test_inspect(corpus):
    a = corpus.inspect("app/a.py::A.go", include_dependencies=True, include_imports=True)
    r = a.rows.first()
    assert r["content"].startswith("def go") and r["parent_name"] == "A" and r["imports"] == ["import os", "from a import b"]
    assert [(d["dst_path"], d["dst_symbol"]) for d in r["dependencies"]] == [("app/a.py", "helper")] and a.stats["degraded_reason"] == "grep_fallback_dependencies"
    with pytest.raises(SymbolNotFound) as e:
        corpus.inspect("app/a.py::A.gp")
    assert "A.go" in e.value.details["did_you_mean"]
    assert corpus.inspect("src/lib.rs::Foo::new").rows.first()["semantic_path"] == "Foo.new"
    with pytest.raises(InvalidSemanticPath):
        corpus.inspect("app/a.py")


def test_locate(corpus):
    r = corpus.locate(locations=[("app/a.py", 6), ("app/a.py", 1)]).rows.collect()
    assert [x["semantic_path"] for x in r] == ["app/a.py::A.go", None]
    d = corpus.locate("app/a.py::helper").rows.first()
    assert (d["path"], d["line"], d["resolution_strategy"]) == ("app/a.py", 10, "symbol_index")
    m = corpus.locate("src/lib.rs::helper#9")
    assert m.stats["degraded_reason"] in ("grep_fallback_file_scoped", "grep_fallback_global")
    with pytest.raises(SymbolNotFound):
        corpus.locate("app/a.py::zzzzzz")


def test_trace(corpus):
    a = corpus.trace("app/a.py::helper")
    got = {(r["semantic_path"], r["direction"]) for r in a.rows.collect()}
    assert got == {("app/a.py::A.go", "incoming"), ("app/a.py::needle", "incoming")} and a.stats["incoming_verified"] is False and a.stats["outgoing"] == 0
    refs = corpus.trace("app/a.py::helper", scope="references")
    assert [(r["line"], r["full_path"]) for r in refs.rows.collect()][:2] == [(6, "app/a.py::A.go"), (14, "app/a.py::needle")]
    o = corpus.trace("app/a.py::helper", scope="overview")
    assert o.rows.filter("direction = 'reference'").count() == refs.stats["total"]


def test_authoritative_edges_are_verified(spark, corpus):
    e = spark.createDataFrame([("app/a.py", "A.go", "app/a.py", "helper", [6], "lsp")], "src_path string, src_symbol string, dst_path string, dst_symbol string, call_sites array<int>, confidence string")
    c = Corpus(corpus.files, authoritative=e)
    c.__dict__["symbols"] = corpus.symbols
    a = c.trace("app/a.py::helper")
    assert a.stats["incoming_verified"] and a.rows.filter("semantic_path = 'app/a.py::A.go'").first()["confidence"] == "lsp"


def test_explore(corpus):
    a = corpus.explore()
    assert "class A // A" in a.text and "_hidden" in a.text and "File: src/lib.rs" in a.text and a.stats["coverage_percent"] <= 100
    assert "func _p" not in a.text and "func _p" in corpus.explore(visibility="all").text
    f = corpus.explore(detail="files").text.split("\n")
    assert "src/lib.rs" in f and "README.md" not in f
    s = corpus.explore(detail="structure")
    assert "src/" in s.text and "Cargo.toml" in s.text
    small = corpus.explore(max_tokens=500, max_tokens_per_file=10)
    assert "[TRUNCATED" in small.text
    assert corpus.explore(changed=corpus.spark.createDataFrame([], "path string")).text == ""
    with pytest.raises(InvalidParams):
        corpus.explore(include_extensions=["py"], exclude_extensions=["rs"])


def test_health(corpus):
    a = corpus.health()
    assert a.stats["overall_status"] == "ready" and {r["language"] for r in a.rows.collect()} >= {"rust", "python", "go"}


def test_saved_index(spark, corpus, tmp_path):
    corpus.save(str(tmp_path))
    c = Corpus.open_saved(spark, str(tmp_path))
    assert c.search("login", mode="symbol").stats["total_found"] == 2


def test_registered_search_holds_files_with_long_lines(spark, tmp_path):
    text = "é" * 600 + "\nsee that\n" + "x" * 1001 + "\ny\nz\n" + "that " * 300
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["line"]: r for r in catalogue.QUERIES["search_context"](spark, str(tmp_path)).collect()}
    digest = lambda before, after: hashlib.sha256(f"{before}\x01{after}".encode()).hexdigest()
    mark = "... [TRUNCATED]"
    assert got[2]["content"] == "see that" and got[2]["context_sha256"] == digest("é" * 500 + mark, "x" * 1000 + mark + "\ny")
    assert got[6]["content"] == "that " * 200 + mark and got[6]["context_sha256"] == digest("y\nz", "")


def test_registered_line_names_hold_every_line(spark, tmp_path):
    text = "  pub fn go(x)\nclass Box:\nplain words\n(1) first\n\nModule m\na let b"
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["line"], r["kind"], r["name"]) for r in catalogue.QUERIES["line_names"](spark, str(tmp_path)).collect())
    assert got == [(1, "function", "go"), (2, "class", "Box"), (3, "unknown", "plain"), (4, "unknown", "(1)"), (5, "unknown", ""), (6, "module", "Module"), (7, "constant", "b")]


def test_registered_elements_of_a_link_named_test(spark, tmp_path):
    spark.createDataFrame([(1, '<a href="/test/1"><a href="/a"><a href="/test">'), (2, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["line"], r["kind"], r["semantic_path"]) for r in catalogue.QUERIES["elements_of_links"](spark, str(tmp_path)).collect())
    want = []
    for line, name, tag in ((1, "w_test", "Ctest"), (4, "w_a", "Ca"), (7, "w_test#2", "Ctest")):
        want += [(line, "Function", name), (line + 1, "Component", f"{name}.return.{tag}"), (line + 1, "HtmlElement", f"{name}.return.p")]
    assert got == want
