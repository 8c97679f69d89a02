"""Scalar functions: paths, text, patterns."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamworks.functions import paths as P
from loamworks.functions import patterns as D
from loamworks.functions import text as X
from loamworks.model import InvalidParams


def one(spark, *columns, **values):
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    r = d.select(*columns).first()
    return r[0] if len(r) == 1 else tuple(r)


@pytest.mark.parametrize(
    "path, ext, name, depth",
    [("a/b.tar.gz", "gz", "b.tar.gz", 1), (".env", None, ".env", 0), ("x", None, "x", 0), ("a/.b.py", "py", ".b.py", 1), ("a/b.", None, "b.", 1)],
)
def test_path_parts(spark, path, ext, name, depth):
    p = F.col("p")
    assert one(spark, P.extension(p), P.basename(p), P.depth(p), p=path) == (ext, name, depth)


@pytest.mark.parametrize("path, lang, sym", [("a.tsx", "typescript", "tsx"), ("x.mjs", "javascript", None), ("Dockerfile", "dockerfile", None), ("a.zzz", "text", None), ("A.java", "java", "java"), ("b.vue", "text", "vue")])
def test_languages(spark, path, lang, sym):
    assert one(spark, P.language_of(F.col("p")), P.symbol_language_of(F.col("p")), p=path) == (lang, sym)


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("**/*.rs", ["a.rs", "x/y/a.rs"], ["a.rsx", "rs"]),
        ("src/*.{ts,tsx}", ["src/a.ts", "src/d/b.tsx"], ["a.ts", "src/a.js"]),
        ("a?c", ["abc"], ["ac", "abbc"]),
        ("[!x]*.py", ["a.py"], ["x.py"]),
        ("**/test/**", ["test/a", "b/test/c/d"], ["tests/a"]),
        (r"a\*b", ["a*b"], ["axb"]),
    ],
)
def test_globs(spark, glob, yes, no):
    d = spark.createDataFrame([(p,) for p in yes + no], "p string").filter(P.matches_glob(F.col("p"), glob))
    assert sorted(r[0] for r in d.collect()) == sorted(yes)


def test_bad_globs():
    for g in ("a{b", "a[b"):
        with pytest.raises(InvalidParams):
            P.glob_regex(g)


@pytest.mark.parametrize(
    "path, tier",
    [
        (".git/config", "hardcoded_deny"), (".gitignore", None), (".gitignorex", None), (".github/workflows/ci.yml", None), ("a/b.PEM", "hardcoded_deny"), ("../x", "hardcoded_deny"), ("/etc/passwd", "hardcoded_deny"),
        (".env", "default_deny"), ("a/.env", "default_deny"), (".env.local", "default_deny"), ("vendor/x.go", "default_deny"), ("src/vendor/x.go", None), ("vendors/x", None),
        ("a.log", "default_deny"), ("x/temp/y", "default_deny"), ("template/y", None), ("note.txt", "user_defined"), ("keep/note.txt", None),
    ],
)
def test_access_tiers(spark, path, tier):
    assert one(spark, P.denied_tier(F.col("p"), ["*.log", "temp/"], [], ["*.txt", "!keep/*.txt"]), p=path) == tier


def test_overrides_allow(spark):
    assert one(spark, P.denied_tier(F.col("p"), [], ["dist/"]), p="dist/a.js") is None


@pytest.mark.parametrize("path, ok", [("src/a.rs", True), ("/abs/a.rs", False), ("C:/a.rs", False), ("node_modules/x/a.js", False), ("std/vec.rs", False), ("stdlib/vec.rs", True), ("a.md", False)])
def test_workspace_source(spark, path, ok):
    assert one(spark, P.is_workspace_source(F.col("p")), p=path) is ok


def test_excluded_dirs_at_any_depth(spark):
    d = spark.createDataFrame([(p,) for p in ("dist/a", "x/node_modules/b", "distx/a", "a/target")], "p string")
    assert [r[0] for r in d.filter(P.in_excluded_dir(F.col("p"))).orderBy("p").collect()] == ["dist/a", "x/node_modules/b"]


@pytest.mark.parametrize("glob, ext", [("**/*.rs", "rs"), ("**/*.tsx", "tsx"), ("**/*.{ts,tsx}", None), ("**/*", None), ("**/*.xyz", None)])
def test_single_extension(glob, ext):
    assert P.single_extension(glob) == ext


def test_semantic_paths(spark):
    sp = F.col("s")
    segments = one(spark, P.semantic_segments(sp), s="src/a.ts::Auth.login#2..x#y")
    assert [(x["name"], x["overload_index"]) for x in segments] == [("Auth", None), ("login", 2)]
    assert one(spark, P.semantic_format(P.semantic_file(sp), P.semantic_segments(sp)), s="a.ts::Auth.login#2") == "a.ts::Auth.login#2"
    assert one(spark, P.separators_corrected(sp), s="a.rs::A::b") == "a.rs::A.b"
    assert one(spark, P.semantic_chain(sp), P.semantic_file(sp), s="a.rs") == (None, "a.rs")


def test_uris_round_trip(spark):
    for p in ("/a b/c.rs", "/x+y/é.py", "/plain"):
        assert one(spark, P.path_of_uri(P.file_uri(F.col("p"))), p=p) == p


@pytest.mark.parametrize("text, lines", [("a\nb\n", ["a", "b"]), ("a\r\nb", ["a", "b"]), ("", []), ("\n", [""]), ("a\n\n", ["a", ""])])
def test_lines(spark, text, lines):
    assert one(spark, X.lines_of(F.col("t")), t=text) == lines


def test_match_column_counts_code_points(spark):
    assert one(spark, X.match_column(F.col("t"), "foo", False), X.match_column(F.col("t"), "fo+", True), t="😀é foo") == (4, 4)
    assert one(spark, X.match_column(F.col("t"), "^a", True), t="a") == 1


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="aé€😀", min_size=0, max_size=700))
def test_byte_cut(spark, s):
    got = one(spark, X.truncated(F.col("t")), t=s)
    want = s if len(s.encode()) <= 1000 else s.encode()[:1000].decode("utf-8", "ignore") + X.TRUNCATED
    assert got == want


def test_preview_and_snippet(spark):
    assert one(spark, X.preview(F.col("t"), 3), t="abcdef") == "abc..."
    assert one(spark, X.preview(F.col("t"), 3), t="éé") == "éé"
    ls = F.array(F.lit("  x "), F.lit("y"))
    assert one(spark, X.snippet(ls, F.lit(1)), X.snippet(ls, F.lit(9)), X.snippet(ls, F.lit(0))) == ("x", "", "")


def test_numbered(spark):
    ls = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, X.numbered(ls, 9)) == ["     9 | a", "    10 | b"]
    assert one(spark, X.numbered(ls, 1, None)) == ["1: a", "2: b"]


def test_regex_dialect():
    for bad in ("", "(?=a)", r"(a)\1", "(", "(?<!x)y"):
        with pytest.raises(InvalidParams):
            X.checked_regex(bad)
    assert X.checked_regex(r"\\1|\d+") and X.literal_regex("a.b(c)") == r"a\.b\(c\)"


def test_hashes(spark):
    full = one(spark, X.version_hash(F.col("t")), t="x")
    assert full.startswith("sha256:") and len(full) == 71
    assert one(spark, X.short_hash(F.col("t")), X.same_version(F.col("t"), F.lit(full[7:15])), X.same_version(F.col("t"), F.lit(full[7:12])), t=full) == (full[7:14], True, False)


@pytest.mark.parametrize("n, text, back", [(0, "0s", 0), (59, "59s", 59), (180, "3m", 180), (185, "3m5s", 185), (7260, "2h1m", 7260), (7261, "2h1m", 7260), (7200, "2h", 7200)])
def test_uptime(spark, n, text, back):
    assert one(spark, X.uptime(F.col("n")), X.uptime_seconds(X.uptime(F.col("n"))), n=n) == (text, back)


def test_backoff_and_probe(spark):
    assert one(spark, X.backoff(F.lit(3)), X.backoff(F.lit(9)), X.probe_interval(F.lit(60)), X.probe_interval(F.lit(61)), X.probe_interval(F.lit(None).cast("long"))) == (8, 60, 10, 30, 120)
    assert one(spark, X.probe_valid(F.lit(9), F.lit(10)), X.probe_valid(F.lit(10), F.lit(10)), X.probe_valid(F.lit(29), F.lit(1000)), X.probe_valid(F.lit(30), F.lit(1000))) == (True, False, True, False)


def test_json(spark):
    j = '{"a":{"b":[1,"x"]},"c~d":2}'
    assert one(spark, X.json_at(F.col("j"), "/a/b/1"), X.json_at(F.col("j"), "/a/b/0", "int"), X.json_at(F.col("j"), "/c~0d", "int"), X.json_at(F.col("j"), "/no", "int", 7), j=j) == ("x", 1, 2, 7)
    assert X.strip_jsonc('{"a": "// no", /* x */ "b": [1, 2,], // y\n}') == '{"a": "// no",  "b": [1, 2] \n}'
    assert one(spark, X.jsonc_to_json(F.col("j")), j='{"a":1,}') == '{"a":1}'


@pytest.mark.parametrize(
    "ext, line, name, hit",
    [
        ("rs", "pub async fn run(x: u8) {", "run", True), ("rs", "run();", "run", False), ("rs", "macro_rules! run {", "run", True), ("ts", "export const f = (a) => a", "f", True), ("js", "function  go()", "go", True),
        ("py", "    async def go(self):", "go", True), ("py", "go = 3", "go", True), ("py", "x.go = 3", "go", False), ("go", "func (s *S) Do(", "Do", True), ("java", "  public static List<String> foo(", "foo", True), ("java", "return new Foo(", "Foo", False), ("zz", "any go here", "go", True),
    ],
)
def test_definitions(spark, ext, line, name, hit):
    d = spark.createDataFrame([(ext, line)], "ext string, content string")
    assert d.select(D.any_definition(F.col("ext"), name)).first()[0] is hit


def test_line_heuristics(spark):
    for line, kind, name in (("pub fn run() {", "function", "run"), ("class A:", "class", "A"), ("x = 1", "unknown", "x"), ("const K = 1", "constant", "K"), ("  @deco", "unknown", "@deco"), ("", "unknown", "")):
        assert one(spark, D.kind_of_line(F.col("t")), D.name_of_line(F.col("t")), t=line) == (kind, name)


def test_calls_and_kinds(spark):
    assert one(spark, D.call_names(F.col("t")), t="if (a) { foo(1); bar.baz (foo()) }") == ["if", "foo", "baz"]
    assert one(spark, D.public_kind(F.lit("Test")), D.public_kind(F.lit("Zone")), D.protocol_kind(F.lit(12)), D.protocol_kind(F.lit(3))) == ("function", "unknown", "function", "symbol")
    assert one(spark, D.relevance("ab", F.lit("ab")), D.relevance("ab", F.lit("abc")), D.relevance("ab", F.lit("xab")), D.relevance("ab", F.lit("x"))) == (3, 2, 1, 0)
