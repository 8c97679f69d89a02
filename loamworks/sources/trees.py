"""Sources: file trees, documents as files, change sets, settings, manifests, zones; and the sinks."""

from __future__ import annotations

import json
import os
import subprocess
import tomllib
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import paths as P
from ..functions import text as X
from ..functions.text import strip_jsonc
from ..model import BinaryFile, Config, FileNotFound, InvalidParams
from . import walk


IGNORE_FILES = (".gitignore", ".ignore")  # the later of one folder goes first
RULES_LIMIT = 1_000_000


class TreeSource(DataSource):
    """Files under a folder that all executors see, with names that Spark's own scan skips (``.x``, ``_x``); excluded folders are not walked into. Option ``names``: only files with these names."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, length long, modificationTime timestamp, content binary"

    def reader(self, schema) -> DataSourceReader:
        names = self.options.get("names", "")
        return _TreeReader(self.options["path"], self.options.get("contents", "true") == "true", set(self.options.get("excluded", "").split("|")), set(names.split("|")) if names else None)


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, contents: bool, excluded: set[str], names: set[str] | None = None, bytes_per_part: int = 32_000_000):
        self.root, self.contents, self.excluded, self.names, self.bytes_per_part = root, contents, excluded, names, bytes_per_part

    def partitions(self) -> list[InputPartition]:
        parts, now, size = [], [], 0
        for folder, dirs, files in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d not in self.excluded)
            for f in sorted(files):
                path = os.path.join(folder, f)
                if (self.names is not None and f not in self.names) or not os.path.isfile(path):
                    continue
                now.append(os.path.relpath(path, self.root))
                size += os.path.getsize(path) + 4096
                if size >= self.bytes_per_part:
                    parts.append(InputPartition(tuple(now)))
                    now, size = [], 0
        return [*parts, InputPartition(tuple(now))]

    def read(self, partition: InputPartition):
        for path in partition.value:
            full = os.path.join(self.root, path)
            content = None
            if self.contents:
                with open(full, "rb") as f:
                    content = f.read()
            yield path, os.path.getsize(full), datetime.fromtimestamp(os.path.getmtime(full), UTC), content


def _scan(spark: SparkSession, root: str, contents: bool, names: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), length, modificationTime, content; of files with these names, if any are given. Remote folders go through Spark's scan of binary files, which skips names with a leading dot or underscore."""
    base = root.rstrip("/")
    if base.startswith("file:") or "://" not in base:
        spark.dataSource.register(TreeSource)
        local = "/" + base.split(":", 1)[-1].lstrip("/") if base.startswith("file:") else os.path.abspath(base)
        return spark.read.format("file_tree").option("contents", str(contents).lower()).option("excluded", "|".join(P.EXCLUDED_DIRS)).option("names", "|".join(names)).load(local)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (raw.option("pathGlobFilter", "{" + ",".join(names) + "}") if names else raw).load(base)
    top = F.regexp_replace(F.lit(base), "^([a-z0-9]+):/+", "$1:/")
    return raw.withColumn("path", F.substr(F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/"), F.length(top) + 2))


def ignore_rules(spark: SparkSession, root: str, names: tuple[str, ...] = IGNORE_FILES) -> list[tuple[str, list[str]]]:
    """(folder, lines) of the ignore files in a tree, from the top down, and in one folder in the order of ``names``.

    They become conditions of a plan, so they come to the driver; a tree with
    more than ``RULES_LIMIT`` bytes of them is an error. Remote folders: those
    whose names have no leading dot or underscore.
    """
    found = _scan(spark, root, True, names).select("path", "length", F.col("content").cast("string").alias("text")).persist() if names else None
    if found is None:
        return []
    try:
        size = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        if size > RULES_LIMIT:
            raise InvalidParams(f"{size} bytes of ignore files, at most {RULES_LIMIT} are read")
        rows = [(r["path"].rpartition("/"), r["text"]) for r in found.collect()]
    finally:
        found.unpersist()
    rows.sort(key=lambda x: (x[0][0].count("/") + bool(x[0][0]), x[0][0], names.index(x[0][2])))
    return [(path[0], text.splitlines()) for path, text in rows]


def read_tree(spark: SparkSession, root: str, *, hidden: bool = True, ignore: list[str] | None = None, ignore_files: tuple[str, ...] = IGNORE_FILES, contents: bool = True, config: Config | None = None, in_tasks: bool = False) -> DataFrame:
    """The files under a folder as FILES, with ``ignored`` besides: by the tree's own ``ignore_files``, each below its folder, and by the rules of ``ignore``, which go first. Always-excluded folders and denied paths are left out, binaries have no text.

    ``contents`` False reads names, sizes and times only and opens no file but
    ignore files. ``in_tasks``: folders are listed by tasks, level by level, and
    those that the rules hide are not gone into, so files below them are no
    rows; else the driver walks, and such files are rows with ``ignored``.
    """
    settings = config or Config()
    if in_tasks:
        d = walk.files_of(walk.walked(spark, root, ignore, ignore_files))
        d = walk.with_contents(d, root) if contents else d
    else:
        d = _scan(spark, root, contents)
    d = d.filter(~P.in_excluded_dir(F.col("path")) & P.denied_tier(F.col("path"), settings.additional_deny, settings.allow_override, settings.ignore).isNull())
    if not hidden:
        d = d.filter(~F.col("path").rlike(r"(^|/)\."))
    if not in_tasks:
        d = d.withColumn("ignored", P.ignored_by(F.col("path"), ignore or [], ignore_rules(spark, root, ignore_files)))
    named = d.select("path", P.extension(F.col("path")).alias("ext"), P.language_of(F.col("path")).alias("language"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "ignored", *(["content"] if contents else []))
    if not contents:
        return named
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")) & ~P.is_binary(F.col("path")), F.col("content").cast("string"))
    return named.withColumn("text", text).withColumn("version_hash", X.version_hash(F.col("content")))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Each document as a file source/lang/doc_id.txt; its language is its lang."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(path.alias("path"), F.lit("txt").alias("ext"), F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), "text", X.version_hash(F.col("text")).alias("version_hash"), "doc_id")


def texts_as_files(spark: SparkSession, files: dict[str, str | bytes]) -> DataFrame:
    """FILES from paths and contents, for small corpora and tests."""
    rows = [(p, c.encode() if isinstance(c, str) else c) for p, c in files.items()]
    d = spark.createDataFrame(rows, "path string, content binary")
    return d.select(
        "path", P.extension(F.col("path")).alias("ext"), P.language_of(F.col("path")).alias("language"), F.octet_length("content").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), "content",
        F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"), X.version_hash(F.col("content")).alias("version_hash"),
    )


def source_filter(files: DataFrame, include: str | None = None, exclude: str | list[str] | None = None, extensions: list[str] | None = None, not_extensions: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """The chain of a scan: excluded folders, include glob, exclude globs, extensions, depth, binary names."""
    if extensions and not_extensions:
        raise InvalidParams("include_extensions and exclude_extensions exclude each other")
    p = F.col("path")
    cond = ~P.in_excluded_dir(p) & P.matches_glob(p, include) & P.matches_none(p, exclude)
    clean = lambda es: [e.lstrip(".").lower() for e in es]
    if extensions:
        cond &= F.coalesce(F.lower(P.extension(p)).isin(*clean(extensions)), F.lit(False))
    if not_extensions:
        cond &= ~F.coalesce(F.lower(P.extension(p)).isin(*clean(not_extensions)), F.lit(False))
    if max_depth is not None:
        cond &= P.depth(p) <= max_depth
    return files.filter(cond & ~P.is_binary(p))


def effective_depth(files: DataFrame, asked: int) -> int:
    """The depth asked for, and no less than 10 where there is Java, else 5."""
    java = files.agg(F.coalesce(F.bool_or(P.extension(F.col("path")) == "java"), F.lit(False))).first()[0]
    return max(asked, 10 if java else 5)


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directories, manifests) of a tree, from paths alone."""
    dirs = files.select(F.split(P.parent_dir(F.col("path")), "/").alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice(F.col("p"), F.lit(1), i), "/"))).alias("dir"))
    return dirs.filter("dir <> ''").distinct(), files.filter(P.is_manifest(F.col("path"))).select("path")


def changed_since(spark: SparkSession, repo: str, ref: str, seconds: int = 10) -> DataFrame:
    """Paths that git reports as changed since a reference."""
    if not ref or ref.startswith("-"):
        raise InvalidParams("not a reference")
    done = subprocess.run(["git", "-C", repo, "diff", "--name-only", ref, "--"], capture_output=True, text=True, timeout=seconds)
    if done.returncode:
        raise InvalidParams(f"git: {done.stderr.strip()}")
    return spark.createDataFrame([(x,) for x in done.stdout.split("\n") if x], "path string")


def changed_files(files: DataFrame, changes: DataFrame | None = None, since=None) -> DataFrame:
    """Files in a change set (left semi join) or modified at or after a time."""
    out = files if changes is None else files.join(changes.select("path"), "path", "left_semi")
    return out if since is None else out.filter(F.col("mtime") >= F.lit(since))


def read_config(path: str) -> Config:
    """Settings from an optional JSON file; unknown keys and wrong types are errors."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except FileNotFoundError:
        return Config()
    except ValueError as e:
        raise InvalidParams(f"{path}: {e}") from e
    try:
        return Config(**data)
    except TypeError as e:
        raise InvalidParams(f"{path}: {e}") from e


def count_source_files(files: DataFrame) -> int:
    return files.filter(~P.in_excluded_dir(F.col("path"), P.COUNT_SKIPPED_DIRS) & P.extension(F.col("path")).isin(*P.COUNTED_EXTENSIONS)).count()


# --- manifests and languages

# Fixed tables: markers of languages, and the files and extensions to try.
MARKERS = {"rust": ["Cargo.toml"], "go": ["go.mod"], "typescript": ["tsconfig.json", "package.json"], "python": ["pyproject.toml", "setup.py", "requirements.txt"], "java": ["pom.xml", "build.gradle", "build.gradle.kts"]}
PROBES = {
    "rust": ["src/main.rs", "src/lib.rs"],
    "go": ["main.go", "cmd/main.go"],
    "typescript": ["src/index.ts", "index.ts", "src/main.ts", "src/index.tsx", "index.tsx", "src/main.tsx"],
    "javascript": ["src/index.js", "index.js", "src/main.js", "src/index.jsx", "index.jsx", "src/main.jsx"],
    "python": ["src/__init__.py", "main.py", "setup.py", "__init__.py"],
    "ruby": ["lib/main.rb", "main.rb"],
    "java": ["src/main/java/Main.java", "src/main/java/App.java", "src/main/java/Application.java"],
}
PROBE_EXTENSIONS = {"rust": ["rs"], "go": ["go"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx"], "python": ["py"], "ruby": ["rb"], "java": ["java"]}


def _marker_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(lang, m) for lang, ms in MARKERS.items() for m in ms], "language string, marker string")


def language_roots(files: DataFrame, max_depth: int = 2) -> DataFrame:
    """language, n_markers and root of each language with a manifest within the depth: the manifest's folder, or the top if several folders have one."""
    spark = files.sparkSession
    some = files.filter(P.depth(F.col("path")) <= max_depth).select("path", P.basename(F.col("path")).alias("marker"))
    hits = some.join(F.broadcast(_marker_table(spark)), "marker").select("language", P.parent_dir(F.col("path")).alias("dir"))
    return hits.groupBy("language").agg(F.count("*").alias("n_markers"), F.when(F.count_distinct("dir") == 1, F.min("dir")).otherwise("").alias("root"))


def languages_present(files: DataFrame, max_depth: int = 8) -> DataFrame:
    """Languages with a source file within the depth (left semi join)."""
    table = files.sparkSession.createDataFrame([(lang, e) for lang, es in PROBE_EXTENSIONS.items() for e in es], "language string, ext string")
    seen = files.filter(P.depth(F.col("path")) <= max_depth).select("ext").distinct()
    return table.join(seen, "ext", "left_semi").select("language").distinct()


def probe_files(files: DataFrame) -> DataFrame:
    """language and path of the file to try: the first well-known path, else the first by path with the language's extension within depth 4 (Java 8)."""
    spark = files.sparkSession
    known = spark.createDataFrame([(lang, p, i) for lang, ps in PROBES.items() for i, p in enumerate(ps)], "language string, path string, priority int")
    ext = spark.createDataFrame([(lang, e, 8 if lang == "java" else 4) for lang, es in PROBE_EXTENSIONS.items() for e in es], "language string, ext string, most int")
    f = files.select("path", F.lower(P.extension(F.col("path"))).alias("ext"))
    first = f.select("path").join(F.broadcast(known), "path").select("language", "path", "priority")
    skip = P.in_excluded_dir(F.col("path"), ("node_modules", "target", "vendor", "dist", "build", "__pycache__")) | F.col("path").rlike(r"(^|/)\.[^/]*/")
    other = f.filter(~skip).join(F.broadcast(ext), "ext").filter(P.depth(F.col("path")) <= F.col("most")).select("language", "path", F.lit(99).alias("priority"))
    order = Window.partitionBy("language").orderBy("priority", "path")
    return first.unionByName(other).withColumn("r", F.row_number().over(order)).filter("r = 1").select("language", "path")


@F.pandas_udf(StringType())
def _toml_fault(names: pd.Series, texts: pd.Series) -> pd.Series:
    def fault(name: str, text: str | None) -> str | None:
        try:
            data = tomllib.loads(text or "")
        except tomllib.TOMLDecodeError as e:
            return f"not valid TOML: {e}"
        return "neither [package] nor [workspace]" if name == "Cargo.toml" and not {"package", "workspace"} & set(data) else None

    return pd.Series([fault(n, t) for n, t in zip(names, texts, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _json_fault(texts: pd.Series) -> pd.Series:
    def fault(text: str | None) -> str | None:
        try:
            json.loads(text or "")
        except ValueError:
            try:
                json.loads(strip_jsonc(text or ""))
            except ValueError as e:
                return f"not valid JSON: {e}"
        return None

    return pd.Series([fault(t) for t in texts], dtype=object)


def manifest_faults(files: DataFrame) -> DataFrame:
    """path and fault (null if valid) of the manifests that have rules. TOML and JSON go to Python, of these few files only."""
    name = P.basename(F.col("path"))
    d = files.filter(P.is_manifest(F.col("path"))).select("path", name.alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    line = F.try_element_at(F.filter(F.transform(F.split(F.col("text"), "\n"), F.trim), lambda x: (x != "") & ~F.startswith(x, F.lit("//"))), F.lit(1))
    go = F.when(line.isNull(), "empty or only comments").when(~line.rlike(r"^module\s+\S"), "no module declaration")
    native = F.when(F.col("name") == "go.mod", go).when((F.col("name") == "pom.xml") & ~F.contains("text", F.lit("<project")), "no <project element").when(F.col("name").isin("build.gradle", "build.gradle.kts") & (F.col("text") == ""), "empty")
    toml = d.filter(F.col("name").isin("Cargo.toml", "pyproject.toml")).select("path", _toml_fault("name", "text").alias("fault"))
    jsons = d.filter(F.col("name") == "tsconfig.json").select("path", _json_fault("text").alias("fault"))
    rest = d.filter(F.col("name").isin("go.mod", "pom.xml", "build.gradle", "build.gradle.kts")).select("path", native.alias("fault"))
    return rest.unionByName(toml).unionByName(jsons)


def whole_text(files: DataFrame, path: str) -> str:
    """The text of one file; not there and not text are different errors."""
    rows = files.filter(F.col("path") == path).select("text", "size").take(1)
    if not rows:
        raise FileNotFound(f"no such file: {path}")
    if rows[0]["text"] is None:
        raise BinaryFile(f"not UTF-8 text: {path}")
    return rows[0]["text"]


# --- sinks


def as_json(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as JSON."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def measured(df: DataFrame, name: str, *expressions: Column):
    """(df, Observation): counts and other aggregates that an action on df measures in passing."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *expressions), seen


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges that a compiler or language server exported, as EDGES with confidence ``lsp``."""
    return spark.read.parquet(path).withColumn("confidence", F.lit("lsp"))
