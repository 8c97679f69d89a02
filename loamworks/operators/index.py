"""The symbol index: symbols, token spans and heuristic edges of a corpus as tables, refreshed by content hash."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import paths as P
from ..functions import patterns as D
from ..model import EDGES, FAULTS, SYMBOLS, TOKENS, names as columns
from . import extract


#: Rows of a batch that a parser gives back, but for those of one file.
ROWS = 20_000


def _rows(kind: str):
    make, schema = {"symbols": (extract.flattened, SYMBOLS), "tokens": (extract.token_rows, TOKENS), "faults": (extract.fault_rows, FAULTS)}[kind]
    names = columns(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, lang, text in zip(b["path"], b["lang"], b["text"], strict=True):
                out += [(p, *r) for r in make(text, lang)]
                if len(out) >= ROWS:
                    yield table(out)
                    out = []
            yield table(out)

    def table(out: list[tuple]) -> pd.DataFrame:
        d = pd.DataFrame(out, columns=names)
        if kind == "symbols":
            d["parent_id"] = d["parent_id"].astype("Int32")
        return d

    return run


def _parsable(files: DataFrame) -> DataFrame:
    lang = P.symbol_language_of(F.col("path"))
    return files.filter(F.col("text").isNotNull() & lang.isNotNull()).select("path", lang.alias("lang"), "text")


def symbols(files: DataFrame) -> DataFrame:
    """SYMBOLS of all files whose language is known."""
    return _parsable(files).mapInPandas(_rows("symbols"), SYMBOLS)


def tokens(files: DataFrame) -> DataFrame:
    """TOKENS: comment and string spans of all files whose language is known."""
    return _parsable(files).mapInPandas(_rows("tokens"), TOKENS)


def faults(files: DataFrame) -> DataFrame:
    """FAULTS: what the parser could not place, a row for each bracket, string or comment left open and each error of syntax. Files without rows were read as a whole."""
    return _parsable(files).mapInPandas(_rows("faults"), FAULTS)


def zones(files: DataFrame) -> DataFrame:
    """path, zone, start and end (in characters, from 0, the end exclusive) of the first script, template and style of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *z) for p, text in zip(b["path"], b["text"], strict=True) for z in extract.zones(text)], columns=["path", "zone", "start", "end"])

    return files.filter("text is not null").select("path", "text").mapInPandas(run, "path string, zone string, start long, end long")


class ExtractSymbols:
    """For SQL: SELECT s.* FROM files, LATERAL extract_symbols(language, text) s"""

    def eval(self, language: str, text: str):
        if language and text:
            yield from extract.flattened(text, language)


def register(spark: SparkSession) -> None:
    spark.udtf.register("extract_symbols", udtf(ExtractSymbols, returnType=SYMBOLS.split(", ", 1)[1]))


def refreshed(files: DataFrame, old_files: DataFrame, old_rows: DataFrame, build=symbols) -> DataFrame:
    """Index rows for ``files``: those of files whose hash is as before are kept, only others are parsed. ``old_files``: path, version_hash."""
    same = files.join(old_files.select("path", "version_hash"), ["path", "version_hash"], "left_semi").select("path")
    new = files.join(old_files.select("path", "version_hash"), ["path", "version_hash"], "left_anti")
    return old_rows.join(same, "path", "left_semi").unionByName(build(new))


def bodies(files: DataFrame, syms: DataFrame) -> DataFrame:
    """Symbols with their source text and their parent's kind and name."""
    text = F.decode(F.substr(F.encode("text", "UTF-8"), F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte")), "UTF-8")
    parent = syms.select("path", F.col("symbol_id").alias("parent_id"), F.col("kind").alias("parent_kind"), F.col("name").alias("parent_name"))
    return syms.join(files.select("path", "text", P.symbol_language_of(F.col("path")).alias("language")), "path").withColumn("content", text).drop("text").join(parent, ["path", "parent_id"], "left")


_FAMILY = {"rs": "rust", "go": "go", "py": "python", "java": "java"}
_CALLABLE = ("Function", "Method", "Test")


def _family(path: Column) -> Column:
    """Languages whose files call one another."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in _FAMILY.items() for x in p]), P.extension(path)), F.lit("js"))


def calls(files: DataFrame, syms: DataFrame, most_calls: int | None = None) -> DataFrame:
    """A row for each name that a function calls: src_path, src_symbol, family, name, call_sites (lines), truncated.

    The function's own name does not count. ``most_calls``: no more names than
    that of a function, in order of their first call; ``truncated`` tells on
    the others' rows that some were left out.
    """
    b = bodies(files, syms.filter(F.col("kind").isin(*_CALLABLE))).filter("content is not null")
    keyword = None
    for lang in D.CALL_KEYWORDS:
        test = F.col("language") == lang if lang != "typescript" else F.col("language").isin("typescript", "tsx")
        some = F.array(*[F.lit(k) for k in D.keywords(lang)])
        keyword = F.when(test, some) if keyword is None else keyword.when(test, some)
    other = F.array(*[F.lit(k) for k in D.OTHER_KEYWORDS])
    names = F.array_except(D.call_names(F.col("content")), F.concat(F.coalesce(keyword, other), F.array("name")))
    cut = F.slice("names", 1, most_calls) if most_calls else F.col("names")
    d = b.withColumn("names", names).select(F.col("path").alias("src_path"), F.col("semantic_path").alias("src_symbol"), _family(F.col("path")).alias("family"), (F.col("start_line") + 1).alias("first"), F.split("content", "\n").alias("ls"), (F.size("names") > (most_calls or 2**31 - 1)).alias("truncated"), F.explode(cut).alias("name"))
    used = F.concat(F.lit(r"\b"), F.col("name"), F.lit(r"\s*\("))
    sites = F.filter(F.transform("ls", lambda x, i: F.when(F.contains(x, F.col("name")) & F.regexp_like(x, used), (F.col("first") + i).cast("int"))), lambda i: i.isNotNull())
    return d.select("src_path", "src_symbol", "family", "name", sites.alias("call_sites"), "truncated")


def definitions(syms: DataFrame) -> DataFrame:
    """The definition that a name means in other files of its family: the first by path and line. family, name, dst_path, dst_symbol."""
    first = F.min_by(F.struct(F.col("path").alias("dst_path"), F.col("semantic_path").alias("dst_symbol")), F.struct("path", "start_line", "semantic_path"))
    return syms.filter(F.col("kind").isin(*_CALLABLE)).groupBy(_family(F.col("path")).alias("family"), "name").agg(first.alias("d")).select("family", "name", "d.*")


def resolved(called: DataFrame, syms: DataFrame) -> DataFrame:
    """EDGES of calls, with family, name and truncated. A name means its first definition in the caller's own file, else the first of all.

    Definitions are reduced to one for each file and name, and one for each
    family and name, before they meet the calls: as many rows are joined as
    there are calls and definitions, however common a name is.
    """
    own = F.min_by("semantic_path", F.struct("start_line", "semantic_path"))
    near = syms.filter(F.col("kind").isin(*_CALLABLE)).groupBy(F.col("path").alias("src_path"), "name").agg(own.alias("own"))
    met = called.join(near, ["src_path", "name"], "left").join(definitions(syms), ["family", "name"], "left").filter("own is not null or dst_path is not null")
    to = lambda a, b: F.when(F.col("own").isNotNull(), a).otherwise(b)
    return met.select("src_path", "src_symbol", to(F.col("src_path"), F.col("dst_path")).alias("dst_path"), to(F.col("own"), F.col("dst_symbol")).alias("dst_symbol"), "call_sites", F.lit("heuristic").alias("confidence"), "family", "name", "truncated")


def edges(files: DataFrame, syms: DataFrame, most_calls: int | None = None) -> DataFrame:
    """EDGES by name: each function's called names, met with the definitions of that name in the same language family."""
    return resolved(calls(files, syms, most_calls), syms).select(*columns(EDGES))


def refreshed_edges(files: DataFrame, syms: DataFrame, old_files: DataFrame, old_syms: DataFrame, old_calls: DataFrame, old_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls and resolved edges of ``files`` made from those of an older state, and the calls that had to be resolved anew.

    Only changed files are parsed for calls. An edge is made anew if its
    caller's file changed, or if its name now means another definition; all
    others are kept. ``old_files``: path, version_hash; ``old_calls`` and
    ``old_edges``: of calls() and resolved().
    """
    key = ["path", "version_hash"]
    now, before = files.select(*key), old_files.select(*key)
    changed = now.join(before, key, "left_anti").select("path").union(before.join(now, key, "left_anti").select("path")).distinct()
    there = changed.withColumnRenamed("path", "src_path")
    fresh = files.join(changed, "path", "left_semi")
    called = old_calls.join(there, "src_path", "left_anti").unionByName(calls(fresh, syms.join(changed, "path", "left_semi")))
    a, b = definitions(old_syms), definitions(syms)
    moved = a.exceptAll(b).unionByName(b.exceptAll(a)).select("family", "name").distinct()
    kept = old_edges.join(there, "src_path", "left_anti").join(moved, ["family", "name"], "left_anti")
    again = called.join(there, "src_path", "left_semi").unionByName(called.join(there, "src_path", "left_anti").join(moved, ["family", "name"], "left_semi"))
    return called, kept.unionByName(resolved(again, syms)), again
