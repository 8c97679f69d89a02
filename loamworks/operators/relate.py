"""Hard-coded relations: positions to symbols and token types, definitions, references, and rows chosen by priority."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..functions import patterns as D
from ..functions import text as X


def enclosing(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """``rows`` (path, line from 1, ...) with the innermost symbol around the line: enclosing_semantic_path, enclosing_kind, enclosing_start; null where there is none.

    Of a line's symbols the shortest is the innermost, of equals the one
    visited last. Symbols of files with asked lines and the distinct asked
    lines are sorted together, by path and line; one sweep over a file's rows
    holds the symbols that are open, so rows read are symbols and lines asked
    for, and no line is spread.
    """
    asked = rows.select("path", F.col("line").cast("long").alias("line")).filter("path is not null and line is not null").distinct()
    s = symbols.join(asked.select("path").distinct(), "path", "left_semi")
    opens = s.select("path", (F.col("start_line") + 1).cast("long").alias("line"), (F.col("end_line") + 1).cast("long").alias("last"), "symbol_id", "semantic_path", "kind", F.col("start_line").cast("int").alias("start_line"))
    events = opens.unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    best = events.repartition("path").sortWithinPartitions("path", "line", F.asc_nulls_first("asked")).mapInArrow(_swept, "path string, line long, enclosing_semantic_path string, enclosing_kind string, enclosing_start int")
    return rows.join(best, ["path", "line"], "left")


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The innermost open symbol of each asked line; of the heap's symbols, shortest first, those that have ended never come back."""
    path, heap = None, []
    for b in batches:
        out = []
        for p, line, last, number, name, kind, start, asked in zip(*(b.column(c).to_pylist() for c in ("path", "line", "last", "symbol_id", "semantic_path", "kind", "start_line", "asked")), strict=True):
            if p != path:
                path, heap = p, []
            if not asked:
                heapq.heappush(heap, (last - line, -number, last, name, kind, start))
                continue
            while heap and heap[0][2] < line:
                heapq.heappop(heap)
            out.append((p, line, *(heap[0][3:] if heap else (None, None, None))))
        columns = zip(*out, strict=True) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()), strict=True)], names=["path", "line", "enclosing_semantic_path", "enclosing_kind", "enclosing_start"])


def with_definition_flag(rows: DataFrame) -> DataFrame:
    """is_definition: whether the row is the first line of its enclosing symbol; null without one."""
    return rows.withColumn("is_definition", F.when(F.col("enclosing_start").isNotNull(), F.col("enclosing_start") == F.col("line") - 1))


def semantic_path_or(rows: DataFrame, name: Column) -> DataFrame:
    """full_path: file::enclosing symbol, or file::name."""
    return rows.withColumn("full_path", F.concat("path", F.lit("::"), F.coalesce(F.col("enclosing_semantic_path"), name)))


def node_types(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rows`` (path, line, column) with node_type: comment, string or code; null where the language is unknown.

    Spans do not overlap, so only the last one that begins at or before a
    place can hold it: spans and places are sorted together and the last span
    is carried along.
    """
    places = rows.select("path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column")).filter("path is not null and line is not null and column is not null").distinct()
    t = tokens.join(places.select("path").distinct(), "path", "left_semi")
    begins = t.select("path", F.col("start_line").cast("long").alias("line"), F.col("start_col").cast("long").alias("column"), F.struct("end_line", "end_col", "node_type").alias("span"))
    events = begins.unionByName(places.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("path").orderBy("line", "column", F.asc_nulls_first("asked")).rowsBetween(Window.unboundedPreceding, 0)
    held = events.withColumn("span", F.last("span", ignorenulls=True).over(order)).filter("asked")
    inside = (F.col("line") < F.col("span.end_line")) | ((F.col("line") == F.col("span.end_line")) & (F.col("column") < F.col("span.end_col")))
    hit = held.filter(inside).select("path", "line", "column", F.col("span.node_type").alias("_t"))
    known = P.symbol_language_of(F.col("path")).isNotNull()
    return rows.join(hit, ["path", "line", "column"], "left").withColumn("node_type", F.when(known, F.coalesce("_t", F.lit("code")))).drop("_t")


def passes_mode(mode: str) -> Column:
    """Whether a row with node_type passes a filter mode; rows of an unknown language do."""
    if mode == "all":
        return F.lit(True)
    return F.col("node_type").isNull() | F.col("node_type").isin(*(["code"] if mode == "code_only" else ["comment", "string"]))


def filtered_by_mode(rows: DataFrame, mode: str) -> DataFrame:
    """Rows with node_type that a filter mode lets through."""
    return rows.filter(passes_mode(mode))


def first_by(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def most_of_each(rows: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """At most k rows for each key, the first in the order, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def cascade(*candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ordered fallback: of each key (or of all) the rows of the first list that has any, with ``priority``."""
    every = reduce(lambda a, b: a.unionByName(b), [c.withColumn("priority", F.lit(i)) for i, c in enumerate(candidates)])
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    if keys:
        return every.withColumn("_p", F.min("priority").over(w)).filter(F.col("priority") == F.col("_p")).drop("_p")
    least = every.agg(F.min("priority").alias("_p"))  # one row
    return every.join(F.broadcast(least), F.col("priority") == F.col("_p")).drop("_p")


_STRATEGIES = ("text_file", "text_impl", "text_global", "text_broad")


def definition_candidates(files: DataFrame, symbols: DataFrame, name: str, expected: str | None = None, parent: str | None = None) -> DataFrame:
    """path, line, column, preview and resolution_strategy of a name's definition lines, in the order of the cascade:
    the expected file, files that implement the parent, all files but tests and mocks, any mention."""
    ls = files.filter(F.contains("text", F.lit(name))).select("path", P.extension(F.col("path")).alias("ext"), F.posexplode(X.lines_of(F.col("text"))).alias("at", "content")).filter(F.contains("content", F.lit(name)))
    defined = ls.filter(D.any_definition(F.col("ext"), name))
    row = lambda d, s: d.select("path", (F.col("at") + 1).cast("long").alias("line"), X.match_column(F.col("content"), name, False).alias("column"), X.preview(F.trim("content")).alias("preview"), F.lit(_STRATEGIES[s]).alias("resolution_strategy"))
    steps = []
    if expected:
        steps.append(row(defined.filter(F.col("path") == expected), 0))
    if parent:
        n = X.literal_regex(parent)
        impl = files.filter(F.col("text").rlike(rf"\bimpl\b[^{{;]*\b{n}\b|\bclass\s+{n}\b|\bfunc\s*\([^)]*\b{n}\b")).select("path")
        steps.append(row(defined.join(impl, "path", "left_semi"), 1))
    tests = F.col("path").rlike(r"(?i)(^|/)(tests?|mocks?|__tests__|__mocks__|fixtures?)/")
    steps.append(row(defined.filter(~tests), 2))
    steps.append(row(ls.filter(F.col("content").rlike(rf"\b{X.literal_regex(name)}\b")), 3))
    return cascade(*steps)


def references(files: DataFrame, name: str, definition_path: str | None = None, definition_line: int | None = None) -> DataFrame:
    """path, line, column and snippet of a name's mentions; the definition's own line, and lines of its file that define the name, are left out."""
    ls = files.filter(F.contains("text", F.lit(name)) & P.is_workspace_source(F.col("path"))).select("path", P.extension(F.col("path")).alias("ext"), F.posexplode(X.lines_of(F.col("text"))).alias("at", "content"))
    word = rf"\b{X.literal_regex(name)}\b"
    hits = ls.filter(F.col("content").rlike(word)).withColumn("line", (F.col("at") + 1).cast("long"))
    if definition_path is not None:
        own = F.col("path") == definition_path
        at_line = (F.col("line") == definition_line) if definition_line is not None else F.lit(False)
        hits = hits.filter(~(own & (at_line | D.any_definition(F.col("ext"), name))))
    return hits.select("path", "line", X.match_column(F.col("content"), word, True).alias("column"), F.substring(F.trim("content"), 1, 512).alias("snippet"))


def without(rows: DataFrame, others: DataFrame, keys: tuple[str, ...] = ("path", "line", "column")) -> DataFrame:
    """References less implementations (left anti join)."""
    return rows.join(others.select(*keys), list(keys), "left_anti")


def nth_duplicate(rows: DataFrame, scope: list[str], name: str, *order) -> DataFrame:
    """unique_name: the name, and name#2, name#3 for its repetitions in a scope."""
    n = F.row_number().over(Window.partitionBy(*scope, name).orderBy(*order))
    return rows.withColumn("n", n.cast("long")).withColumn("unique_name", F.when(F.col("n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), F.col("n").cast("string"))))


def resolve_chain(symbols: DataFrame, path: str, segments: list[tuple[str, int | None]]) -> DataFrame:
    """The symbol that a chain of (name, n) names: the n-th of that name at each level, as its semantic path says."""
    label = ".".join(n if not i or i == 1 else f"{n}#{i}" for n, i in segments)
    return symbols.filter((F.col("path") == path) & (F.col("semantic_path") == label))


def visible(symbols: DataFrame, visibility: str = "public", include_tests: bool = False) -> DataFrame:
    """Public and protected symbols whose ancestors are so too; a parent without visible children stays.

    A symbol is hidden with any ancestor: the hidden ones' semantic paths are
    prefixes, met by an equi-join on each symbol's own prefixes.
    """
    if visibility == "all":
        return symbols
    test = F.lit(include_tests) & ((F.col("kind") == "Test") | ((F.col("kind") == "Module") & F.col("name").isin("test", "tests")) | (F.col("kind").isin("Function", "Method") & F.col("name").rlike("^(test_|it_)|_test$")))
    s = symbols.withColumn("_hidden", ~(F.col("access_level").isin("Public", "Protected") | test))
    hidden = s.filter("_hidden").select("path", F.col("semantic_path").alias("_up"))
    parts = F.split("semantic_path", r"(?<!\\)\.")
    up = s.select("path", "symbol_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("_up"))
    gone = up.join(hidden, ["path", "_up"]).select("path", "symbol_id").distinct()
    return s.drop("_hidden").join(gone, ["path", "symbol_id"], "left_anti")
