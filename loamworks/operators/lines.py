"""Line search: matches with columns and context, counters, pages and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..functions import text as X
from ..model import InvalidParams


def lines(files: DataFrame) -> DataFrame:
    """path, line and content of every line of every text. Columns of files that follow are kept."""
    rest = [c for c in files.columns if c not in ("path", "text", "content")]
    return files.filter("text is not null").select("path", *rest, F.posexplode(X.lines_of(F.col("text"))).alias("at", "content")).select("path", (F.col("at") + 1).cast("long").alias("line"), "content", *rest)


def find(files: DataFrame, query: str, *, regex: bool = False, context: int = 2) -> DataFrame:
    """A row for each line with a match: path, line, column, content, context_before, context_after, version_hash.

    Everything happens within the file's row: its lines that match are found
    as an array, and context reaches back to the line after the previous match
    and on to the line before the next one. So the search has no shuffle.
    """
    if not query:
        raise InvalidParams("the query is empty")
    pre = X.may_match(F.col("text"), query, regex)
    f = files.filter(F.col("text").isNotNull() & pre).select("path", "version_hash", X.lines_of(F.col("text")).alias("ls"))
    hit = lambda x: X.matches(x, query, regex)
    f = f.withColumn("hits", F.filter(F.transform("ls", lambda x, i: F.when(hit(x), i + 1)), lambda i: i.isNotNull())).filter(F.size("hits") > 0)
    m = f.select("path", "version_hash", "ls", "hits", F.posexplode("hits").alias("k", "line"))
    prev = F.coalesce(F.try_element_at("hits", F.when(F.col("k") > 0, F.col("k")).otherwise(F.lit(2**31 - 1))), F.lit(0))
    follow = F.coalesce(F.try_element_at("hits", F.col("k") + 2), F.size("ls") + 1)
    first = F.greatest(F.col("line") - context, prev, F.lit(1))
    last = F.least(F.col("line") + context, follow - 1, F.size("ls"))
    line = F.element_at("ls", F.col("line"))
    cut = lambda a: F.transform(a, X.truncated)
    return m.select(
        "path",
        F.col("line").cast("long").alias("line"),
        X.match_column(line, query, regex).alias("column"),
        X.truncated(line).alias("content"),
        cut(F.slice("ls", first, F.greatest(F.col("line") - first, F.lit(0)))).alias("context_before"),
        cut(F.slice("ls", F.col("line") + 1, F.greatest(last - F.col("line"), F.lit(0)))).alias("context_after"),
        "version_hash",
    )


def page(matches: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows offset+1 to offset+limit in order of path and line, with their rank; no sort beyond the top rows."""
    if offset < 0 or limit < 1:
        raise InvalidParams("offset must not be negative, max_results be positive")
    top = matches.orderBy("path", "line").limit(offset + limit).offset(offset)
    return top.withColumn("rank", (F.row_number().over(Window.orderBy("path", "line")) + offset).cast("long"))


def with_known(matches: DataFrame, known: DataFrame) -> DataFrame:
    """Matches with ``known``; of files the caller has, content and context are blanked. ``known``: path."""
    k = known.select(P.without_dot_slash(F.col("path")).alias("path")).distinct().withColumn("known", F.lit(True))
    m = matches.join(k, "path", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    blank = F.array().cast("array<string>")
    return m.withColumns({"content": F.when(F.col("known"), "").otherwise(F.col("content")), **{c: F.when(F.col("known"), blank).otherwise(F.col(c)) for c in ("context_before", "context_after") if c in matches.columns}})


def grouped(matches: DataFrame) -> DataFrame:
    """A row for each file: path, version_hash, total_matches, matches and known_matches in order of lines, and the rank of its first match."""
    full = F.struct("line", "column", "content", "context_before", "context_after", "enclosing_semantic_path", "is_definition")
    some = F.struct("line", "column", "enclosing_semantic_path", "is_definition")
    for c, kind in (("enclosing_semantic_path", "string"), ("is_definition", "boolean"), ("known", "boolean")):
        if c not in matches.columns:
            matches = matches.withColumn(c, F.lit(None).cast(kind) if c != "known" else F.lit(False))
    known = F.col("known")
    return matches.groupBy("path").agg(
        F.first("version_hash").alias("version_hash"),
        F.count("*").alias("total_matches"),
        F.array_sort(F.collect_list(F.when(~known, full))).alias("matches"),
        F.array_sort(F.collect_list(F.when(known, some))).alias("known_matches"),
        F.min("rank").alias("first_rank") if "rank" in matches.columns else F.min("line").alias("first_rank"),
    )


def counters(files: DataFrame, include: str | None = None, exclude=None) -> DataFrame:
    """One row of a scan's counters: files_in_scope, files_searched, binary_skipped, gitignored_skipped, other_skipped, coverage_percent."""
    p = F.col("path")
    scope = files.filter(~P.in_excluded_dir(p) & P.matches_glob(p, include) & P.matches_none(p, exclude))
    ignored = F.col("ignored") if "ignored" in files.columns else F.lit(False)
    binary = P.is_binary(p)
    out = scope.agg(
        F.count_if(~binary).alias("files_in_scope"),
        F.count_if(~binary & ~ignored & F.col("text").isNotNull()).alias("files_searched"),
        F.count_if(binary).alias("binary_skipped"),
        F.count_if(~binary & ignored).alias("gitignored_skipped"),
        F.count_if(~binary & ~ignored & F.col("text").isNull()).alias("other_skipped"),
    )
    return out.withColumn("coverage_percent", coverage(F.col("files_searched"), F.col("files_in_scope")))


def coverage(part, whole):
    """Whole percent, 100 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(F.lit(100)).cast("long")


def imports(files: DataFrame, most: int = 200) -> DataFrame:
    """path, line and content of import lines, by the file's extension; Go's blocks by a running count of their brackets."""
    d = lines(files.select("path", "text", P.extension(F.col("path")).alias("ext")))
    t = F.trim("content")
    w = Window.partitionBy("path").orderBy("line")
    go = F.col("ext") == "go"
    opened = F.sum(F.when(go & (t == "import ("), 1).otherwise(0)).over(w)
    d = d.withColumn("opened", opened).withColumn("since", F.sum(F.when(go & (t == ")"), 1).otherwise(0)).over(Window.partitionBy("path", "opened").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)))
    in_block = go & (F.col("opened") > 0) & (F.coalesce("since", F.lit(0)) == 0)
    by_ext = (
        F.when(F.col("ext").isin("java", "kt", "scala"), t.rlike("^(import|package) "))
        .when(F.col("ext") == "cs", t.rlike("^(using|namespace) "))
        .when(F.col("ext") == "py", t.rlike("^(import|from) "))
        .when(F.col("ext").isin("ts", "tsx", "js", "jsx", "mjs", "cjs"), t.rlike(r"^import[ {]|require\("))
        .when(F.col("ext") == "rs", t.rlike("^(use|extern crate) "))
        .when(go, in_block | F.startswith(t, F.lit('import "')))
        .when(F.col("ext") == "rb", t.rlike("^(require|require_relative) "))
        .otherwise(F.startswith(t, F.lit("import ")))
    )
    return d.filter(by_ext).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).select("path", "line", "content")
