"""Bounded graph traversal over edges, and what is told about its completeness."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends here, in files that all executors share."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="loamworks-"))
    return df.checkpoint()


def reach(edges: DataFrame, start: DataFrame, src: str = "src", dst: str = "dst", max_depth: int = 3, keep: Column | None = None) -> DataFrame:
    """node and depth of what is reachable from ``start`` (node) in 1 to ``max_depth`` steps; the first discovery sets the depth.

    Each round joins the frontier with the edges and drops visited nodes by an
    anti join. ``keep`` filters edges first (as of the corpus' own files). A
    round without news ends it.
    """
    e = edges if keep is None else edges.filter(keep)
    e = e.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    seen = start.select("node", F.lit(0).alias("depth")).distinct()
    frontier = seen.select("node")
    for depth in range(1, max(1, max_depth) + 1):
        new = cut(frontier.join(e, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti"))
        if not new.limit(1).count():
            break
        seen = seen.unionByName(new.withColumn("depth", F.lit(depth)))
        frontier = new
    return seen.filter("depth > 0").select("node", F.col("depth").cast("long").alias("depth"))


def callers_and_callees(edges: DataFrame, path: str, symbol: str, max_depth: int = 3, max_references: int = 50) -> tuple[DataFrame, DataFrame, bool]:
    """(incoming, outgoing, truncated): path, symbol, depth and confidence; the budget is halved, an odd place goes to the incoming side."""
    node = lambda p, s: F.concat(F.col(p), F.lit("::"), F.col(s))
    e = edges.withColumns({"src": node("src_path", "src_symbol"), "dst": node("dst_path", "dst_symbol")})
    start = edges.sparkSession.createDataFrame([(f"{path}::{symbol}",)], "node string")
    depth, most = max(1, min(max_depth, 5)), max(1, min(max_references, 500))
    shares = (most + 1) // 2, most // 2
    sides = []
    for (src, dst), n in ((("dst", "src"), shares[0]), (("src", "dst"), shares[1])):
        found = reach(e, start, src, dst, depth)
        ends = e.groupBy(F.col(dst).alias("node")).agg(F.max((F.col("confidence") == "lsp").cast("int")).alias("sure"))
        side = found.join(ends, "node", "left").withColumn("confidence", F.when(F.col("sure") == 1, "lsp").otherwise("heuristic"))
        sides.append(side.select(F.col("node").alias("semantic_path"), F.substring_index("node", "::", 1).alias("path"), "depth", "confidence").orderBy("depth", "semantic_path").limit(n))
    counts = [s.count() for s in sides]
    return sides[0].withColumn("direction", F.lit("incoming")), sides[1].withColumn("direction", F.lit("outgoing")), sum(counts) >= most


def with_implementations(edges: DataFrame, implementations: DataFrame, path: str, symbol: str, max_depth: int = 3) -> DataFrame:
    """Callers of an interface's method: those of each implementation (impl_path, impl_symbol by path, symbol), together, each once."""
    node = lambda p, s: F.concat(F.col(p), F.lit("::"), F.col(s))
    start = implementations.filter((F.col("path") == path) & (F.col("symbol") == symbol)).select(node("impl_path", "impl_symbol").alias("node"))
    e = edges.select(node("src_path", "src_symbol").alias("src"), node("dst_path", "dst_symbol").alias("dst"))
    return reach(e, start, "dst", "src", max_depth).groupBy("node").agg(F.min("depth").alias("depth"))


def verified(value: Column, degraded: Column, traversed: Column) -> Column:
    """Whether a list is a confirmed answer: it is there, nothing degraded it and a traversal ran. An unknown list stays null, not empty."""
    return value.isNotNull() & ~degraded & traversed
