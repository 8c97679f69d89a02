"""Provenance: degraded reasons and guidance, status rollups, degraded tools and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed table: reason, retry, retry after seconds, fallback, trust, permanent.
REASONS = [
    ("no_lsp", False, None, "search", "partial", True),
    ("lsp_warmup_empty_unverified", True, 15, None, "unreliable", False),
    ("lsp_warmup_grep_fallback", True, 30, "search", "heuristic", False),
    ("lsp_timeout_grep_fallback", True, 30, "search", "heuristic", False),
    ("lsp_error_grep_fallback", False, None, "search", "heuristic", True),
    ("no_lsp_grep_fallback", False, None, "search", "heuristic", True),
    ("grep_fallback_file_scoped", False, None, "search", "heuristic", True),
    ("grep_fallback_impl_scoped", False, None, "search", "heuristic", True),
    ("grep_fallback_global", False, None, "search", "heuristic", True),
    ("grep_fallback_dependencies", False, None, "search", "heuristic", True),
    ("unsupported_language_filter_bypassed", False, None, "read", "partial", True),
    ("unsupported_language", False, None, "read", "none", True),
    ("git_error", True, 5, None, "partial", False),
]
STATUS_RANK = {"ready": 4, "warming_up": 3, "starting": 2, "degraded": 1, "unavailable": 0}
INDEX_SECONDS = {"java": 120, "rust": 60, "typescript": 45, "javascript": 45, "go": 30, "python": 30}


def reasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REASONS, "degraded_reason string, retry_recommended boolean, retry_after_seconds int, fallback_tool string, trust_level string, permanent boolean")


def with_guidance(rows: DataFrame) -> DataFrame:
    """Rows with the guidance of their degraded_reason; null without one."""
    return rows.join(F.broadcast(reasons(rows.sparkSession)), "degraded_reason", "left")


def status_of(ready: Column, indexed: Column, up_seconds: Column) -> Column:
    """A language's status: ready, warming_up, starting or unavailable, by navigation readiness, index state and uptime."""
    return F.when(ready, "ready").when(~ready | ~indexed, "warming_up").when(up_seconds.isNotNull(), "starting").otherwise("unavailable")


def status_rank(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in STATUS_RANK.items() for x in p]), status)


def overall_status(rows: DataFrame, *keys: str) -> DataFrame:
    """The best status by rank for each of ``keys``, and whether no index is in progress."""
    return rows.groupBy(*keys).agg(F.max_by("status", status_rank(F.col("status"))).alias("overall_status"), F.bool_and(F.coalesce(F.col("indexing_status") != "in_progress", F.lit(True))).alias("indexing_complete"))


def degraded_tools(verified: Column, ready: Column, definition: Column, hierarchy: Column) -> Column:
    """array<struct<tool, severity>> of the tools that do less than they could."""
    some = lambda *xs: F.array(*[F.struct(F.lit(t).alias("tool"), F.lit(s).alias("severity")) for t, s in xs])
    four = ("locate", "trace", "inspect", 'trace(scope="references")')
    none = F.array().cast("array<struct<tool:string,severity:string>>")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    parts = F.concat(F.when(no(definition), some(("locate", "grep_fallback"))).otherwise(none), F.when(no(hierarchy), some(('trace(scope="callers")', "grep_fallback"), ("inspect(include_dependencies=true)", "unavailable"))).otherwise(none))
    return F.when(verified == F.lit(False), some(*[(t, "degraded") for t in four])).when(verified.isNull() & no(ready), some(*[(t, "warming_up") for t in four])).otherwise(parts)


def merged_reason(warmup: Column, impact: Column, references: Column) -> Column:
    """The reason of a combined answer: a warm-up comes first, then the impact's, then the references'."""
    starts = lambda c: F.coalesce(F.startswith(c, F.lit("lsp_warmup")), F.lit(False))
    return F.when(starts(warmup), warmup).when(starts(impact), impact).when(starts(references), references).otherwise(F.coalesce(impact, references))


def search_hint(returned: Column, total: Column, coverage: Column, mode: str) -> Column:
    """What a caller could do next, or null."""
    filtered = F.concat(F.lit(f"No match with filter_mode={mode}, but "), total.cast("string"), F.lit(" with filter_mode=all."))
    partial = F.concat(F.lit(" Only "), coverage.cast("string"), F.lit("% of the files in scope were searched."))
    nothing = F.concat(F.lit("No match. Check the spelling, try a regex or a wider path_glob."), F.when(coverage < 100, partial).otherwise(""))
    return F.when((returned == 0) & (total > 0) & F.lit(mode != "all"), filtered).when(total == 0, nothing).when(coverage < 50, F.concat(F.lit("Low coverage."), partial))


def trace_hint(count: Column, verified: Column) -> Column:
    """Unknown is not zero: an unverified empty answer says so."""
    return F.when(count.isNull(), "Unknown: nothing could be checked. This is not zero.").when((count == 0) & ~verified, "None found by heuristics; not verified.").when(count == 0, "Verified: none.")


def notice(reason: Column) -> Column:
    return F.when(reason.isNotNull(), F.concat(F.lit("[degraded: "), reason, F.lit("]")))
