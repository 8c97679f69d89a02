"""Budgets, fuzzy top-k, paging over lists, and the text of skeletons."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import graph

OMISSION_TOKENS = 50
_PREFIXES = {"Test": "test ", "Function": "func ", "Class": "class ", "Struct": "struct ", "Method": "method ", "Impl": "impl ", "Constant": "const ", "Interface": "interface ", "Enum": "enum ", "Module": "mod ", "Zone": "zone ", "Component": "component ", "HtmlElement": "element ", "CssSelector": "selector ", "CssAtRule": "at-rule "}


#: Rows of a block, blocks that one task folds at a time, and rows from which a workspace is folded by blocks.
BLOCK_ROWS, OPEN_BLOCKS, LARGE = 1 << 16, 16, 1 << 20


class _Fold:
    """The remainder of a budget as rows go by: a row that fits is admitted, another is marked if its omission fits."""

    def __init__(self, left: int, omission: int):
        self.left, self.omission = left, omission

    def row(self, cost: int | None) -> tuple[bool, bool]:
        fits = cost is not None and cost <= self.left
        marks = not fits and 0 < self.omission <= self.left
        self.left -= cost if fits else self.omission if marks else 0
        return fits, marks

    def block(self, n: int, least: int | None, total: int | None, holes: int) -> bool:
        """Goes over a block by its summary alone, if that tells enough: all of it fits, or none of it."""
        if not holes and (total or 0) <= self.left:
            self.left -= total or 0
            return True
        if least is None or least > self.left:
            self.left -= self.omission * min(n, self.left // self.omission) if self.omission > 0 else 0
            return True
        return False


def greedy(rows: DataFrame, budget: int, keys: list[str] | None = None, omission: int = OMISSION_TOKENS, key: str = "path", cost: str = "cost", block_rows: int = BLOCK_ROWS, large: int = LARGE) -> DataFrame:
    """Rows with ``admitted`` and ``marked``: in order of ``key`` a row is admitted if it still fits, else marked as omitted if ``omission`` tokens still fit; later, smaller rows go on being tried. Costs are not negative; null ones never fit.

    The fold is sequential by nature, but only a block's first remainder ties
    it to the rest. The rows, sorted over many tasks, are cut into blocks; the
    driver goes over their summaries (rows, least cost, sum) and skips a block
    that fits as a whole or not at all. Others are folded in order, a few at a
    time; as the remainder only falls, and each of them makes it fall, they
    are at most as many as omissions and single tokens fit into the budget,
    however many rows there are. Then all blocks are folded side by side. A
    workspace of ``keys`` with fewer than ``large`` rows streams through a task.
    """
    group = keys or []
    narrow = rows.select(*group, key, F.col(cost).cast("long").alias("_cost"))
    if not group:
        return _by_blocks(narrow, budget, omission, key, block_rows)
    big = [tuple(r)[:-1] for r in narrow.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") >= large).collect()]
    same = [reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(group, who, strict=True)]) for who in big]
    out = _streamed(narrow.filter(~reduce(lambda x, y: x | y, same)) if same else narrow, budget, omission, group, key)
    types = dict(narrow.dtypes)
    for who, mine in zip(big, same, strict=True):
        part = _by_blocks(narrow.filter(mine).select(key, "_cost"), budget, omission, key, block_rows)
        out = out.unionByName(part.select(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(group, who, strict=True)], key, "admitted", "marked"))
    return out


def _streamed(narrow: DataFrame, budget: int, omission: int, group: list[str], key: str) -> DataFrame:
    """The fold of each workspace in one task, which holds one sum."""
    types = dict(narrow.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, _Fold(0, 0)
        for b in batches:
            said = []
            for *who, n in zip(*(b.column(c).to_pylist() for c in (*group, "_cost")), strict=True):
                if who != now:
                    now, fold = who, _Fold(budget, omission)
                said.append(fold.row(n))
            yield _told(b, [*group, key], said)

    order = narrow.repartition(*group).sortWithinPartitions(*group, key, "_cost")
    return order.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in (*group, key)) + ", admitted boolean, marked boolean")


def _told(b: pa.RecordBatch, columns: list[str], said: list[tuple[bool, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *(pa.array([x[i] for x in said], pa.bool_()) for i in (0, 1))], names=[*columns, "admitted", "marked"])


def _by_blocks(narrow: DataFrame, budget: int, omission: int, key: str, block_rows: int) -> DataFrame:
    spark, kind = narrow.sparkSession, dict(narrow.dtypes)[key]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            place = np.arange(at, at + b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("_cost"), pa.array(part + place // block_rows), pa.array(place)], names=[key, "_cost", "_block", "_at"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first(key), F.asc_nulls_first("_cost")]
    table = graph.cut(narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(numbered, f"`{key}` {kind}, _cost long, _block long, _at long"))
    summary = table.groupBy("_block").agg(F.count("*").alias("n"), F.min("_cost").alias("least"), F.sum("_cost").alias("total"), F.count_if(F.col("_cost").isNull()).alias("holes"))
    blocks = sorted(tuple(r) for r in summary.collect())  # five numbers for each block

    def folded(left: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fold, now = _Fold(left, omission), None
            for b in batches:
                out = []
                for block, cost in zip(b.column("_block").to_pylist(), b.column("_cost").to_pylist(), strict=True):
                    if block != now:
                        now = block
                        out.append((block, fold.left))
                    fold.row(cost)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["_block", "left"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([fold.left], pa.int64())], names=["_block", "left"])

        return run

    fold, first, i = _Fold(budget, omission), {}, 0
    while i < len(blocks):
        first[blocks[i][0]] = fold.left
        if fold.block(*blocks[i][1:]):
            i += 1
            continue
        some = [x[0] for x in blocks[i : i + OPEN_BLOCKS]]
        rows = table.filter(F.col("_block").isin(some)).select("_block", "_at", "_cost").coalesce(1).sortWithinPartitions("_block", "_at")
        found = {r["_block"]: r["left"] for r in rows.mapInArrow(folded(fold.left), "_block long, left long").collect()}
        fold.left = found.pop(-1)
        first |= found
        i += len(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, _Fold(0, 0)
        for b in batches:
            said = []
            for block, cost in zip(b.column("_block").to_pylist(), b.column("_cost").to_pylist(), strict=True):
                if block != now:
                    now, fold = block, _Fold(first[block], omission)
                said.append(fold.row(cost))
            yield _told(b, [key], said)

    return table.repartition("_block").sortWithinPartitions("_block", "_at").mapInArrow(run, f"`{key}` {kind}, admitted boolean, marked boolean")


def until_full(rows: DataFrame, budget: int, key: str = "path", cost: str = "cost") -> DataFrame:
    """Rows in order of ``key`` up to the first that does not fit: a running sum over the first rows, as every row costs a token at least."""
    rows = rows.orderBy(key).limit(max(budget, 0))
    total = F.sum(cost).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_t", total).filter(F.col("_t") <= budget).drop("_t")


def scaled_budget(asked: int, source_files: int, default: int = 16_000) -> int:
    """The budget: grown with the number of source files if it is the default, then held to 500..100000."""
    if asked == default and source_files > 20:
        asked = max(16_000, min(48_000, source_files * 800))
    return max(500, min(100_000, asked))


def suggested_budget(needed: int) -> int:
    return min(100_000, -(-needed // 4000) * 4000)


def did_you_mean(names: DataFrame, target: str, k: int = 3, column: str = "semantic_path", order: str = "symbol_id") -> DataFrame:
    """The k names nearest to a target: the target itself alone if it is there; containment counts as the difference of lengths, else the edit distance up to max(5, length / 4)."""
    t, c = F.lit(target), F.col(column)
    most = max(5, len(target.encode()) // 4)
    inside = F.contains(c, t) | F.contains(t, c)
    delta = F.abs(F.octet_length(c) - len(target.encode()))
    near = F.when(inside, delta).when(delta <= most, F.nullif(F.levenshtein(c, t, most), F.lit(-1)))  # -1: farther
    d = names.withColumn("distance", F.when(c == t, -1).otherwise(near).cast("long"))
    d = d.filter((F.col("distance") == -1) | F.contains(c, t) | F.col("distance").between(0, most))
    first = Window.orderBy("distance", order)
    best = d.orderBy("distance", order).limit(k).withColumn("_first", F.min("distance").over(Window.partitionBy()))
    return best.filter((F.col("_first") >= 0) | (F.col("distance") == -1)).withColumn("rank", F.row_number().over(first).cast("long")).drop("_first")


def name_grams(names: DataFrame, column: str = "semantic_path", order: str = "symbol_id") -> DataFrame:
    """The index that near_names reads: a row for each three characters that follow one another in a name, once a name; kept sorted by gram, it is read by gram."""
    c = F.col(column)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3))))
    return names.filter(F.length(c) > 2).select(F.explode(grams).alias("gram"), column, order)


def near_names(grams: DataFrame, names: DataFrame, target: str, k: int = 3, column: str = "semantic_path", order: str = "symbol_id") -> tuple[DataFrame, int]:
    """did_you_mean by an index of grams, and the number of names that were compared.

    A name within d edits of the target has at least as many of its n distinct
    grams as n less 3 d, and one that holds the target has all. So the names
    with so many hold all names up to the distance d; if the k best of them are
    as near, they are the answer. d grows while n is larger than 3 d; after
    that, and for targets of few characters, every name is compared.
    """
    own = sorted({target[i : i + 3] for i in range(len(target) - 2)})
    if own:
        shared = graph.cut(grams.filter(F.col("gram").isin(own)).groupBy(column, order).agg(F.count("*").alias("_shared")))
        d = 1
        while 3 * d < len(own):
            some = shared.filter(F.col("_shared") >= len(own) - 3 * d).drop("_shared")
            best = graph.cut(did_you_mean(some, target, k, column, order))
            n, far = best.agg(F.count("*"), F.max("distance")).first()
            if far is not None and (far == -1 or (n == k and far <= d)):
                return best, some.count()
            d += 1
    return did_you_mean(names, target, k, column, order), names.count()


def paged_union(lists: list[DataFrame], offset: int, limit: int, *order) -> DataFrame:
    """A page over lists one after another: list_rank, rank."""
    out = None
    for i, d in enumerate(lists):
        d = d.withColumn("list_rank", F.lit(i).cast("long"))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    top = out.orderBy("list_rank", *order).limit(offset + limit).offset(offset)
    return top.withColumn("rank", (F.row_number().over(Window.orderBy("list_rank", *order)) + offset).cast("long"))


def prefix_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in _PREFIXES.items() for x in p]), kind)


def skeletons(symbols: DataFrame, max_tokens_per_file: int = 2000) -> DataFrame:
    """path, skeleton, tokens and truncated: the symbols of a file as indented lines; over the cap the top ones with counts of what they hold."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), prefix_of(F.col("kind")), F.col("name"), F.lit(" // "), F.col("semantic_path"))
    full = symbols.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("full"))
    held = symbols.filter("parent_id is not null").groupBy("path", F.col("parent_id").alias("symbol_id")).agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("Method", "methods"), ("Function", "functions"), ("Constant", "constants"))])
    top = symbols.filter("depth = 0").join(held, ["path", "symbol_id"], "left")
    parts = F.array_compact(F.array(*[F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {n}"))) for n in ("methods", "functions", "constants")]))
    note = F.when(F.col("kind").isin("Class", "Struct", "Enum", "Interface", "Impl", "Module") & (F.size(parts) > 0), F.concat(F.lit("\n  // ... "), F.array_join(parts, ", "), F.lit(" omitted"))).otherwise("")
    short = F.concat(prefix_of(F.col("kind")), F.col("name"), F.lit(" // "), F.col("semantic_path"), note)
    stub = top.groupBy("path").agg(F.concat(F.lit("// [TRUNCATED DUE TO SIZE]\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol_id", short.alias("l")))), lambda x: x["l"]), "\n")).alias("stub"))
    over = X.estimate_tokens(F.col("full")) > max_tokens_per_file
    d = full.join(stub, "path", "left").select("path", F.when(over, F.coalesce("stub", F.lit("// [TRUNCATED - NO SYMBOLS EXTRACTED]"))).otherwise(F.col("full")).alias("skeleton"), over.alias("truncated"))
    return d.withColumn("tokens", X.estimate_tokens(F.col("skeleton")))
