"""Sharding by Karmarkar-Karp differencing: groups of equal texts dealt to shards of nearly equal bytes.

The multiway differencing method keeps partial partitions: for each item the
sums of its shards, spread apart at first (the item in one shard, nothing in
the others). It takes the two of largest spread, adds them in opposite order,
largest sum to smallest, and puts the result back, until one is left.

What it runs over is bounded at every input size: a group larger than
1/``bundles`` of all bytes is an item of its own, of which there are fewer
than ``bundles``, and the smaller groups go by the hash of their text into at
most ``bundles`` bundles. A group is never cut, so one that exceeds a shard's
share makes its shard larger; the others are balanced around it.

Null text has size 1 like the empty text and shares its group. Repeated rows
and rows of a null doc_id are rows like others. An empty table gives an empty
result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, only


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item, by the multiway Karmarkar-Karp method; ties go to the earlier item."""
    if not sizes:
        return []
    # a partial partition: sums in falling order, for each the items as a linked pair (left, right)
    heap = []
    for i, s in enumerate(sizes):
        sums = [int(s)] + [0] * (shards - 1)
        heap.append((-(sums[0] - sums[-1]), i, sums, [(i,)] + [()] * (shards - 1)))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = sorted(((a[k] + b[-1 - k], (x[k], y[-1 - k]) if x[k] and y[-1 - k] else x[k] or y[-1 - k]) for k in range(shards)), key=lambda p: -p[0])
        sums = [p[0] for p in both]
        heapq.heappush(heap, (-(sums[0] - sums[-1]), n, sums, [p[1] for p in both]))
        n += 1
    out = [0] * len(sizes)
    for shard, tree in enumerate(heap[0][3]):
        todo = [tree]
        while todo:
            t = todo.pop()
            if t and isinstance(t[0], int):
                out[t[0]] = shard
            else:
                todo.extend(t)
    return out


def _local_slots(shard_of_item: np.ndarray, items: dict[int, int], bundles: int):
    """A function for mapInArrow: the shard of each row and its place among the task's rows of that shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        used = np.zeros(int(shard_of_item.max(initial=0)) + 1, np.int64)
        own = np.array(sorted(items), np.int64)
        at = np.array([items[k] for k in own.tolist()], np.int64)
        for b in batches:
            key = b.column("group_key").to_numpy(zero_copy_only=False)
            item = key % bundles
            if len(own):
                i = np.minimum(np.searchsorted(own, key), len(own) - 1)
                item = np.where(own[i] == key, at[i], item)
            shard = shard_of_item[item]
            order = np.argsort(shard, kind="stable")
            count = np.bincount(shard, minlength=len(used))
            begin = np.cumsum(count) - count
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - begin[shard[order]] + used[shard[order]]
            used += count
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(shard.astype(np.int32)), pa.array(np.full(len(shard), task, np.int32)), pa.array(local)],
                names=["doc_id", "size", "text_crc32", "shard", "task", "local"],
            )

    return run


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 16, bundles: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; slots count from 0 in each shard without gaps."""
    d = only(docs, doc_id="long", text="string")
    text = F.coalesce("text", F.lit(""))
    # 63 bits of a hash name a group; two texts that share one are one group, which breaks no rule
    rows = kept(
        spark,
        d.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text, F.lit(7)), 1).alias("group_key")),
    )
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = groups.filter(F.col("size") * bundles > total).collect()  # fewer than ``bundles``: each has more than 1/bundles of all
    large = sorted((int(g["group_key"]), int(g["size"])) for g in large)
    own = [k for k, _ in large]
    bundle = rows.groupBy(F.pmod("group_key", F.lit(bundles)).alias("bundle")).agg(F.sum("size").alias("size"))
    sums = [0] * bundles
    for r in bundle.collect():  # at most ``bundles`` rows
        sums[r["bundle"]] = int(r["size"])
    for k, s in large:
        sums[k % bundles] -= s
    dealt = np.array(differencing(sums + [s for _, s in large], shards), np.int64)
    items = {k: bundles + i for i, k in enumerate(own)}

    schema = "doc_id long, size long, text_crc32 long, shard int, task int, local long"
    placed = kept(spark, rows.mapInArrow(_local_slots(dealt, items, bundles), schema))
    counts = placed.groupBy("task", "shard").count()  # a row for each task and shard
    before = counts.select("task", "shard", (F.sum("count").over(Window.partitionBy("shard").orderBy("task")) - F.col("count")).alias("before"))
    return placed.join(before, ["task", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("local")).alias("slot"))
