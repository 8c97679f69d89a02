"""Best-fit packing with large-item matching, planned on the histogram of lengths.

Pieces longer than a third of the capacity fit at most two to a bin: in falling
order of length each is matched greedily with the longest other one that fits
beside it. Smaller pieces, again in falling order, go to the fullest bin that
still takes them; a new bin is opened where none does.

Only lengths matter to that, and there are at most ``capacity`` of them, so
the plan is made from their counts: a step treats all bins of one make and all
pieces of one length at once. Its size and the driver's work depend on the
capacity alone. The pieces of a length are then numbered across the tasks
(each task numbers its own; the tasks' counts are summed up) and look up their
bin and place in the plan.

Null text counts as empty and has the end id alone. Repeated rows and rows of
a null doc_id are packed like others. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_pieces, kept, only
from .tokens import Encoder


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length the bins of its pieces, as rows (first rank, first bin, offset, pieces in a run of a bin).

    The pieces of rank r to r + m * run - 1 of a row lie in m bins one after
    another, ``run`` in each, side by side from the offset on.
    """
    bins = 0
    used: dict[int, int] = defaultdict(int)  # pieces of a length that have a place
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # free room -> [first bin, bins] with that room

    def place(length: int, first: int, n: int, offset: int, run: int = 1) -> None:
        rows[length].append((used[length], first, offset, run))
        used[length] += n * run

    left = {k: int(v) for k, v in counts.items() if v and k > 0}
    big = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in big:
        while left[a]:
            b = next((k for k in big if k <= min(a, capacity - a) and left[k] > 0), None)
            if b is None:
                n = left[a]
                place(a, bins, n, 0)
                left[a] = 0
                room = capacity - a
            elif b == a:
                n = left[a] // 2
                if not n:  # the last one; a shorter partner, if there is one
                    b = next((k for k in big if k < a and k <= capacity - a and left[k] > 0), None)
                    n = 1
                    place(a, bins, 1, 0)
                    left[a] = 0
                    room = capacity - a
                    if b is not None:
                        place(b, bins, 1, a)
                        left[b] -= 1
                        room -= b
                else:
                    place(a, bins, n, 0, 2)
                    left[a] -= 2 * n
                    room = capacity - 2 * a
            else:
                n = min(left[a], left[b])
                place(a, bins, n, 0)
                place(b, bins, n, a)
                left[a] -= n
                left[b] -= n
                room = capacity - a - b
            if room:
                gaps[room].append([bins, n])
            bins += n
    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        todo = left[a]
        while todo:
            room = min((g for g, x in gaps.items() if g >= a and x), default=0)
            if room:
                first, n = gaps[room].pop()
                run = room // a  # the fullest bin stays the fullest while it takes pieces of this length
                whole = min(n, todo // run)
                if whole:
                    place(a, first, whole, capacity - room, run)
                    todo -= whole * run
                    if room - run * a:
                        gaps[room - run * a].append([first, whole])
                rest = n - whole
                if rest and todo:
                    run = min(run, todo)
                    place(a, first + whole, 1, capacity - room, run)
                    todo -= run
                    if room - run * a:
                        gaps[room - run * a].append([first + whole, 1])
                    whole, rest = whole + 1, rest - 1
                if rest:
                    gaps[room].append([first + whole, rest])
            else:
                n = -(-todo // (capacity // a))
                gaps[capacity].append([bins, n])
                bins += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def look_up(rows: np.ndarray, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the pieces of one length by their ranks."""
    r = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
    k = rank - r[:, 0]
    return r[:, 1] + k // r[:, 3], r[:, 2] + k % r[:, 3] * length


def _pieces(path: str, capacity: int, end_id: int, lasting: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder = Encoder(path, words=True, bits=21 if lasting else 19, lasting=lasting)
        end = np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for b in in_pieces(batches):
            every, bounds = encoder.encode(b.column("text"))
            data, at_doc = every.astype("<u4").tobytes(), bounds.tolist()
            out: list[tuple[int, int, int, int, int]] = []
            for row in range(b.num_rows):
                ids = data[4 * at_doc[row] : 4 * at_doc[row + 1]] + end
                n = len(ids) // 4
                for p, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    out.append((row, p, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
            x = np.array(out, np.int64).reshape(-1, 5)
            order = np.argsort(x[:, 3], kind="stable")
            count = np.bincount(x[:, 3], minlength=capacity + 1)
            begin = np.cumsum(count) - count
            local = np.empty(len(x), np.int64)
            local[order] = np.arange(len(x)) - begin[x[order, 3]] + seen[x[order, 3]]
            seen += count
            ids = b.column("doc_id").take(pa.array(x[:, 0]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(x[:, 1].astype(np.int32)), *(pa.array(x[:, k]) for k in (2, 3, 4)), pa.array(np.full(len(x), task, np.int32)), pa.array(local)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local"],
            )

    return run


def _places(by_length: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            where, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            values, at, n = np.unique(length[order], return_index=True, return_counts=True)
            for v, i, k in zip(values.tolist(), at.tolist(), n.tolist(), strict=True):
                rows = order[i : i + k]
                where[rows], offset[rows] = look_up(by_length[v], v, rank[rows])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(where), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, lasting: bool = False) -> DataFrame:
    """A row for each piece of each document: its place in the document (piece, start, length), the checksum of its ids and its place in a sequence. ``lasting``: workers keep the ids of words for their later tasks, at about 150 MB each."""
    d = only(docs, doc_id="long", text="string")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"
    pieces = kept(spark, d.mapInArrow(_pieces(path, capacity, end_id, lasting), schema))
    counts = pieces.groupBy("length", "task").count()
    made = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)  # at most ``capacity`` rows
    before = counts.select("length", "task", (F.sum("count").over(Window.partitionBy("length").orderBy("task")) - F.col("count")).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(_places(made), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
