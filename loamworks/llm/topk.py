"""Exact top-k inner products by a bit-sliced index.

Rows are gathered in blocks. For each attribute a block keeps the slices of
its quantised values, biased to be non-negative, one bitmap for each bit,
besides the exact values. A query adds the slices, shifted by the bits of its
own components (in non-adjacent form, so few are set), with full adders on bitmaps: the result are the slices of all rows' approximate scores. The top rows
are then selected from the most significant slice downward. Quantisation
floors the values to multiples of ``step``, so an exact score lies within
known bounds of the approximate one; rows whose bounds reach the k-th row's
are the boundary, and their exact scores decide.

Queries and rows meet block by block: each pair of a block of queries and one
of rows gives at most k rows for each query, and those are reduced to the k
best, ties to the smaller vec_id.

All sums are exact at any size of components: slices have no width, and where
products could leave 64 bits they are of whole numbers without bounds. A score
beyond a long is ranked by its true value and shown as the nearest long.

Vectors that are null or empty or hold null or non-finite components take no part, nor
do those with a component whose ``scale`` fold is not finite as a double, nor
rows of a null id. A query whose width differs from a row's does not meet
it. Repeated rows are rows; a query is not compared with any row of its own
id. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, only

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _narrowest(values: np.ndarray) -> str:
    """The smallest type that holds the whole numbers, given as doubles; those beyond 62 bits stay doubles, which hold them exactly."""
    low, high = float(values.min(initial=0)), float(values.max(initial=0))
    return next((t for t in ("<i1", "<i2", "<i4") if np.iinfo(t).min <= low and high <= np.iinfo(t).max), "<i8" if max(-low, high) < 2.0**62 else "<f8")


def _pack(rows: int, scale: float):
    """Blocks of up to ``rows`` vectors of one width: ids and values, floor(scale * x), as bytes, and the type of the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(w: int) -> pa.RecordBatch:
            nonlocal n
            ids = np.concatenate([i for i, _ in held[w]])
            values = np.concatenate([v for _, v in held[w]])
            held[w] = []
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), pa.array([w], pa.int32()), pa.array([kind := _narrowest(values)]), pa.array([ids.astype("<i8").tobytes()]), pa.array([values.astype(kind).tobytes()])], names=["block", "width", "kind", "ids", "vectors"])

        for b in batches:
            ids = b.column("vec_id").to_numpy()
            lists = b.column("v")
            offsets, values = lists.offsets.to_numpy(), np.floor(scale * lists.values.to_numpy(zero_copy_only=False))
            sizes = np.diff(offsets)
            for w in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == w)
                x = values[(offsets[of][:, None] + np.arange(w)[None, :]).ravel()].reshape(len(of), w) if w else np.zeros((len(of), 0))
                for i in range(0, len(of), rows):
                    have = held.setdefault(w, [])
                    have.append((ids[of[i : i + rows]], x[i : i + rows]))
                    while sum(len(a) for a, _ in held[w]) >= rows:
                        a, v = np.concatenate([a for a, _ in held[w]]), np.concatenate([v for _, v in held[w]])
                        held[w] = [(a[:rows], v[:rows])]
                        rest = (a[rows:], v[rows:])
                        yield block(w)
                        held[w] = [rest] if len(rest[0]) else []
        for w in list(held):
            if held[w]:
                yield block(w)

    return run


class SlicedIndex:
    """Bit slices of a block's quantised attributes."""

    def __init__(self, values: np.ndarray, shift: int):
        self.exact = values
        self.rows = len(values)
        self.shift = shift
        q = values >> shift  # floor
        self.low = q.min(axis=0)
        q = q - self.low
        if values.dtype != object:
            q = q.astype(np.uint64)
        self.bits = int(q.max(initial=0)).bit_length()
        words = -(-self.rows // 64)
        self.words = words
        padded = np.zeros((words * 64, values.shape[1]), q.dtype)
        padded[: self.rows] = q
        # planes[d * bits + b] is the bitmap of bit b of attribute d
        self.planes = np.zeros((values.shape[1] * self.bits, words), np.uint64)
        for b in range(self.bits):
            on = ((padded >> b) & 1).astype(bool) if q.dtype == object else ((padded >> np.uint64(b)) & np.uint64(1)).astype(bool)
            self.planes[b :: self.bits] = np.ascontiguousarray(np.packbits(on.T, axis=1, bitorder="little")).view(np.uint64)
        every = np.zeros(words * 64, bool)
        every[: self.rows] = True
        self.every = np.packbits(every, bitorder="little").view(np.uint64)

    def _sum(self, rows: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of the sum of planes << weights. At each weight bitmaps are added three at a time, many such full adders at once; their carries go to the next weight."""
        order = np.argsort(weights, kind="stable")
        rows, weights = rows[order], weights[order]
        out: list[np.ndarray] = []
        carries: list[np.ndarray] = []
        w = 0
        while carries or (len(weights) and w <= weights[-1]):
            at = np.searchsorted(weights, [w, w + 1])
            stack = np.concatenate([self.planes[rows[at[0] : at[1]]], *carries])
            carries = []
            while len(stack) > 2:
                k = len(stack) // 3
                x, y, z = stack[:k], stack[k : 2 * k], stack[2 * k : 3 * k]
                half = x ^ y
                carries.append((x & y) | (half & z))
                stack = np.concatenate([half ^ z, stack[3 * k :]])
            if len(stack) == 2:
                carries.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            w += 1
        while out and not out[-1].any():
            out.pop()
        return out

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the approximate scores less a constant: plus and minus parts are added apart, then subtracted."""
        forms = {c: non_adjacent(abs(c)) for c in set(query.tolist())}
        digits = [(d, at, sign if c > 0 else -sign) for d, c in enumerate(query.tolist()) for at, sign in forms[c]]
        d, at, sign = (np.array(x, np.int64) for x in zip(*digits, strict=True)) if digits else (np.zeros(0, np.int64),) * 3
        bit = np.arange(self.bits)
        rows, weights = (d[:, None] * self.bits + bit), (at[:, None] + bit)
        plus, minus = (self._sum(rows[some].ravel(), weights[some].ravel()) for some in (sign > 0, sign < 0))
        # plus - minus + 2^n in two's complement never is negative
        n = max(len(plus), len(minus)) + 1
        zero = np.zeros(self.words, np.uint64)
        out = []
        carry = np.full(self.words, _ONES)
        for i in range(n):
            a = plus[i] if i < len(plus) else zero
            b = ~minus[i] if i < len(minus) else np.full(self.words, _ONES)
            y = a ^ b
            out.append(y ^ carry)
            carry = (a & b) | (y & carry)
        out.append(carry)  # 1 where plus >= minus
        return out

    def top(self, query: np.ndarray, k: int, allowed: np.ndarray) -> np.ndarray:
        """Rows, in no order, among which are all of the k best allowed ones by exact score."""
        total = self.scores(query)
        n = len(total)
        sure, maybe = np.zeros(self.words, np.uint64), allowed.copy()
        count = int(np.bitwise_count(allowed).sum())
        if count <= k:
            return _places(allowed)
        threshold = 0  # the k-th largest approximate score, found bit by bit
        have = 0
        for i in range(n - 1, -1, -1):
            both = maybe & total[i]
            c = int(np.bitwise_count(both).sum())
            if have + c >= k:
                maybe = both
                threshold |= 1 << i
            else:
                have += c
                sure |= both
                maybe = maybe & ~total[i]
        # exact = step * approximate + error, error between sums of the query's negative and positive parts times (step - 1)
        lost = ((1 << self.shift) - 1) * sum(abs(x) for x in query.tolist())
        bound = threshold - -(-lost // (1 << self.shift))
        return _places(self._at_least(total, bound, allowed))

    def _at_least(self, total: list[np.ndarray], bound: int, allowed: np.ndarray) -> np.ndarray:
        """Bitmap of the allowed rows whose sum is at least ``bound``."""
        if bound <= 0:
            return allowed
        more, same = np.zeros(self.words, np.uint64), allowed
        for i in range(len(total) - 1, -1, -1):
            if bound >> i & 1:
                same = same & total[i]
            else:
                more = more | (same & total[i])
                same = same & ~total[i]
        return more | same


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def non_adjacent(n: int) -> list[tuple[int, int]]:
    """n as a sum of signed powers of two of which no two are neighbours: (power, sign)."""
    out, at = [], 0
    while n:
        if n & 1:
            d = 2 - (n & 3)
            out.append((at, d))
            n -= d
        n >>= 1
        at += 1
    return out


def _values(data: bytes, kind: str, width: int) -> np.ndarray:
    x = np.frombuffer(data, kind).reshape(-1, max(width, 1))[:, :width]
    if kind != "<f8":
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products, as 64-bit numbers if none can be beyond them, else as Python's."""
    most = max((abs(v) for v in query.tolist()), default=0) * int(max(rows.max(initial=0), -rows.min(initial=0))) * len(query)
    if rows.dtype != object and most < 1 << 63:
        return rows @ query.astype(np.int64)
    return np.array([sum(a * b for a, b in zip(r, query.tolist(), strict=True)) for r in rows.tolist()], object)


_LONG = (-(1 << 63), (1 << 63) - 1)


def beyond(score: int) -> bytes:
    """Bytes that order scores which one long stands for."""
    if _LONG[0] <= score <= _LONG[1]:
        return b"\x80"
    size = (abs(score).bit_length() + 7) // 8
    data = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\xff" + data if score > 0 else b"\x00" + bytes(255 - x for x in data)


def _meet(k: int, shift: int):
    """The k best rows of a block for each query of the blocks of queries that follow it; one block of rows and one of queries are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, SlicedIndex, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                width, these = r["width"], np.frombuffer(r["ids"], "<i8")
                if r["side"] == 0:
                    held = (r["block"], SlicedIndex(_values(r["vectors"], r["kind"], width), shift), these, np.argsort(these, kind="stable"))
                    continue
                block, index, ids, order = held
                if block != r["block"]:
                    raise ValueError("a block of queries without its block of rows")
                sorted_ids, query_ids = ids[order], these
                queries = _values(r["vectors"], r["kind"], width)
                out = []
                for q, v in zip(query_ids.tolist(), queries, strict=True):
                    allowed = index.every
                    lo, hi = np.searchsorted(sorted_ids, q), np.searchsorted(sorted_ids, q, "right")
                    if hi > lo:
                        allowed = allowed.copy()
                        for own in order[lo:hi].tolist():
                            allowed[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
                    rows = index.top(v, k, allowed)
                    if not len(rows):
                        continue
                    score = products(index.exact[rows], v)
                    if score.dtype == object:
                        best = np.array(sorted(range(len(rows)), key=lambda i: (-score[i], ids[rows[i]]))[:k])
                        more = [beyond(x) for x in score[best]]
                        shown = np.array([min(max(x, _LONG[0]), _LONG[1]) for x in score[best]], np.int64)
                    else:
                        best = np.lexsort((ids[rows], -score))[:k]
                        more, shown = [b"\x80"] * len(best), score[best]
                    out.append((np.full(len(best), q), ids[rows][best], shown, np.array(more, object)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score", "more"])

    return run


def top_k(spark: SparkSession, vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, step_bits: int = 2, block_rows: int = 16_384, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row whose vec_id is divisible by ``every``; a component x counts as floor(scale * x)."""
    v = only(vectors, vec_id="long", embedding="array<double>")
    fit = v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * float(scale)) < float("inf"))))
    fit = fit.filter(F.size("embedding") > 0).select("vec_id", F.col("embedding").alias("v"))
    schema = "block long, width int, kind string, ids binary, vectors binary"
    rows = kept(spark, fit.mapInArrow(_pack(block_rows, float(scale)), schema))
    queries = kept(spark, fit.filter(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(_pack(query_rows, float(scale)), schema))
    # every block of queries meets every block of rows of its width: a stated query set against all rows, in blocks;
    # a block of rows is carried once, the much smaller queries go to each of them;
    # the pairs of numbers are dealt by the row block, as most blocks have one width
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_rows = rows.select(F.col("block").alias("row_block"), "width", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    of_queries = queries.select(F.col("block").alias("query_block"), "width", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    names = of_rows.join(of_queries, ["width", "salt"]).select("row_block", "query_block")
    asked = names.join(queries.withColumnRenamed("block", "query_block"), "query_block").drop("query_block").withColumnRenamed("row_block", "block")
    met = rows.withColumn("side", F.lit(0)).unionByName(asked.withColumn("side", F.lit(1))).repartition("block").sortWithinPartitions("block", "side")
    best = met.mapInArrow(_meet(k, step_bits), "query_id long, vec_id long, score long, more binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("more"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
