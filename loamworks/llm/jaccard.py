"""N-gram Jaccard join by T-occurrence search (DivideSkip), reduced to classes of linked documents.

A document's set are its distinct shingles of k words. Two sets x and y link
when 100 * |x & y| >= p * |x | y|, that is when they share at least
T = ceil(p * (|x| + |y|) / (100 + p)) shingles: y must occur T times or more on
the inverted lists of x's shingles.

How it is laid out on a cluster:

1. One pass counts all shingles of all documents in a sketch of fixed size. The
   counts only order the shingles (by the logarithm of what a shingle's cell
   has above the mean cell, then by hash): any order gives right results, this
   one puts long lists last.
2. A second pass gives each document a digest of its set and its short part,
   the |x| - ceil(p * |x| / 100) + 1 first shingles: partners meet on one of
   these lists at least. Equal sets become one class.
3. The short parts are dealt by shingle. Links are wanted for classes, not
   pairs, so a list first emits only pairs with its leader, the member with the
   fewest rare shingles (a member of many near copies is close to that one).
   Sizes and places that rule out T drop a pair. A list that the sketch calls
   very long is split over several tasks, whose leaders meet once more.
4. Short parts of paired documents rule out most pairs that do not link: up
   to the earlier of their ends all that the two share is known.
5. Pairs that are left go to their leader as a query, whose set is sent once.
   Its candidates' sets make inverted lists of the query's shingles, and
   DivideSkip decides: the L longest lists are put aside, the others are merged
   on a heap, counting each candidate's occurrences; who has T - L or more is
   probed for in the long lists by binary search, until T is reached or out of
   reach. A query with many candidates is split.
6. Members linked to one leader share a label. Lists with several labels then
   emit the pairs across labels that were not yet tried, in the same way (split
   lists block by block); so no link between components is lost. All links make
   the components.

Null or empty text has an empty set and links with nothing. Rows of a null
doc_id link with nothing and have a null component. Rows that share a doc_id
count as one document in links. Repeated rows stay. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_ids, dropped, in_pieces, kept, only, summed, sums
from .components import components
from .words import U, Words, mix, runs


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles (64-bit hashes) of each text; of a text with fewer words, all of it as one."""
    w = Words(texts)
    grams, of = w.ngrams(k)
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        n = int(w.first[i + 1] - w.first[i])
        if n >= k:
            g = np.sort(grams[cut[i] : cut[i + 1]])
            yield g[np.r_[True, g[1:] != g[:-1]]]
        elif n:
            h = np.array([n], np.uint64)
            for x in w.hash[w.first[i] : w.first[i + 1]]:
                h = mix(h * U(0xD6E8FEB86659FD93) + x)
            yield mix(h + U(1))
        else:
            yield np.zeros(0, np.uint64)


def short_part(n: int, percent: int) -> int:
    """Shingles of a set of n that are merged: n less the required overlap with the smallest partner, and one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def required(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * (n + m) // (100 + percent))


def divide_skip(query: np.ndarray, sets: list[np.ndarray], need: np.ndarray, weight: float = 0.1) -> list[int]:
    """Which of the sorted ``sets`` share ``need`` values or more with the sorted query. ``weight`` sets how many lists count as long; results do not depend on it."""
    members = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = np.minimum(np.searchsorted(query, members), len(query) - 1)
    hit = query[at] == members
    at, owner = at[hit], owner[hit]  # in order of owners, so every list is sorted
    order = np.argsort(at, kind="stable")
    first, size = runs(at[order])
    owners = owner[order].tolist()
    lists = [owners[i : i + n] for i, n in sorted(zip(first.tolist(), size.tolist(), strict=True), key=lambda p: p[1])]
    if not lists:
        return []
    least = int(need.min())
    long = max(0, min(least - 1, int(least / (weight * np.log2(len(lists[-1])) + 1)), len(lists)))
    short, skipped = lists[: len(lists) - long], lists[len(lists) - long :]
    out, required = [], need.tolist()
    for doc, times in groupby(heapq.merge(*short)):
        count = sum(1 for _ in times)
        left = len(skipped)
        for x in skipped:
            if count >= required[doc] or count + left < required[doc]:
                break
            left -= 1
            i = bisect_left(x, doc)
            count += i < len(x) and x[i] == doc
        if count >= required[doc]:
            out.append(doc)
    return out


SKETCH_BITS = 20
_CHUNK = 1 << 16


def _cells(sets: np.ndarray) -> np.ndarray:
    return (mix(sets) >> U(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(k: int):
    """How many shingles of the task's sets fall into each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in in_pieces(batches, chars=3_000_000):
            sets = list(shingle_sets(b.column("text"), k))
            if sets:
                count += np.bincount(_cells(np.concatenate(sets)), minlength=len(count))
        if count.any():
            yield sums(count, _CHUNK, "<i8")

    return run


def levels(count: np.ndarray) -> np.ndarray:
    """By cell, the logarithm of its count above the mean; 0 for up to 8 above it."""
    return np.clip(np.log2(np.maximum((count - count.mean()) / 4, 1)), 0, 31).astype(np.uint64)


def ordered(sets: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Keys of a set's shingles in the order of all lists: the level of frequency in the 5 leading bits, then 59 bits of the hash."""
    return np.sort((sets >> U(5)) | level[_cells(sets)] << U(59))


def _short_parts(k: int, percent: int, level: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            sizes, high, low, rare, parts = [], [], [], [], []
            for s in shingle_sets(b.column("text"), k):
                n = len(s)
                # two sums of differently mixed shingles: 128 bits for the set
                high.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                low.append(int(mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                keys = ordered(s, level)
                rare.append(int(np.searchsorted(keys, U(1 << 59))))
                sizes.append(n)
                parts.append(keys[: short_part(n, percent)].view(np.int64))
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(rare, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))],
                names=["doc_id", "n", "d1", "d2", "rare", "part"],
            )

    return run


def _possible(n, m, i, j, percent):
    """Whether sets of sizes n and m that first meet at places i and j of their orders can share enough."""
    return 1 + np.minimum(n - i - 1, m - j - 1) >= required(n, m, percent)


def _lists(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Whole inverted lists of two members or more from rows sorted by shingle; a list may span batches."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(cols[0]):
            continue
        at, n = runs(cols[0])
        first_end = int(at[1]) if len(at) > 1 else len(cols[0])
        if held and held[-1][0][-1] == cols[0][0]:
            held.append([c[:first_end] for c in cols])
            if first_end == len(cols[0]):
                continue
            start = 1
        else:
            start = 0
        if held:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            if len(whole[0]) > 1:
                yield whole
        held = []
        for k in np.flatnonzero(n[:-1] > 1).tolist():
            if k >= start:
                i = int(at[k])
                yield [c[i : i + int(n[k])] for c in cols]
        if len(at) > start:
            held = [[c[int(at[-1]) :] for c in cols]]
    if held:
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        if len(whole[0]) > 1:
            yield whole


def _led(percent: int, rows: int = 100_000):
    """Members of the lists of two members or more, with the list's leader, and whether the two can share enough."""
    names = ["s", "doc", "n", "rare", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        size = 0
        for cols in _lists(batches, tuple(names)):
            _, doc, n, rare, place = cols
            lead = int(np.lexsort((doc, rare))[0])
            ok = _possible(n, n[lead], place, place[lead], percent) & (doc != doc[lead])
            out.append([*cols, np.full(len(doc), doc[lead]), ok])
            size += len(doc)
            if size >= rows:
                yield table(out)
                out, size = [], 0
        if out:
            yield table(out)

    def table(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=[*names, "lead", "fits"])

    return run


def _across(percent: int):
    """Pairs of a list's members with different labels. Of a block of two parts of a list, only pairs of both parts; else less those with the leader, which were tried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        size = 0
        for _, doc, n, rare, place, comp, side in _lists(batches, ("s", "doc", "n", "rare", "place", "comp", "side")):
            ids, inverse, count = np.unique(comp, return_inverse=True, return_counts=True)
            if len(ids) < 2:
                continue
            two = bool((side != side[0]).any())
            lead = -1 if two else int(np.lexsort((doc, rare))[0])
            # every pair across components has a member outside the largest one
            outside = np.flatnonzero(inverse != int(count.argmax()))
            order = np.argsort(n, kind="stable")
            sizes = n[order]
            for i in outside.tolist():
                if i == lead:
                    continue
                lo = np.searchsorted(sizes, -(-percent * n[i] // 100))
                hi = np.searchsorted(sizes, 100 * n[i] // percent, "right")
                j = order[lo:hi]
                j = j[(comp[j] != comp[i]) & (j != lead) & (doc[j] != doc[i]) & ((not two) | (side[j] != side[i]))]
                j = j[_possible(n[i], n[j], place[i], place[j], percent)]
                if len(j):
                    out.append(np.stack([np.minimum(doc[j], doc[i]), np.maximum(doc[j], doc[i])]))
                    size += len(j)
                if size > 200_000 or len(out) > 20_000:
                    yield _pairs(out)
                    out, size = [], 0
        yield _pairs(out)

    return run


def _pairs(out: list[np.ndarray]) -> pa.RecordBatch:
    if not out:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
    x = np.concatenate(out, axis=1)
    x = x[:, np.lexsort(x[::-1])]
    x = x[:, np.r_[True, (x[:, 1:] != x[:, :-1]).any(axis=0)]]
    return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["a", "b"])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            sets = [s.view(np.int64) for s in shingle_sets(b.column("text"), k)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], names=["doc", "members"])

    return run


def _hopeful(percent: int):
    """Pairs that can share enough by their short parts: up to the earlier of the two ends all that they share is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column("n").to_numpy(), b.column("m").to_numpy()
            need = required(n, m, percent)
            xs, ys = b.column("x"), b.column("y")
            xo, yo = xs.offsets.to_numpy(), ys.offsets.to_numpy()
            xv, yv = xs.values.to_numpy().view(np.uint64), ys.values.to_numpy().view(np.uint64)
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                end = min(x[-1], y[-1])
                left = min(n[i] - np.searchsorted(x, end, "right"), m[i] - np.searchsorted(y, end, "right"))
                keep[i] = shared + left >= need[i]
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def _search(percent: int, together: int = 256):
    """Pairs that link, of rows query, part, doc, members in order: a query's own set first (several where rows share its id), then its candidates'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, docs, sets = None, [], [], []

        def found() -> pa.RecordBatch:
            size = np.array([len(x) for x in sets], np.int64)
            hits = sorted({docs[i] for q in queries for i in divide_skip(q, sets, required(size, len(q), percent))}) if docs else []
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(hits) if now else [], pa.int64()), pa.array(hits, pa.int64())], names=["a", "b"])

        for b in batches:
            members = b.column("members")
            offset, value = members.offsets.to_numpy(), members.values.to_numpy().view(np.uint64)
            for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in ("query", "part", "doc")), strict=True)):
                if key[:2] != now or len(docs) == together:
                    yield found()
                    docs, sets = [], []
                    if key[:2] != now:
                        now, queries = key[:2], []
                x = value[offset[i] : offset[i + 1]]
                if not len(x):
                    continue
                if key[2] == key[0]:
                    queries.append(x)
                else:
                    docs.append(key[2])
                    sets.append(x)
        yield found()

    return run


def similar_documents(spark: SparkSession, docs: DataFrame, k: int = 3, percent: int = 90, hot_bits: int = 17) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    ``hot_bits``: a list of which the sketch has more than 2 to this power members
    is split into parts of about that size. Results do not depend on it.
    """
    d = only(docs, doc_id="long", text="string")
    level = levels(summed(spark, d.mapInArrow(_sketch(k), "chunk int, values binary"), 1 << SKETCH_BITS, _CHUNK, "<i8"))
    every = d.mapInArrow(_short_parts(k, percent, level), "doc_id long, n long, d1 long, d2 long, rare long, part array<long>")
    wide = kept(spark, every.withColumn("row", F.monotonically_increasing_id()))
    keys = ["n", "d1", "d2"]
    every = kept(spark, wide.select("doc_id", *keys, "row"))
    full = every.filter("n > 0 and doc_id is not null")
    reps = kept(spark, full.groupBy(*keys).agg(F.min(F.struct("doc_id", "row")).alias("m")).select(*keys, F.col("m.doc_id").alias("doc"), "m.row"))
    copies = full.select(*keys, "row").join(reps.select(*keys, F.col("row").alias("kept")), keys).filter("row <> kept").select("row")
    classes = kept(spark, by_ids(spark, wide.filter("n > 0 and doc_id is not null"), copies, "left_anti", "row").select(*keys, F.col("doc_id").alias("doc"), "rare", "part"))
    dropped(spark, wide)

    # the lists; a part's number stands in the last 20 bits of a split list's key
    members = classes.select("doc", "n", "rare", F.posexplode("part").alias("place", "s"))
    split = F.shiftrightunsigned("s", 59) + 2 - hot_bits
    whole = F.shiftleft(F.shiftrightunsigned("s", 20), 20)
    parts = F.pow(F.lit(2.0), F.least(split, F.lit(20))).cast("long")
    part = F.pmod(F.xxhash64("doc"), parts)
    members = members.select(F.when(split > 0, whole + part).otherwise(F.col("s")).alias("s"), "doc", "n", "rare", F.col("place").cast("long").alias("place"))
    schema = "s long, doc long, n long, rare long, place long, lead long, fits boolean"
    lists = kept(spark, members.repartition("s").sortWithinPartitions("s", "doc").mapInArrow(_led(percent), schema))
    hot = split > 0
    paired = lambda x: x.filter("fits").select(F.least("doc", "lead").alias("a"), F.greatest("doc", "lead").alias("b"))
    heads = lists.filter(hot & (F.col("doc") == F.col("lead"))).select(whole.alias("s"), "doc", "n", "rare", "place")
    first = kept(spark, paired(lists).unionAll(paired(heads.repartition("s").sortWithinPartitions("s", "doc").mapInArrow(_led(percent), schema))).distinct())
    twice = full.groupBy("doc_id", *keys).count().filter("count > 1").limit(1).count() > 0
    links = _linked(spark, d, classes, first, k, percent, twice)
    links = _with_shared_ids(spark, links, every, classes)
    # members linked to one leader get one label; only pairs across labels are still open
    known = kept(spark, _labels(links))
    shared = lists.join(known, "doc", "left").select("s", "doc", "n", "rare", "place", F.coalesce("label", "doc").alias("comp"))
    second = shared.filter(~hot).withColumn("side", F.lit(0).cast("long")).unionByName(_blocks(members.filter(hot), known, whole, parts))
    second = second.repartition("s").sortWithinPartitions("s", "doc").mapInArrow(_across(percent), "a long, b long").distinct()
    second = kept(spark, second.join(first, ["a", "b"], "left_anti"))
    more = _linked(spark, d, classes, second, k, percent, twice)
    found = components(spark, links.unionByName(more))

    named = reps.select(*keys, "doc").join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").select(*keys, F.coalesce("component", "doc").alias("c"))
    rows = every.select("doc_id", *keys)
    linked = rows.filter("n > 0 and doc_id is not null").join(named, keys).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
    rest = rows.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(rest)


def _blocks(members: DataFrame, known: DataFrame, whole: Column, parts: Column) -> DataFrame:
    """Members of split lists with several labels, once for each pair of parts that has theirs; the key of a block replaces the list's."""
    # a part of one member is on no list of two; so members come from the short parts themselves
    rows = members.join(known, "doc", "left").select(whole.alias("l"), F.col("s").bitwiseAND(F.lit((1 << 20) - 1)).alias("side"), parts.alias("parts"), "doc", "n", "rare", "place", F.coalesce("label", "doc").alias("comp"))
    several = rows.groupBy("l").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("l")
    rows = rows.join(several, "l", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    block = F.xxhash64("l", F.least("side", "other"), F.greatest("side", "other"))
    return rows.select(block.alias("s"), "doc", "n", "rare", "place", "comp", "side")


def _labels(links: DataFrame) -> DataFrame:
    """doc and label, the smallest document within two links: equal labels are in one component, for certain."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least.withColumnRenamed("a", "b"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("m").alias("label"))


def _with_shared_ids(spark: SparkSession, links: DataFrame, every: DataFrame, classes: DataFrame) -> DataFrame:
    """``links`` and those of classes that meet in a doc_id: rows of one doc_id with different sets are one document."""
    rows = every.filter("n > 0 and doc_id is not null").select("doc_id", "n", "d1", "d2")
    several = rows.groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).filter("lo <> hi").select("doc_id")
    several = kept(spark, rows.join(several, "doc_id", "left_semi").join(classes.select("n", "d1", "d2", "doc"), ["n", "d1", "d2"]).select("doc_id", "doc").distinct())
    if not several.limit(1).count():
        return links
    least = several.groupBy("doc_id").agg(F.min("doc").alias("a"))
    return links.unionByName(several.join(least, "doc_id").select("a", F.col("doc").alias("b")).filter("a <> b"))


def _linked(spark: SparkSession, d: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int, twice: bool, candidates: int = 256) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets share enough: first by the short parts, then by the sets of the rest. ``twice``: rows are repeated."""
    ids = lambda x: x.select(F.col("a").alias("doc")).unionAll(x.select(F.col("b").alias("doc")))
    parts = by_ids(spark, classes, ids(pairs), "left_semi", "doc").select("doc", "n", "part")
    both = pairs.join(parts.select(F.col("doc").alias("b"), F.col("n").alias("m"), F.col("part").alias("y")), "b")
    both = both.join(parts.select(F.col("doc").alias("a"), "n", F.col("part").alias("x")), "a")
    pairs = kept(spark, both.select("a", "b", "n", "m", "x", "y").mapInArrow(_hopeful(percent), "a long, b long").distinct())
    texts = by_ids(spark, d.filter("doc_id is not null"), ids(pairs).withColumnRenamed("doc", "doc_id"), "left_semi")
    if twice:
        texts = texts.groupBy("doc_id", F.xxhash64("text")).agg(F.min("text").alias("text"))
    sets = kept(spark, texts.select("doc_id", "text").mapInArrow(_sets(k), "doc long, members array<long>"))
    # the document with more partners is the query
    degree = ids(pairs).groupBy("doc").count()
    of = lambda x, n: degree.select(F.col("doc").alias(x), F.col("count").alias(n))
    asked = pairs.join(of("a", "na"), "a").join(of("b", "nb"), "b")
    swap = F.col("nb") > F.col("na")
    asked = asked.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("query"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("doc"), F.greatest("na", "nb").alias("count"))
    asked = kept(spark, asked.select("query", F.pmod(F.xxhash64("doc"), F.ceil(F.col("count") / candidates)).alias("part"), "doc"))
    rows = asked.join(sets, "doc").select("query", "part", "doc", "members")
    own = asked.select("query", "part").distinct().join(sets.withColumnRenamed("doc", "query"), "query").select("query", "part", F.col("query").alias("doc"), "members")
    rows = rows.unionAll(own).repartition("query", "part").sortWithinPartitions("query", "part", F.col("doc") != F.col("query"))
    links = kept(spark, rows.mapInArrow(_search(percent), "a long, b long").distinct())
    dropped(spark, pairs, sets, asked)
    return links


def one_of_each(spark: SparkSession, docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when each class keeps its smallest doc_id; rows of one doc_id stay together, those of a null doc_id stay."""
    found = similar_documents(spark, docs, **parameters)
    return by_ids(spark, docs, found.filter("component_id is not null and doc_id <> component_id"), "left_anti")
