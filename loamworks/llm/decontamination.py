"""Benchmark decontamination by greedy string tiling over seeds from running Karp-Rabin hashes.

Words are runs of letters and digits, lower-cased; signs and spaces of all
scripts part them, and an ideograph or a letter of a script without blanks is a
word. Every ``k`` words of a benchmark item are a seed, by a rolling hash.

An item's anchors are its rarest seeds within the benchmark, so many that the
words of all its other seeds together stay below the threshold: a document that
holds the item has one of them. A document's words run past the anchors of all
items at once; for each item whose anchor it meets, all seeds that both share
are looked up. Phrases that many items share are hardly ever anchors, so they
make no pairs of documents and items.

Neighbours on a diagonal are joined to the longest matches. Tiling then marks the
longest match first (ties: the earliest in the document, then in the item),
words once marked are not used again, and a match that is partly marked is cut
to what is left, until none of at least ``k`` words remains. The tiles' share of
the item's words is its coverage, in whatever order the tiles come, so reordered
passages count. From ``threshold`` on the document holds the item. An item of
fewer than ``k`` words is held where all its words stand in a row.

The benchmark is sent to all tasks in slices of at most ``slice_words`` words;
a larger one takes more passes over the documents.

Items of null or without words match nothing, null and empty texts neither.
Rows of a null item_id or doc_id count like others; equal items are matched
once and told for each row. The result has a row for each document row and item
row that match; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, in_pieces, kept, only
from .words import U, Words, mix


#: Letters of scripts that put no blanks between words.
_SINGLE = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def split_words(texts: pa.Array) -> Words:
    """The words of texts; those with other than ASCII characters have their signs and spaces replaced by blanks first."""
    texts = pc.utf8_lower(texts)
    other = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
    if pc.any(other).as_py():
        some = pc.replace_substring_regex(texts.filter(other), r"[\p{P}\p{S}\p{Z}]+", " ")
        texts = pc.replace_with_mask(texts, other, pc.replace_substring_regex(some, _SINGLE, r" \1 "))
    return Words(texts, letters_only=True)


class Seeds:
    """The items' words, all their seeds, and which items have a seed as an anchor. Equal items are one, with several ids."""

    def __init__(self, items: list[tuple[int | None, str]], k: int, threshold: float):
        self.k, self.threshold = k, threshold
        w = split_words(pa.array([t for _, t in items], pa.string()))
        by_words: dict[bytes, int] = {}
        self.ids: list[list[int | None]] = []
        self.words: list[np.ndarray] = []
        for i, (item, _) in enumerate(items):
            h = w.hash[w.first[i] : w.first[i + 1]]
            if not len(h):
                continue
            at = by_words.setdefault(h.tobytes(), len(self.ids))
            if at == len(self.ids):
                self.ids.append([])
                self.words.append(h)
            self.ids[at].append(item)
        # the seed of a short item is all of it
        self.seeds = [_rolled(h, min(k, len(h))) for h in self.words]
        every, count = np.unique(np.concatenate([np.unique(x) for x in self.seeds]) if self.seeds else np.zeros(0, np.uint64), return_counts=True)
        anchors = [x[_anchors(count[np.searchsorted(every, x)], len(h), min(k, len(h)), threshold)] for x, h in zip(self.seeds, self.words, strict=True)]
        key = np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(anchors)), [len(x) for x in anchors])
        words = np.minimum([len(h) for h in self.words], k)[item] if len(item) else np.zeros(0, np.int64)
        #: words of a seed -> sorted anchors, their items, and a bitmap of the anchors' last bits
        self.tables = {n: _table(key[words == n], item[words == n]) for n in np.unique(words).tolist()}


def _table(key: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((item, key))
    key, item = key[order], item[order]
    bits = 16
    while (1 << bits) < 16 * len(key) and bits < 27:
        bits += 1
    there = np.zeros(1 << bits, bool)
    there[(key & U((1 << bits) - 1)).astype(np.int64)] = True
    return key, item, there


def _anchors(count: np.ndarray, size: int, k: int, threshold: float) -> np.ndarray:
    """Places of the fewest seeds, rarest first, without which the words of the others stay below the threshold of an item of ``size`` words."""
    least = next(n for n in range(int(threshold * size), size + 2) if n / size >= threshold and n > 0)  # words that a document must share
    order = np.argsort(count, kind="stable")
    rank = np.empty(len(count), np.int64)
    rank[order] = np.arange(len(count))
    # a word is covered as long as one of its seeds is left, that of the highest rank
    last = np.full(size, -1)
    for i in range(k):
        last[i : i + len(rank)] = np.maximum(last[i : i + len(rank)], rank)
    if least > size:
        return np.zeros(0, np.int64)
    return order[: int(np.sort(last)[size - least]) + 1]


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k words in a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * U(0xD6E8FEB86659FD93) + h[i : n + i]
    return mix(out)


def tile(doc: np.ndarray, item: np.ndarray, matches: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, place in the item, words) from the longest matches of two rows of words."""
    heap = [(-n, d, i) for d, i, n in matches]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item = np.zeros(len(item), bool)
    out = []
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        free = ~in_item[i : i + n]
        if in_doc:
            free &= np.fromiter((x not in in_doc for x in range(d, d + n)), bool, n)
        if free.all():
            if n >= k and np.array_equal(doc[d : d + n], item[i : i + n]):
                out.append((d, i, n))
                in_item[i : i + n] = True
                in_doc.update(range(d, d + n))
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, free, False]))
        for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= k:
                heapq.heappush(heap, (s - e, d + s, i + s))
    return sorted(out)


def longest_matches(at: np.ndarray, place: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Matches (place in the document, in the item, words) of seeds that follow one another on a diagonal."""
    order = np.lexsort((at, at - place))
    at, place = at[order], place[order]
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(place) != 1)]
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(at)]) + k - 1
    return list(zip(at[first].tolist(), place[first].tolist(), n.tolist(), strict=True))


def _met(h: np.ndarray, fits: np.ndarray, doc: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different (row, item) of the seeds ``h`` that are anchors; a seed that repeats within a row counts once."""
    key, item, there = table
    hit = np.flatnonzero(there[(h & U(len(there) - 1)).astype(np.int64)] & fits)
    lo, hi = np.searchsorted(key, h[hit]), np.searchsorted(key, h[hit], "right")
    hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    if not len(hit):
        return hit, hit
    pair = np.unique(np.stack([doc[hit], lo, n]), axis=1)
    row, lo, n = pair
    every = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    both = np.unique(np.stack([np.repeat(row, n), item[every]]), axis=1)
    return both[0], both[1]


def held(texts: pa.Array, seeds: Seeds) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
    """(row, item, coverage, tiles) of the items that texts hold."""
    if not seeds.tables:
        return
    w = split_words(texts)
    for k, table in seeds.tables.items():
        h = _rolled(w.hash, k)
        if not len(h):
            continue
        fits = w.doc[: len(h)] == w.doc[k - 1 :]
        now, sorted_h = -1, h[:0]
        for r, i in zip(*(x.tolist() for x in _met(h, fits, w.doc[: len(h)], table)), strict=True):
            size, begin, end = len(seeds.words[i]), int(w.first[r]), int(w.first[r + 1])
            if r != now:
                own = h[begin : end - k + 1]
                order = np.argsort(own, kind="stable")
                now, sorted_h = r, own[order]
            mine = seeds.seeds[i]
            lo, hi = np.searchsorted(sorted_h, mine), np.searchsorted(sorted_h, mine, "right")
            p = np.flatnonzero(hi > lo)
            covered = np.zeros(size + 1, np.int64)  # what all seeds together cover bounds what tiles can
            covered[p] += 1
            np.subtract.at(covered, np.minimum(p + k, size), 1)
            if (np.cumsum(covered)[:size] > 0).sum() / size < seeds.threshold:
                continue
            n = (hi - lo)[p]
            every = np.repeat(lo[p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            tiles = tile(w.hash[begin:end], seeds.words[i], longest_matches(order[every], np.repeat(p, n), k), k)
            coverage = sum(x[2] for x in tiles) / size
            if coverage >= seeds.threshold:
                yield r, i, coverage, tiles


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("tiles", pa.string())])


def _find(seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, chars=1_000_000):
            ids = b.column("doc_id")
            rows = []
            for r, i, c, t in held(b.column("text"), seeds):
                tiles = ",".join(f"{x}:{y}:{n}" for x, y, n in t)
                rows += [(ids[r].as_py(), item, c, len(t), tiles) for item in seeds.ids[i]]
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FOUND.types, strict=True)], schema=_FOUND)


def _without(seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, chars=1_000_000):
            bad = {r for r, *_ in held(b.column("text"), seeds)}
            yield b if not bad else b.filter(pa.array([i not in bad for i in range(b.num_rows)]))

    return run


def _slices(benchmark: DataFrame, k: int, threshold: float, slice_words: int) -> Iterator[tuple[Seeds, bool]]:
    """The benchmark in parts of bounded size: items by a hash, in as many parts as its size needs; and whether there are several."""
    items = only(benchmark, item_id="long", text="string").filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0))).first()[0]  # no text of letters and blanks has more words
    parts = max(1, -(-int(total) // slice_words))
    for p in range(parts):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) if parts > 1 else items
        yield Seeds([(r["item_id"], r["text"]) for r in some.orderBy("item_id", "text").collect()], k, threshold), parts > 1


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, k: int = 4, threshold: float = 0.6, slice_words: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles and tiles (place in the document : place in the item : words) for each document that holds an item. What a slice of several found is written before the next one is read, so the driver holds one slice at a time."""
    d = only(docs, doc_id="long", text="string")
    out = None
    for seeds, several in _slices(benchmark, k, threshold, slice_words):
        found = d.mapInArrow(_find(seeds), "doc_id long, item_id long, coverage double, n_tiles long, tiles string")
        found = kept(spark, found) if several else found
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, k: int = 4, threshold: float = 0.6, slice_words: int = 4_000_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item. Between slices the rows that are left are written, so one slice is held at a time."""
    out, first = bounded(docs).withColumn("text", docs["text"].cast("string")), True
    for seeds, _ in _slices(benchmark, k, threshold, slice_words):
        out = (out if first else kept(spark, out)).mapInArrow(_without(seeds), out.schema)
        first = False
    return out
