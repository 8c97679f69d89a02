"""Quality selection by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

Two multinomial models over hashed n-grams are estimated: the target model
from documents labelled good (at most ``sample`` labelled ones, those of
smallest hash of their id), the raw model from all documents. A document's
log importance weight is the sum over its n-grams of the difference of their
log probabilities.

N-grams are of two alphabets. Words: single words and pairs. Shapes: runs of
one to three shapes of words, a shape being the kinds of characters at the
word's start, inside and at its end, its length and whether it repeats the
word before; signs that stand alone or cling to words, capitals and repetition
show there even if each word is new.

Gumbel top-k draws k documents without replacement, in proportion to their
importance weights: each one's key is its log importance weight plus Gumbel
noise from a hash of its id and the seed, and the k largest keys stay. The k-th
key is found by counting keys in ever finer intervals; ties go to the smaller
doc_id. k is a parameter; by default it is the number of documents whose log
weight reaches the boundary that best separates the labelled documents
(balanced accuracy), so the target's own share of the raw text.

Null and empty text has no n-grams and log weight 0, and takes part in the draw
like others. With no labels of both kinds the boundary is 0. Repeated rows
have the same key. A null doc_id is hashed as such. Columns beside doc_id and
text do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_ids, in_pieces, kept, only
from .words import U, Words, mix

# Kinds of bytes: 0 letters of other scripts, 1 lower case, 2 upper case, 3 digits, 4.. signs by themselves
_KIND = np.zeros(256, np.uint64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
for _i, _c in enumerate([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]):
    _KIND[_c] = 4 + _i


def shapes(w: Words) -> np.ndarray:
    """A hash of the shape of each word."""
    start, end = w.start, w.end
    n = end - start
    kind = _KIND[w.raw]
    letters = np.concatenate([[0], np.cumsum(w.raw >= 128), ])
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    signs = np.concatenate([[0], np.cumsum(kind >= 4)])
    digits = np.concatenate([[0], np.cumsum(kind == 3)])
    share = lambda c: np.minimum(c[end] - c[start], 3).astype(np.uint64)
    same = np.zeros(len(n), np.uint64)
    if len(n) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    out = kind[start]
    for x in (kind[end - 1], share(upper), share(signs), share(digits), share(letters) > 0, np.minimum(n // 4, 4), same):
        out = out * U(40) + np.asarray(x, np.uint64)
    return mix(out + U(77))


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the text of every n-gram."""
    w = Words(texts)
    parts = [(mix(w.hash + U(1)), w.doc)]
    two, of_two = w.ngrams(2)
    parts.append((mix(two + U(2)), of_two))
    s = shapes(w)
    parts.append((mix(s + U(3)), w.doc))
    for k in (2, 3):
        n = len(s) - k + 1
        if n > 0:
            h = s[:n]
            for i in range(1, k):
                h = mix(h * U(0xD6E8FEB86659FD93) + s[i : n + i])
            ok = w.doc[:n] == w.doc[k - 1 :]
            parts.append((mix(h[ok] + U(3 + k)), w.doc[:n][ok]))
    return np.concatenate([(h % U(buckets)).astype(np.int64) for h, _ in parts]), np.concatenate([d for _, d in parts])


def _count(buckets: int, good: np.ndarray):
    """Counts by bucket of a task's documents, and of those in ``good``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in in_pieces(batches, chars=1_000_000):
            f, of = features(b.column("text"), buckets)
            raw += np.bincount(f, minlength=buckets)
            ids = b.column("doc_id").fill_null(-1).to_numpy()
            chosen = np.isin(ids, good) & b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            if chosen.any():
                target += np.bincount(f[chosen[of]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return run


def _weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, chars=1_000_000):
            f, of = features(b.column("text"), len(ratio))
            n = np.bincount(of, minlength=b.num_rows)
            weight = np.bincount(of, weights=ratio[f], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(weight)], names=["doc_id", "n_ngrams", "log_weight"])

    return run


def boundary(value: np.ndarray, good: np.ndarray) -> float:
    """The value that best separates good from bad: the highest mean of the two shares on the right side, midway between neighbours."""
    if not good.any() or good.all():
        return 0.0
    order = np.argsort(value, kind="stable")
    m, g = value[order], good[order]
    bad_below = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    good_above = 1 - np.concatenate([[0], np.cumsum(g)]) / g.sum()
    cuts = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    ok = np.concatenate([[True], m[1:] > m[:-1], [True]])
    both = np.where(ok, bad_below + good_above, -1)
    best = np.flatnonzero(both >= both.max() - 1e-12)
    return float(cuts[best[len(best) // 2]])


def top_k(keys: DataFrame, k: int, bins: int = 1024, few: int = 20_000) -> DataFrame:
    """The k rows of largest ``key``, ties to the smaller doc_id (then whole groups of equal rows by their order of hash)."""
    if k <= 0:
        return keys.limit(0)
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k >= n:
        return keys
    above = 0  # keys over the interval [low, high]
    while True:
        inside = keys.filter(F.col("key").between(low, high))
        count = inside.count()
        if count <= few or high <= low or (high - low) <= abs(high) * 1e-14:
            break
        width = (high - low) / bins
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        # the exact bounds of each bin come from the keys in it
        found = sorted(inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect(), key=lambda r: -r["bin"])
        for r in found:
            if above + r["n"] >= k:
                if (r["lo"], r["hi"]) == (low, high):
                    high = low if low == high else high
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    rank = k - above
    if count <= few:
        edge = inside.select("key", "doc_id").orderBy(F.desc("key"), F.asc_nulls_first("doc_id")).limit(rank).collect()[-1]
    else:  # very many equal keys: their ids in order decide
        edge = inside.select("key", "doc_id").orderBy(F.desc("key"), F.asc_nulls_first("doc_id")).offset(rank - 1).limit(1).first()
    same = F.col("doc_id") <= edge["doc_id"] if edge["doc_id"] is not None else F.lit(False)
    return keys.filter((F.col("key") > edge["key"]) | ((F.col("key") == edge["key"]) & (F.col("doc_id").isNull() | same)))


def log_ratio(raw: np.ndarray, target: np.ndarray, smoothing: float) -> np.ndarray:
    """By bucket, the log of the target model's probability over the raw model's."""
    buckets = len(raw)
    # both are smoothed towards the raw model, so that n-grams the target sample lacks by chance weigh little
    p = (raw + smoothing) / (raw.sum() + smoothing * buckets)
    strength = max(2.0, target.sum() / buckets)
    return np.log((target + strength * p * buckets) / (target.sum() + strength * buckets)) - np.log(p)


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = 1 << 18, sample: int = 20_000, smoothing: float = 0.5, seed: int = 20240501) -> DataFrame:
    """doc_id, n_ngrams, log_weight and key of the sampled rows, one for each row of the input that stays."""
    d = only(docs, doc_id="long", text="string")
    marks = only(labels, doc_id="long", quality="int").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # at most ``sample`` rows
    good = np.array(sorted(r["doc_id"] for r in chosen if r["quality"] > 0), np.int64)
    quality = {r["doc_id"]: r["quality"] > 0 for r in chosen}

    counts = d.mapInArrow(_count(buckets, good), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most ``buckets`` rows
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    weights = kept(spark, d.mapInArrow(_weigh(log_ratio(raw, target, smoothing)), "doc_id long, n_ngrams long, log_weight double"))
    if k is None:
        ids = spark.createDataFrame([(int(i),) for i in quality], "doc_id long")
        seen = weights.join(F.broadcast(ids), "doc_id", "left_semi").filter("n_ngrams > 0").groupBy("doc_id").agg(F.min("log_weight").alias("w")).collect()
        cut = boundary(np.array([r["w"] for r in seen]), np.array([quality[r["doc_id"]] for r in seen], bool)) if seen else 0.0
        k = weights.filter(F.col("log_weight") >= cut).count()
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return top_k(weights.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), k)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, with all their columns, that resampling draws; rows of one doc_id stay or go together."""
    drawn = kept(spark, resample(spark, docs, labels, **parameters).select("doc_id"))
    known = by_ids(spark, docs, drawn.filter("doc_id is not null"), "left_semi")
    return known.unionByName(docs.filter("doc_id is null")) if drawn.filter("doc_id is null").limit(1).count() else known
