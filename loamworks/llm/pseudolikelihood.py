"""Documents scored by masked pseudo-likelihood: a network predicts every word from both sides.

The words are counted over all documents. The network knows the most frequent
ones by themselves and the others by classes of endings, and each class by
parts, of words that begin alike. It adds up an embedding of each of two words
to the left and two to the right (one table for each place), squashes the sum
and predicts the masked word in steps, each from both sides: its group, then
the word or class within the group, then the part of the class. Within a part
the word is predicted from the corpus counts of all its words, which are
smoothed by a spelling model, a chain of bytes, in the manner of Witten and
Bell; so every word, seen or not, has a probability of its own. A document's
score is the sum of the log probabilities of its words.

Training is by data-parallel stochastic gradient (Adagrad) in numpy. The
documents are dealt to rounds by a hash of their id and text, a small part to
the first one. In each round every task starts from the same weights and learns
from all positions of its documents of that round; then the tasks' weights,
weighted by the positions they learned from, are averaged, chunk by chunk. So
every position is learned from once. As with any such training, which documents
share a task moves the weights a little.
What is gathered grows with the corpus: word counts and one set of weights for
each task. Workers hold the counts of up to 250,000 words; those of the rest
are joined.

Null, empty and blank text has no words, score 0 and a null mean. Words beside
the ends of a text are a blank. Repeated rows stay, a null doc_id stays null,
other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold_memory, in_pieces, kept, only
from .words import _SPACE, U, Words, mix, runs

GROUPS = 32
SIZE = GROUPS * GROUPS
ENDINGS, PARTS = 64, 32
BLANK = SIZE
PLACES = (-2, -1, 1, 2)
_SHAPES = {"embed": (len(PLACES), SIZE + 1, -1), "bias": (-1,), "group": (GROUPS, -1), "group_bias": (GROUPS,), "word": (GROUPS, GROUPS, -1), "word_bias": (GROUPS, GROUPS), "part": (ENDINGS, PARTS, -1), "part_bias": (ENDINGS, PARTS)}


def blank_weights(width: int, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    shape = lambda s: tuple(width if x < 0 else x for x in s)
    return {k: (rng.normal(0, 0.1, shape(s)) if k in ("embed", "group", "word", "part") else np.zeros(shape(s))).astype(np.float32) for k, s in _SHAPES.items()}


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in _SHAPES])


def shaped(x: np.ndarray, width: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        shape = tuple(width if i < 0 else i for i in s)
        n = int(np.prod(shape))
        out[k] = x[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def dealt_evenly(share: np.ndarray) -> np.ndarray:
    """A place (member * GROUPS + group) for each word or class, so that groups of GROUPS members have like shares of all positions: the largest go first, each to the group of least sum that has room."""
    total, size = np.zeros(GROUPS), np.zeros(GROUPS, np.int64)
    out = np.empty(SIZE, np.int64)
    for i in np.argsort(-share, kind="stable").tolist():
        g = int(np.where(size < GROUPS, total, np.inf).argmin())
        out[i] = size[g] * GROUPS + g
        total[g] += share[i]
        size[g] += 1
    return out


def _class(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (mix(last.astype(np.uint64) * U(256) + before.astype(np.uint64)) % U(ENDINGS)).astype(np.int64)


def endings(w: Words) -> np.ndarray:
    """The class of each word by its last two bytes."""
    if not len(w.end):
        return np.zeros(0, np.int64)
    return _class(np.where(w.end - w.start > 1, w.buf[np.maximum(w.end - 2, 0)], 0), w.buf[w.end - 1])


def parts(w: Words) -> np.ndarray:
    """The part of its class that each word is in, by its first byte."""
    return (mix(w.buf[w.start].astype(np.uint64) + U(1)) % U(PARTS)).astype(np.int64)


def places(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """np.searchsorted(known, h) for hashes: they lie evenly, so the leading bits of one lead to the neighbourhood of its place."""
    bits = max(len(known).bit_length(), 1)
    slot = np.zeros((1 << bits) + 1, np.int64)
    np.cumsum(np.bincount((known >> U(64 - bits)).astype(np.int64), minlength=1 << bits), out=slot[1:])
    at = slot[(h >> U(64 - bits)).astype(np.int64)]
    known = np.append(known, U((1 << 64) - 1))  # nothing is greater
    low = np.flatnonzero(known[at] < h)
    while len(low):
        at[low] += 1
        low = low[known[at[low]] < h[low]]
    return at


def word_ids(w: Words, vocabulary: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of words: their rank if frequent, else a class by the last two bytes."""
    known, rank = vocabulary
    ids = endings(w) + (SIZE - ENDINGS)
    if len(known):
        at = np.minimum(places(known, w.hash), len(known) - 1)
        ids = np.where(known[at] == w.hash, rank[at], ids)
    return ids


def contexts(ids: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Ids of the words at the places around each word, by place; beyond a text the blank."""
    n = len(ids)
    out = np.full((len(PLACES), n), BLANK, np.int64)
    for k, p in enumerate(PLACES):
        if abs(p) >= n:
            continue
        if p < 0:
            same = doc[:p] == doc[-p:]
            out[k, -p:][same] = ids[:p][same]
        else:
            same = doc[:-p] == doc[p:]
            out[k, :-p][same] = ids[p:][same]
    return out


def _hidden(w: dict[str, np.ndarray], ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hidden rows, with a one behind each that meets the biases in _ahead(), and the roots of their slopes."""
    z = np.take(w["embed"][0], ctx[0], axis=0)
    for k in range(1, len(PLACES)):
        z += np.take(w["embed"][k], ctx[k], axis=0)
    z += w["bias"]
    scale = np.abs(z)
    scale += 1
    np.reciprocal(scale, out=scale)
    h = np.empty((len(z), z.shape[1] + 1), z.dtype)
    np.multiply(z, scale, out=h[:, :-1])
    h[:, -1] = 1
    return h, scale


def _ahead(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights that score groups, words and parts, turned, with their biases as a last row."""
    out = {}
    for k in ("group", "word", "part"):
        *lead, members, width = w[k].shape
        out[k] = np.empty((*lead, width + 1, members), w[k].dtype)
        out[k][..., :-1, :] = w[k].swapaxes(-1, -2)
        out[k][..., -1, :] = w[f"{k}_bias"]
    return out


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(x) in the place of x, up to a factor for each row that only large values need, and its sums over the last axis."""
    if x.size and max(x.max(), -x.min()) > 60:
        x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[-1], x.dtype)


def _dealt(group: np.ndarray) -> tuple[np.ndarray, int]:
    """A place for each row in a table of GROUPS equally long stretches, and their length: so all groups are multiplied at once."""
    order = np.argsort(group.astype(np.int16), kind="stable")
    count = np.bincount(group, minlength=GROUPS)
    cap = int(count.max())
    place = np.empty(len(group), np.int64)
    place[order] = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.arange(GROUPS) * cap, count)
    return place, cap


def _in_groups(ahead: np.ndarray, h: np.ndarray, place: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The hidden rows at their places, and their scores of the members of their groups."""
    dealt = np.zeros((GROUPS * cap, h.shape[1]), h.dtype)
    dealt[place] = h
    dealt = dealt.reshape(GROUPS, cap, -1)
    return dealt, dealt @ ahead


def _runs(c: np.ndarray) -> list[tuple[int, int, int]]:
    """(class, start, end) of rows in order of their classes."""
    ends = np.cumsum(np.bincount(c, minlength=ENDINGS)).tolist()
    return [(k, s, e) for k, (s, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if e > s]


def _of_parts(ahead: np.ndarray, h: np.ndarray, classes: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of hidden rows in order of their classes: the probabilities of the parts, not yet divided by their sums, and these."""
    x = np.empty((len(h), PARTS), h.dtype)
    for k, s, e in classes:
        np.matmul(h[s:e], ahead[k], out=x[s:e])
    return _exp(x)


def log_probabilities(w: dict[str, np.ndarray], ids: np.ndarray, ctx: np.ndarray, deal: np.ndarray, part: np.ndarray, block: int = 8192) -> np.ndarray:
    """The log probability of each word, or of its class and part, given both its sides; ``deal`` has each one's place in the groups."""
    out = np.empty(len(ids), np.float32)
    ahead = _ahead(w)
    for i in range(0, len(ids), block):
        y = deal[ids[i : i + block]]
        g, rest = y % GROUPS, y // GROUPS
        every = np.arange(len(g))
        h, _ = _hidden(w, ctx[:, i : i + block])
        e, total = _exp(h @ ahead["group"])
        lp = e[every, g] / total
        place, cap = _dealt(g)
        _, x = _in_groups(ahead["word"], h, place, cap)
        e, total = _exp(x)
        lp *= e.reshape(GROUPS * cap, -1)[place, rest] / total.ravel()[place]
        rare = np.flatnonzero(ids[i : i + block] >= SIZE - ENDINGS)
        c = ids[i : i + block][rare] - (SIZE - ENDINGS)
        order = np.argsort(c.astype(np.int8), kind="stable")
        rare = rare[order]
        e, total = _of_parts(ahead["part"], np.take(h, rare, axis=0), _runs(c[order]))
        lp[rare] *= e[np.arange(len(rare)), part[i : i + block][rare]] / total
        out[i : i + block] = np.log(np.maximum(lp, 1e-30))
    return out


class Trainer:
    """Adagrad on batches of masked positions."""

    def __init__(self, weights: dict[str, np.ndarray], deal: np.ndarray, rate: float = 0.1):
        self.deal = deal
        self.w = {k: v.copy() for k, v in weights.items()}
        self.g = {k: np.full(v.shape, 1e-3, np.float32) for k, v in weights.items()}
        self.rate = rate
        self.seen = 0

    def _move(self, w: np.ndarray, g: np.ndarray, slope: np.ndarray) -> None:
        move = slope * slope
        g += move
        np.add(g, 1e-12, out=move)
        np.sqrt(move, out=move)
        np.divide(slope, move, out=move)
        move *= self.rate
        w -= move

    def step(self, ids: np.ndarray, ctx: np.ndarray, part: np.ndarray) -> float:
        """One update; returns the mean loss before it."""
        w, n = self.w, len(ids)
        order = np.argsort(ids.astype(np.int16), kind="stable")  # brings the rows of a class together, the classes last
        ids, ctx, part = ids[order], np.take(ctx, order, axis=1), part[order]
        every = np.arange(n)
        ahead = _ahead(w)
        h, scale = _hidden(w, ctx)
        y = self.deal[ids]
        g, rest = y % GROUPS, y // GROUPS
        # every d is a slope of the mean loss, so the gradients need no further division by n
        d, total = _exp(h @ ahead["group"])
        lp = d[every, g] / total
        total *= n
        d /= total[:, None]
        d[every, g] -= 1 / n
        up = d.T @ h
        grad = {"group": up[:, :-1], "group_bias": up[:, -1]}
        dh = d @ w["group"]
        place, cap = _dealt(g)
        dealt, x = _in_groups(ahead["word"], h, place, cap)
        e, total = _exp(x)
        flat_e, total = e.reshape(GROUPS * cap, -1), total.ravel()[place]
        lp *= flat_e[place, rest] / total
        weight = np.zeros(GROUPS * cap, total.dtype)  # places without a row count for nothing
        weight[place] = 1 / (total * n)
        flat_e *= weight[:, None]
        flat_e[place, rest] -= 1 / n
        up = e.transpose(0, 2, 1) @ dealt
        grad["word"], grad["word_bias"] = up[..., :-1], up[..., -1]
        dh += np.take((e @ w["word"]).reshape(GROUPS * cap, -1), place, axis=0)
        rare = slice(int(np.searchsorted(ids, SIZE - ENDINGS)), n)
        some, at, of = h[rare], every[: n - rare.start], part[rare]
        d, total = _of_parts(ahead["part"], some, classes := _runs(ids[rare] - (SIZE - ENDINGS)))
        lp[rare] *= d[at, of] / total
        total *= n
        d /= total[:, None]
        d[at, of] -= 1 / n
        up = np.zeros((ENDINGS, PARTS, h.shape[1]), h.dtype)
        back = np.empty((len(some), h.shape[1] - 1), h.dtype)
        for k, s, e in classes:
            x = d[s:e]
            np.matmul(x.T, some[s:e], out=up[k])
            np.matmul(x, w["part"][k], out=back[s:e])
        grad["part"], grad["part_bias"] = up[..., :-1], up[..., -1]
        dh[rare] += back
        dh *= scale
        dh *= scale
        grad["bias"] = np.ones(n, dh.dtype) @ dh
        column = np.ascontiguousarray(dh.T, np.float64)
        for k in range(len(PLACES)):
            up = np.empty(w["embed"].shape[1:], dh.dtype)
            for j, x in enumerate(column):
                up[:, j] = np.bincount(ctx[k], x, SIZE + 1)
            self._move(w["embed"][k], self.g["embed"][k], up)
        for k, x in grad.items():
            self._move(w[k], self.g[k], x)
        self.seen += n
        return -float(np.log(np.maximum(lp, 1e-30)).mean())


def spelling(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the next byte in a word, 32 being its start and end, and the log share of words in each part of each class.

    ``pairs``: how often a byte follows a byte, of shape (256, 256).
    """
    p = pairs + 1 / 256
    p[32, 32] = 0
    p /= p.sum(axis=1, keepdims=True)
    go = p.copy()
    go[32], go[:, 32] = 0, 0
    start, end = p[32], p[:, 32]
    byte = np.arange(256)
    of_part = (mix(byte.astype(np.uint64) + U(1)) % U(PARTS)).astype(np.int64)
    begins = np.where(of_part[:, None] == np.arange(PARTS), start[:, None], 0)
    visits = np.linalg.solve(np.eye(256) - go.T, begins)  # of each byte in a word, on average, by the part it begins in
    share = np.empty((ENDINGS, PARTS))
    for k in range(PARTS):
        share[:, k] = np.bincount(_class(byte[:, None], byte[None]).ravel(), weights=(visits[:, k, None] * go * end).ravel(), minlength=ENDINGS)
        share[:, k] += np.bincount(_class(np.zeros(256, np.int64), byte), weights=begins[:, k] * end, minlength=ENDINGS)
    with np.errstate(divide="ignore"):
        return np.log(p).ravel(), np.log(share).ravel()


def spelled(w: Words, follow: np.ndarray) -> np.ndarray:
    """The log probability of each word's bytes."""
    if not len(w.end):
        return np.zeros(0)
    x = np.concatenate([[32], np.where(_SPACE[w.buf], 32, w.buf)]).astype(np.int64)
    steps = follow[x[:-1] * 256 + x[1:]]
    steps[(x[:-1] == 32) & (x[1:] == 32)] = 0
    total = np.concatenate([[0.0], np.cumsum(steps)])
    return total[w.end + 1] - total[w.start]


def _byte_pairs(w: Words, at: np.ndarray) -> np.ndarray:
    """How often byte follows byte in the words ``at``; 32 stands before and after a word."""
    inside = np.zeros(len(w.buf) + 1, np.int8)
    inside[w.start[at]] = 1
    inside[w.end[at]] -= 1
    x = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, w.buf, 32).astype(np.int64)
    pairs = np.bincount(np.concatenate([[32], x[:-1]]) * 256 + x, minlength=65_536)
    pairs[32 * 257] = 0
    return pairs


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their class and part (class * PARTS + part) and count; with class -1, pairs of bytes in the distinct words of each piece."""
    held, have = [], 0
    pairs = np.zeros(65_536, np.int64)

    def counted(word: np.ndarray, kind: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(n)], names=["word", "ending", "n"])

    def together() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(word)
        at, _ = runs(word[order])
        return word[order[at]], kind[order[at]], np.add.reduceat(n[order], at) if len(at) else n

    for b in in_pieces(batches, chars=3_000_000):
        w = Words(b.column("text"))
        order = np.argsort(w.hash)
        at, n = runs(w.hash[order])
        at = order[at]
        pairs += _byte_pairs(w, at)
        held.append((w.hash[at], (endings(w) * PARTS + parts(w))[at], n))
        have += len(at)
        if have > 1_000_000:  # bounded memory; the sums go on after the shuffle
            held = [together()]
            if len(held[0][0]) > 500_000:
                yield counted(*held.pop())
            have = sum(len(x[0]) for x in held)
    if held:
        yield counted(*together())
    at = np.flatnonzero(pairs)
    yield counted(at, np.full(len(at), -1), pairs[at])


class Network(NamedTuple):
    """The frequent words' hashes, sorted, and their ranks; the places of words and classes in the groups; the weights."""

    vocabulary: tuple[np.ndarray, np.ndarray]
    deal: np.ndarray
    weights: np.ndarray
    width: int


def _learn(net: Network, batch: int, rate: float, chunk: int):
    """The weights that a task's documents lead to, in chunks: sums over the positions learned from, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory()
        trainer = Trainer(shaped(net.weights, net.width), net.deal, rate)
        rng = np.random.Generator(np.random.PCG64(17))
        held_y, held_c, held_p, have = [], [], [], 0
        for b in in_pieces(batches, chars=1_000_000):
            w = Words(b.column("text"))
            ids = word_ids(w, net.vocabulary)
            order = rng.permutation(len(ids))
            held_y.append(ids[order])
            held_c.append(contexts(ids, w.first, w.doc)[:, order])
            held_p.append(parts(w)[order])
            have += len(ids)
            if have >= batch:
                y, c, p = np.concatenate(held_y), np.concatenate(held_c, axis=1), np.concatenate(held_p)
                whole = have // batch * batch
                for i in range(0, whole, batch):
                    trainer.step(y[i : i + batch], c[:, i : i + batch], p[i : i + batch])
                held_y, held_c, held_p, have = [y[whole:]], [c[:, whole:]], [p[whole:]], have - whole
        if have:
            trainer.step(np.concatenate(held_y), np.concatenate(held_c, axis=1), np.concatenate(held_p))
        if trainer.seen:
            x = flat(trainer.w)
            at = range(0, len(x), chunk)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(at)), pa.int32()), pa.array([trainer.seen] * len(at)), pa.array([(x[i : i + chunk].astype(np.float64) * trainer.seen).astype(np.float32).tobytes() for i in at])], names=["chunk", "weight", "values"]
            )

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of one number added up, of rows in order of their numbers."""
    now, weight, total = None, 0, np.zeros(0)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()])], names=["chunk", "values"])

    for b in batches:
        for k, n, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != now:
                if now is not None:
                    yield row()
                now, weight, total = k, 0, 0.0
            weight += n
            total = total + np.frombuffer(x, np.float32).astype(np.float64)
    if now is not None:
        yield row()


def averaged(spark: SparkSession, learned: DataFrame, weights: np.ndarray, chunk: int) -> np.ndarray:
    """The mean of the tasks' weights, or ``weights`` where none learned. It is made chunk by chunk; the driver gets one set."""
    rows = learned.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed, "chunk int, values binary").collect()
    out = weights.copy()
    for r in rows:
        x = np.frombuffer(r["values"], np.float32)
        out[r["chunk"] * chunk : r["chunk"] * chunk + len(x)] = x
    return out


class Lexicon(NamedTuple):
    """What predicts a word within its part of a class: words of known count, sizes of parts, spelling."""

    word: np.ndarray
    n: np.ndarray
    escape: np.ndarray  # by class and part: the log weight of the spelling model, which counts as that many words
    total: np.ndarray  # by class and part: the log of all counts and that weight
    follow: np.ndarray


def within(w: Words, rare: np.ndarray, x: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words ``rare``: their log probabilities within their parts of classes, less those of no known count, which are told; and the log weights of their spellings."""
    c = (endings(w) * PARTS + parts(w))[rare]
    spell = spelled(w, x.follow)[rare] + x.escape[c]
    n = np.zeros(len(rare))
    if len(x.word):
        h = w.hash[rare]
        at = np.minimum(places(x.word, h), len(x.word) - 1)
        n = np.where(x.word[at] == h, x.n[at], 0)
    with np.errstate(divide="ignore"):
        lp = np.where(n > 0, np.logaddexp(np.log(n), spell), 0) - x.total[c]
    return lp, n == 0, spell


def _score(net: Network, lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory()
        w = shaped(net.weights, net.width)
        for b in in_pieces(batches, chars=1_000_000):
            words = Words(b.column("text"))
            ids = word_ids(words, net.vocabulary)
            lp = log_probabilities(w, ids, contexts(ids, words.first, words.doc), net.deal, parts(words)).astype(np.float64)
            rare = np.flatnonzero(ids >= SIZE - ENDINGS)
            more, open_, spell = within(words, rare, lexicon)
            lp[rare] += more
            total = np.bincount(words.doc, weights=lp, minlength=b.num_rows)
            rare, spell = rare[open_], spell[open_]
            ends = pa.array(np.searchsorted(rare, words.first).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (words.hash[rare].view(np.int64), spell)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(words.first)), pa.array(total), *lists], names=["doc_id", "n_tokens", "total", "word", "spell"])

    return run


def _lexicon(counts: DataFrame, frequent: dict[int, tuple[int, int]], held: int) -> tuple[Lexicon, np.ndarray]:
    """The lexicon, and how often each class occurs. ``frequent``: class with part and count of each word that the network knows; its class goes without it."""
    words = counts.filter("ending >= 0")
    sums = words.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    n, k = np.zeros(ENDINGS * PARTS), np.zeros(ENDINGS * PARTS)
    for r in sums:
        n[r["ending"]], k[r["ending"]] = r["n"], r["k"]
    for ending, m in frequent.values():
        n[ending] -= m
        k[ending] -= 1
    pairs = np.zeros(65_536)
    for r in counts.filter("ending < 0").collect():
        pairs[r["word"]] = r["n"]
    follow, share = spelling(pairs.reshape(256, 256))
    # the least count of which workers can hold all words
    least, many = 1 << 62, 0
    for r in words.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect():
        many += r["k"]
        if many > held:
            break
        least = r["n"]
    table = words.filter(F.col("n") >= least).select("word", "n").toArrow()
    word, m = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(np.float64)
    order = np.argsort(word)
    k = np.maximum(k, 1)
    return Lexicon(word[order], m[order], np.log(k) - share, np.log(n + k), follow), n.reshape(ENDINGS, PARTS).sum(axis=1)


def fit(spark: SparkSession, d: DataFrame, width: int = 24, rounds: tuple[int, ...] = (1, 7), batch: int = 4096, rate: float = 0.2, held: int = 250_000, chunk: int = 2048) -> tuple[Network, Lexicon, DataFrame]:
    """The network, the lexicon and the counts of all words.

    ``rounds``: the shares of the documents that each round learns from.
    ``held``: so many words at most have their counts in the lexicon; results do
    not depend on it.
    """
    counts = kept(spark, d.mapInArrow(_count_words, "word long, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n")))
    top = counts.filter("ending >= 0").orderBy(F.desc("n"), "word").limit(SIZE - ENDINGS).collect()
    lexicon, of_class = _lexicon(counts, {r["word"]: (r["ending"], r["n"]) for r in top}, held)
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    share = np.zeros(SIZE)
    share[: len(top)] = [r["n"] for r in top]
    share[SIZE - ENDINGS :] = of_class
    net = Network((hashes[order], order.astype(np.int64)), dealt_evenly(share), flat(blank_weights(width)), width)
    part, begin = F.pmod(F.xxhash64("doc_id", "text"), F.lit(sum(rounds))), 0
    for n in rounds:
        some = d.filter((part >= begin) & (part < begin + n))
        learned = some.mapInArrow(_learn(net, batch, rate, chunk), "chunk int, weight long, values binary")
        net = net._replace(weights=averaged(spark, learned, net.weights, chunk))
        begin += n
    return net, lexicon, counts


def score_documents(spark: SparkSession, docs: DataFrame, width: int = 24, **parameters) -> DataFrame:
    """doc_id, n_tokens, pseudo_log_likelihood and mean_log_probability of every row."""
    d = only(docs, doc_id="long", text="string")
    net, lexicon, counts = fit(spark, d, width, **parameters)
    rows = d.mapInArrow(_score(net, lexicon), "doc_id long, n_tokens long, total double, word array<long>, spell array<double>")
    rows = kept(spark, rows.withColumn("row", F.monotonically_increasing_id()))
    rest = rows.select("row", F.explode(F.arrays_zip("word", "spell")).alias("x")).select("row", "x.word", "x.spell")
    rest = rest.join(counts.filter("ending >= 0").select("word", "n"), "word", "left")
    lp = F.when(F.col("n").isNull(), F.col("spell")).otherwise(F.log(F.col("n") + F.exp("spell")))
    parts = rows.select("row", "doc_id", "n_tokens", "total").unionAll(rest.select("row", F.lit(None).cast("long"), F.lit(None).cast("long"), lp))
    found = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("total").alias("pseudo_log_likelihood"))
    return found.select("doc_id", "n_tokens", "pseudo_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens")).alias("mean_log_probability"))
