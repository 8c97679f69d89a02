"""Language identification of words in mixed text by a linear-chain conditional random field.

A word's features are its affixes (first and last one to three bytes), byte
n-grams of two and three, and the lexicons it stands in (for each language the
words that occur most in its training texts and mark it); a label is a
language. Features and label-to-label transitions have learned weights, and
forward-backward gives each word's probabilities given the whole text. A
document's language is the one with the largest sum over its words, its score
that sum's mean.

Forward-backward runs over whole texts, all of a batch at once: texts are cut
into stretches, each stretch's product of transition matrices is computed side
by side, the products are passed along each text, and a second pass fills in
the stretches. That is exact, cuts included.

Training maximises the conditional likelihood by stochastic gradient on chains
that are spliced from stretches of several training texts, so that transitions
see switches; the expected transitions are the exact probabilities of pairs of
neighbouring labels. At most ``per_language`` texts of each language are used, of
``longest`` bytes at most, those of smallest hash of their id, and the
``languages`` languages with most texts; they are what the driver gets. There is a set of weights for each language.

Null text and text without a letter gives ``und`` with score 0. Without any
training text all is ``und``. Rows of a null doc_id are predicted, not learned
from; repeated rows stay and count once in learning; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_pieces, only
from .words import U, Words, mix

BUCKETS = 1 << 16
STRETCH = 64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Model:
    """Weights: ``emit`` by hashed feature and label, ``lexicon`` by (list, label), ``move`` by (label, next label); ``lists``: sorted word hashes and the lists they are in."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.emit = np.zeros((BUCKETS, n), np.float32)
        self.lexicon = np.zeros((n, n), np.float32)
        self.move = np.zeros((n, n), np.float32)
        self.words = np.zeros(0, np.uint64)
        self.lists = np.zeros((0, n), np.float32)


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words in a byte buffer, and where each word's begin (and their number)."""
    n = end - start
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    every = np.arange(len(n))
    padded = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.uint64)

    def add(kind: int, of: np.ndarray, *values: np.ndarray) -> None:
        h = np.full(len(of), kind, np.uint64)
        for v in values:
            h = h * U(1099511628211) + v + U(1)
        parts.append(((mix(h) % U(BUCKETS)).astype(np.int32), of))

    for k in (1, 2, 3):
        of = every[n >= k]
        add(k, of, *(padded[start[of] + i] for i in range(k)))
        add(10 + k, of, *(padded[end[of] - k + i] for i in range(k)))
    for k in (2, 3):
        m = np.maximum(n - k + 1, 0)
        of = np.repeat(every, m)
        at = start[of] + (np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m))
        add(20 + k, of, *(padded[at + i] for i in range(k)))
    feature = np.concatenate([f for f, _ in parts])
    of = np.concatenate([o for _, o in parts])
    order = np.argsort(of, kind="stable")
    return feature[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))])


def scores(model: Model, w: Words, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Emission scores of words."""
    f, at = word_features(w.buf, start, end)
    out = np.add.reduceat(model.emit[f], at[:-1], axis=0) if len(f) else np.zeros((len(start), len(model.labels)), np.float32)
    if len(model.words):
        i = np.minimum(np.searchsorted(model.words, hashes), len(model.words) - 1)
        out += np.where((model.words[i] == hashes)[:, None], model.lists[i], 0) @ model.lexicon
    return out


def _norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-30)


def marginals(e: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Label probabilities of every word: ``e`` are exp(emission) of all words, text i has words first[i] to first[i + 1] - 1."""
    labels = e.shape[1]
    sizes = np.diff(first)
    stretches = -(-sizes // STRETCH)
    begin = np.cumsum(stretches) - stretches
    total = int(stretches.sum())
    if not total:
        return np.zeros_like(e)
    a = np.exp(move).astype(np.float32)
    # dense stretches: place of word j of text i
    of = np.repeat(np.arange(len(sizes)), sizes)
    j = np.arange(len(e)) - first[of]
    lane, step = begin[of] + j // STRETCH, j % STRETCH
    dense = np.ones((STRETCH, total, labels), np.float32)
    dense[step, lane] = e
    length = np.bincount(lane, minlength=total)
    full = int(length.max())

    product = np.broadcast_to(np.eye(labels, dtype=np.float32), (total, labels, labels)).copy()
    for t in range(full):
        x = (product.reshape(-1, labels) @ a).reshape(total, labels, labels) * dense[t][:, None, :]
        x /= np.maximum(x.max(axis=(1, 2), keepdims=True), 1e-30)
        product = np.where((length > t)[:, None, None], x, product)

    forward = np.full((total, labels), 1 / labels, np.float32)
    backward = np.ones((total, labels), np.float32)
    order = np.argsort(-stretches, kind="stable")
    many = stretches[order]
    for s in range(1, int(many[0]) if len(many) else 0):
        live = order[: np.searchsorted(-many, -s)]  # texts with more than s stretches
        here = begin[live] + s
        forward[here] = _norm(np.einsum("ni,nij->nj", forward[here - 1], product[here - 1]))
    for s in range((int(many[0]) if len(many) else 0) - 2, -1, -1):
        live = order[: np.searchsorted(-many, -(s + 1))]
        here = begin[live] + s
        backward[here] = _norm(np.einsum("nij,nj->ni", product[here + 1], backward[here + 1]))

    alpha = np.empty((full, total, labels), np.float32)
    x = forward
    for t in range(full):
        x = np.where((length > t)[:, None], _norm((x @ a) * dense[t]), x)
        alpha[t] = x
    y = backward
    for t in range(full - 1, -1, -1):
        alpha[t] *= y
        y = np.where((length > t)[:, None], _norm((dense[t] * y) @ a.T), y)
    return _norm(alpha[step, lane])


def gradients(s: np.ndarray, truth: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of chains of equal length with emission scores ``s`` and true labels ``truth`` (chains, steps, labels): the sum of the log-likelihoods, and its derivatives by s and by move.

    As in ``marginals`` a chain comes from an even mixture of labels before its
    first word.
    """
    chains, steps, n = s.shape
    a = np.exp(move)
    e = np.exp(s)
    forward, backward = np.empty_like(e), np.ones_like(e)
    x = np.full((chains, n), 1 / n, e.dtype)
    total = 0.0
    for t in range(steps):
        x = (x @ a) * e[:, t]
        z = x.sum(axis=1, keepdims=True)
        total += float(np.log(z).sum())
        x /= z
        forward[:, t] = x
    for t in range(steps - 2, -1, -1):
        backward[:, t] = _norm((e[:, t + 1] * backward[:, t + 1]) @ a.T)
    p = _norm(forward * backward)
    # P(label i at t, label j at t + 1) is in proportion to what led to i, the move, and all that follows j
    pair = forward[:, :-1, :, None] * a * (e * backward)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    before = a / a.sum(axis=0)  # where a chain's first label comes from
    right = np.einsum("cti,ctj->ij", truth[:, :-1], truth[:, 1:]) + before * truth[:, 0].sum(axis=0)
    likelihood = float((s * truth).sum() + (move * np.einsum("cti,ctj->ij", truth[:, :-1], truth[:, 1:])).sum() + (truth[:, 0] @ np.log(a.mean(axis=0))).sum())
    return likelihood - total, truth - p, right - pair.sum(axis=(0, 1)) - before * p[:, 0].sum(axis=0)


def label_words(model: Model, texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of texts, which of them have a letter, and their label probabilities."""
    w = Words(pc.utf8_lower(texts))
    if not len(w.hash) or not model.labels:
        return w, np.zeros(len(w.hash), bool), np.zeros((len(w.hash), len(model.labels)), np.float32)
    _, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    letters = np.concatenate([[0], np.cumsum(_LETTER[w.buf])])
    s = scores(model, w, w.start[at], w.end[at], w.hash[at])
    has = letters[w.end[at]] > letters[w.start[at]]
    s = np.where(has[:, None], s - s.max(axis=1, keepdims=True), 0)
    e = np.exp(np.maximum(s, -30)).astype(np.float32)
    return w, has[inverse], marginals(e[inverse], w.first, model.move)


def train(texts: list[str], langs: list[str], seed: int = 5, rounds: int = 40, chains: int = 128, lexicon: int = 300, rate: float = 0.3) -> Model:
    """A model of texts, each in one language."""
    labels = sorted(set(langs))
    model = Model(labels)
    n = len(labels)
    if n < 2:
        return model
    w = Words(pc.utf8_lower(pa.array(texts, pa.string())))
    label = np.array([labels.index(x) for x in langs])[w.doc]
    letters = np.concatenate([[0], np.cumsum(_LETTER[w.buf])])
    use = np.flatnonzero(letters[w.end] > letters[w.start])
    if not len(use):
        return model

    hashes, inverse = np.unique(w.hash[use], return_inverse=True)
    counts = np.zeros((len(hashes), n))
    np.add.at(counts, (inverse, label[use]), 1)
    share = counts / np.maximum(counts.sum(axis=0), 1)
    marks = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-12) > 0.6
    chosen = np.zeros_like(marks)
    for k in range(n):
        best = np.argsort(-counts[:, k] * marks[:, k], kind="stable")[:lexicon]
        chosen[best, k] = marks[best, k] & (counts[best, k] > 1)
    some = chosen.any(axis=1)
    model.words, model.lists = hashes[some], chosen[some].astype(np.float32)

    rng = np.random.Generator(np.random.PCG64(seed))
    by_label = [use[label[use] == k] for k in range(n)]
    by_label = [x for x in by_label if len(x)]
    g_emit, g_lex, g_move = np.full(model.emit.shape, 1e-2, np.float32), np.full((n, n), 1e-2), np.full((n, n), 1e-2)
    for _ in range(rounds):
        index = np.empty((chains, STRETCH), np.int64)
        for c in range(chains):  # half of the chains are of one text, half switch a few times
            cuts = [0, STRETCH] if c % 2 else [0, *sorted(rng.choice(np.arange(6, STRETCH - 5), rng.integers(1, 4), replace=False).tolist()), STRETCH]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                pool = by_label[rng.integers(len(by_label))]
                at = rng.integers(max(1, len(pool) - (e - s)))
                index[c, s:e] = np.resize(pool[at : at + e - s], e - s)
        i = index.ravel()
        f, at = word_features(w.buf, w.start[i], w.end[i])
        lex = np.minimum(np.searchsorted(model.words, w.hash[i]), max(len(model.words) - 1, 0))
        inside = np.where((model.words[lex] == w.hash[i])[:, None], model.lists[lex], 0) if len(model.words) else np.zeros((len(i), n), np.float32)
        s = np.add.reduceat(model.emit[f], at[:-1], axis=0) + inside @ model.lexicon
        s = np.maximum(s - s.max(axis=1, keepdims=True), -30)
        truth = np.eye(n, dtype=np.float32)[label[i]]
        _, d, dm = gradients(s.reshape(chains, STRETCH, n).astype(np.float64), truth.reshape(chains, STRETCH, n), model.move.astype(np.float64))
        d, dm = d.reshape(-1, n), dm / chains
        of = np.repeat(np.arange(len(i)), np.diff(at))
        de = np.stack([np.bincount(f, weights=d[of, k], minlength=BUCKETS) for k in range(n)], axis=1).astype(np.float32) / chains
        dl = inside.T @ d / chains
        for x, g, step in ((model.emit, g_emit, de - 1e-4 * model.emit), (model.lexicon, g_lex, dl), (model.move, g_move, dm - 1e-3 * model.move)):
            g += step * step
            x += rate * step / np.sqrt(g)
    return model


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("switches", pa.int64())])


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.labels)
        names = np.array([*model.labels, "und"], dtype=object)
        for b in in_pieces(batches, chars=1_000_000):
            texts = b.column("text")
            w, has, p = label_words(model, texts)
            count = np.bincount(w.doc[has], minlength=b.num_rows) if len(has) else np.zeros(b.num_rows, np.int64)
            sums = np.stack([np.bincount(w.doc[has], weights=p[has, k], minlength=b.num_rows) for k in range(n)], axis=1) if n and len(has) else np.zeros((b.num_rows, max(n, 1)))
            best = sums.argmax(axis=1)
            mean = sums[np.arange(b.num_rows), best] / np.maximum(count, 1)
            # bytes of other scripts may be signs: texts without a Latin letter are looked at by character
            plain = np.concatenate([[0], np.cumsum(_LETTER[w.buf] & (w.buf < 128))])
            none = plain[w.text_at[1:]] == plain[w.text_at[:-1]]
            for i in np.flatnonzero(none).tolist():
                none[i] = not any(c.isalpha() for c in texts[i].as_py() or "")
            if not n:
                none[:] = True
            words = p.argmax(axis=1) if p.size else np.zeros(len(p), np.int64)
            keep = np.flatnonzero(has)
            change = (words[keep[1:]] != words[keep[:-1]]) & (w.doc[keep[1:]] == w.doc[keep[:-1]])
            switches = np.bincount(w.doc[keep[1:]][change], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[np.where(none, n, best)], pa.string()), pa.array(np.where(none, 0.0, np.clip(mean, 0, 1))), pa.array(switches)], schema=_OUT)

    return run


def training_rows(known: DataFrame, per_language: int, longest: int, languages: int = 256, salts: int = 16) -> DataFrame:
    """doc_id, lang and text of at most ``per_language`` different rows of each of the ``languages`` with most rows.

    Equal rows are made one before any is ranked. Each partition keeps the
    smallest hashes of each language and salt, then each salt, then each
    language; so no task sees all rows of one language or of one id.
    """
    fit = known.filter(F.octet_length("text") <= longest)
    rows = fit.select("doc_id", "lang", F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("o")).distinct()
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    rows = rows.join(F.broadcast(most.select("lang")), "lang", "left_semi")  # ``languages`` names
    order = ("o", "doc_id", "h")
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id", "h"), F.lit(salts))).orderBy(*order)
    some = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_language).drop("r")
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("r") <= per_language).select("doc_id", "lang", "h")
    # at most languages * per_language rows of three values
    found = fit.withColumn("h", F.xxhash64("text")).join(F.broadcast(some), ["doc_id", "lang", "h"], "left_semi")
    return found.groupBy("doc_id", "lang", "h").agg(F.min("text").alias("text")).drop("h")


def identify(spark: SparkSession, docs: DataFrame, per_language: int = 400, longest: int = 100_000, languages: int = 256, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and switches (changes of language between words) of every row; learned from the rows that are not held out."""
    d = only(docs, doc_id="long", text="string", lang="string")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    known = d.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != held_out))
    sample = sorted((r["doc_id"], r["lang"], r["text"]) for r in training_rows(known, per_language, longest, languages).collect())
    model = train([text for _, _, text in sample], [lang for _, lang, _ in sample])
    if len(set(model.labels)) == 1:
        model.emit = np.zeros((BUCKETS, 1), np.float32)
    out = d.select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, switches long")
    return out.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "switches")
