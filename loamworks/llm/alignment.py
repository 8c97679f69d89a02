"""Alignment of two tokenizers over the bytes of a text.

Both sets of ids are ids of the same bytes: a blank and the text. Bit i of a
packed bitset says that a token ends after byte i; the AND of both sets has
the shared cuts, counts of bits before a cut (popcounts of whole words and of
one masked word) give the tokens up to it on either side, and the tokens
between two cuts are a group. A link joins the two tokens that end at a cut.

The bytes of one token of a link end those of the other, as both end at one
place of one text. So the pairs that can be linked at all are known from the
two vocabularies, some 400,000, and counting links of any corpus is counting
into an array of that size: each task counts its own, the sums are added up by
chunk, and go to all tasks. Nothing else leaves a task, and no document waits
for another.

A long text goes in pieces, cut at a single blank between letters or digits,
where both tokenizers cut in any case; what follows is again a blank and a
text. A text without such places is encoded as a whole.

Null and empty texts, and texts whose tokens do not give their bytes back
(with U+2581, which stands for a blank), have no tokens: zeros and an empty
string. Null doc_ids and repeated rows stay, each with its row, and count
each time. Empty tables give empty ones. Other columns are ignored. Strings of
special tokens in a text are ordinary text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_pieces, kept, only, summed, sums
from .tokens import Encoder, PieceEncoder, _lasting

#: Characters after which a text is cut at the next fit place, and of all pieces that are aligned at once.
PIECE_CHARS = 300_000
_CUT = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
_CHUNK = 1 << 14


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """Parts of a text which joined by single blanks are the text."""
    out, at = [], 0
    while len(text) - at > most:
        m = _CUT.search(text, at + most)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


# --- vocabularies


def byte_level_bytes(token: str) -> bytes:
    """The bytes of an entry of a byte-level vocabulary, where a printable character stands for each byte."""
    return bytes(_BYTE_OF[c] for c in token)


def _byte_characters() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTE_OF = _byte_characters()


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: U+2581 is a blank, <0xHH> a byte."""
    m = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(m.group(1), 16)]) if m else piece.replace("▁", " ").encode()


class Strings:
    """Byte strings of numbers, end to end in a pool."""

    def __init__(self, strings: list[bytes]):
        self.n = np.array([len(s) for s in strings], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.pool = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.n[ids]
        return self.pool[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted keys a * len(b) + b of all pairs of ids of which one's bytes end the other's."""
    by: dict[bytes, list[int]] = {}
    for j, x in enumerate(b):
        by.setdefault(x, []).append(j)
    size, keys = len(b), set()
    for i, x in enumerate(a):
        for k in range(len(x)):
            keys.update(i * size + j for j in by.get(x[k:], ()))
    by = {}
    for i, x in enumerate(a):
        by.setdefault(x, []).append(i)
    for j, x in enumerate(b):
        for k in range(1, len(x)):
            keys.update(i * size + j for i in by.get(x[k:], ()))
    return np.array(sorted(keys), np.int64)


class Tokenizers:
    """Two tokenizers, from the paths of their files: a byte-level one and one of pieces."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Encoder(path_a, words=False, lasting=True, led=True), PieceEncoder(path_b, lasting=True)
        a, b = self.a.tokenizer, self.b.tokenizer
        # special tokens never come; their bytes are as their names say
        of_a = [byte_level_bytes(t) if (t := a.id_to_token(i)) and all(c in _BYTE_OF for c in t) else b"" for i in range(a.get_vocab_size())]
        of_b = [piece_bytes(b.id_to_piece(i)) for i in range(b.get_piece_size())]
        self.bytes_a, self.bytes_b = Strings(of_a), Strings(of_b)
        self.keys, self.size = linkable(of_a, of_b), len(of_b)
        #: ids of both as decimal numbers, each with a place for the sign after it; those of b follow those of a
        self.names = Strings([b"%d " % i for i in [*range(len(of_a)), *range(len(of_b))]])


def loaded(path_a: str, path_b: str) -> Tokenizers:
    """The tokenizers, which stay in a worker for its later tasks."""
    memory = _lasting()
    if ("pair", path_a, path_b) not in memory:
        memory["pair", path_a, path_b] = Tokenizers(path_a, path_b)
    return memory["pair", path_a, path_b]


# --- bitsets


class Bits:
    """A set of places as a packed bitset with the counts before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        count = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(count) - count

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def places(self) -> np.ndarray:
        """All places of the set, in order (select)."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many places of the set are up to each place, that one included."""
        word = at >> 6
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (at & 63)).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


# --- alignment


@dataclass
class Aligned:
    """Pieces of texts aligned together: ids of both tokenizers end to end; for each shared cut its last byte, the tokens up to it, and its piece."""

    a: np.ndarray
    b: np.ndarray
    cut: np.ndarray
    rank_a: np.ndarray
    rank_b: np.ndarray
    ok: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    first_cut: np.ndarray
    first_byte: np.ndarray


def _without(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of both sides, and where those of each piece begin, without those of pieces that are not ok."""
    out = []
    for ids, first in ((a, first_a), (b, first_b)):
        n = np.diff(first)
        out.append((ids[np.repeat(ok, n)], np.concatenate([[0], np.cumsum(np.where(ok, n, 0))])))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def align(t: Tokenizers, texts: list[str]) -> Aligned:
    """Aligns pieces, none of them empty; of pieces that are not ``ok`` there are no tokens."""
    column = pa.array(texts, pa.string())
    (a, first_a), (b, first_b) = t.a.encode(column), t.b.encode(column)
    a, b = a.astype(np.int64), b.astype(np.int64)
    raw = [b" " + x.encode() for x in texts]
    size = np.array([len(x) for x in raw], np.int64)
    ok = np.ones(len(texts), bool)
    for s, ids, first in ((t.bytes_a, a, first_a), (t.bytes_b, b, first_b)):
        ok &= np.diff(np.concatenate([[0], np.cumsum(s.n[ids])])[first]) == size
    if not ok.all():
        a, b, first_a, first_b = _without(a, b, first_a, first_b, ok)
    first_byte = np.concatenate([[0], np.cumsum(np.where(ok, size, 0))])
    whole = np.frombuffer(b"".join(x for x, fine in zip(raw, ok.tolist(), strict=True) if fine), np.uint8)
    wrong = np.flatnonzero((t.bytes_a.joined(a) != whole) | (t.bytes_b.joined(b) != whole))
    if len(wrong):
        bad = np.unique(np.searchsorted(first_byte, wrong, "right") - 1)
        ok[bad] = False
        a, b, first_a, first_b = _without(a, b, first_a, first_b, ok)
        first_byte = np.concatenate([[0], np.cumsum(np.where(ok, size, 0))])
    total = int(first_byte[-1])
    ends_a = Bits.of(np.cumsum(t.bytes_a.n[a]) - 1, total)
    ends_b = Bits.of(np.cumsum(t.bytes_b.n[b]) - 1, total)
    cut = (ends_a & ends_b).places()
    return Aligned(a, b, cut, ends_a.rank(cut), ends_b.rank(cut), ok, first_a, first_b, np.searchsorted(cut, first_byte), first_byte)


def links(t: Tokenizers, x: Aligned) -> np.ndarray:
    """The place among the linkable pairs of the link at each cut."""
    return np.searchsorted(t.keys, x.a[x.rank_a - 1] * t.size + x.b[x.rank_b - 1]).astype("<u4")


def written(t: Tokenizers, x: Aligned) -> tuple[bytes, np.ndarray]:
    """All groups as ``a1,a2|b1;``, and where each piece's begin."""
    na, nb, groups = len(x.a), len(x.b), np.arange(len(x.cut))
    group_a = np.repeat(groups, np.diff(x.rank_a, prepend=0))
    group_b = np.repeat(groups, np.diff(x.rank_b, prepend=0))
    at_a = np.arange(na) + np.concatenate([[0], x.rank_b])[group_a]
    at_b = np.arange(nb) + x.rank_a[group_b]
    code = np.empty(na + nb, np.int64)
    code[at_a], code[at_b] = x.a, x.b + len(t.bytes_a.n)
    out = t.names.joined(code)
    end = np.cumsum(t.names.n[code])
    out[end - 1] = ord(",")
    out[end[at_a[x.rank_a - 1]] - 1] = ord("|")
    out[end[at_b[x.rank_b - 1]] - 1] = ord(";")
    return out.tobytes(), np.concatenate([[0], end])[x.first_a + x.first_b]


@dataclass
class _Document:
    """What is known of a document as its pieces are aligned one after another."""

    ok: bool = True
    n_a: int = 0
    n_b: int = 0
    links: list[np.ndarray] = field(default_factory=list)
    digest: object = None

    def add(self, n_a: int, n_b: int, some: np.ndarray, groups: bytes) -> None:
        self.n_a, self.n_b = self.n_a + n_a, self.n_b + n_b
        self.links.append(some)
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b";")
        self.digest.update(groups[:-1])


_DOCUMENTS = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def _together(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(text, piece) of all texts but empty ones, in lists of about PIECE_CHARS."""
    out: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for p in pieces(text) if text else ():
            out.append((i, p))
            size += len(p)
            if size >= PIECE_CHARS:
                yield out
                out, size = [], 0
    if out:
        yield out


def _documents(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(path_a, path_b)
        for batch in in_pieces(batches):
            texts = batch.column("text").to_pylist()
            docs = [_Document() for _ in texts]
            for some in _together(texts):
                x = align(t, [p for _, p in some])
                every, (data, at) = links(t, x), written(t, x)
                for k, (i, _) in enumerate(some):
                    d = docs[i]
                    d.ok &= bool(x.ok[k])
                    if d.ok:
                        d.add(int(x.first_a[k + 1] - x.first_a[k]), int(x.first_b[k + 1] - x.first_b[k]), every[x.first_cut[k] : x.first_cut[k + 1]], data[at[k] : at[k + 1]])
            docs = [d if d.ok else _Document() for d in docs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([f(d) for d in docs], pa.int64()) for f in (lambda d: d.n_a, lambda d: d.n_b, lambda d: sum(map(len, d.links)))),
                    pa.array([d.digest.hexdigest() if d.digest else "" for d in docs]),
                    pa.array([b"".join(y.tobytes() for y in d.links) for d in docs], pa.binary()),
                ],
                names=[c.split(" ")[0] for c in _DOCUMENTS.split(", ")],
            )

    return run


def _counted(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            some = b.column("links")
            for i in range(b.num_rows):
                total += np.bincount(np.frombuffer(some[i].as_buffer(), "<u4"), minlength=size) if len(some[i].as_buffer()) > size else 0
            small = b"".join(x.as_py() for x in some if len(x.as_buffer()) <= size)
            total += np.bincount(np.frombuffer(small, "<u4"), minlength=size)
        if total.any():
            yield sums(total, _CHUNK, "<i8")

    return run


def _scored(count: np.ndarray, best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.column("links").to_pylist()
            n = np.array([len(x) // 4 for x in some], np.int64)
            every = np.frombuffer(b"".join(some), "<u4")
            add = lambda values, n=n, every=every: np.diff(np.concatenate([[0], np.cumsum(values[every])])[np.concatenate([[0], np.cumsum(n)])])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), pa.array(n), pa.array(add(best.astype(np.int64))), pa.array(add(count)), b.column("groups_sha256")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return run


class Alignment:
    """The alignment of all documents (doc_id, text) by a byte-level tokenizer and one of pieces."""

    def __init__(self, spark: SparkSession, docs: DataFrame, path_a: str, path_b: str):
        self.tokenizers = t = loaded(path_a, path_b)
        #: doc_id, n_a, n_b, n_groups, groups_sha256, and the links as places among the linkable pairs
        self.documents = kept(spark, only(docs, doc_id="long", text="string").mapInArrow(_documents(path_a, path_b), _DOCUMENTS))
        #: how many links of the corpus each linkable pair has
        self.count = summed(spark, self.documents.select("links").mapInArrow(_counted(len(t.keys)), "chunk int, values binary"), len(t.keys), _CHUNK, "<i8")
        best = np.zeros(t.size, np.int64)
        np.maximum.at(best, t.keys % t.size, self.count)
        self.best = (self.count == best[t.keys % t.size]) & (self.count > 0)

    def scores(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
        return self.documents.mapInArrow(_scored(self.count, self.best), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def pairs(self, spark: SparkSession) -> DataFrame:
        """a, b, count and best of all pairs that are linked somewhere; as many at most as the vocabularies allow."""
        t, some = self.tokenizers, np.flatnonzero(self.count)
        return spark.createDataFrame(pa.table({"a": t.keys[some] // t.size, "b": t.keys[some] % t.size, "count": self.count[some], "best": self.best[some]}))


def _groups(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(path_a, path_b)
        for batch in in_pieces(batches):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            last, start, piece = None, 0, 0
            for some in _together(texts):
                x = align(t, [p for _, p in some])
                rows = []
                for k, (i, _) in enumerate(some):
                    start, piece = (start, piece + 1) if i == last else (0, 0)
                    s, e = x.first_cut[k], x.first_cut[k + 1]
                    rows.append((ids[i].as_py(), piece, x.a[x.first_a[k] : x.first_a[k + 1]], x.b[x.first_b[k] : x.first_b[k + 1]], x.cut[s:e] + 1 - x.first_byte[k] + start, x.rank_a[s:e] - x.first_a[k], x.rank_b[s:e] - x.first_b[k]))
                    last, start = i, start + int(x.first_byte[k + 1] - x.first_byte[k])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 5], strict=True)], names=["doc_id", "piece", "a", "b", "cuts", "until_a", "until_b"])

    return run


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, piece, ids a and b, byte offsets of the shared cuts in a blank and the text, and the number of tokens of either side up to each.

    A row for each piece of a text; of a piece that does not give its bytes back the lists are empty.
    """
    return only(docs, doc_id="long", text="string").mapInArrow(_groups(path_a, path_b), "doc_id long, piece int, a array<long>, b array<long>, cuts array<long>, until_a array<long>, until_b array<long>")
