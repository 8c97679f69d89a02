"""Token ids of whole texts by the tokenizers library, with the ids of recurring words remembered.

A text is cut at white space where the tokenizer cuts in any case, so that the
ids of the pieces, each encoded by the library, joined are the ids of the
text. Texts for which that does not hold are encoded whole. Strings of special
tokens in a text are ordinary text.

Words are looked up by a 64-bit hash in a table of bounded size and their ids
gathered from a pool, for millions of bytes at once; only words that are not
in the table become Python strings.
"""

from __future__ import annotations

import os
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import U, Words, mix

_BLANK, _LINE, _FIRST = 0, 1, 2  # what stands before a word
#: At byte level printable bytes are their own signs, the others have the signs from U+0100 on.
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
_SIGN_BYTES = np.array([[*chr(_BYTE_SIGNS.get(b, b)).encode(), 0][:2] for b in range(256)], np.uint8)  # in UTF-8: two bytes, or one and 0
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, np.int64)  # a full stop or comma
_SIGN[[44, 46]] = 1
#: Bytes of letters up to U+023F, of ASCII signs, and others. U+00D7 and U+00F7 are no letters, which _stems looks at.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = 0
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_BESIDE = 200  # words that go to the library as one string


def _lasting() -> dict:
    """A dictionary that lives as long as the Python process, so that later tasks of a worker find what earlier ones learned."""
    return sys.modules.setdefault("_loamworks_lasting", types.ModuleType("_loamworks_lasting")).__dict__


class _Table:
    """Ids of words by hash: open addressing, half full at most, and a pool of ids."""

    def __init__(self, bits: int):
        self.mask, self.limit = U((1 << bits) - 1), 1 << (bits - 1)
        self.key = np.zeros(1 << bits, np.uint64)
        self.at, self.n = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.pool, self.used, self.entries = np.zeros(1 << bits, np.uint32), 0, 0

    @property
    def full(self) -> bool:
        return self.entries >= self.limit

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where it is not in the table."""
        slot = h & self.mask
        got = self.key[slot]
        out = np.where(got == h, slot.astype(np.int64), -1)
        todo = np.flatnonzero((got != h) & (got != 0))
        while len(todo):
            slot[todo] = (slot[todo] + U(1)) & self.mask
            got = self.key[slot[todo]]
            hit = got == h[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (got != 0)]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Distinct new hashes with their ids, laid end to end. One batch may need a larger table."""
        if 2 * (self.entries + len(h)) > len(self.key):
            have = np.flatnonzero(self.key)
            key, at_, n_ = self.key[have], self.at[have], self.n[have]
            size = 1 << (2 * (self.entries + len(h))).bit_length()
            self.mask = U(size - 1)
            self.key, self.at, self.n = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int32)
            self._put(key, at_, n_)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(n) - n
        self.used += len(ids)
        self.entries += len(h)
        self._put(h, at, n)

    def _put(self, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        slot, todo = h & self.mask, np.arange(len(h))
        while len(todo):
            free = self.key[slot[todo]] == 0
            some, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][first]
            self.key[some], self.at[some], self.n[some] = h[put], at[put], n[put]
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(free)[first]] = False
            todo = todo[left]
            slot[todo] = (slot[todo] + U(1)) & self.mask

    def gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slots, end to end, and how many each has."""
        n = self.n[slot].astype(np.int64)
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        return self.pool[np.repeat(self.at[slot] - (end - n), n) + np.arange(total)], n


def _apart(vocab: dict[str, int]) -> bool:
    """Whether words of letters that each follow a blank or a line end, in signs of bytes, are told apart by their ids though nothing parts them before: no token of several signs has such a beginning elsewhere, and a line end is a token by itself."""
    begin, inside = "\u0120\u010a", {chr(_BYTE_SIGNS.get(b, b)) for b in np.flatnonzero(_KIND == 0).tolist()}
    if not set(begin) <= set(vocab):
        return False
    return not any((x[0] == begin[1] or begin[0] in x[1:] or begin[1] in x[1:]) and any(y in inside for y in x) and set(x) <= inside | set(begin) for x in vocab if len(x) > 1)


class Encoder:
    """Ids of texts. ``words``: the tokenizer drops white space (else it is kept with the word after it).

    Two tables of about 2^(bits - 1) words are kept; when the newer is full
    it becomes the older, and words met again move to the newer. ``lasting``:
    they stay in the worker for its later tasks, at about 150 MB. ``led``: a
    blank is put before each text that is not empty.
    """

    def __init__(self, path: str, words: bool, bits: int = 20, lasting: bool = False, led: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        memory = _lasting() if lasting else {}
        if (path, bits) not in memory:
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            # ids that end a word, or that begin one with its blank: they part the ids of words encoded side by side
            mark = (lambda x: x.endswith("</w>")) if words else (lambda x: x.startswith("\u0120"))
            vocab = tokenizer.get_vocab()
            edge = np.zeros(tokenizer.get_vocab_size(), bool)
            edge[[i for x, i in vocab.items() if mark(x)]] = True
            letters = tokenizer
            if not words and type(tokenizer.pre_tokenizer) is pre_tokenizers.ByteLevel and _apart(vocab):
                letters = Tokenizer.from_file(path)
                letters.encode_special_tokens = True
                letters.pre_tokenizer = None  # text is in the signs of its bytes, and no token goes from one word into the next
            memory[path, bits] = (tokenizer, letters, [_Table(bits), _Table(bits)], edge, vocab.get("\u010a", -1))
        self.tokenizer, self.letters, self.tables, self.edge, self.line = memory[path, bits]
        self.words, self.bits, self.led = words, bits, led

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        if self.led:
            texts = [x and " " + x for x in texts]
        for i in range(0, len(texts), 2000):
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)]
        return out

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of words, each with its blank if it keeps one, encoded side by side, and how many each has; None if they can't be parted."""
        parts, sizes = [], []
        for i in range(0, len(words), 100):
            some = words[i : i + 100]
            text = " ".join(some) if self.words else " " + " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            edge = np.flatnonzero(self.edge[ids])
            if len(edge) != len(some) or (edge[-1] + 1 != len(ids) if self.words else edge[0]):
                return None
            parts.append(ids)
            sizes.append(np.diff(edge, prepend=-1) if self.words else np.diff(edge, append=len(ids)))
        return (np.concatenate(parts), np.concatenate(sizes)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _encode_each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings, end to end, and how many each has."""
        encoded = [e.ids for i in range(0, len(words), 2000) for e in self.tokenizer.encode_batch_fast(words[i : i + 2000], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(encoded), np.uint32), np.fromiter(map(len, encoded), np.int64, len(encoded))

    def _learn(self, words: list[str], before: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words with what stands before them, end to end, and how many each has.

        Words of letters after a blank go side by side, also those that a full
        stop or comma ends, whose ids are those of the word and of the sign,
        and other words that keep their blank; the rest are encoded one by one.
        """
        stem = [x if x.isalpha() else x[:-1] if x[-1:] in (".", ",") and x[:-1].isalpha() else "" for x in words]
        if not self.words:
            stem = [x if b == _BLANK else "" for x, b in zip(stem, before, strict=True)]
        number = {x: i for i, x in enumerate(dict.fromkeys(filter(None, stem)))}
        found = self._encode_words(list(number))
        if found is None:
            stem, number, found = [""] * len(words), {}, (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        left = [i for i, y in enumerate(stem) if not y]
        beside = [] if self.words else [i for i in left if before[i] == _BLANK]
        together = self._encode_words([words[i] for i in beside])
        if together is None:
            beside, together = [], (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        apart = sorted(set(left) - set(beside)) if beside else left
        prefix = {_BLANK: " ", _LINE: "\n", _FIRST: ""}
        each = self._encode_each([".", ",", *((words[i] if self.words else prefix[before[i]] + words[i]) for i in apart)])
        pool, n = (np.concatenate(x) for x in zip(found, each, together, strict=True))
        at = np.cumsum(n) - n
        # of each word two parts of the pool: its stem or itself, and its sign or nothing
        signs = len(number)
        first = np.array([number.get(y, -1) for y in stem], np.int64)
        first[apart + beside] = signs + 2 + np.arange(len(left))
        marked = np.array([0 if not y or len(y) == len(x) else 1 if x[-1] == "." else 2 for x, y in zip(words, stem, strict=True)], np.int64)
        start = np.stack([at[first], at[signs + np.maximum(marked - 1, 0)]], axis=1).ravel()
        size = np.stack([n[first], np.where(marked > 0, n[signs + np.maximum(marked - 1, 0)], 0)], axis=1)
        flat = size.ravel()
        ids = pool[np.repeat(start - (np.cumsum(flat) - flat), flat) + np.arange(int(flat.sum()))]
        return ids, size.sum(axis=1)

    def _plain(self, w: Words, at: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        """Which of the words ``at`` are A-Z and a-z after a blank, perhaps with a full stop or comma at the end: the simplest of those that _stems tells."""
        if self.letters is self.tokenizer or before is None or not len(at):
            return np.zeros(len(at), bool)
        n = w.end[at] - w.start[at] - _SIGN[w.buf[w.end[at] - 1]]
        first = np.cumsum(n) - n
        other = np.concatenate([[0], np.cumsum(~_LETTER[w.buf[np.repeat(w.start[at] - first, n) + np.arange(int(n.sum()))]])])
        return (n > 0) & (before == _BLANK) & (other[first + n] == other[first])

    def _stems(self, w: Words, at: np.ndarray) -> np.ndarray:
        """Of each of the words ``at`` the bytes of the letters up to U+023F that it begins with, if nothing but ASCII signs follows; else 0."""
        n = w.end[at] - w.start[at]
        end = np.cumsum(n)
        byte = w.buf[np.repeat(w.start[at] - (end - n), n) + np.arange(int(n.sum()))]
        kind = _KIND[byte]
        bad = kind == 2
        bad[1:] |= (kind[1:] < kind[:-1]) | ((byte[:-1] == 0xC3) & ((byte[1:] == 0x97) | (byte[1:] == 0xB7)))
        bad[end - n] = kind[end - n] != 0  # what is before a word is not its own
        some = np.concatenate([[0], np.cumsum(bad)])
        letters = np.concatenate([[0], np.cumsum(kind == 0)])
        return np.where(some[end] == some[end - n], letters[end] - letters[end - n], 0)

    def _learn_plain(self, w: Words, at: np.ndarray, before: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _learn, for words that _stems told (``n``: bytes of the stem): bytes of letters go to the library side by side, those of one stem once.

        A word at the beginning of a text is encoded as after a line end, whose id is left out.
        """
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        blank = before == _BLANK
        _, first, stem = np.unique(w.spans(w.start[at], n) + blank, return_index=True, return_inverse=True)
        size = n[first] + 1
        end = np.cumsum(size)
        byte = w.buf[np.maximum(np.repeat(w.start[at[first]] - 1 - (end - size), size) + np.arange(int(end[-1])), 0)]  # the first of each is put in now
        byte[end - size] = np.where(blank[first], 32, 10)
        two = _SIGN_BYTES[byte]
        text = two[two > 0]
        cuts = np.concatenate([[0], np.cumsum(1 + (two[:, 1] > 0))])[np.concatenate([[0], end[_BESIDE - 1 : -1 : _BESIDE], end[-1:]])].tolist()
        parts = [text[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:], strict=False)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.letters.encode_batch_fast(parts, add_special_tokens=False)), np.uint32)
        here = np.flatnonzero(self.edge[ids] | (ids == self.line))
        if len(here) != len(first):
            return self._learn(w.texts(at), before.tolist())
        length = np.diff(here, append=len(ids))
        # the signs after the stems: few kinds
        more = w.end[at] - w.start[at] - n
        _, one, kind = np.unique(w.spans(w.start[at] + n, more), return_index=True, return_inverse=True)
        signs = [w.buf[a:b].tobytes().decode() for a, b in zip((w.start[at] + n)[one].tolist(), w.end[at[one]].tolist(), strict=True)]
        sign_ids, sign_n = self._encode_each(signs)
        sign_at = len(ids) + np.cumsum(sign_n) - sign_n
        ids = np.concatenate([ids, sign_ids])
        skip = before == _FIRST
        start = np.stack([here[stem] + skip, sign_at[kind]], axis=1).ravel()
        each = np.stack([length[stem] - skip, sign_n[kind]], axis=1)
        flat = each.ravel()
        return ids[np.repeat(start - (np.cumsum(flat) - flat), flat) + np.arange(int(flat.sum()))], each.sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and where each text's begin (and their number); null is empty."""
        w = Words(texts, lower=self.words)  # A-Z, which that tokenizer lowers itself; for the other case matters
        n = len(texts)
        h = w.hash
        if self.words:
            before = None
            whole = np.zeros(n, bool)
        else:
            before, whole = self._before(w)
            h = mix(h + before.astype(np.uint64) * U(0x9E3779B97F4A7C15))
            h = np.where(whole[w.doc], U(1), h)  # looked up once, in vain
        h = np.maximum(h, U(1))
        slot = self._slots(h, w, before, whole)
        fine = slot >= 0
        ids, sizes = self.tables[0].gather(slot[fine])
        per_word = np.zeros(len(h), np.int64)
        per_word[fine] = sizes
        total = np.concatenate([[0], np.cumsum(per_word)])
        ends = total[w.first]
        if not whole.any():
            return ids, ends
        at = np.flatnonzero(whole)
        extra = dict(zip(at.tolist(), self._encode(texts.take(pa.array(at)).to_pylist()), strict=True))
        parts = [extra.get(i) if i in extra else ids[ends[i] : ends[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _before(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """What stands before each word, and which texts must be encoded whole: with white space other than single blanks and line ends between words."""
        buf, n = w.raw, len(w.text_at) - 1
        doc_start = np.zeros(len(w.start), bool)
        some = w.first[:-1] < w.first[1:]
        doc_start[w.first[:-1][some]] = True
        prev = buf[np.maximum(w.start - 1, 0)]
        before = np.where(doc_start, _BLANK if self.led else _FIRST, np.where(prev == 10, _LINE, _BLANK))
        gap = np.diff(w.start, prepend=0)
        gap[1:] = w.start[1:] - w.end[:-1]
        bad = np.zeros(n, bool)
        odd_gap = ~doc_start & ((gap != 1) | ((prev != 32) & (prev != 10)))
        bad[w.doc[odd_gap]] = True
        # white space at either end, or no word but white space
        text_end = w.text_at[1:] - 1
        bad[some] |= w.start[w.first[:-1][some]] != w.text_at[:-1][some]
        bad[some] |= w.end[w.first[1:][some] - 1] != text_end[some]
        bad[~some] |= text_end[~some] > w.text_at[:-1][~some]
        # white space of other kinds
        at = np.flatnonzero(((buf >= 28) & (buf <= 31)) | (buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)))
        if len(at):
            b = np.concatenate([buf, np.zeros(3, np.uint8)])
            x, y, z = b[at], b[at + 1], b[at + 2]
            two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
            e2 = (x == 0xE2) & (((y == 0x80) & (((z >= 0x80) & (z <= 0x8A)) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
            other = ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
            at = at[(x < 32) | two | e2 | other]
            bad[np.searchsorted(w.text_at, at, "right") - 1] = True
        return before, bad

    def _slots(self, h: np.ndarray, w: Words, before: np.ndarray | None, whole: np.ndarray) -> np.ndarray:
        """Slots in the newer table; words that are not there are learned first. Words of texts that are encoded whole have none."""
        if self.tables[0].full:
            self.tables[:] = [_Table(self.bits), self.tables[0]]
        new, old = self.tables
        slot, size = new.find(h), len(new.key)
        skip = whole[w.doc]
        miss = np.flatnonzero((slot < 0) & ~skip)
        if len(miss):
            keys, first = np.unique(h[miss], return_index=True)
            at = miss[first]
            there = old.find(keys)
            have = there >= 0
            if have.any():
                new.add(keys[have], *old.gather(there[have]))
            at, keys = at[~have], keys[~have]
            if len(keys):
                what = np.full(len(at), _BLANK) if before is None else before[at]
                if self.letters is not self.tokenizer:
                    stem = self._stems(w, at)
                    plain = stem > 0
                    new.add(keys[plain], *self._learn_plain(w, at[plain], what[plain], stem[plain]))
                    at, keys, what = at[~plain], keys[~plain], what[~plain]
                if len(keys):
                    new.add(keys, *self._learn(w.texts(at), what.tolist()))
            if len(new.key) != size:
                slot = new.find(h)
            else:
                slot[miss] = new.find(h[miss])
        slot[skip] = -1
        return slot


class PieceEncoder(Encoder):
    """Ids of texts by a sentencepiece model whose pieces hold blanks only at their beginning and no line end; it puts a blank before each text itself."""

    def __init__(self, path: str, bits: int = 20, lasting: bool = False):
        import sentencepiece

        memory = _lasting() if lasting else {}
        if (path, bits) not in memory:
            memory[path, bits] = (sentencepiece.SentencePieceProcessor(model_file=path), [_Table(bits), _Table(bits)])
        self.tokenizer, self.tables = memory[path, bits]
        self.letters = self.tokenizer
        self.words, self.bits, self.led = False, bits, True

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.tokenizer.encode(texts, num_threads=1)]

    def _learn(self, words: list[str], before: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """As for Encoder; after a line end the blank that the model puts in front is a piece by itself, and is left out."""
        ids = self.tokenizer.encode(["\n" + x if b == _LINE else x for x, b in zip(words, before, strict=True)], num_threads=1)
        ids = [x[1:] if b == _LINE else x for x, b in zip(ids, before, strict=True)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
