"""Words of many texts at once: boundaries and 64-bit hashes computed over one byte buffer.

A word's hash is a polynomial over the bytes, with a random 64-bit value for
each byte, taken from cumulative sums modulo 2^64 and mixed at the end. The
multiplier is odd, so the power at a word's start can be divided out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1


def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_STATE: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_STATE.get("up", ())) < n:
        m = max(n, 1 << 16)
        inv = pow(_RADIX, -1, 1 << 64)
        for key, base in (("up", _RADIX), ("down", inv)):
            out = np.empty(m, np.uint64)
            out[0] = 1
            have = 1
            while have < m:  # doubling: the next stretch is the first times a power
                k = min(have, m - have)
                out[have : have + k] = out[:k] * U(pow(base, have, 1 << 64))
                have += k
            _STATE[key] = out
    return _STATE["up"], _STATE["down"]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column of texts, A-Z lower-cased unless ``lower`` is False; null is a text without words.

    ``doc`` and ``hash`` have an entry for each word; ``first`` has the first
    word of each text and, at the end, the number of words; ``start`` and
    ``end`` are places in ``buf``.
    """

    def __init__(self, texts: pa.Array, lower: bool = True, letters_only: bool = False):
        n = len(texts)
        texts = texts.cast(pa.large_binary()).fill_null(b"") if texts.null_count else texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        size = int(offsets[-1] - offsets[0]) if n else 0
        data = np.frombuffer(texts.buffers()[2], np.uint8)[int(offsets[0]) : int(offsets[0]) + size] if size else np.zeros(0, np.uint8)
        # one blank byte after each text keeps words of neighbours apart
        self.text_at = (offsets - offsets[0]) + np.arange(n + 1) if n else np.zeros(1, np.int64)
        buf = np.full(size + n, 32, np.uint8)
        if n and size:
            keep = np.ones(size + n, bool)
            keep[self.text_at[1:] - 1] = False
            buf[keep] = data
        self.raw = buf
        if lower:
            buf = _LOWER[buf]
        self.buf = buf
        blank = (buf == 32) | (buf - np.uint8(9) < 5) if not letters_only else _APART[buf]
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_at)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self._hashes()

    def _hashes(self) -> None:
        up, down = _powers(min(len(self.buf), 1 << 16) or 1)
        value, m = _STATE.setdefault("values", _byte_values()), len(up)
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):  # stretches in which powers do not run out
            lo = int(self.start[at])
            to = int(np.searchsorted(self.end, lo + m, "right"))
            if to <= at:  # one word longer than the table
                up, down = _powers(int(self.end[at]) - lo + 1)
                m = len(up)
                continue
            hi = int(self.end[to - 1])
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(value[self.buf[lo:hi]] * up[: hi - lo], out=total[1:])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            at = to
        self.hash = mix(out)

    def spans(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hashes of runs of ``n`` bytes from ``start`` on."""
        up, _ = _powers(max(int(n.max(initial=1)), 1))
        end = np.cumsum(n)
        first = end - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        total = np.zeros(len(step) + 1, np.uint64)
        np.cumsum(_STATE.setdefault("values", _byte_values())[self.buf[np.repeat(start, n) + step]] * up[step], out=total[1:])
        return mix(total[end] - total[first] + n.astype(np.uint64))

    def ngrams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``k`` words within a text, and the text of each."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hash[:n].copy()
        for i in range(1, k):
            h = mix(h * U(0xD6E8FEB86659FD93) + self.hash[i : n + i])
        ok = self.doc[:n] == self.doc[k - 1 :]
        return h[ok], self.doc[:n][ok]

    def texts(self, at: np.ndarray) -> list[str]:
        """Several words as strings, decoded together; no word holds a line end."""
        if not len(at):
            return []
        n = self.end[at] - self.start[at]
        end = np.cumsum(n + 1)
        out = np.full(int(end[-1]), 10, np.uint8)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(end - n - 1, n) + step] = self.buf[np.repeat(self.start[at], n) + step]
        return out[:-1].tobytes().decode("utf-8", "replace").split("\n")

    def text(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


#: For words of letters and digits only: ASCII signs part words, bytes of other scripts do not.
_APART = np.ones(256, bool)
_APART[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _APART[_a:_b] = False


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    at = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)
    return at, np.diff(np.r_[at, len(sorted_keys)])
