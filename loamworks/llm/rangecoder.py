"""An adaptive context-mixing range coder of token ids, over many blocks and streams at once.

A block is coded by itself: its model starts anew, and its checksum is in its
header. The ids of a block are cut into up to 256 streams of equal length that
share the block's model. Step t codes the t-th id of every stream; then the
model learns these ids. So numpy codes thousands of ids in a step, and decoding
repeats the same steps.

The model mixes three predictions of the next id:

order 2  the id seen last after the same two ids, with a confidence of 0 to 3
order 1  the id seen last after the same id, likewise
order 0  how often each id occurred in the block, with an escape for new ids

For each pair of confidences the block counts how often order 2 or else order
1 was right. These shares are the weights of the mixture: parts of the coder's
range that go to the two predicted ids; the rest is divided by order 0, whose
table is renewed after steps 1, 2, 4, ... and then every 128. An escaped id
follows in plain bits.

Ids are below 2^30. The coder is carry-less: 48 bits of low end, words of 16 bits go out when the
leading word is settled or the range would get too small.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

STREAMS = 256
CONTEXT_BITS = 16  # of the tables of orders 1 and 2 in each block
_CONTEXTS = (1 << CONTEXT_BITS) - 1
DIRECT = 1 << 16  # ids below it can be in the order-0 table
_BITS = 24
_WHOLE = 1 << _BITS
_TOP, _BOTTOM, _MASK = np.uint64(1 << 32), np.uint64(1 << 28), np.uint64((1 << 48) - 1)
_MIX = np.uint32(2654435761)
_PAIR = np.uint32(pow(2654435761, -1, 1 << 32) * 40503 % (1 << 32))  # makes an id's mixed value 40503 times the id
_U16, _U24, _U32 = np.uint64(16), np.uint64(_BITS), np.uint64(32)
_HEADER = "<4sIIIHH"  # magic, ids, crc of the ids, crc of what follows, streams, words of an id
_HEAD = struct.calcsize(_HEADER)
_MAGIC = b"LWT1"


def _shape(n: int) -> tuple[int, int]:
    """Streams and steps of a block of n ids."""
    s = STREAMS
    while s > 1 and n < s * 64:
        s >>= 1
    return s, -(-n // s)


def _places(mask: np.ndarray) -> np.ndarray:
    return mask.nonzero()[0]


def _at(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``x[places]``; places are within x, so the faster way of numpy's that does not look is taken."""
    return x.take(places, mode="clip")


class _Model:
    """The models of several blocks with as many streams each, in order of falling steps.

    Ids and the tables of orders 1 and 2 are 32 bits wide and their products
    wrap; what is added up or indexes a table is 64 bits wide.

    Inside, ids below DIRECT go by numbers, in order of meeting them, so that
    the entries in use lie together in each block's tables and fit a processor's
    cache: a block has some thousand different ids, up to 65,535. So do the places
    of the table of order 1. Other ids are their own numbers. What is coded does not depend on the numbers.
    """

    def __init__(self, blocks: int, streams: int, decode: bool):
        lanes = blocks * streams
        self.blocks, self.streams, self.decode = blocks, streams, decode
        block = np.repeat(np.arange(blocks), streams)
        self.base = block << 16
        self.context_base = block << CONTEXT_BITS
        self.ctx_base = block << 5
        n = blocks << 16
        self.last1, self.last2 = np.zeros(blocks << CONTEXT_BITS, np.uint32), np.zeros(blocks << CONTEXT_BITS, np.uint32)  # id * 4 + confidence; 0 where nothing was seen
        self.count = np.zeros((blocks, DIRECT), np.int32)
        self.range0 = np.zeros(n, np.uint32)  # order 0: where an id's part begins * 2^16 + its size; 0 for new ids
        self.escape = np.zeros(lanes, np.int64)  # where the escape of a lane's block begins; it goes to 2^16
        self.slot = np.zeros(n, np.uint16) if decode else None
        self.number, self.id, self.met = np.full(DIRECT, -1, np.int32), np.zeros(DIRECT, np.uint32), 0
        self.mixed = np.zeros(DIRECT, np.uint32)  # by number, as is the next
        self.place1 = np.zeros(DIRECT, np.int32)
        self.place_of, self.places = np.full(1 << CONTEXT_BITS, -1, np.int32), 0
        self.at1 = self.context_base + self._place(np.zeros(1, np.uint32))[0]
        self.numbers(np.zeros(1, np.uint32), False)  # 0 is 0 in any case, as empty entries of the tables read 0
        self.hits = np.repeat(np.array([[2.0], [1.0], [4.0]]), blocks * 32, axis=1)  # right by order 2, else by order 1, by neither
        self.mixed1, self.mixed2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)  # of the last id and of that before it
        self.steps = 0
        self._weights()

    def _weights(self) -> None:
        """The parts of the range that orders 2 and 1 have, by context: confidence of order 2, of order 1, and whether both say the same."""
        share = self.hits[:2] / self.hits.sum(axis=0)
        w2 = np.minimum(np.maximum(share[0] * _WHOLE, 4096), _WHOLE * 62 // 64).astype(np.int64)
        w1 = np.minimum(np.maximum(share[1] * _WHOLE, 4096), _WHOLE - _WHOLE // 128 - w2).astype(np.int64)
        w2, w1 = w2.reshape(-1, 4, 4, 2), w1.reshape(-1, 4, 4, 2)
        w2[:, 0] = 0
        w1[:, :, 0] = w1[:, 1:, :, 1] = 0
        w1[:, 0, :, 1] = w1[:, 0, :, 0]  # without a prediction by order 2 there is no "same"
        self.w2, self.w1 = w2.ravel(), w1.ravel()

    def _place(self, mixed: np.ndarray) -> np.ndarray:
        """The places of mixed ids in the tables of order 1."""
        at = (mixed >> np.uint32(9)) & np.uint32(_CONTEXTS)
        fresh = np.unique(at[self.place_of[at] < 0])
        self.place_of[fresh] = self.places + np.arange(len(fresh))
        self.places += len(fresh)
        return self.place_of[at]

    def numbers(self, ids: np.ndarray, wide: bool) -> np.ndarray:
        """The numbers of ids; those met for the first time get the next ones."""
        small = ids[ids < DIRECT] if wide else ids
        new = small[self.number[small] < 0]
        if len(new):
            new = np.unique(new)
            at = slice(self.met, self.met + len(new))
            self.number[new] = np.arange(at.start, at.stop)
            self.id[at], self.mixed[at] = new, new * _MIX
            self.place1[at] = self._place(self.mixed[at])
            self.met = at.stop
        return self._renamed(ids, self.number.view(np.uint32), wide)

    def ids(self, numbers: np.ndarray, wide: bool) -> np.ndarray:
        return self._renamed(numbers, self.id, wide)

    @staticmethod
    def _renamed(x: np.ndarray, table: np.ndarray, wide: bool) -> np.ndarray:
        got = table.take(x, mode="clip")
        return np.where(x < DIRECT, got, x) if wide else got

    def predict(self, n: int):
        """For the first n lanes: places in the tables, their entries, predicted ids, the context, and the parts of the range that they have."""
        at1 = self.at1[:n]
        at2 = self.context_base[:n] + (((self.mixed1[:n] + self.mixed2[:n]) >> 8) & _CONTEXTS)
        e1, e2 = _at(self.last1, at1), _at(self.last2, at2)
        ctx = self.ctx_base[:n] + (((e2 & 3) << 3) | ((e1 & 3) << 1) | ((e1 ^ e2) < 4))
        return at1, at2, e1, e2, e1 >> 2, e2 >> 2, ctx, _at(self.w2, ctx), _at(self.w1, ctx)

    def learn(self, n: int, x: np.ndarray, seen, hit2: np.ndarray, hit1: np.ndarray, wide: bool) -> None:
        """``hit2``, ``hit1``: the lanes where order 2 was right, or else order 1. Factors 0 and 1 choose, as half of the lanes are right as a rule."""
        at1, at2, e1, e2, x1, x2, ctx, _, _ = seen
        size = self.hits.shape[1]
        for row, c in enumerate((_at(ctx, hit2), _at(ctx, hit1), ctx)):
            k = np.bincount(c, minlength=size)
            if row == 2:
                k -= both
            else:
                both = both + k if row else k.copy()
            k = k.reshape(-1, 4, 4, 2)
            k[:, 0, :, 0] += k[:, 0, :, 1]
            k[:, 0, :, 1] = 0
            self.hits[row] += k.ravel()
        over = _places(self.hits.sum(axis=0) > 4000)
        if len(over):
            self.hits[:, over] *= 0.5
        self.steps += 1
        if self.steps < 16 or not self.steps % 4:
            self._weights()
        one = np.uint32(1)
        fresh = (x << 2) + one
        top = fresh + one
        right2 = np.zeros(n, np.uint32)
        right2[hit2] = 1
        for at, e, right, last in ((at1, e1, (x1 == x).astype(np.uint32), self.last1), (at2, e2, right2, self.last2)):
            # right: one surer, up to 3; wrong: one less sure, or at 1 the new id with 1
            new = fresh + ((e >> 1) & one) * (e - top)
            last[at] = new + right * (np.minimum(e, top) + one - new)
        self.mixed2[:n] = self.mixed1[:n] * _PAIR
        at = x.astype(np.int64)
        self.mixed1[:n] = _at(self.mixed, at)
        self.at1 = self.context_base[:n] + _at(self.place1, at)
        if wide:
            other = _places(x >= DIRECT)
            self.mixed1[other] = x[other] * _MIX
            self.at1[other] = self.context_base[other] + self._place(self.mixed1[other])

    def renew(self, n: int, rows: np.ndarray, wide: bool) -> None:
        """The order-0 tables of the blocks of the first n lanes, after the steps of ``rows``; ``wide``: ids may be beyond the table."""
        met = self.met
        by_id = np.argsort(self.id[:met])
        for b in range(n // self.streams):
            new = rows[:, b * self.streams : (b + 1) * self.streams].ravel()
            if wide:
                new = new[new < DIRECT]
            count = self.count[b, :met]
            if len(new) < met // 8:
                np.add.at(count, new, np.int32(1))
            else:
                count += np.bincount(new, minlength=met).astype(np.int32)
            c = count.take(by_id)
            some = _places(c > 0)
            if len(some) > 12_000:  # the most frequent; the others are escaped
                some = np.sort(some[np.argsort(-c[some], kind="stable")[:12_000]])
            ids, c = by_id.take(some), c.take(some).astype(np.int64)
            total = int(c.sum())
            rest = min(max(int((c == 1).sum()) * 65536 // (total + 1), 256), 32768)
            room = 65536 - rest - 2 * len(ids)
            f = 2 + c * room // max(total, 1)
            end = np.cumsum(f)
            lo = b << 16
            self.range0[lo : lo + met] = 0
            self.range0[lo + ids] = (end - f) << 16 | f
            escape = int(end[-1]) if len(ids) else 0
            self.escape[b * self.streams : (b + 1) * self.streams] = escape
            if self.decode:
                self.slot[lo : lo + escape] = np.repeat(ids.astype(np.uint16), f)


def _renewals(steps: int) -> set[int]:
    return {1, 2, 4, 8, 16, 32, 64} | set(range(128, steps, 128))


def _encode_alike(blocks: list[np.ndarray], streams: int) -> list[bytes]:
    """Blocks with equal numbers of streams, in order of falling steps."""
    steps = [-(-len(x) // streams) for x in blocks]
    lanes = len(blocks) * streams
    grid = np.zeros((max(steps, default=0), lanes), np.uint32)
    for b, (x, t) in enumerate(zip(blocks, steps, strict=True)):
        grid[:t, b * streams : (b + 1) * streams] = np.pad(x.astype(np.uint32), (0, t * streams - len(x))).reshape(streams, t).T
    wide = [int(x.max(initial=0)) >= DIRECT for x in blocks]
    far = any(wide)
    wide_lane = np.repeat(wide, streams)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _MASK)
    room = 6 * (max(steps, default=0) + 1)
    # the k-th words of all lanes lie side by side, as lanes are about equally far
    out, at = np.zeros(lanes * room, np.uint16), np.arange(lanes)

    def code(rows, lo: np.ndarray, size: np.ndarray, bits: np.uint64) -> None:
        r = span[rows] >> bits
        a = low[rows] + r * lo.view(np.uint64)
        s = r * size.view(np.uint64)
        low[rows], span[rows] = a, s
        todo = None  # all of rows
        while True:
            settled = (a ^ (a + s)) < _TOP
            go = _places(settled | (s < _BOTTOM))
            if not len(go):
                break
            a, s, small = _at(a, go), _at(s, go), _places(~_at(settled, go))
            todo = go if todo is None and isinstance(rows, slice) else _at(rows if todo is None else todo, go)
            if len(small):
                s[small] = (np.uint64(0) - a[small]) & (_BOTTOM - np.uint64(1))
            i = _at(at, todo)
            out[i] = a >> _U32
            at[todo] = i + lanes
            a, s = (a << _U16) & _MASK, s << _U16
            low[todo], span[todo] = a, s

    model, renewals = _Model(len(blocks), streams, False), _renewals(len(grid))
    since = 0
    for row in grid:
        row[:] = model.numbers(row, far)
    for t in range(len(grid)):
        n = sum(s > t for s in steps) * streams
        x = grid[t, :n]
        seen = model.predict(n)
        _, _, _, _, x1, x2, _, w2, w1 = seen
        hit2, hit1 = _places(x == x2), _places(x == x1)
        hit2, hit1 = hit2[w2.take(hit2) > 0], hit1[w1.take(hit1) > 0]  # order 1 has no part where it says the same
        known = w2 + w1
        rest = _WHOLE - known
        if far:
            e = np.where(x < DIRECT, model.range0.take(model.base[:n] + np.minimum(x, DIRECT - 1)), np.uint32(0))
        else:
            e = _at(model.range0, model.base[:n] + x)
        new = e == 0
        new[hit2] = new[hit1] = False
        raw = _places(new)
        first = (e >> 16).astype(np.int64)
        last = first + (e & 0xFFFF)
        first[raw], last[raw] = model.escape.take(raw), 65536
        first, last = first * rest >> 16, last * rest >> 16
        lo, size = known + first, last - first
        lo[hit1], size[hit1] = w2.take(hit1), w1.take(hit1)
        lo[hit2], size[hit2] = 0, w2.take(hit2)
        code(slice(0, n), lo, size, _U24)
        if len(raw):
            y = model.ids(x[raw], far).astype(np.int64)
            if far:
                some = wide_lane[raw]
                code(raw[some], y[some] >> 16, np.ones(int(some.sum()), np.int64), _U16)
            code(raw, y & 0xFFFF, np.ones(len(raw), np.int64), _U16)
        model.learn(n, x, seen, hit2, hit1, far)
        if t + 1 in renewals:
            model.renew(n, grid[since : t + 1], far)
            since = t + 1
    # the shortest number within the range: one word, or two
    one = ((low + _TOP - np.uint64(1)) >> _U32) << _U32
    short = one < low + span
    two = ((low + np.uint64(0xFFFF)) >> _U16) << _U16
    end = np.where(short, one, two)
    out[at] = end >> _U32
    out[at + lanes] = (end >> _U16) & np.uint64(0xFFFF)
    words = at // max(lanes, 1) + np.where(short, 1, 2)
    out = out[: int(words.max(initial=0)) * lanes].reshape(-1, lanes).T.astype("<u2")  # a row for each lane
    done = []
    for b, x in enumerate(blocks):
        rows = range(b * streams, (b + 1) * streams)
        body = words[rows.start : rows.stop].astype("<u4").tobytes() + b"".join(out[r, : words[r]].tobytes() for r in rows)
        done.append(struct.pack(_HEADER, _MAGIC, len(x), zlib.crc32(x.astype("<u4").tobytes()), zlib.crc32(body), streams, 2 if wide[b] else 1) + body)
    return done


def _decode_alike(blocks: list[tuple[int, bytes, int]], streams: int) -> list[np.ndarray]:
    """(ids, body, words of an id) of blocks with equal numbers of streams, in order of falling steps."""
    steps = [-(-n // streams) for n, _, _ in blocks]
    lanes = len(blocks) * streams
    sizes, words = [], []
    for _, body, _ in blocks:
        size = np.frombuffer(body, "<u4", streams).astype(np.int64)
        sizes.append(size)
        words.append(np.frombuffer(body, "<u2", offset=4 * streams))
    size = np.concatenate(sizes)
    stream = np.concatenate([*words, np.zeros(4, np.uint16)])
    at = np.cumsum(size) - size
    end = at + size

    def read(rows: np.ndarray) -> np.ndarray:
        i = _at(at, rows)
        at[rows] = i + 1
        return (stream.take(i, mode="clip") * (i < _at(end, rows))).astype(np.uint64)

    above = np.zeros(lanes, np.uint64)  # the coded number less the low end
    for _ in range(3):
        above = (above << _U16) | read(np.arange(lanes))
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _MASK)
    wide = [w > 1 for _, _, w in blocks]
    far = any(wide)
    wide_lane = np.repeat(wide, streams)

    def target(rows, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Units of the range and how many of them lie below the coded number."""
        r = span[rows] >> bits
        return r, (above[rows] // r).view(np.int64)

    def take(rows, r: np.ndarray, lo: np.ndarray, size: np.ndarray) -> None:
        step = r * lo.view(np.uint64)
        a = low[rows] + step
        s = r * size.view(np.uint64)
        low[rows], span[rows] = a, s
        above[rows] -= step
        todo = None  # all of rows
        while True:
            settled = (a ^ (a + s)) < _TOP
            go = _places(settled | (s < _BOTTOM))
            if not len(go):
                break
            a, s, small = _at(a, go), _at(s, go), _places(~_at(settled, go))
            todo = go if todo is None and isinstance(rows, slice) else _at(rows if todo is None else todo, go)
            if len(small):
                s[small] = (np.uint64(0) - a[small]) & (_BOTTOM - np.uint64(1))
            above[todo] = ((_at(above, todo) << _U16) & _MASK) | read(todo)
            a, s = (a << _U16) & _MASK, s << _U16
            low[todo], span[todo] = a, s

    grid = np.zeros((max(steps, default=0), lanes), np.uint32)
    model, renewals = _Model(len(blocks), streams, True), _renewals(len(grid))
    since = 0
    for t in range(len(grid)):
        n = sum(s > t for s in steps) * streams
        rows = slice(0, n)
        seen = model.predict(n)
        _, _, _, _, x1, x2, _, w2, w1 = seen
        known = w2 + w1
        rest = _WHOLE - known
        r, v = target(rows, _U24)
        hit = _places(v < known)
        by2 = _at(v, hit) < _at(w2, hit)
        hit2, hit1 = hit[by2], hit[~by2]
        c = (np.maximum(((v - known + 1) << 16) - 1, 0).view(np.uint64) // rest.view(np.uint64)).view(np.int64)
        np.minimum(c, DIRECT - 1, out=c)
        x = _at(model.slot, model.base[:n] + c).astype(np.uint32)
        new = c >= model.escape[:n]
        new[hit] = False
        raw = _places(new)
        e = _at(model.range0, model.base[:n] + x)
        first = (e >> 16).astype(np.int64)
        last = first + (e & 0xFFFF)
        first[raw], last[raw] = model.escape.take(raw), 65536
        first, last = first * rest >> 16, last * rest >> 16
        lo, size = known + first, last - first
        lo[hit1], size[hit1], x[hit1] = w2.take(hit1), w1.take(hit1), x1.take(hit1)
        lo[hit2], size[hit2], x[hit2] = 0, w2.take(hit2), x2.take(hit2)
        take(rows, r, lo, size)
        if len(raw):
            y = np.zeros(n, np.uint32)
            if far:
                some = raw[wide_lane[raw]]
                r, v = target(some, _U16)
                take(some, r, v, np.ones(len(some), np.int64))
                y[some] = v << 16
            r, v = target(raw, _U16)
            take(raw, r, v, np.ones(len(raw), np.int64))
            x[raw] = model.numbers(y.take(raw) | v.astype(np.uint32), far)
        grid[t, :n] = x
        model.learn(n, x, seen, hit2, hit1, far)
        if t + 1 in renewals:
            model.renew(n, grid[since : t + 1], far)
            since = t + 1
    return [model.ids(grid[:t, b * streams : (b + 1) * streams].T.ravel()[:n], far) for b, ((n, _, _), t) in enumerate(zip(blocks, steps, strict=True))]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids as bytes that decode on their own."""
    if any(len(x) and int(x.max()) >> 30 for x in blocks):
        raise ValueError("token ids must be below 2^30")
    out: list[bytes] = [b""] * len(blocks)
    shapes = [_shape(len(x)) for x in blocks]
    for s in sorted({s for s, _ in shapes}):
        of = sorted((i for i in range(len(blocks)) if shapes[i][0] == s), key=lambda i: (-shapes[i][1], i))
        for i, data in zip(of, _encode_alike([blocks[i] for i in of], s), strict=True):
            out[i] = data
    return out


def decode(data: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; ValueError where a checksum does not fit."""
    heads = []
    for x in data:
        if len(x) < _HEAD or x[:4] != _MAGIC:
            raise ValueError("not a block of token ids")
        _, n, ids_crc, body_crc, streams, words = struct.unpack_from(_HEADER, x)
        if zlib.crc32(x[_HEAD :]) != body_crc:
            raise ValueError("a block of token ids is damaged")
        heads.append((n, ids_crc, streams, words))
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(data)
    for s in sorted({h[2] for h in heads}):
        of = sorted((i for i in range(len(data)) if heads[i][2] == s), key=lambda i: (-(-(-heads[i][0] // s)), i))
        for i, ids in zip(of, _decode_alike([(heads[i][0], data[i][_HEAD :], heads[i][3]) for i in of], s), strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != heads[i][1]:
                raise ValueError("a block of token ids decodes to others than were written")
            out[i] = ids
    return out
