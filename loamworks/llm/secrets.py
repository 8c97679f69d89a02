"""Secret scans: probabilistic automata inferred from labelled credentials score every candidate's format.

Inference (ALERGIA): the labelled strings of a format make a prefix tree with
counts. States are compared in breadth-first order, a state with those kept so
far: two are compatible when the frequencies of ending and of each next symbol
differ by less than Hoeffding's bound, and so do their successors'. A state is
merged only with a compatible one, and of several with the one that makes the
strings below it likeliest, as rare states are compatible with many; their
subtrees are folded together. A state with no compatible one is kept. The
result is a deterministic automaton with probabilities.

Symbols are the first four characters as they are and after that classes
(upper, lower a-f, other lower, digit, each sign), as a format fixes a prefix
but draws the rest at random; for ordinary strings all are classes. A class's probability is spread evenly over its
characters, so the likelihoods of all automata are about characters and can be
compared. One automaton is inferred from labelled strings that are no
credentials. A candidate is a run of 16 or more characters of tokens, or any
part of it of that length between signs (``=``, ``/``, ``.``, ``-``) or its ends;
full stops at its end are left out. It is reported when some format's
likelihood exceeds that of ordinary strings by ``margin`` nats for each
character and by ``least`` nats as a whole; of parts that overlap, the one that
exceeds the margin most.

The labelled strings are the caller's (``labelled``: strings by format) or drawn by
a seeded generator from public formats; no document is needed to learn them,
and learning does not depend on the input.

Besides, three base patterns are always reported. Null text is empty. Spans
are in code points, end exclusive. Repeated rows stay, other columns are
ignored, a null doc_id stays null, an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, in_pieces, only

# Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
KINDS = ("assign", "access", "hex", "format")
LEAST_LENGTH, _SIGNS = 16, frozenset("=/.-")

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def labelled_credentials(seed: int = 11, each: int = 400) -> dict[str, list[str]]:
    """Strings of public credential formats, by format."""
    r = random.Random(seed)
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    word = _UPPER + _LOWER + _DIGIT
    formats = {
        "access_key": lambda: "AKIA" + draw(_UPPER + _DIGIT, 16),
        "code_host": lambda: r.choice(("ghp_", "gho_", "ghs_", "ghu_", "ghr_")) + draw(word, 36),
        "chat": lambda: r.choice(("xoxb-", "xoxp-", "xoxa-")) + draw(_DIGIT, r.randint(10, 13)) + "-" + draw(_DIGIT, r.randint(10, 13)) + "-" + draw(word, 24),
        "payment": lambda: r.choice(("sk_live_", "rk_live_", "pk_live_")) + draw(word, r.choice((24, 32))),
        "map": lambda: "AIza" + draw(word + "_-", 35),
        "web_token": lambda: "eyJ" + draw(word, r.randint(17, 33)) + ".eyJ" + draw(word, r.randint(20, 60)) + "." + draw(word + "_-", 43),
        "base64_key": lambda: draw(word + "+/", 40),
        "hex_key": lambda: draw(_DIGIT + "abcdef", r.choice((32, 40, 64))),
    }
    return {name: [make() for _ in range(each)] for name, make in formats.items()}


def labelled_ordinary(seed: int = 12, n: int = 4000) -> list[str]:
    """Long runs that are no credentials: joined words, capitals, identifiers, paths, hosts, numbers and dates."""
    r = random.Random(seed)
    consonants, vowels = "bcdfghjklmnpqrstvwxz", "aeiouy"
    word = lambda: "".join(r.choice(("", r.choice(consonants))) + r.choice(vowels) + r.choice(("", "", "n", "r", "s", "t", "l", "th", "ng")) for _ in range(r.randint(1, 4)))
    number = lambda: str(r.randint(0, 10 ** r.randint(1, 6)))

    def one() -> str:
        kind = r.randint(0, 10)
        words = [word() for _ in range(r.randint(2, 6))]
        if kind <= 1:
            return "".join(words)
        if kind == 2:
            return "".join(words).upper()
        if kind == 3:
            return "".join(w.capitalize() for w in words) + r.choice(("", ".", "..."))
        if kind == 4:
            return r.choice("_-./").join(words)
        if kind == 5:
            return "/".join(words) + "/" + number() + r.choice((".html", ".txt", ""))
        if kind == 6:
            return "_".join([*words, number()])
        if kind == 7:
            return r.choice("-=._") * r.randint(16, 60)
        if kind >= 9:
            return "".join(r.choice(_DIGIT) for _ in range(r.randint(12, 40)))
        return r.choice(("-", "/", ".", "")).join(str(r.randint(0, 9999)) for _ in range(r.randint(4, 8)))

    out = [one() for _ in range(n)]
    return [x for x in out if len(x) >= 12]


def symbols(text: str, head: int = 4) -> list[str]:
    """The automaton's symbols of a string."""
    return list(text[:head]) + [_CLASS[c] for c in text[head:]]


_CLASS = {c: "U" for c in _UPPER} | {c: "L" for c in _LOWER} | {c: "h" for c in "abcdef"} | {c: "D" for c in _DIGIT} | {c: c for c in "+/_.=-"}
_SPREAD = {"U": -math.log(26), "L": -math.log(20), "h": -math.log(6), "D": -math.log(10)}


class Automaton:
    """A probabilistic automaton by state merging; ``alpha`` is the confidence of the compatibility test."""

    def __init__(self, strings: list[str], spread: float, head: int = 4, alpha: float = 0.02):
        self.alpha, self.spread, self.head = alpha, spread, head
        self.merged: list[tuple[int, int]] = []
        self.count: list[int] = [0]
        self.ends: list[int] = [0]
        self.next: list[dict[str, int]] = [{}]
        self.flow: list[dict[str, int]] = [{}]
        for s in strings:
            self._add(symbols(s, head))
        self._merge_all()
        self._finish()
        del self.count, self.ends, self.next, self.flow  # what tasks get is the table

    def _add(self, word: list[str]) -> None:
        at = 0
        self.count[0] += 1
        for x in word:
            self.flow[at][x] = self.flow[at].get(x, 0) + 1
            if x not in self.next[at]:
                self.next[at][x] = len(self.count)
                self.count.append(0)
                self.ends.append(0)
                self.next.append({})
                self.flow.append({})
            at = self.next[at][x]
            self.count[at] += 1
        self.ends[at] += 1

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        if not n or not m:
            return False
        return abs(a / n - b / m) > (1 / math.sqrt(n) + 1 / math.sqrt(m)) * math.sqrt(0.5 * math.log(2 / self.alpha))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        seen = set()
        while todo:
            p, q = todo.pop()
            if p == q or (p, q) in seen:
                continue
            seen.add((p, q))
            n, m = self.count[p], self.count[q]
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for x in self.flow[p].keys() | self.flow[q].keys():
                if self._differ(self.flow[p].get(x, 0), n, self.flow[q].get(x, 0), m):
                    return False
                if x in self.next[p] and x in self.next[q]:
                    todo.append((self.next[p][x], self.next[q][x]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Adds the tree below q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.count[p] += self.count[q]
            self.ends[p] += self.ends[q]
            for x, k in self.flow[q].items():
                self.flow[p][x] = self.flow[p].get(x, 0) + k
                below = self.next[q].get(x)
                if below is None:
                    continue
                if x in self.next[p]:
                    todo.append((self.next[p][x], below))
                else:
                    self.next[p][x] = below

    def _likelihood(self, p: int, q: int) -> float:
        """The log-likelihood of the strings below q if they went on from p."""
        todo: list[tuple[int | None, int]] = [(p, q)]
        total = 0.0
        while todo:
            p, q = todo.pop()
            for x, k in self.flow[q].items():
                known = 0 if p is None else self.flow[p].get(x, 0)
                total += k * math.log((known + 0.01) / ((0 if p is None else self.count[p]) + 1))
                below = self.next[q].get(x)
                if below is not None:
                    todo.append((None if p is None else self.next[p].get(x), below))
            if self.ends[q]:
                total += self.ends[q] * math.log(((0 if p is None else self.ends[p]) + 0.01) / ((0 if p is None else self.count[p]) + 1))
        return total

    def _merge(self, p: int, x: str, r: int) -> None:
        """The state after p and x becomes r."""
        q, self.next[p][x] = self.next[p][x], r
        self.merged.append((r, q))
        self._fold(r, q)

    def _merge_all(self) -> None:
        red, is_red = [0], {0}
        blue = deque((0, x) for x in self.next[0])
        while blue:
            p, x = blue.popleft()  # breadth first
            q = self.next[p][x]
            if q in is_red:
                continue
            fits = [r for r in red if self._compatible(r, q)]
            if fits:
                r = max(fits, key=lambda r: self._likelihood(r, q))
                before = {s: set(self.next[s]) for s in red}
                self._merge(p, x, r)
                blue.extend((s, y) for s in red for y in self.next[s] if y not in before[s])
            else:
                red.append(q)
                is_red.add(q)
                blue.extend((q, y) for y in self.next[q])
        self.states = red

    def _finish(self) -> None:
        number = {s: i for i, s in enumerate(self.states)}
        even = self.spread / 70  # this part of each state's probability is spread over all symbols and the end
        self.table = []
        for s in self.states:
            total = max(self.count[s], 1)
            row = {x: (math.log((1 - self.spread) * k / total + even), number[self.next[s][x]]) for x, k in self.flow[s].items()}
            self.table.append((row, math.log(even), math.log((1 - self.spread) * self.ends[s] / total + even)))

    def score(self, text: str) -> float:
        """The log-likelihood of the characters; after an unknown symbol the state stays."""
        at, total = 0, 0.0
        for i, x in enumerate(symbols(text, self.head)):
            if i >= self.head:
                total += _SPREAD.get(x, 0.0)
            row, unknown, _ = self.table[at]
            step = row.get(x)
            if step is None:
                total += unknown
            else:
                total += step[0]
                at = step[1]
        return total + self.table[at][2]


class FormatScorer:
    """Automata of all formats and of ordinary strings."""

    def __init__(self, margin: float = 0.35, least: float = 12.0, labelled: dict[str, list[str]] | None = None):
        self.margin, self.least = margin, least
        self.formats = {k: Automaton(v, 1e-4) for k, v in (labelled or labelled_credentials()).items()}  # a format is rigid
        self.ordinary = Automaton(labelled_ordinary(), 0.03, head=0)

    def best(self, text: str) -> tuple[str, float]:
        """The likeliest format and its log-likelihood above that of an ordinary string."""
        base = self.ordinary.score(text)
        name, score = max(((k, a.score(text)) for k, a in self.formats.items()), key=lambda p: p[1])
        return name, score - base

    def accepts(self, text: str) -> tuple[str, float] | None:
        name, gain = self.best(text)
        return (name, gain) if gain >= self.least and gain >= self.margin * len(text) else None

    def within(self, run: str) -> list[tuple[int, int, str, float]]:
        """(start, end, format, gain) of the parts of a run that formats explain, none over another, the best ones first taken.

        A part begins at the run or after a sign, and ends at the run's end or
        before a sign. Its gain is the format's log-likelihood above that of
        the same characters in an ordinary run. All parts go along the run
        together: of those of a format that are in one state, the one that has
        most so far stays the best whatever follows, so a run costs its length
        times the states of the automata.
        """
        end = len(run.rstrip("."))
        before, ends_here, at = [0.0], [], 0
        for i, c in enumerate(run[:end]):
            ends_here.append(self.ordinary.table[at][2])
            if i and run[i - 1] in _SIGNS:  # an ordinary word may begin here, whatever went before
                at = 0
            row, unknown, _ = self.ordinary.table[at]
            step = row.get(_CLASS[c])
            before.append(before[-1] + _SPREAD.get(_CLASS[c], 0.0) + (step[0] if step else unknown))
            at = step[1] if step else at
        ends_here.append(self.ordinary.table[at][2])
        hits = [x for name, a in self.formats.items() for x in self._parts(run, end, name, a, before, ends_here)]
        out: list[tuple[int, int, str, float]] = []
        for _, s, e, name, gain in sorted(hits, key=lambda h: (-h[0], h[1], -h[2], h[3])):
            i = bisect.bisect(out, (s,))
            if (not i or out[i - 1][1] <= s) and (i == len(out) or out[i][0] >= e):
                out.insert(i, (s, e, name, gain))
        return out

    def _parts(self, run: str, end: int, name: str, a: Automaton, before: list[float], ends_here: list[float]) -> Iterator[tuple[float, int, int, str, float]]:
        """(gain less the margin, start, end, format, gain) of the best part for each end and state that passes."""
        held: dict[tuple[int, int], tuple[float, int]] = {}  # by age, up to the least length, and state
        for i in range(end):
            if not i or run[i - 1] in _SIGNS:
                held[0, 0] = (0.0, i)
            c = run[i]
            kind = _CLASS[c]
            less = before[i + 1] - before[i] + self.margin
            spread = _SPREAD.get(kind, 0.0) - less
            now: dict[tuple[int, int], tuple[float, int]] = {}
            for (age, state), (value, start) in held.items():
                row, unknown, _ = a.table[state]
                step = row.get(c) if age < a.head else row.get(kind)
                value += (step[0] if step else unknown) + (-less if age < a.head else spread)
                key = (min(age + 1, LEAST_LENGTH), step[1] if step else state)
                if key not in now or (value, -start) > (now[key][0], -now[key][1]):
                    now[key] = (value, start)
            held = now
            if i + 1 == end or run[i + 1] in _SIGNS:
                for (age, state), (value, start) in held.items():
                    over = value + a.table[state][2] - ends_here[i + 1]
                    gain = over + self.margin * (i + 1 - start)
                    if age == LEAST_LENGTH and over >= 0 and gain >= self.least:
                        yield over, start, i + 1, name, gain


@cache
def _own_scorer(margin: float, least: float) -> FormatScorer:
    return FormatScorer(margin, least)


def _scorer(margin: float, least: float, labelled: dict[str, list[str]] | None = None) -> FormatScorer:
    """Inferred once, on the driver; tasks get the automata."""
    return FormatScorer(margin, least, labelled) if labelled else _own_scorer(margin, least)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str, scorer: FormatScorer, known: dict[str, list[tuple[int, int, str, float]]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str, float]]]:
    """Base spans, and (start, end, format, gain) of the parts of candidates that a format explains and no base span touches."""
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # how far the base spans up to each go
    found = []
    for m in CANDIDATE.finditer(text):
        x = m.group()
        hits = known.get(x)
        if hits is None:
            hits = scorer.within(x)
            if len(known) < 100_000 and len(x) < 1000:
                known[x] = hits
        for s, e, name, gain in hits:
            start, end = m.start() + s, m.start() + e
            i = bisect.bisect_left(starts, end)
            if not i or reach[i - 1] <= start:
                found.append((start, end, name, gain))
    return base, found


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_format", pa.int64()), ("base_spans", pa.string()), ("spans", pa.string()), ("formats", pa.string())])


def _scan(scorer: FormatScorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, int, str, float]]] = {}
        for b in in_pieces(batches):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                base, more = scan(text or "", scorer, known)
                every = sorted(base + [(s, 3, e) for s, e, _, _ in more])
                write = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                rows.append((doc, *(sum(k == i for _, k, _ in base) for i in range(3)), len(more), write(base), write(every), ",".join(f"{f}:{g:.1f}" for _, _, f, g in more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return run


def find_secrets(docs: DataFrame, margin: float = 0.35, least: float = 12.0, labelled: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, counts by kind, base_spans, spans (kind:start:end, joined by commas) and the formats of added spans, for every row."""
    d = only(docs, doc_id="long", text="string")
    return d.mapInArrow(_scan(_scorer(margin, least, labelled)), "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_spans string, spans string, formats string")


def base_digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def _mask(scorer: FormatScorer, mark: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, int, str, float]]] = {}
        for b in in_pieces(batches):
            out = []
            for text in b.column("text").to_pylist():
                if text:
                    base, more = scan(text, scorer, known)
                    at, parts = 0, []
                    for s, e in sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, _, _ in more]):
                        if s >= at:
                            parts += [text[at:s], mark]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield b.set_column(names.index("text"), pa.field("text", pa.string()), pa.array(out, pa.string()))

    return run


def mask_secrets(docs: DataFrame, mark: str = "[SECRET]", margin: float = 0.35, least: float = 12.0, labelled: dict[str, list[str]] | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with every span of ``text`` replaced by ``mark``, overlapping spans by one; a column n_chars counts the characters anew."""
    d = bounded(docs).withColumn("text", docs["text"].cast("string"))
    out = d.mapInArrow(_mask(_scorer(margin, least, labelled), mark, d.columns), d.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(d.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in d.columns else out
