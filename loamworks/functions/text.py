"""Text functions: lines, matches, columns, previews, hashes, durations and JSON, all native but for JSON with comments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..model import InvalidParams

TRUNCATED = "... [TRUNCATED]"
MAX_LINE_BYTES = 1000


def lines_of(text: Column) -> Column:
    """The lines of a text without their line ends; a last empty line after a final line end is none."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def estimate_tokens(text: Column) -> Column:
    """ceil(characters / 4)"""
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def checked_regex(pattern: str) -> str:
    """A regular expression of the common dialect: no look-around, no back-references; classes know Unicode."""
    if not pattern:
        raise InvalidParams("the query is empty")
    if re.search(r"\(\?(?:[=!]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise InvalidParams("look-around and back-references are not supported")
    try:
        re.compile(re.sub(r"(?<!\\)((?:\\\\)*)(?:\\[pP]\{[^}]*\}|\\[zZAG])", r"\1x", pattern))
    except re.error as e:
        raise InvalidParams(f"invalid regular expression: {e}") from e
    return pattern


def java_regex(pattern: str) -> str:
    return "(?U)" + pattern


def literal_regex(query: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", query)


def matches(line: Column, query: str, regex: bool) -> Column:
    return line.rlike(java_regex(checked_regex(query))) if regex else F.contains(line, F.lit(query))


def may_match(text: Column, query: str, regex: bool) -> Column:
    """Whether a whole text can hold a line that matches; true for each that does. A match within a line stands in the text as well, and ^ and $ hold at the ends of its lines; only patterns that name the ends of the input cannot be told in advance."""
    if regex and re.search(r"(?<!\\)(?:\\\\)*\\[AzZG]|\(\?-?[a-z]*m", query):
        return F.lit(True)
    return text.rlike("(?Um)" + checked_regex(query)) if regex else F.contains(text, F.lit(query))


def match_column(line: Column, query: str, regex: bool) -> Column:
    """Where the first match begins, in code points from 1."""
    if not regex:
        return (F.length(F.substring_index(line, query, 1)) + 1).cast("long")
    # the text before the first match, counted in code points (regexp_instr counts UTF-16 units)
    return (F.length(F.element_at(F.split(line, java_regex(query), 2), 1)) + 1).cast("long")


def truncated(line: Column) -> Column:
    """A line of over 1000 bytes cut at a character's end, with a mark."""
    ascii_cut = F.concat(F.substring(line, 1, MAX_LINE_BYTES), F.lit(TRUNCATED))
    return F.when(F.octet_length(line) <= MAX_LINE_BYTES, line).when(F.octet_length(line) == F.length(line), ascii_cut).otherwise(native_byte_cut(line))


def native_byte_cut(line: Column) -> Column:
    """The longest prefix of whole characters within 1000 bytes: its byte prefix, less the bytes of a character that was cut."""
    head = F.substring(F.encode(line, "UTF-8"), 1, MAX_LINE_BYTES)
    tail = F.hex(F.substring(head, MAX_LINE_BYTES - 3, 4))
    # bytes of an unfinished character at the end: a lead byte with too few followers
    cut = F.when(tail.rlike("(F[0-7][89AB][0-9A-F][89AB][0-9A-F])$"), 3).when(tail.rlike("(E[0-9A-F][89AB][0-9A-F]|F[0-7][89AB][0-9A-F])$"), 2).when(tail.rlike("([CDE][0-9A-F]|F[0-7])$"), 1).otherwise(0)
    return F.concat(F.decode(F.substr(head, F.lit(1), F.lit(MAX_LINE_BYTES) - cut), "UTF-8"), F.lit(TRUNCATED))


def preview(s: Column, chars: int = 100) -> Column:
    """The first characters and ...; the length test is in bytes, as a text of more bytes may have fewer characters, which then stays whole."""
    return F.when((F.octet_length(s) <= chars) | (F.length(s) <= chars), s).otherwise(F.concat(F.substring(s, 1, chars), F.lit("...")))


def snippet(lines: Column, row: Column, max_chars: int = 512) -> Column:
    """Trimmed line at a 1-based row, at most 512 characters; empty out of range."""
    return F.substring(F.trim(F.coalesce(F.try_element_at(lines, F.when(row > 0, row.cast("int")).otherwise(F.lit(2**31 - 1))), F.lit(""))), 1, max_chars)


def numbered(lines: Column, first: int = 1, width: int | None = 6) -> Column:
    """Lines with their numbers: right-aligned and ``|``, or ``n: text`` if ``width`` is None."""
    form = (lambda n, x: F.concat(F.lpad(n, width, " "), F.lit(" | "), x)) if width else (lambda n, x: F.concat(n, F.lit(": "), x))
    return F.transform(lines, lambda x, i: form((i + first).cast("string"), x))


def version_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def short_hash(full: Column) -> Column:
    return F.substring(F.regexp_replace(full, "^sha256:", ""), 1, 7)


def same_version(full: Column, given: Column) -> Column:
    """Whether a hash of at least 7 hex digits, long or short, with or without its prefix, names this version."""
    bare = F.regexp_replace(given, "^sha256:", "")
    return (F.length(bare) >= 7) & F.startswith(F.regexp_replace(full, "^sha256:", ""), bare)


def uptime(seconds: Column) -> Column:
    """45s, 3m5s, 3m, 2h1m, 2h"""
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60))
    part = lambda n, u: F.when(n > 0, F.concat(n.cast("string"), F.lit(u))).otherwise("")
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(part(m, "m"), part(s, "s"))).otherwise(F.concat(part(h, "h"), part(m, "m")))


def uptime_seconds(text: Column) -> Column:
    """The inverse of uptime; null stays null."""
    unit = lambda u, k: F.coalesce(F.regexp_extract(text, rf"(\d+){u}", 1).try_cast("long"), F.lit(0)) * k
    return F.when(text.isNotNull(), unit("h", 3600) + unit("m", 60) + unit("s", 1))


def backoff(n: Column, most: int = 60) -> Column:
    """min(2^n, most) seconds"""
    return F.least(F.pow(F.lit(2.0), F.least(n, F.lit(30))), F.lit(float(most))).cast("long")


def probe_interval(age: Column) -> Column:
    """Seconds a probe stays valid, by the age of the process; unknown age counts as old."""
    return F.when(age <= 60, 10).when(age <= 300, 30).otherwise(120).cast("long")


def probe_valid(probe_age: Column, process_age: Column) -> Column:
    return probe_age < F.least(F.lit(30), probe_interval(process_age))


def json_at(text: Column, pointer: str, kind: str = "string", default=None) -> Column:
    """The value at a JSON pointer, cast, or the default."""
    steps = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in steps)
    return F.coalesce(F.get_json_object(text, path).try_cast(kind), F.lit(default).cast(kind))


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings are left alone."""
    pieces = re.findall(r'"(?:\\.|[^"\\])*"?|/\*.*?(?:\*/|$)|//[^\n]*|[^"/]+|/', text, re.DOTALL)
    kept = "".join(p for p in pieces if not p.startswith(("/*", "//")))
    pieces = re.findall(r'"(?:\\.|[^"\\])*"?|,(?=\s*[}\]])|[^",]+|,', kept, re.DOTALL)
    out = []
    at = 0
    for p in pieces:
        at += len(p)
        if p == "," and re.match(r"\s*[}\]]", kept[at:]):
            continue
        out.append(p)
    return "".join(out)


@F.pandas_udf(StringType())
def jsonc_to_json(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else strip_jsonc(x))
