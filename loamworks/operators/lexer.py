"""Tokens of source texts: a table of patterns for each language, and a stack for what nests.

One pass, linear in the text. Comments that nest (Rust) and template literals
whose substitutions hold code and further literals are followed by a stack, so
an inner one does not end the outer; a whole template literal is one string.
What is not closed ends with its line or the text and is told as a fault.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Lexed:
    """Words and signs of the code with their places, and the spans that are not code. A string is the word ``"``.

    ``stop`` and ``after``: for an opening bracket, the end of what it holds
    and the token after its closing one; -1 for other tokens.
    """

    words: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    fresh: list[bool] = field(default_factory=list)  # first of its line
    spans: list[tuple[int, int, str]] = field(default_factory=list)
    faults: list[tuple[int, str]] = field(default_factory=list)
    stop: list[int] = field(default_factory=list)
    after: list[int] = field(default_factory=list)


# languages whose spans alone are wanted
_SPANS = {
    "python": r"(?P<comment>#[^\n]*)|(?P<string>[rRbBuUfF]{0,2}(?:'''(?:\\.|[^\\])*?(?:'''|\Z)|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?))",
    "css": r"(?P<comment>/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)",
    "html": r"(?P<comment><!--(?:.|\n)*?(?:-->|\Z))",
}
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"?"
_CHAR = r"'(?:\\.|[^'\\\n])+'"
#: For each language the patterns of strings that one expression describes.
_STRINGS = {
    "rust": r"b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\(?:x..|u\{[^}\n]{0,12}\}|.)|[^'\\\n])'",
    "go": rf"`[^`]*`?|{_QUOTED}|{_CHAR}",
    "java": rf"\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|{_QUOTED}|{_CHAR}",
    "typescript": rf"{_QUOTED}|(?<!\w)'(?:\\.|[^'\\\n])*'?",
}
_FAMILY = {"tsx": "typescript", "javascript": "typescript"}
_COMPILED = {k: re.compile(v, re.DOTALL) for k, v in _SPANS.items()}
_TOKENS = {k: re.compile(rf"\s*(?:(?P<comment>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?r(?P<hashes>#*)\"(?!\Z))|(?P<string>{v})|(?P<template>`)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<other>\d[\w.]*|.))", re.DOTALL) for k, v in _STRINGS.items()}
_NESTING = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.DOTALL)
_SUBSTITUTION = re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|{_STRINGS['typescript']}|[`{{}}]", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n]){0,200}\]|[^/\\\[\n]){1,1000}/[a-z]*")
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ return typeof case in of delete void throw new".split())


def _block_end(text: str, at: int, nested: bool) -> tuple[int, bool]:
    """The end of a block comment that opens at ``at``, and whether it is closed."""
    if not nested:
        end = text.find("*/", at + 2)
        return (end + 2, True) if end >= 0 else (len(text), False)
    depth = 0
    for m in _NESTING.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end(), True
    return len(text), False


def _template_end(text: str, at: int) -> tuple[int, bool]:
    """The end of a template literal whose backtick is at ``at``; the stack holds literals and, within them, braces."""
    stack, pos = ["`"], at + 1
    while stack:
        m = (_TEMPLATE if stack[-1] == "`" else _SUBSTITUTION).search(text, pos)
        if not m:
            return len(text), False
        pos, x = m.end(), m.group()
        if x == "`":
            stack.pop() if stack[-1] == "`" else stack.append(x)
        elif x in ("${", "{"):
            stack.append("{")
        elif x == "}":
            stack.pop()
    return pos, True


def lex(text: str, language: str) -> Lexed:
    """Tokens and spans of a text in a language of braces."""
    family = _FAMILY.get(language, language)
    out, match = Lexed(), _TOKENS[family].match
    words, starts, ends, fresh, spans = out.words, out.starts, out.ends, out.fresh, out.spans
    pos, size, last_end = 0, len(text), 0
    while pos < size:
        m = match(text, pos)
        if not m:  # white space to the end
            break
        kind, begin, pos = m.lastgroup if m.lastgroup != "hashes" else "raw", m.start(m.lastgroup), m.end()
        begin = m.start(kind)
        word = text[begin:pos]
        if kind in ("comment", "block"):
            if kind == "block":
                pos, closed = _block_end(text, begin, family == "rust")
                if not closed:
                    out.faults.append((begin, "unclosed comment"))
            spans.append((begin, pos, "comment"))
            continue
        if kind == "raw" and family != "rust":  # an identifier that ends in r
            pos = begin + word.index('"')
            kind, word = "word", text[begin:pos].rstrip("#")
            pos = begin + len(word)
        elif kind == "raw":
            close = '"' + m.group("hashes")
            end = text.find(close, pos)
            pos = end + len(close) if end >= 0 else size
            if end < 0:
                out.faults.append((begin, "unclosed string"))
            kind = "string"
        elif kind == "template":
            pos, closed = _template_end(text, begin)
            if not closed:
                out.faults.append((begin, "unclosed string"))
            kind = "string"
        elif kind == "string" and (word[-1] not in "\"'`" or len(word.lstrip("b")) < 2):
            out.faults.append((begin, "unclosed string"))
        elif word == "/" and family == "typescript" and (not words or words[-1] in _BEFORE_REGEX):
            r = _REGEX.match(text, begin)
            if r:
                pos, kind, word = r.end(), "other", "0"
        if kind == "string":
            spans.append((begin, pos, "string"))
            word = '"'
        words.append(word)
        starts.append(begin)
        ends.append(pos)
        fresh.append(not last_end or text.find("\n", last_end, begin) >= 0)
        last_end = pos
    return out


_CLOSING = {"}": "{", ")": "(", "]": "["}


def pair(x: Lexed, text: str, restart: frozenset[str]) -> None:
    """Fills ``stop`` and ``after``.

    A brace that closes ends the brackets still open within it. If braces stay
    open at the end, all are paired once more, and a word of ``restart`` in the
    first column ends whatever is open there: one missing brace costs one
    declaration, not the rest of the file.
    """
    restarts = False
    while True:
        n = len(x.words)
        x.stop, x.after = [-1] * n, [-1] * n
        faults: list[tuple[int, str]] = []
        stack: list[int] = []
        braces = 0

        def close(i: int, after: int, why: str | None, faults=faults, stack=stack) -> None:
            o = stack.pop()
            x.stop[o], x.after[o] = i, after
            if why:
                faults.append((x.starts[o], why + x.words[o]))

        for i, w in enumerate(x.words):
            if w in ("{", "(", "["):
                stack.append(i)
                braces += w == "{"
            elif w in _CLOSING:
                want = _CLOSING[w]
                if want == "{" and braces:
                    while x.words[stack[-1]] != "{":
                        close(i, i, "unclosed ")
                    close(i, i + 1, None)
                    braces -= 1
                elif stack and x.words[stack[-1]] == want:
                    close(i, i + 1, None)
                else:
                    faults.append((x.starts[i], f"unexpected {w}"))
            elif restarts and stack and w in restart and x.fresh[i] and (x.starts[i] == 0 or text[x.starts[i] - 1] == "\n"):
                while stack:
                    close(i, i, "unclosed ")
                braces = 0
        if braces and not restarts:
            restarts = True
            continue
        while stack:
            close(n, n, "unclosed ")
        x.faults = sorted(x.faults + faults)
        return


def spans(text: str, language: str) -> list[tuple[int, int, str]]:
    """(start, end, comment or string) in characters, in order."""
    family = _FAMILY.get(language, language)
    if family in _TOKENS:
        return lex(text, language).spans
    scanner = _COMPILED.get(language)
    return [(m.start(), m.end(), m.lastgroup) for m in scanner.finditer(text)] if scanner else []
