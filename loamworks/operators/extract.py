"""Symbols and token spans of source texts; run once, when an index is built.

Python goes through ``ast`` where it parses, else by indentation. Rust, Go,
Java, TypeScript, JavaScript and the script of a single-file component are
tokens of the lexer, whose brackets are paired; declarations are known by
their words, and each body is gone through once, so time is linear in the
text and no symbol depends on how long it takes. What does not fit is a fault:
a bracket, string or comment that is not closed, or what Python's parser says.
Lines and columns of symbols count from 0, columns in bytes.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from . import lexer


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    name_at: int
    access: str
    test: bool = False
    children: list[Symbol] = field(default_factory=list)


def token_spans(text: str, language: str) -> list[tuple[int, int, str]]:
    """(start, end, comment or string) in characters, in order."""
    if language == "vue":
        inner = {"script": "typescript", "style": "css", "template": "html"}
        return sorted((a + s, b + s, k) for zone, s, e in zones(text) for a, b, k in lexer.spans(text[s:e], inner[zone]))
    return lexer.spans(text, language)


def blanked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with the spans blanked, line ends kept."""
    out, at = [], 0
    for s, e, _ in spans:
        out += [text[at:s], re.sub(r"[^\n]", " ", text[s:e])]
        at = e
    return "".join([*out, text[at:]])


# --- languages of braces

#: Words that begin a declaration in the first column, by which a file with a missing brace is taken up again.
RESTART = {
    "rust": frozenset("fn pub struct enum trait impl mod type const static union unsafe async extern use".split()),
    "go": frozenset("func type const var import package".split()),
    "java": frozenset("class interface enum record public abstract final sealed import package".split()),
    "typescript": frozenset("function class interface enum export import namespace type const abstract async declare".split()),
}
#: Words that may stand before a declaration; those with a list do so only before a word of it, others before any word.
_RUST_NEXT = frozenset('fn impl trait const async unsafe extern mod type static struct enum union "'.split())
_MODIFIERS = {
    "rust": {"pub": None, **dict.fromkeys(("default", "const", "async", "unsafe", "extern"), _RUST_NEXT)},
    "go": {},
    "java": dict.fromkeys("public private protected static final abstract sealed strictfp synchronized native default transient volatile".split()),
    "typescript": {**dict.fromkeys("export default declare abstract async public private protected static readonly override get set".split()), "const": frozenset(["enum"])},
}
#: Declarations that a word and a name make: the kind, and the contexts where it counts (all if None).
_TYPES = {
    "rust": {"fn": ("Function", None), "struct": ("Struct", None), "union": ("Struct", None), "enum": ("Enum", None), "trait": ("Interface", None), "type": ("Class", ("file", "module", "function")), "mod": ("Module", ("file", "module"))},
    "go": {},
    "java": {"class": ("Class", None), "interface": ("Interface", None), "enum": ("Enum", None), "record": ("Struct", None)},
    "typescript": {"function": ("Function", None), "class": ("Class", None), "interface": ("Interface", None), "enum": ("Enum", None), "type": ("Class", None), "namespace": ("Module", None), "module": ("Module", None)},
}
#: What must follow the name, where the word alone does not tell.
_FOLLOW = {("rust", "union"): ("{", "<", "where"), ("java", "record"): ("<", "("), ("typescript", "interface"): ("<", "extends", "{"), ("typescript", "type"): ("=", "<"), ("typescript", "namespace"): ("{", "."), ("typescript", "module"): ("{", ".")}
_NO_MEMBER = {"java": frozenset("return new throw else case assert package import instanceof yield".split()), "typescript": frozenset("if for while switch catch return function with await typeof new".split())}
_CONTEXT = {"Class": "type", "Struct": "type", "Interface": "type", "Enum": "type", "Impl": "type", "Module": "module"}
_GOES_ON = frozenset("= | & , ( < : ? + - * / % ^ . ! extends implements".split())
_CARRIES_ON = frozenset("= | & . ? : + * / % ^ > < extends implements { instanceof in as satisfies".split())


def _is_word(w: str) -> bool:
    return w[:1].isalpha() or w[:1] in "_$"


class _Scan:
    """The declarations of one text. Scopes wait on a list, not on the call stack, however deep they are."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.family = "typescript" if language in ("tsx", "javascript") else language
        self.x = lexer.lex(text, language)
        lexer.pair(self.x, text, RESTART[self.family])
        self.words = [*self.x.words, "", "", "", ""]  # four empty ones spare checks of the end
        self.types, self.modifiers = _TYPES[self.family], _MODIFIERS[self.family]

    def run(self) -> list[Symbol]:
        root: list[Symbol] = []
        todo = [(0, len(self.x.words), "file", None, False, root)]
        scopes = []
        while todo:
            lo, hi, context, parent, exported, out = todo.pop()
            scopes.append(out)
            self.scope(lo, hi, context, parent, exported, out, todo)
        if self.family == "rust":
            for out in reversed(scopes):  # inner scopes first
                out[:] = _with_types(out)
        return root

    def scope(self, lo: int, hi: int, context: str, parent: Symbol | None, exported: bool, out: list[Symbol], todo: list) -> None:
        """The declarations between two tokens, not those within others or in other brackets; their bodies go to ``todo``."""
        w, after, i, begin, head = self.words, self.x.after, lo, lo, None
        while i < hi:
            if after[i] >= 0:
                i, head = after[i], None
                if w[i - 1] == "}":
                    begin = i
                continue
            if w[i] in (";", "}"):
                i, head = i + 1, None
                begin = i
                continue
            if self.x.fresh[i] and self.family == "go":
                begin = i
            j = self.modifier(i)
            if j:
                head = i if head is None else head
                i = j
                continue
            if w[i] == "=" and self.family == "java" and context == "type":
                i = self.extent(i, hi, False, True)[0]
                begin, head = i, None
                continue
            found = self.declaration(i, context, parent, begin)
            if not found:
                i, head = i + 1, None
                continue
            kind, at, then, start = found
            start = min(x for x in (start, head) if x is not None) if self.family != "java" or kind != "Function" else start
            end, body = self.extent(then, hi, self.family == "go" or kind == "Constant" or (self.family == "typescript" and w[i] == "type"), kind == "Constant" or (self.family == "typescript" and w[i] == "type"), kind)
            if w[i] in ("const", "let", "var") and self.family == "typescript":
                arrow = self.function_value(at + 1, end)
                if arrow:
                    kind, body = "Function", arrow if arrow[1] > arrow[0] else None
            if kind == "Type group":
                todo.append((then + 1, self.x.stop[then], "types", None, False, out))
            else:
                self.add(kind, at, begin, start, end, body, parent, exported, out, todo)
            i, head = max(end, i + 1), None
            begin = i

    def add(self, kind: str, at: int, begin: int, start: int, end: int, body: tuple[int, int] | None, parent: Symbol | None, exported: bool, out: list[Symbol], todo: list) -> None:
        x, text = self.x, self.text
        if kind == "Impl":
            brace = body[0] - 1 if body else end
            name, name_at = text[x.ends[at] : x.starts[brace] if brace < len(x.starts) else len(text)].strip(), x.ends[at]
        else:
            name, name_at = (text[x.starts[at] : x.ends[at]] if self.words[at] != "#" else "#" + self.words[at + 1]), x.starts[at]
        head = text[x.starts[start] : name_at]
        first, last = x.starts[start], x.ends[min(max(end, at + 1), len(x.ends)) - 1]
        mark = {"Impl": "impl", "Interface": "trait"}.get(parent.kind) if parent and self.family == "rust" else None
        s = Symbol(name, kind, first, last, name_at, _access(self.family, name, head, exported, mark))
        if kind in ("Function", "Method") and is_test(self.family, name, text[x.starts[begin] : first] + head):
            s.test, s.kind = True, "Test" if kind == "Function" else kind
        out.append(s)
        if body:
            inner = _CONTEXT.get(kind, "function")
            todo.append((body[0], min(body[1], len(x.words)), inner, s, inner == "type" and (exported or bool(re.search(r"\bexport\b", head))), s.children))

    def modifier(self, i: int) -> int:
        """The token after a modifier with what belongs to it, 0 if there is none."""
        w, after = self.words, self.x.after
        if w[i] == "@" and self.family == "java" and w[i + 1] != "interface" and _is_word(w[i + 1]):
            i += 2
            while w[i] == "." and _is_word(w[i + 1]):
                i += 2
            return after[i] if w[i] == "(" else i
        if w[i] not in self.modifiers:
            return 0
        some = self.modifiers[w[i]]
        if w[i] == "pub" and w[i + 1] == "(":
            return after[i + 1]
        if self.family == "rust" and w[i] == "extern" and w[i + 1] == '"':
            return i + 2
        fits = w[i + 1] in some if some else _is_word(w[i + 1]) or w[i + 1] in ("*", "#", "<", "@")
        return i + 1 if fits else 0

    def declaration(self, i: int, context: str, parent: Symbol | None, begin: int) -> tuple[str, int, int, int] | None:
        """Kind, the token of the name, the one after what belongs to it, and the first one, of a declaration at a token."""
        w, after = self.words, self.x.after
        if not _is_word(w[i]) and w[i] != "#":
            return None
        before = w[i - 1] if i else ""
        if w[i] in self.types and before != ".":
            kind, where = self.types[w[i]]
            at = i + 1 + (w[i + 1] == "*")
            follow = _FOLLOW.get((self.family, w[i]))
            if _is_word(w[at]) and (where is None or context in where) and (not follow or w[at + 1] in follow):
                if self.family == "rust" and kind == "Function" and context == "type":
                    kind = "Method" if parent and parent.kind in ("Impl", "Interface") else kind
                return kind, at, at + 1, i - (self.family == "java" and before == "@")
        if self.family == "rust":
            if w[i] in ("const", "static") and context in ("file", "module", "type"):
                at = i + 1 + (w[i + 1] == "mut")
                if _is_word(w[at]) and w[at + 1] == ":":
                    return "Constant", at, at + 1, i
            if w[i] == "impl" and context in ("file", "module", "function"):
                return "Impl", i, i + 1, i
        elif self.family == "go":
            return self.go_declaration(i, context)
        elif self.family == "java":
            if context == "type" and w[i + 1] == "(" and w[i] not in _NO_MEMBER["java"]:
                typed = i > begin and (_is_word(before) and before not in _NO_MEMBER["java"] or before in (">", "]"))
                built = parent is not None and w[i] == parent.name and (w[after[i + 1]] in ("{", "throws"))
                if typed or built:
                    return "Function", i, after[i + 1], begin
        elif w[i] in ("const", "let", "var"):
            if context in ("file", "module") and _is_word(w[i + 1]) and (w[i + 2] in (":", "=", ";", ",", "") or self.x.fresh[i + 2]):
                return "Constant", i + 1, i + 2, i
        elif context == "type" and parent is not None and parent.kind == "Class":
            return self.member(i)
        return None

    def go_declaration(self, i: int, context: str) -> tuple[str, int, int, int] | None:
        w, x = self.words, self.x
        if not x.fresh[i] and i and w[i - 1] not in (";", "{"):
            return None
        if context == "types" or (w[i] == "type" and context in ("file", "function") and _is_word(w[i + 1])):
            at = i if context == "types" else i + 1
            then = at + 1
            if w[then] == "[" and x.starts[then] == x.ends[at] and _is_word(w[then + 1]) and x.stop[then] > then + 2:
                then = x.after[then]
            return {"struct": "Struct", "interface": "Interface"}.get(w[then], "Class"), at, then, i
        if context not in ("file", "function"):
            return None
        if w[i] == "type" and w[i + 1] == "(":
            return "Type group", i, i + 1, i
        if context == "file" and w[i] == "func":
            if _is_word(w[i + 1]):
                return "Function", i + 1, i + 2, i
            if w[i + 1] == "(" and _is_word(w[x.after[i + 1]]):
                return "Method", x.after[i + 1], x.after[i + 1] + 1, i
        if context == "file" and w[i] in ("const", "var"):
            group = w[i + 1] == "("
            if _is_word(w[i + 1 + group]):
                return "Constant", i + 1 + group, i + 1 if group else i + 2, i
        return None

    def member(self, i: int) -> tuple[str, int, int, int] | None:
        """A method of a class: a name, parameters, perhaps a type, and a body."""
        w, after = self.words, self.x.after
        j = i + 1 + (w[i] == "#")
        if w[i] in _NO_MEMBER["typescript"] or (i and w[i - 1] in (".", "=", ">")):
            return None
        if w[j] == "<":
            while w[j] not in ("(", ";", "", "{"):
                j += 1
        if w[j] != "(" or after[j] < 0:
            return None
        j = after[j]
        return ("Method", i, j, i) if w[j] == "{" or (w[j] == ":" and self.extent(j, len(self.x.words), False, False, "Method")[1]) else None

    def extent(self, i: int, hi: int, by_line: bool, through: bool, kind: str = "") -> tuple[int, tuple[int, int] | None]:
        """The token after a declaration whose rest begins at ``i``, and its body. ``by_line``: a line may end it; ``through``: braces are values."""
        w, x, first = self.words, self.x, i
        group = self.family == "go" and kind in ("Constant", "Type group") and w[i] == "("
        while i < hi:
            if x.after[i] >= 0:
                literal = through or (self.family == "go" and kind in ("Function", "Method") and w[i - 1] in ("interface", "struct"))
                literal = literal or (self.family == "typescript" and w[i - 1] in (":", "|", "&", "<", ","))
                if w[i] == "{" and not literal:
                    return min(x.after[i], hi), (i + 1, x.stop[i])
                if group:
                    return min(x.after[i], hi), None
                i = x.after[i]
            elif w[i] == ";":
                return i + 1, None
            elif w[i] in ("}", ")", "]"):
                return i, None
            elif by_line and i > first and x.fresh[i] and w[i] not in _CARRIES_ON and w[i - 1] not in _GOES_ON and not (w[i - 1] == ">" and w[i - 2] == "="):
                return i, None
            else:
                i += 1
        return hi, None

    def function_value(self, i: int, end: int) -> tuple[int, int] | None:
        """The body of a function or arrow that a name is set to; an empty one where an expression is the body."""
        w, x = self.words, self.x
        while i < end and w[i] != "=":
            i = x.after[i] if x.after[i] >= 0 else i + 1
        i += 1
        if w[i] == "async":
            i += 1
        if w[i] == "function":
            while i < end and w[i] != "{":
                i = x.after[i] if x.after[i] >= 0 else i + 1
            return (i + 1, x.stop[i]) if i < end else None
        if w[i] == "<":
            while i < end and w[i] != "(":
                i += 1
        if w[i] == "(" and i < end:
            i = x.after[i]
            if w[i] == ":":
                while i < end and not (w[i] == "=" and w[i + 1] == ">"):
                    i = x.after[i] if x.after[i] >= 0 else i + 1
        elif _is_word(w[i]):
            i += 1
        if i >= end or w[i] != "=" or w[i + 1] != ">":
            return None
        return (i + 3, x.stop[i + 2]) if w[i + 2] == "{" and i + 2 < end else (0, 0)


def _access(language: str, name: str, head: str, exported: bool, parent: str | None) -> str:
    if language == "rust":
        m = re.match(r"pub(?:\s*\(([^)]*)\))?", head.strip())
        if parent == "impl":
            return "Public"
        if not m:
            return "Private"
        return {"crate": "Package", "super": "Protected"}.get((m.group(1) or "").strip(), "Public")
    if language == "go":
        return "Private" if name.startswith("_") else "Public" if name[:1].isascii() and name[:1].isupper() else "Package"
    if language == "java":
        return next((k.capitalize() for k in re.findall(r"\b(public|protected|private)\b", head)), "Package")
    if exported or re.search(r"\bexport\b", head):
        return "Public"
    return "Private" if name.startswith(("_", "#")) else "Package"


def python_access(name: str) -> str:
    if name.startswith("__"):
        return "Public" if name.endswith("__") else "Private"
    return "Protected" if name.startswith("_") else "Public"


def is_test(language: str, name: str, before: str) -> bool:
    """Whether a function is a test, by its name and the text of its attributes, annotations or decorators."""
    if language == "rust":
        return any(x in before for x in ("#[test]", "#[tokio::test", "#[rstest]", "#[test_case")) or name.startswith("test_") or name.endswith("_test")
    if language == "python":
        return any(x in before for x in ("@pytest", "unittest", "@given")) or name.startswith("test_")
    if language == "go":
        return name.startswith("Test")
    if language == "java":
        return any(x in before for x in ("@Test", "@org.junit.Test", "@ParameterizedTest")) or name == "test" or name.startswith("test_") or bool(re.match(r"test[A-Z]", name))
    return name.startswith(("test_", "it_")) or name.endswith("_test") or name in ("test", "it", "describe")


def impl_type(header: str) -> str:
    """The bare type name of an impl header: generics, trait and path prefix stripped."""
    h = header.strip()
    while h.startswith("<"):
        depth = 0
        for i, c in enumerate(h):
            depth += (c == "<") - (c == ">" and h[i - 1] != "-")
            if not depth:
                h = h[i + 1 :].strip()
                break
        else:
            break
    h = re.split(r"\bwhere\b", h)[0]
    plain, depth = "", 0
    for i, c in enumerate(h):
        if c == "<":
            depth += 1
        elif c == ">" and h[i - 1] != "-":
            depth -= 1
        elif not depth:
            plain += c
    plain = re.split(r"\bfor\b", plain)[-1]
    return re.sub(r"^[&\s]*(?:mut\s+|dyn\s+)?", "", plain.strip()).split("::")[-1].strip() or h.strip()


def _with_types(symbols: list[Symbol]) -> list[Symbol]:
    """Methods of impl blocks go to the type of the same scope; blocks without one stay, those of one name together."""
    held = {s.name: s for s in symbols if s.kind in ("Struct", "Enum", "Interface", "Class")}
    out = []
    for s in symbols:
        if s.kind != "Impl":
            out.append(s)
            continue
        name = impl_type(s.name)
        if name not in held:
            s.name, held[name] = name, s
            out.append(s)
            continue
        held[name].children += s.children
        if held[name].kind == "Impl":
            held[name].end = max(held[name].end, s.end)
    return out


# --- Python


def _python(text: str) -> tuple[list[Symbol], list[tuple[int, str]]]:
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    lines = text.split("\n")

    def place(row: int, byte_col: int) -> int:
        return starts[row - 1] + len(lines[row - 1].encode()[:byte_col].decode("utf-8", "ignore"))

    def walk(body: list[ast.stmt], in_class: bool) -> Iterator[Symbol]:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                start = place(first, node.col_offset) - (1 if first < node.lineno and text[place(first, node.col_offset) - 1 : place(first, node.col_offset)] == "@" else 0)
                word = "class" if isinstance(node, ast.ClassDef) else "def"
                name_at = text.index(node.name, text.index(word, place(node.lineno, node.col_offset)) + len(word))
                kind = "Class" if word == "class" else "Function"
                s = Symbol(node.name, kind, start, place(node.end_lineno, node.end_col_offset), name_at, python_access(node.name))
                if kind == "Function" and is_test("python", node.name, text[start:name_at]):
                    s.kind, s.test = "Test", True
                s.children = list(walk(node.body, kind == "Class"))
                yield s
            elif isinstance(node, (ast.If, ast.Try, ast.With)):
                yield from walk([*node.body, *getattr(node, "orelse", []), *getattr(node, "finalbody", [])], in_class)

    try:
        return list(walk(ast.parse(text).body, False)), []
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        line = min(max(getattr(e, "lineno", None) or 1, 1), len(lines))
        return _indented(text), [(min(starts[line - 1] + max((getattr(e, "offset", None) or 1) - 1, 0), len(text)), getattr(e, "msg", None) or str(e))]


def _attributes(text: str, at: int) -> str:
    """Lines of decorators right above a place."""
    start = text.rfind("\n", 0, at) + 1
    out, end = [text[start:at]], start - 1
    while end > 0:
        start = text.rfind("\n", 0, end) + 1
        if not re.match(r"\s*@[^{};]*$", text[start:end]):
            break
        out.append(text[start:end])
        end = start - 1
    return "\n".join(out)


def _indented(text: str) -> list[Symbol]:
    """Functions and classes by indentation, for texts that do not parse."""
    code = blanked(text, token_spans(text, "python"))
    root: list[Symbol] = []
    open_: list[tuple[int, Symbol]] = []
    last_end = 0
    for m in re.finditer(r"^([ \t]*)(\S[^\n]*)", code, re.MULTILINE):
        indent = len(m.group(1).expandtabs(8))
        while open_ and open_[-1][0] >= indent:
            open_.pop()[1].end = last_end
        d = re.match(r"(?:async\s+)?(def|class)\s+(\w+)", m.group(2))
        if d:
            kind = "Class" if d.group(1) == "class" else "Function"
            s = Symbol(d.group(2), kind, m.start(2), m.end(), m.start(2) + d.start(2), python_access(d.group(2)))
            if kind == "Function" and is_test("python", s.name, _attributes(text, m.start(2))):
                s.kind, s.test = "Test", True
            (open_[-1][1].children if open_ else root).append(s)
            open_.append((indent, s))
        last_end = m.end()
    for _, s in open_:
        s.end = last_end
    return root


# --- single-file components


def zones(text: str) -> list[tuple[str, int, int]]:
    """(zone, start, end) of the first script, template and style, in order of the text."""
    out = []
    for zone in ("script", "template", "style"):
        m = re.search(rf"<{zone}(?=[\s>/])[^>]*>", text)
        if not m or m.group().endswith("/>"):
            continue
        if zone == "template":  # nested templates
            depth, end = 1, len(text)
            for t in re.finditer(r"<(/?)template(?=[\s>/])[^>]*?(/?)>", text[m.end() :]):
                depth += -1 if t.group(1) else 0 if t.group(2) else 1
                if not depth:
                    end = m.end() + t.start()
                    break
        else:
            end = text.find(f"</{zone}", m.end())
            end = len(text) if end < 0 else end
        out.append((zone, m.end(), end))
    return sorted(out, key=lambda z: z[1])


_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def template_elements(text: str, lo: int, hi: int) -> list[Symbol]:
    """Components of a template at any depth, and plain elements in its first three levels; repeated names are numbered."""
    code = blanked(text[lo:hi], [x for x in token_spans(text[lo:hi], "html")])
    stack: list[tuple[str, Symbol | None]] = []
    out: list[Symbol] = []
    seen: dict[str, int] = {}
    for m in re.finditer(r"<(/?)([A-Za-z][\w.-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>", code):
        close, tag, rest = m.groups()
        if close:
            while stack:
                name, s = stack.pop()
                if s:
                    s.end = lo + m.end()
                if name == tag:
                    break
            continue
        component = tag[0].isupper() or "-" in tag
        s = None
        if component or len(stack) < 3:
            seen[tag] = seen.get(tag, 0) + 1
            name = tag if seen[tag] == 1 else f"{tag}[{seen[tag]}]"
            s = Symbol(name, "Component" if component else "HtmlElement", lo + m.start(), lo + m.end(), lo + m.start(2), "Public")
            out.append(s)
        if not rest.endswith("/") and tag.lower() not in _VOID:
            stack.append((tag, s))
    return out


def style_rules(text: str, lo: int, hi: int) -> list[Symbol]:
    """Selectors and at-rules of a style; repeated ones are numbered."""
    code = blanked(text[lo:hi], token_spans(text[lo:hi], "css"))
    closing: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer("[{}]", code):
        if m.group() == "{":
            opened.append(m.start())
        elif opened:
            closing[opened.pop()] = m.start()
    closing.update(dict.fromkeys(opened, len(code) - 1))
    out: list[Symbol] = []
    seen: dict[str, int] = {}
    for m in re.finditer(r"(?:^|(?<=[{};]))\s*([^{};]+?)\s*(?=\{)|(?:^|(?<=[{};]))\s*(@[\w-]+[^{};]*);", code):
        at_rule = (m.group(1) or m.group(2)).startswith("@")
        whole = m.group(1) or m.group(2)
        begin = m.start(1) if m.group(1) else m.start(2)
        end = closing.get(m.end(), m.end()) + 1 if m.group(1) else m.end()
        for name in [whole.split()[0]] if at_rule else re.findall(r"[.#][\w-]+", whole) or [whole]:
            seen[name] = seen.get(name, 0) + 1
            label = name if seen[name] == 1 else f"{name}[{seen[name]}]"
            out.append(Symbol(label, "CssAtRule" if at_rule else "CssSelector", lo + begin, lo + end, lo + begin, "Public"))
    return out


def jsx_children(text: str, s: Symbol) -> list[Symbol]:
    """Elements that a function returns, as children named return.Tag."""
    out, seen = [], {}
    for r in re.finditer(r"\breturn\s*\(?\s*(?=<[A-Za-z])|=>\s*\(?\s*(?=<[A-Za-z])", text[s.start : s.end]):
        begin = s.start + r.end()
        for m in re.finditer(r"<([A-Za-z][\w.]*)(?=[\s/>])", text[begin : s.end]):
            seen[m.group(1)] = seen.get(m.group(1), 0) + 1
            tag = m.group(1) if seen[m.group(1)] == 1 else f"{m.group(1)}[{seen[m.group(1)]}]"
            out.append(Symbol(f"return.{tag}", "Component" if m.group(1)[0].isupper() else "HtmlElement", begin + m.start(), begin + m.end(), begin + m.start(1), "Public"))
        break
    return out


def parse(text: str, language: str) -> tuple[list[Symbol], list[tuple[int, str]]]:
    """The tree of symbols of a text, and its faults: places in characters and what is wrong there."""
    if language == "python":
        return _python(text)
    if language == "vue":
        out: list[Symbol] = []
        faults: list[tuple[int, str]] = []
        for zone, lo, hi in zones(text):
            if zone == "script":
                script, faults = parse(re.sub(r"[^\n]", " ", text[:lo]) + text[lo:hi], "typescript")
                out = script + out
            else:
                inner = template_elements(text, lo, hi) if zone == "template" else style_rules(text, lo, hi)
                if inner:
                    out.append(Symbol(zone, "Zone", lo, hi, lo, "Public", children=inner))
        return out, faults
    if language not in ("rust", "go", "java", "typescript", "tsx", "javascript"):
        return [], []
    scan = _Scan(text, language)
    symbols = scan.run()
    if language in ("tsx", "javascript"):
        todo = list(symbols)
        while todo:
            s = todo.pop()
            todo += s.children
            if s.kind in ("Function", "Method", "Test"):
                s.children += jsx_children(text, s)
    return symbols, scan.x.faults


def extract(text: str, language: str) -> list[Symbol]:
    """The tree of symbols of a text."""
    return parse(text, language)[0]


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def fault_rows(text: str, language: str) -> Iterator[tuple[int, int, str]]:
    """Line and column (both from 1, in characters) and what is wrong there."""
    starts = _line_starts(text)
    for at, what in parse(text, language)[1]:
        row = bisect.bisect_right(starts, at) - 1
        yield row + 1, at - starts[row] + 1, what


def flattened(text: str, language: str) -> Iterator[tuple]:
    """Rows of SYMBOLS without the path, in preorder; duplicates in a scope are named name, name#2, name#3."""
    symbols = extract(text, language)
    starts = _line_starts(text)
    if text.isascii():
        byte = lambda at: at
    else:  # bytes before each character
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        size = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
        before = np.concatenate([[0], np.cumsum(size)])
        byte = lambda at: int(before[at])
    row = lambda at: bisect.bisect_right(starts, at) - 1
    stack = [_labelled(symbols, None, "", 0)]
    number = 0
    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
            continue
        s, parent, depth, ordinal, path = item
        first, last = row(s.start), row(max(s.start, s.end - 1))
        column = byte(s.name_at) - byte(starts[row(s.name_at)])
        yield (number, parent, depth, ordinal, s.name, path, s.kind, s.access, s.test, byte(s.start), byte(s.end), first, last, column)
        stack.append(_labelled(s.children, number, path, depth + 1))
        number += 1


def _labelled(some: list[Symbol], parent: int | None, prefix: str, depth: int) -> Iterator[tuple]:
    """Symbols of a scope in order, with their semantic paths."""
    seen: dict[str, int] = {}
    for ordinal, s in enumerate(sorted(some, key=lambda x: x.start)):
        seen[s.name] = seen.get(s.name, 0) + 1
        label = s.name if seen[s.name] == 1 else f"{s.name}#{seen[s.name]}"
        label = label.replace(".", "\\.") if s.kind.startswith("Css") else label
        yield s, parent, depth, ordinal, f"{prefix}.{label}" if prefix else label


def token_rows(text: str, language: str) -> Iterator[tuple]:
    """Rows of TOKENS without the path: 1-based lines, 1-based columns in characters, the end column exclusive."""
    line, at = 1, 0
    for s, e, kind in token_spans(text, language):
        line += text.count("\n", at, s)
        first_col = s - (text.rfind("\n", 0, s) + 1) + 1
        last = line + text.count("\n", s, e)
        last_col = e - (text.rfind("\n", 0, e) + 1) + 1
        yield line, first_col, last, last_col, kind
        line, at = last, e
