"""Definition patterns, call keywords and kinds of lines: regular expressions made on the driver, applied as native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import literal_regex

# Fixed lists.
DEFINITION_KEYWORDS = ("fn", "function", "def", "struct", "class", "interface", "type", "enum", "trait", "const", "static", "var", "let", "mod", "impl")
_JS_KEYWORDS = "if else for while switch case break continue return function class interface type const let var new this super static async await import export from as try catch finally throw yield typeof instanceof in".split()
CALL_KEYWORDS = {
    "rust": "if else for while loop match return break continue let mut const static struct enum trait impl fn type where use mod pub crate super self Self move ref unsafe async await".split(),
    "go": "if else for range switch case default return break continue go defer goto fallthrough select chan make new func type var const struct interface import package".split(),
    "typescript": _JS_KEYWORDS,
    "javascript": _JS_KEYWORDS,
    "python": "if elif else for while def class return break continue yield async await import from as try except finally raise with lambda global nonlocal assert pass".split(),
    "java": "if else for while switch case break continue return try catch finally throw new class interface extends implements instanceof import package void int long float double boolean char byte short final static synchronized native this super assert".split(),
    "vue": _JS_KEYWORDS + "defineProps defineEmits defineExpose defineModel withDefaults ref reactive computed watch watchEffect onMounted onUnmounted provide inject toRef toRefs useSlots useAttrs useTemplateRef template script style setup".split(),
}
OTHER_KEYWORDS = "if else for while return break continue".split()
CALL = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
KIND_ALIASES = {
    "function": ("function", "method", "fn"),
    "method": ("function", "method", "fn"),
    "fn": ("function", "method", "fn"),
    "class": ("class", "struct", "interface"),
    "struct": ("struct",),
    "interface": ("interface", "trait"),
    "trait": ("interface", "trait"),
    "enum": ("enum",),
    "type": ("class", "struct", "interface", "trait", "enum"),
    "constant": ("constant", "const", "static", "let"),
    "const": ("constant", "const", "static", "let"),
    "static": ("constant", "const", "static", "let"),
    "let": ("constant", "const", "static", "let"),
    "module": ("module", "mod", "namespace"),
    "mod": ("module", "mod", "namespace"),
    "namespace": ("module", "mod", "namespace"),
    "impl": ("impl",),
}
PUBLIC_KINDS = {"Function": "function", "Method": "function", "Test": "function", "Class": "class", "Struct": "struct", "Impl": "impl", "Constant": "constant", "Interface": "interface", "Enum": "enum", "Module": "module"}
PROTOCOL_KINDS = {5: "class", 6: "method", 11: "interface", 12: "function"}

@dataclass(frozen=True)
class Form:
    """How a language declares a name: words that stand before it (none: ``before`` alone), and what has to follow it. Modifiers before the words need no mention, as a pattern is searched for anywhere in a line."""

    words: str
    before: str = ""
    after: str = r"\b"
    callable: bool = False

    def pattern(self, name: str) -> str:
        words = rf"\b(?:{'|'.join(self.words.split())})\s+" if self.words else ""
        return words + self.before + name + self.after


# Java's methods have no word of their own: a line of type and modifier words, none of them a statement's, then the name and a bracket.
_STATEMENTS = "return throw new else assert case yield"
_JAVA_HEAD = rf"^\s*(?!(?:{'|'.join(_STATEMENTS.split())})\b)(?:@\w+(?:\([^)]*\))?\s+)*(?:[\w.$<>,?&\[\]]+\s+)*"
_SCRIPT = (
    Form("function", callable=True),
    Form("class interface type enum"),
    Form("const let var", after=r"\s*[=:]", callable=True),
)
FORMS = {
    "rust": (Form("fn", callable=True), Form("struct enum trait type mod const static macro_rules!")),
    "typescript": _SCRIPT,
    "vue": _SCRIPT,
    "python": (Form("def", callable=True), Form("class"), Form("", before="^", after=r"\s*[=:]")),
    "go": (Form("func", before=r"(?:\([^)]*\)\s*)?", callable=True), Form("type", after=r"[\s\[]"), Form("const var")),
    "java": (Form("class interface enum"), Form("record", after=r"\s*[<(]"), Form("", before=_JAVA_HEAD, after=r"\s*\(", callable=True)),
}
_LANGUAGE_OF = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "vue": "vue", "py": "python", "go": "go", "java": "java"}
# The words before a name that make a definition of it in a file of any other kind.
_ANY_CALLABLE = Form("fn def function class struct type interface")


def definition_patterns(ext: str, name: str, callable_only: bool = False) -> list[str]:
    """Patterns of lines that define a name, by file extension; of a file of another kind any mention, or for callables any usual word before it."""
    n = literal_regex(name)
    forms = FORMS.get(_LANGUAGE_OF.get(ext, ""))
    if forms is None:
        return [_ANY_CALLABLE.pattern(n) if callable_only else rf"\b{n}\b"]
    return [f.pattern(n) for f in forms if f.callable or not callable_only]


def any_definition(ext: Column, name: str, callable_only: bool = False) -> Column:
    """Whether a line, column ``content``, of a file with this extension defines the name."""
    line = F.col("content")
    by_pattern: dict[str, list[str]] = {}
    for e in _LANGUAGE_OF:
        by_pattern.setdefault("|".join(definition_patterns(e, name, callable_only)), []).append(e)
    out = line.rlike(definition_patterns("", name, callable_only)[0])
    for pattern, extensions in by_pattern.items():
        out = F.when(ext.isin(*extensions), line.rlike(pattern)).otherwise(out)
    return out


def keywords(language: str) -> list[str]:
    return CALL_KEYWORDS.get(language, OTHER_KEYWORDS)


def call_names(body: Column) -> Column:
    """Names called in a text, each once, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(CALL), F.lit(1)))


# Kinds of lines and the words that tell them, in the order in which they are tried.
LINE_KINDS = (("function", "fn func function def"), ("struct", "struct"), ("class", "class type"), ("enum", "enum"), ("interface", "trait interface"), ("constant", "const static var let"), ("module", "mod module"), ("impl", "impl"))


def kind_of_line(line: Column) -> Column:
    """A guess at what a line defines, by its keywords."""
    low = F.lower(line)
    out = None
    for kind, words in LINE_KINDS:
        hit = low.rlike("(?:" + "|".join(words.split()) + ") ")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def name_of_line(line: Column) -> Column:
    """The identifier after the first definition keyword, else the identifier that the line begins with, else its first word."""
    t = F.trim(line)
    words = "|".join(DEFINITION_KEYWORDS)
    defined = F.regexp_extract(t, rf"(?:^|\s)(?:{words})\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    begins = F.regexp_extract(t, r"^([A-Za-z_][A-Za-z0-9_]*)", 1)
    return F.coalesce(F.nullif(defined, F.lit("")), F.nullif(begins, F.lit("")), F.regexp_extract(t, r"^(\S*)", 1))


def public_kind(kind: Column) -> Column:
    """The vocabulary of kind filters for a symbol's kind."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PUBLIC_KINDS.items() for x in p]), kind), F.lit("unknown"))


def protocol_kind(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PROTOCOL_KINDS.items() for x in p]), code), F.lit("symbol"))


def relevance(query: str, name: Column) -> Column:
    """3 for the name itself, 2 if it begins with the query, 1 if it contains it, else 0."""
    q = F.lit(query)
    return F.when(name == q, 3).when(F.startswith(name, q), 2).when(F.contains(name, q), 1).otherwise(0)
