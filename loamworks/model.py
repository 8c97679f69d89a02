"""Schemas, vocabularies and errors of the engine."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

FILES = "path string, ext string, language string, size long, mtime timestamp, content binary, text string, version_hash string"
MATCHES = (
    "path string, line long, `column` long, content string, context_before array<string>, context_after array<string>, enclosing_semantic_path string, version_hash string, is_definition boolean, known boolean"
)
SYMBOLS = (
    "path string, symbol_id int, parent_id int, depth int, ordinal int, name string, semantic_path string, kind string, access_level string, is_test boolean, start_byte int, end_byte int, start_line int, end_line int, name_column int"
)
TOKENS = "path string, start_line int, start_col int, end_line int, end_col int, node_type string"
FAULTS = "path string, line int, column int, fault string"
EDGES = "src_path string, src_symbol string, dst_path string, dst_symbol string, call_sites array<int>, confidence string"
ZONES = "path string, zone string, start_byte int, end_byte int, start_line int, end_line int"
IMPACT = "semantic_path string, path string, line int, snippet string, direction string, depth int, confidence string"



def names(schema: str) -> list[str]:
    """Column names of one of these schemas, whose types have no blanks."""
    return [c.split()[0].strip("`") for c in schema.split(",") if " " in c.strip()]


# Fixed vocabularies.
SYMBOL_KINDS = ("Test", "Function", "Method", "Class", "Struct", "Impl", "Constant", "Interface", "Enum", "Module", "Zone", "Component", "HtmlElement", "CssSelector", "CssAtRule")
ACCESS_LEVELS = ("Public", "Protected", "Package", "Private")
DETAILS = ("structure", "files", "symbols")
READ_DETAILS = ("source_only", "compact", "symbols", "full")
FILTER_MODES = ("code_only", "comments_only", "all")
SCOPES = ("callers", "references", "overview")
BATCH_LIMIT = 10


class EngineError(Exception):
    """Base of all errors; ``code`` and ``hint`` are stable, ``kind`` is client, access or internal."""

    code = "INTERNAL_ERROR"
    kind = "internal"
    default_hint: str | None = None

    def __init__(self, message: str, hint: str | None = None, **details):
        super().__init__(message)
        self.hint = hint if hint is not None else self.default_hint
        self.details = details

    def as_row(self) -> tuple[str, str, str, str | None]:
        """(code, message, details as JSON, hint)"""
        return self.code, str(self), json.dumps(self.details, sort_keys=True), self.hint


class InvalidParams(EngineError):
    code, kind = "INVALID_PARAMS", "client"


class FileNotFound(EngineError):
    code, kind = "FILE_NOT_FOUND", "client"
    default_hint = "Check that the path is relative to the root of the corpus; search finds paths, explore lists them."


class BinaryFile(EngineError):
    code, kind = "BINARY_FILE", "client"
    default_hint = "The file is not UTF-8 text."


class SymbolNotFound(EngineError):
    code, kind = "SYMBOL_NOT_FOUND", "client"

    def __init__(self, semantic_path: str, did_you_mean: list[str] | None = None):
        similar = did_you_mean or []
        base = semantic_path.rsplit("::", 1)[-1].split(".")[0]
        hint = f"Did you mean: {', '.join(similar)}?" if similar else f"Not in that file. search(mode='symbol', query='{base}') looks in all files."
        if "::" not in semantic_path:
            hint += " A semantic path has '::' between file and symbol, and '.' between nested symbols."
        elif semantic_path.count("::") > 1:
            hint += " Only one '::' is allowed, between file and symbol; nested symbols take '.'."
        super().__init__(f"symbol not found: {semantic_path}", hint, did_you_mean=similar)


class AccessDenied(EngineError):
    code, kind = "ACCESS_DENIED", "access"
    default_hint = "The access policy hides this path; see the ignore rules of the corpus."


class PathTraversal(AccessDenied):
    code = "PATH_TRAVERSAL"
    default_hint = "Use a path relative to the root, without '..'."


class InvalidSemanticPath(EngineError):
    code, kind = "INVALID_SEMANTIC_PATH", "client"
    default_hint = "Write file::symbol, with '.' between nested symbols; read returns whole files."


class UnsupportedLanguage(EngineError):
    code, kind = "UNSUPPORTED_LANGUAGE", "client"
    default_hint = "No symbols for this kind of file; read returns its text."


class ParseError(EngineError):
    code = "PARSE_ERROR"


@dataclass
class Config:
    """Settings of a corpus; read from JSON by ``sources.trees.read_config``. Unlike constants they take effect."""

    max_results: int = 50
    max_tokens: int = 16_000
    idle_timeout_minutes: int = 15
    additional_deny: list[str] = field(default_factory=list)
    allow_override: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)

    def __post_init__(self):
        for name in ("max_results", "max_tokens", "idle_timeout_minutes"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise InvalidParams(f"{name} must be a positive integer")
