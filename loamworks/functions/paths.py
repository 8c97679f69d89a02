"""Path functions: extensions, languages, globs, access policy and semantic paths, all native expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import InvalidParams

# Fixed lists.
EXCLUDED_DIRS = (".git", "node_modules", "target", "vendor", ".idea", ".vscode", "__pycache__", ".qlty", "dist", "build", ".next", ".turbo", ".gradle", "coverage", ".nyc_output", ".mypy_cache")
BINARY_EXTENSIONS = tuple(
    "png jpg jpeg gif bmp ico webp svg tiff tif mp3 mp4 wav avi mov mkv flv wmv webm ogg zip tar gz bz2 xz 7z rar tgz zst pdf doc docx xls xlsx ppt pptx odt ods odp exe dll so dylib o a lib obj wasm class jar pyc pyo woff woff2 ttf otf eot sqlite db mdb node bin dat idx pack".split()
)
SOURCE_EXTENSIONS = ("rs", "go", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "pyi", "vue", "java")
COUNTED_EXTENSIONS = tuple("rs ts tsx js jsx py go java kt swift cpp c h cs rb php scala clj ex exs erl hs ml m nim pl pm r sh lua dart fs fsi fsx zig v svelte vue".split())
COUNT_SKIPPED_DIRS = ("node_modules", "target", "vendor", ".git", "dist", "build", "out", ".next", ".venv", "venv", "env")
SYMBOL_LANGUAGES = {"go": "go", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "vue": "vue", "java": "java"}
FILE_LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "go": "go", "py": "python", "java": "java", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "mdx": "markdown", "sh": "shell", "bash": "shell"}
MANIFESTS = (
    "Cargo.toml", "package.json", "go.mod", "pyproject.toml", "setup.py", "requirements.txt", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts",
    "Makefile", "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "tsconfig.json", "jsconfig.json", ".env.example", "Gemfile", "Pipfile", "flake.nix", "CMakeLists.txt",
)
HARD_DENY = (".git/objects/", ".git/HEAD", ".git/refs/", ".git/index", ".git/config", ".git/hooks/")
HARD_DENY_EXTENSIONS = ("pem", "key", "pfx", "p12")
GIT_ALLOWED = (".gitignore", ".github/workflows/", ".github/actions/", ".gitattributes")
DEFAULT_DENY = (".env", ".env.*", "secrets/", "node_modules/", "vendor/", "__pycache__/", "dist/", "build/")
STDLIB_ROOTS = ("std", "core", "alloc")
GLOBS_BY_LANGUAGE = {"rust": "**/*.rs", "typescript": "**/*.{ts,tsx}", "tsx": "**/*.{ts,tsx}", "javascript": "**/*.{js,jsx}", "python": "**/*.py", "go": "**/*.go", "vue": "**/*.{vue,ts,tsx,js,jsx,mjs,cjs}", "java": "**/*.java"}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    """The directory of a path, empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def extension(path: Column) -> Column:
    """The extension without its dot, null if there is none; a leading dot alone makes none."""
    e = F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)
    return F.when(e != "", e)


def without_dot_slash(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def relative_to(path: Column, root: str) -> Column:
    """A path with the root's prefix stripped; others as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key)


def language_of(path: Column) -> Column:
    """Language for display; text if unknown."""
    ext = extension(path)
    named = F.when((basename(path) == "Dockerfile") & (ext.isNull() | (ext == "dockerfile")), F.lit("dockerfile"))
    return F.coalesce(named, F.when(ext.isNotNull(), _mapped(ext, FILE_LANGUAGES)), F.lit("text"))


def symbol_language_of(path: Column) -> Column:
    """Language whose symbols can be extracted, else null."""
    ext = extension(path)
    return F.when(ext.isNotNull(), _mapped(ext, SYMBOL_LANGUAGES))


def is_binary(path: Column) -> Column:
    return F.coalesce(F.lower(extension(path)).isin(*BINARY_EXTENSIONS), F.lit(False))


def in_excluded_dir(path: Column, names: tuple[str, ...] = EXCLUDED_DIRS) -> Column:
    """Whether a directory of the path, at any depth, is one of ``names``."""
    return path.rlike("(^|/)(" + "|".join(map(re.escape, names)) + ")/")


def is_manifest(path: Column) -> Column:
    return basename(path).isin(*MANIFESTS)


def is_source(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*SOURCE_EXTENSIONS), F.lit(False))


def is_workspace_source(path: Column) -> Column:
    """A source file of the corpus itself: no absolute path, dependency directory or standard library root."""
    outside = path.rlike(r"^[/\\]|^.:") | path.rlike(r"(node_modules|vendor)[/\\]")
    library = path.rlike(r"^(std|core|alloc)(/|$)|^library[/\\](std|core|alloc)[/\\]")
    return ~outside & ~library & is_source(path)


def glob_regex(glob: str) -> str:
    """The regular expression of a glob. ``*`` crosses ``/``, ``**/`` may be empty, braces and classes are allowed."""
    out, i, depth_ = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
            continue
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise InvalidParams(f"unclosed class in glob {glob!r}")
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out += "(?:"
            depth_ += 1
        elif c == "}" and depth_:
            out += ")"
            depth_ -= 1
        elif c == "," and depth_:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    if depth_:
        raise InvalidParams(f"unclosed brace in glob {glob!r}")
    return "^(?:" + out + ")$"


def matches_glob(path: Column, glob: str | None) -> Column:
    """Include glob; the glob for everything costs nothing."""
    if glob in (None, "", "**/*", "**"):
        return F.lit(True)
    return path.rlike(glob_regex(glob))


def matches_none(path: Column, globs: str | list[str] | None) -> Column:
    """True where none of the exclude globs matches."""
    some = [globs] if isinstance(globs, str) else list(globs or [])
    some = [g for g in some if g]
    return ~path.rlike("|".join(glob_regex(g) for g in some)) if some else F.lit(True)


def ignore_regex(rules: list[str], folder: str = "") -> list[tuple[str, bool]]:
    """(regular expression, whether it ignores) of lines in the ignore-file dialect that hold below a folder; the last that matches decides."""
    out, top = [], "^" + re.escape(folder + "/") if folder else "^"
    for raw in rules:
        rule = raw.rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        rule = rule[1:] if keep else rule
        only_dir, rule = rule.endswith("/"), rule.rstrip("/")
        rooted = "/" in rule
        rule = rule.lstrip("/")
        body, i = "", 0
        while i < len(rule):
            if rule.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif rule.startswith("**", i):
                body, i = body + ".*", i + 2
            elif rule[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif rule[i] == "?":
                body, i = body + "[^/]", i + 1
            else:
                body, i = body + re.escape(rule[i]), i + 1
        out.append((top + ("" if rooted else "(?:.*/)?") + body + ("/" if only_dir else "(?:/|$)"), not keep))
    return out


def ignored_by(path: Column, rules: list[str], nested: list[tuple[str, list[str]]] | None = None) -> Column:
    """Whether the ignore rules hide a path. ``nested``: folders and the rules of their ignore files, from the top down; a deeper folder's rules go before those above it, and ``rules`` before all."""
    out = F.lit(False)
    for pattern, ignores in [x for folder, some in nested or [] for x in ignore_regex(some, folder)] + ignore_regex(rules):
        out = F.when(path.rlike(pattern), F.lit(ignores)).otherwise(out)
    return out


def denied_tier(path: Column, additional: list[str] | None = None, overrides: list[str] | None = None, ignore: list[str] | None = None) -> Column:
    """The tier that denies access to a path (hardcoded_deny, default_deny, user_defined), or null."""
    name = basename(path)
    ext = F.coalesce(F.lower(extension(path)), F.lit(""))
    starts = lambda p: F.startswith(path, F.lit(p))
    any_of = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))

    traversal = path.rlike(r"(^|/)\.\.(/|$)") | starts("/")
    allowed = any_of([starts(a) if a.endswith("/") else (path == a) | starts(a + "/") for a in GIT_ALLOWED])
    hard = ext.isin(*HARD_DENY_EXTENSIONS) & ~(starts(".") & allowed) | (~allowed & any_of([starts(p) for p in HARD_DENY]))

    def by_default(p: str) -> Column:
        if p.endswith("/"):
            return (path == p[:-1]) | starts(p)
        if p.endswith("*"):
            return F.startswith(name, F.lit(p[:-1]))
        return (name == p) | (path == p)

    def by_config(p: str) -> Column:
        if p.startswith("*."):
            return F.endswith(path, F.lit(p[1:]))
        if p.endswith("/"):
            return path.rlike("(^|/)" + re.escape(p[:-1]) + "(/|$)")
        return (name == p) | (path == p)

    default = any_of([by_default(p) for p in DEFAULT_DENY if p not in (overrides or [])] + [by_config(p) for p in additional or []])
    return F.when(traversal | hard, "hardcoded_deny").when(default, "default_deny").when(ignored_by(path, ignore or []), "user_defined")


def single_extension(glob: str) -> str | None:
    """The one known source extension that a glob aims at; null where it aims at several or none."""
    if "{" in glob:
        return None
    found = [e for e in (*SYMBOL_LANGUAGES,) if re.search(r"\*\." + e + r"(?![A-Za-z])", glob)]
    return found[0] if len(found) == 1 else None


# --- semantic paths: file[::symbol(.symbol)*], symbol = name[#n]


def semantic_file(sp: Column) -> Column:
    return F.when(F.instr(sp, "::") > 0, F.substring_index(sp, "::", 1)).otherwise(sp)


def semantic_chain(sp: Column) -> Column:
    """The symbol part as text, null if there is none."""
    at = F.instr(sp, "::")
    return F.when(at > 0, F.substr(sp, at + 2))


def semantic_segments(sp: Column) -> Column:
    """array<struct<name, overload_index>>; empty segments and segments with a bad number are left out."""
    parts = F.split(F.coalesce(semantic_chain(sp), F.lit("")), r"\.")
    good = F.filter(parts, lambda x: x.rlike(r"^[^#]+(#[0-9]{1,9})?$"))
    return F.transform(good, lambda x: F.struct(F.regexp_extract(x, "^([^#]+)", 1).alias("name"), F.when(x.contains("#"), F.regexp_extract(x, "#([0-9]+)$", 1).try_cast("int")).alias("overload_index")))


def semantic_format(file: Column, segments: Column) -> Column:
    """The inverse of semantic_segments."""
    texts = F.transform(segments, lambda s: F.concat(s["name"], F.coalesce(F.concat(F.lit("#"), s["overload_index"].cast("string")), F.lit(""))))
    return F.when(F.size(segments) > 0, F.concat(file, F.lit("::"), F.array_join(texts, "."))).otherwise(file)


def separators_corrected(sp: Column) -> Column:
    """A path whose symbol part has '::' written with '.'."""
    return F.when(F.instr(sp, "::") > 0, F.concat(semantic_file(sp), F.lit("::"), F.replace(semantic_chain(sp), F.lit("::"), F.lit(".")))).otherwise(sp)


def file_uri(path: Column) -> Column:
    """file:// URI of an absolute path."""
    return F.concat(F.lit("file://"), F.array_join(F.transform(F.split(path, "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/"))


def path_of_uri(uri: Column) -> Column:
    """Path of a file URI, null for others."""
    return F.when(F.startswith(uri, F.lit("file://")), F.url_decode(F.replace(F.regexp_extract(uri, r"^file://[^/]*(/.*)$", 1), F.lit("+"), F.lit("%2B"))))
