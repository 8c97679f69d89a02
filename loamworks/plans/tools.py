"""The query API: explore, search, read, inspect, locate, trace and health over one corpus.

Each call checks its arguments, builds a plan over the corpus' tables and
returns an Answer: rows, and one row of counts, flags and hints. Lines are
1-based everywhere. An unknown list is None, never an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import patterns as D
from ..functions import text as X
from ..model import BATCH_LIMIT, DETAILS, EDGES, FILTER_MODES, READ_DETAILS, SCOPES, AccessDenied, Config, FileNotFound, InvalidParams, InvalidSemanticPath, PathTraversal, SymbolNotFound, UnsupportedLanguage
from ..model import names as columns
from ..operators import budget, graph, index, lines, quality, relate
from ..sources import trees, versions


@dataclass
class Answer:
    """Rows of a call, a dictionary of its counts and flags, and text where the call renders any."""

    rows: DataFrame | None
    stats: dict = field(default_factory=dict)
    text: str | None = None


@dataclass
class Corpus:
    """Files and the index over them. ``authoritative``: edges of a compiler or language server, if there are any."""

    files: DataFrame
    config: Config = field(default_factory=Config)
    authoritative: DataFrame | None = None
    #: whether symbols are read from a saved index; otherwise calls on some files parse only these
    indexed: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    @cached_property
    def allowed(self) -> DataFrame:
        """Files that the access policy shows."""
        c = self.config
        return self.files.filter(P.denied_tier(F.col("path"), c.additional_deny, c.allow_override, c.ignore).isNull() & ~P.in_excluded_dir(F.col("path")))

    @cached_property
    def symbols(self) -> DataFrame:
        return index.symbols(self.allowed)

    def symbols_in(self, paths: list[str]) -> DataFrame:
        """Symbols of some files; a filter above the parser would not reach the files."""
        some = F.col("path").isin(*dict.fromkeys(paths))
        return self.symbols.filter(some) if self.indexed else index.symbols(self.allowed.filter(some))

    @cached_property
    def tokens(self) -> DataFrame:
        return index.tokens(self.allowed)

    @cached_property
    def faults(self) -> DataFrame:
        """What the parser could not place in files; see index.faults."""
        return index.faults(self.allowed)

    @cached_property
    def edges(self) -> DataFrame:
        own = index.edges(self.allowed, self.symbols)
        return own if self.authoritative is None else self.authoritative.unionByName(own.join(self.authoritative.select("src_path", "src_symbol").distinct(), ["src_path", "src_symbol"], "left_anti"))

    def resolved_edges(self) -> DataFrame:
        """The edges, written once, for calls that go over them many times."""
        if not self.indexed and "_edges" not in self.__dict__:
            self.__dict__["_edges"] = graph.cut(self.edges)
        return self.__dict__.get("_edges", self.edges)

    def save(self, folder: str) -> int:
        """Writes the index as the next version in a folder, for open_saved; parsing then happens once. The version's number."""
        calls = self.__dict__.get("calls") or index.calls(self.allowed, self.symbols)
        written = {"files": self.files, "symbols": self.symbols, "tokens": self.tokens, "calls": calls}
        return versions.write(self.spark, folder, written | {"resolved": index.resolved(calls, self.symbols), "edges": self.edges})

    @classmethod
    def open_saved(cls, spark: SparkSession, folder: str, config: Config | None = None, version: int | None = None) -> Corpus:
        tables = versions.read(spark, folder, ("files", "symbols", "tokens", "calls", "resolved", "edges"), version)
        c = cls(tables.pop("files"), config or Config(), indexed=True)
        c.__dict__.update(tables)
        return c

    @classmethod
    def refresh(cls, spark: SparkSession, folder: str, files: DataFrame, config: Config | None = None) -> tuple[Corpus, dict]:
        """The saved index brought to the state of ``files`` and written as the next version: only files whose hash changed are parsed, and only calls whose file or target changed are resolved. The corpus, and how much was made anew."""
        old = cls.open_saved(spark, folder, config)
        new = cls(files, config or Config())
        was, now = old.allowed, new.allowed
        fresh = now.join(was.select("path", "version_hash"), ["path", "version_hash"], "left_anti")
        symbols = graph.cut(index.refreshed(now, was, old.symbols))
        tokens = index.refreshed(now, was, old.tokens, index.tokens)
        calls, edges, again = index.refreshed_edges(now, symbols, was, old.symbols, old.calls, old.resolved)
        calls, edges = graph.cut(calls), graph.cut(edges)
        versions.write(spark, folder, {"files": files, "symbols": symbols, "tokens": tokens, "calls": calls, "resolved": edges, "edges": edges.select(*columns(EDGES))})
        return cls.open_saved(spark, folder, config), {"files_parsed": fresh.count(), "calls_resolved": again.count(), "calls": calls.count()}

    # --- argument checks

    def _path(self, path: str) -> str:
        """A path relative to the root, checked against the policy."""
        p = path.removeprefix("./")
        if ".." in p.split("/"):
            raise PathTraversal(f"path leaves the corpus: {path}")
        tier = self.spark.range(1).select(P.denied_tier(F.lit(p), self.config.additional_deny, self.config.allow_override, self.config.ignore)).first()[0]
        if tier:
            raise AccessDenied(f"denied: {path}", tier=tier)
        return p

    def _semantic(self, sp: str) -> tuple[str, str | None]:
        if not sp or sp.startswith("::"):
            raise InvalidSemanticPath(f"not a semantic path: {sp!r}")
        file, _, chain = sp.partition("::")
        return self._path(file), chain or None

    def _symbol(self, sp: str):
        """The symbol row of a semantic path; separators are corrected and the call retried once, else similar names are told."""
        file, chain = self._semantic(sp)
        if chain is None:
            raise InvalidSemanticPath(f"no symbol in {sp!r}")
        if not self.allowed.filter(F.col("path") == file).limit(1).count():
            raise FileNotFound(f"no such file: {file}")
        own = self.symbols_in([file])
        for label in dict.fromkeys((chain, chain.replace("::", "."))):
            found = own.filter(F.col("semantic_path") == label).take(1)
            if found:
                return found[0]
        near = [r["semantic_path"] for r in budget.did_you_mean(own, chain.replace("::", ".")).orderBy("rank").collect()]
        if not near:
            last = chain.replace("::", ".").split(".")[-1]
            near = [f"{r['path']}::{r['semantic_path']}" for r in self.symbols.filter((F.col("name") == last) & F.col("kind").isin("Function", "Method", "Test")).orderBy("path", "symbol_id").limit(20).collect()]
        raise SymbolNotFound(sp, near)

    # --- explore

    def explore(self, path: str = ".", detail: str = "symbols", max_tokens: int | None = None, depth: int = 3, visibility: str = "public", max_tokens_per_file: int = 2000, changed: DataFrame | None = None, since=None, include_extensions: list[str] | None = None, exclude_extensions: list[str] | None = None, include_tests: bool = False) -> Answer:
        """A skeleton of the corpus within a budget of tokens. The rows tell of every file whether it was admitted or truncated."""
        if detail not in DETAILS or visibility not in ("public", "all"):
            raise InvalidParams(f"detail is one of {DETAILS}, visibility public or all")
        top = "" if path in (".", "", "./") else self._path(path.rstrip("/"))
        f = self.allowed.filter(F.startswith("path", F.lit(top + "/")) | (F.col("path") == top)) if top else self.allowed
        f = f.filter(~F.col("path").rlike(r"(^|/)\."))
        if changed is not None or since is not None:
            f = trees.changed_files(f, changed, since)
            if not f.limit(1).count():
                return Answer(None, {"files_in_scope": 0, "coverage_percent": 100, "hint": "nothing changed"}, "")
        within = trees.effective_depth(f, depth) if detail == "symbols" else depth
        f = trees.source_filter(f, extensions=include_extensions, not_extensions=exclude_extensions).filter(P.depth(F.col("path")) - (P.depth(F.lit(top)) + 1 if top else F.lit(0)) <= within)
        asked = max_tokens or self.config.max_tokens
        most = budget.scaled_budget(asked, trees.count_source_files(f))
        stack = sorted(r[0] for r in f.select(P.symbol_language_of(F.col("path"))).distinct().collect() if r[0])
        if detail == "structure":
            dirs, manifests = trees.structure(f)
            cost = X.estimate_tokens(F.concat("path", F.lit("/\n")))
            shown = budget.until_full(dirs.select(F.col("dir").alias("path")).withColumn("cost", cost), most)
            names = [r["path"] + "/" for r in shown.orderBy("path").collect()]
            used = shown.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
            listed = manifests.withColumn("cost", X.estimate_tokens(F.concat("path", F.lit("\n"))))
            notable = [r["path"] for r in budget.until_full(listed, most - used - 6).orderBy("path").collect()]
            text = "\n".join(names) + ("\n\nNotable files:\n" + "\n".join(notable) if notable else "")
            return Answer(shown.select("path"), {"tech_stack": stack, "dirs_scanned": dirs.count(), "files_in_scope": manifests.count(), "coverage_percent": 100, "max_tokens_used": most}, text.strip())
        if detail == "files":
            listed = f.filter(P.is_source(F.col("path"))).select("path", X.short_hash(F.col("version_hash")).alias("version_hash")).withColumn("cost", X.estimate_tokens(F.concat("path", F.lit("\n"))))
            kept = listed.join(budget.greedy(listed, most, omission=0), "path")
            text = "\n".join(r["path"] for r in kept.filter("admitted").orderBy("path").collect())
            n = kept.agg(F.count_if("admitted").alias("a"), F.count_if(~F.col("admitted")).alias("b")).first()
            return Answer(kept, {"tech_stack": stack, "files_scanned": n["a"], "files_truncated": n["b"], "files_in_scope": n["a"] + n["b"], "coverage_percent": 100, "max_tokens_used": most}, text)
        source = f.filter(P.symbol_language_of(F.col("path")).isNotNull())
        sk = budget.skeletons(relate.visible(self.symbols.join(source.select("path"), "path", "left_semi"), visibility, include_tests), max_tokens_per_file)
        header = F.concat(F.lit("\nFile: "), F.col("path"), F.lit("\n"), F.repeat(F.lit("="), F.length("path") + 6), F.lit("\n"))
        d = sk.withColumn("header", header).withColumn("cost", F.col("tokens") + X.estimate_tokens(header))
        d = d.join(budget.greedy(d, most), "path").join(source.select("path", X.short_hash(F.col("version_hash")).alias("version_hash")), "path")
        # what is shown is held to the budget: admitted files cost their tokens, marked ones 50 each
        shown = d.filter("admitted or marked").select("path", "admitted", "header", F.when(F.col("admitted"), F.col("skeleton")).alias("skeleton")).orderBy("path").collect()
        text = "".join(r["header"] + r["skeleton"] + "\n" if r["admitted"] else f"\n// [... Omitted {r['path']} due to token budget]\n" for r in shown)
        n = d.agg(F.count("*").alias("all"), F.count_if("admitted").alias("shown"), F.coalesce(F.sum("cost"), F.lit(0)).alias("need")).first()
        n_scope = source.count()
        stats = {"tech_stack": stack, "files_scanned": n["shown"], "files_truncated": n["all"] - n["shown"], "files_in_scope": n_scope, "coverage_percent": 100 if not n_scope else n["all"] * 100 // n_scope, "rendered_percent": 100 if not n["all"] else n["shown"] * 100 // n["all"], "max_tokens_used": most}
        if n["need"] > most:
            stats |= {"suggested_max_tokens": budget.suggested_budget(n["need"]), "hint": "Raise max_tokens to see the omitted files."}
        return Answer(d.drop("header"), stats, text.strip())

    # --- search

    def search(self, query: str, mode: str = "text", path_glob: str = "**/*", exclude_glob: str | list[str] | None = None, max_results: int | None = None, offset: int = 0, context_lines: int = 2, known_files: list[str] | None = None, kind: str | None = None, group_by_file: bool = True, filter_mode: str = "code_only") -> Answer:
        """Matching lines, filtered before they are paged, so pages neither overlap nor miss rows."""
        if mode == "symbol":
            return self.find_symbol(query, path_glob, kind, max_results)
        if mode not in ("text", "regex") or filter_mode not in FILTER_MODES:
            raise InvalidParams("mode is text, regex or symbol; filter_mode code_only, comments_only or all")
        limit = max_results or self.config.max_results
        f = trees.source_filter(self.allowed, path_glob, exclude_glob)
        f = f.filter(~F.col("ignored")) if "ignored" in f.columns else f
        m = lines.find(f, query, regex=mode == "regex", context=context_lines)
        if filter_mode != "all":  # only files with matches are parsed
            m = relate.node_types(m, index.tokens(f.join(m.select("path").distinct(), "path", "left_semi")) if not self.indexed else self.tokens)
        unsupported = P.symbol_language_of(F.col("path")).isNull() & F.lit(filter_mode != "all")
        n = m.agg(F.count("*").alias("total"), F.count_if(relate.passes_mode(filter_mode)).alias("kept"), F.count_if(unsupported).alias("unknown")).first()
        total, kept, unknown = n["total"], n["kept"], n["unknown"] > 0
        rows = graph.cut(lines.page(m.filter(relate.passes_mode(filter_mode)), offset, limit))
        shown = [r["path"] for r in rows.select("path").distinct().collect()]  # a page has few files
        rows = relate.with_definition_flag(relate.enclosing(rows, self.symbols_in(shown)))
        rows = lines.with_known(rows, self.spark.createDataFrame([(p,) for p in known_files or []], "path string"))
        scan = lines.counters(self.files, path_glob, exclude_glob).first().asDict()
        returned = max(0, min(limit, kept - offset))
        hint = self.spark.range(1).select(quality.search_hint(F.lit(returned if offset < kept or not kept else 1), F.lit(total), F.lit(scan["coverage_percent"]), filter_mode)).first()[0]
        stats = scan | {"total_matches": total, "filtered_matches": kept, "returned": returned, "truncated": offset + returned < kept, "next_offset": offset + returned if offset + returned < kept else None, "hint": hint, "degraded_reason": "unsupported_language_filter_bypassed" if unknown else None}
        return Answer(lines.grouped(rows).orderBy("first_rank") if group_by_file else rows.orderBy("rank"), stats)

    def find_symbol(self, query: str, path_glob: str = "**/*", kind: str | None = None, max_results: int | None = None) -> Answer:
        """Semantic paths of symbols with a name, by relevance."""
        if not query or any(x in query for x in ("..", "/", "\\")):
            raise InvalidParams("a symbol's name has no '..', '/' or '\\'")
        if kind is not None and kind.lower() not in D.KIND_ALIASES:
            raise InvalidParams(f"kind is one of {sorted(D.KIND_ALIASES)}")
        limit = max_results or self.config.max_results
        s = self.symbols.filter(P.matches_glob(F.col("path"), path_glob)).withColumn("public_kind", D.public_kind(F.col("kind")))
        if kind:
            s = s.filter(F.col("public_kind").isin(*D.KIND_ALIASES[kind.lower()]))
        hits = s.withColumn("relevance", D.relevance(query, F.col("name"))).filter("relevance > 0")
        hits = relate.first_by(hits, ["path", "semantic_path"], "start_line")
        first = F.element_at(X.lines_of(F.col("text")), F.col("start_line") + 1)
        total = hits.count()
        top = hits.orderBy(F.desc("relevance"), "path", "start_line").limit(limit)
        rows = top.join(self.allowed.select("path", "text"), "path").select(F.concat("path", F.lit("::"), "semantic_path").alias("semantic_path"), F.col("public_kind").alias("kind"), "path", (F.col("start_line") + 1).alias("line"), X.preview(F.trim(first)).alias("preview"), "relevance")
        stats = {"total_found": total, "resolution_strategy": "symbol_index"}
        if not total:
            near = budget.did_you_mean(self.symbols, query, 5, column="name")
            stats |= {"did_you_mean": [f"{r['path']}::{r['semantic_path']}" for r in near.orderBy("rank").collect()], "hint": "No symbol of that name."}
        return Answer(rows.orderBy(F.desc("relevance"), "path", "line"), stats)

    # --- read

    def read(self, filepath: str | None = None, paths: list[str] | None = None, detail_level: str = "compact", start_line: int = 1, end_line: int | None = None, max_lines_per_file: int = 500) -> Answer:
        """Lines and symbols of one file or of up to ten; a batch has a row for each, with its error if it has one. ``faults``: how many places the parser could not make out."""
        if (filepath is None) == (paths is None) or detail_level not in READ_DETAILS:
            raise InvalidParams(f"one of filepath and paths; detail_level is one of {READ_DETAILS}")
        if start_line < 1 or (end_line is not None and end_line < start_line):
            raise InvalidParams("lines count from 1, and end_line is not before start_line")
        asked = [filepath] if paths is None else paths
        if not asked or len(asked) > BATCH_LIMIT:
            raise InvalidParams(f"1 to {BATCH_LIMIT} paths")
        if paths is None:
            trees.whole_text(self.allowed, self._path(filepath))
        want = self.spark.createDataFrame([(i, p.removeprefix("./")) for i, p in enumerate(asked)], "ordinal int, path string")
        d = F.broadcast(want).join(self.files.select("path", "text", "version_hash"), "path", "left")
        tier = P.denied_tier(F.col("path"), self.config.additional_deny, self.config.allow_override, self.config.ignore)
        error = F.when(tier.isNotNull(), "ACCESS_DENIED").when(F.col("version_hash").isNull(), "FILE_NOT_FOUND").when(F.col("text").isNull(), "BINARY_FILE")
        ls = X.lines_of(F.col("text"))
        last = F.least(F.lit(end_line if end_line is not None else 2**31 - 1), F.size(ls), F.lit(start_line + max_lines_per_file - 1))
        part = F.slice(ls, F.lit(start_line), F.greatest(last - start_line + 1, F.lit(0)))
        known = P.symbol_language_of(F.col("path")).isNotNull()
        rows = d.select("ordinal", "path", error.alias("error"), "version_hash", P.language_of(F.col("path")).alias("language"), F.size(ls).alias("total_lines"), part.alias("lines"), (last < F.size(ls)).alias("truncated"), (~known).alias("unsupported_language"))
        rows = rows.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("version_hash", "language", "total_lines", "lines", "truncated")})
        if detail_level == "symbols":
            rows = rows.withColumn("lines", F.lit(None).cast("array<string>"))
        if detail_level != "source_only":
            hi = end_line if end_line is not None else 2**31 - 1
            s = self.symbols_in([p.removeprefix("./") for p in asked]).filter((F.col("end_line") + 1 >= start_line) & (F.col("start_line") + 1 <= hi))
            if detail_level == "compact":
                s = s.filter("depth <= 1")
            one = F.struct("symbol_id", "semantic_path", "kind", (F.col("start_line") + 1).alias("start_line"), (F.col("end_line") + 1).alias("end_line"), "access_level")
            rows = rows.join(s.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("symbols")), "path", "left")
            faults = index.faults(self.allowed.filter(F.col("path").isin(*[p.removeprefix("./") for p in asked]))).groupBy("path").agg(F.count("*").alias("faults"))
            rows = rows.join(faults, "path", "left").withColumn("faults", F.when(known & F.col("error").isNull(), F.coalesce("faults", F.lit(0))))
        n = rows.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("bad")).first()
        return Answer(rows.orderBy("ordinal"), {"succeeded": n["ok"], "failed": n["bad"]})

    # --- inspect

    def inspect(self, semantic_path: str | None = None, semantic_paths: list[str] | None = None, include_dependencies: bool = False, max_dependencies: int = 50, include_imports: bool = False) -> Answer:
        """Source of symbols, what they call, and their files' imports."""
        if (semantic_path is None) == (semantic_paths is None) or not 1 <= max_dependencies <= 500:
            raise InvalidParams("one of semantic_path and semantic_paths; max_dependencies is 1 to 500")
        asked = [semantic_path] if semantic_paths is None else semantic_paths
        if not asked or len(asked) > BATCH_LIMIT:
            raise InvalidParams(f"1 to {BATCH_LIMIT} semantic paths")
        found = [self._symbol(sp) for sp in asked]
        want = self.spark.createDataFrame([(i, r["path"], r["semantic_path"]) for i, r in enumerate(found)], "ordinal int, path string, semantic_path string")
        inside = [r["path"] for r in found]
        b = index.bodies(self.allowed.filter(F.col("path").isin(*inside)), self.symbols_in(inside))
        rows = b.drop("ordinal").join(F.broadcast(want), ["path", "semantic_path"]).select("ordinal", "path", "semantic_path", "kind", "access_level", (F.col("start_line") + 1).alias("start_line"), (F.col("end_line") + 1).alias("end_line"), "language", "content", "parent_kind", "parent_name")
        stats: dict = {"succeeded": len(found), "failed": 0}
        if include_dependencies:
            e = self.edges.withColumnsRenamed({"src_path": "path", "src_symbol": "semantic_path"}).join(F.broadcast(want), ["path", "semantic_path"])
            dep = F.struct("dst_path", "dst_symbol", "confidence")
            deps = e.groupBy("ordinal").agg(F.array_sort(F.collect_set(dep)).alias("d"))
            rows = rows.join(deps, "ordinal", "left").withColumn("dependencies", F.slice(F.coalesce("d", F.array().cast("array<struct<dst_path:string,dst_symbol:string,confidence:string>>")), 1, max_dependencies)).withColumn("dependencies_truncated", F.coalesce(F.size("d") > max_dependencies, F.lit(False))).drop("d")
            stats |= {"degraded_reason": None if self.authoritative is not None else "grep_fallback_dependencies", "dependencies_verified": self.authoritative is not None}
        if include_imports:
            im = lines.imports(self.allowed.join(F.broadcast(want.select("path").distinct()), "path", "left_semi")).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]).alias("imports"))
            rows = rows.join(im, "path", "left")
        return Answer(rows.orderBy("ordinal"), stats)

    # --- locate

    def locate(self, semantic_path: str | None = None, file: str | None = None, line: int | None = None, locations: list[tuple[str, int]] | None = None) -> Answer:
        """Where a symbol is defined, or which symbol encloses positions."""
        if sum((semantic_path is not None, file is not None or line is not None, locations is not None)) != 1:
            raise InvalidParams("one of semantic_path, file with line, and locations")
        if semantic_path is not None:
            return self._definition(semantic_path)
        if locations is None:
            if file is None or line is None:
                raise InvalidParams("file needs line")
            locations = [(file, line)]
        if not locations or len(locations) > BATCH_LIMIT or any(n < 1 for _, n in locations):
            raise InvalidParams(f"1 to {BATCH_LIMIT} locations, lines from 1")
        at = self.spark.createDataFrame([(i, self._path(p), int(n)) for i, (p, n) in enumerate(locations)], "ordinal int, path string, line long")
        rows = relate.enclosing(at, self.symbols_in([self._path(p) for p, _ in locations]))
        rows = rows.withColumn("semantic_path", F.when(F.col("enclosing_semantic_path").isNotNull(), F.concat("path", F.lit("::"), "enclosing_semantic_path")))
        return Answer(rows.orderBy("ordinal"), {"requested": len(locations)})

    def _definition(self, sp: str) -> Answer:
        file, chain = self._semantic(sp)
        if chain is None:
            raise InvalidSemanticPath(f"no symbol in {sp!r}")
        label = chain.replace("::", ".")
        exact = self.symbols_in([file]).filter(F.col("semantic_path") == label).join(self.allowed.select("path", "text"), "path")
        row = exact.select("path", (F.col("start_line") + 1).cast("long").alias("line"), (F.col("name_column") + 1).cast("long").alias("column"), X.preview(F.trim(F.element_at(X.lines_of(F.col("text")), F.col("start_line") + 1))).alias("preview"), F.lit("symbol_index").alias("resolution_strategy"))
        if row.limit(1).count():
            return Answer(row, {"degraded_reason": None})
        segments = label.split(".")
        name = segments[-1].split("#")[0]
        found = relate.definition_candidates(self.allowed.filter(P.is_source(F.col("path"))), self.symbols, name, file, segments[-2] if len(segments) > 1 else None).orderBy("path", "line").limit(1)
        rows = found.collect()
        if not rows:
            near = [r["semantic_path"] for r in budget.did_you_mean(self.symbols_in([file]), label).orderBy("rank").collect()]
            raise SymbolNotFound(sp, near)
        reason = {"text_file": "grep_fallback_file_scoped", "text_impl": "grep_fallback_impl_scoped"}.get(rows[0]["resolution_strategy"], "grep_fallback_global")
        return Answer(found, {"degraded_reason": reason})

    # --- trace

    def trace(self, semantic_path: str, scope: str = "callers", max_depth: int = 3, max_references: int = 50, offset: int = 0) -> Answer:
        """Callers and callees, references, or both with the source."""
        if scope not in SCOPES or offset < 0:
            raise InvalidParams(f"scope is one of {SCOPES}")
        s = self._symbol(semantic_path)
        most = max(1, min(max_references, 500))
        if scope == "callers":
            return self._callers(s, max_depth, most)
        if scope == "references":
            return self._references(s, most, offset)
        calls, refs = self._callers(s, 2, most), self._references(s, most, 0)
        source = self.inspect(f"{s['path']}::{s['semantic_path']}").rows.first()
        body = source["content"]
        text = f"{s['path']}::{s['semantic_path']}" + (f"\n{body}" if body and body.count("\n") < 10 else "")
        rows = calls.rows.select("semantic_path", "path", "direction", "depth", "confidence").unionByName(refs.rows.select(F.col("full_path").alias("semantic_path"), "path", F.lit("reference").alias("direction"), F.lit(None).cast("long").alias("depth"), F.lit("heuristic").alias("confidence")))
        return Answer(rows, calls.stats | {"references": refs.stats["total"]}, text)

    def _callers(self, s, depth: int, most: int) -> Answer:
        e = self.resolved_edges()
        parent = self.symbols_in([s["path"]]).filter(F.col("symbol_id") == s["parent_id"]).select("kind", "name").first() if s["parent_id"] is not None else None
        if parent and parent["kind"] == "Interface":  # an interface's method: its implementations are called in its place
            impl = self.symbols.filter((F.col("name") == s["name"]) & (F.col("semantic_path") != s["semantic_path"]) & F.col("kind").isin("Function", "Method"))
            same = impl.select(F.lit(s["path"]).alias("src_path"), F.lit(s["semantic_path"]).alias("src_symbol"), "path", "semantic_path")
            to = same.select(F.col("path").alias("dst_path"), F.col("semantic_path").alias("dst_symbol"))
            via = e.join(to, ["dst_path", "dst_symbol"], "left_semi").withColumns({"dst_path": F.lit(s["path"]), "dst_symbol": F.lit(s["semantic_path"])})
            e = e.unionByName(via)
        incoming, outgoing, truncated = graph.callers_and_callees(e, s["path"], s["semantic_path"], depth, most)
        sure = self.authoritative is not None
        rows = graph.cut(incoming.unionByName(outgoing))  # at most ``most`` rows
        told = {r["direction"]: r["n"] for r in rows.groupBy("direction").agg(F.count("*").alias("n")).collect()}
        n = told.get("incoming", 0), told.get("outgoing", 0)
        stats = {"incoming": n[0], "outgoing": n[1], "truncated": truncated, "incoming_verified": sure, "outgoing_verified": sure, "degraded_reason": None if sure else "no_lsp_grep_fallback", "resolution_strategy": "call_edges" if sure else "text_edges"}
        stats["hint"] = self.spark.range(1).select(quality.trace_hint(F.lit(n[0]), F.lit(sure))).first()[0]
        stats["files_referenced"] = rows.agg(F.count_distinct("path")).first()[0]
        return Answer(rows, stats)

    def _references(self, s, most: int, offset: int) -> Answer:
        refs = relate.references(self.allowed, s["name"], s["path"], s["start_line"] + 1)
        total = refs.count()
        top = budget.paged_union([refs], offset, most, "path", "line")
        rows = relate.semantic_path_or(relate.enclosing(top, self.symbols), F.lit(s["name"]))
        stats = {"total": total, "truncated": offset + most < total, "next_offset": offset + most if offset + most < total else None, "degraded_reason": "no_lsp_grep_fallback", "files": refs.agg(F.count_distinct("path")).first()[0]}
        return Answer(rows.orderBy("rank"), stats)

    # --- health

    def health(self, language: str | None = None, action: str | None = None, force_probe: bool = False) -> Answer:
        """The state of each language's index: ready where all its files have been indexed. ``restart`` drops the index so that it is built anew; ``force_probe`` parses each language's probe file now and tells how many symbols it has."""
        if action not in (None, "restart"):
            raise InvalidParams("action is restart")
        if action == "restart":
            for name in ("symbols", "tokens", "edges", "_edges"):
                self.__dict__.pop(name, None)
        lang = P.symbol_language_of(F.col("path"))
        per = self.allowed.filter(lang.isNotNull()).groupBy(lang.alias("language")).agg(F.count("*").alias("files"), F.count_if(F.col("text").isNotNull()).alias("readable"))
        roots = trees.language_roots(self.allowed).select("language", F.col("root"))
        d = per.join(roots, "language", "left").withColumn("status", F.when(F.col("readable") == F.col("files"), "ready").when(F.col("readable") > 0, "degraded").otherwise("unavailable")).withColumn("indexing_status", F.lit("complete"))
        missing = roots.join(per.select("language"), "language", "left_anti").withColumns({"status": F.lit("unavailable"), "files": F.lit(0).cast("long")})
        d = d.unionByName(missing, allowMissingColumns=True)
        sure = F.lit(self.authoritative is not None)
        d = d.withColumn("degraded_tools", quality.degraded_tools(F.lit(None).cast("boolean"), F.col("status") == "ready", sure, sure)).join(trees.probe_files(self.allowed).withColumnRenamed("path", "probe_file"), "language", "left")
        d = d.filter(F.col("language") == language) if language else d
        if language and not d.limit(1).count():
            raise UnsupportedLanguage(f"no files of language {language}")
        if force_probe:
            probes = [r["probe_file"] for r in d.select("probe_file").distinct().collect() if r["probe_file"]]  # one for each language
            seen = index.symbols(self.allowed.filter(F.col("path").isin(*probes))).groupBy(F.col("path").alias("probe_file")).agg(F.count("*").alias("probed_symbols"))
            d = d.join(seen, "probe_file", "left").withColumn("probed_symbols", F.when(F.col("probe_file").isNotNull(), F.coalesce("probed_symbols", F.lit(0))))
        o = quality.overall_status(d.withColumn("_", F.lit(0)), "_").first()
        return Answer(d, {"overall_status": o["overall_status"] if o else "unavailable", "indexing_complete": o["indexing_complete"] if o else True})
