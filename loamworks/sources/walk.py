"""A walk of a tree in tasks: folders are rows, and each level is listed by one round over them.

The driver lists no file. A folder carries the ignore rules from above it, in
order, to the task that lists it; what an ignore file of its own adds holds
below it. A folder that the rules hide is told of and never listed, as is one
that is always excluded. The root is a folder that all executors see.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.graph import cut

#: kind: folder, file, or pruned (a folder that rules hide)
LISTED = "path string, kind string, length long, modificationTime timestamp, ignored boolean, rules string"
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC")), ("ignored", pa.bool_()), ("rules", pa.string())])
#: Entries of a batch, and bytes of files that a task holds at once, but for one larger file.
ROWS, BYTES = 10_000, 32_000_000


def _hidden(path: str, rules: list[list]) -> bool:
    """Whether the last rule that matches hides a path; a folder's ends in a slash."""
    return next((ignores for pattern, ignores in reversed(rules) if re.search(pattern, path)), False)


def _entries(root: str, folder: str, rules: list[list], last: list[list], excluded: frozenset[str], ignore_files: tuple[str, ...]) -> Iterator[tuple]:
    with os.scandir(os.path.join(root, folder)) as found:
        entries = sorted(found, key=lambda e: e.name)
    for name in ignore_files:
        for e in entries:
            if e.name == name and e.is_file():
                with open(e.path, encoding="utf-8", errors="replace") as f:
                    rules = [*rules, *(list(r) for r in P.ignore_regex(f.read().splitlines(), folder))]
    carried = json.dumps(rules)
    for e in entries:
        path = f"{folder}/{e.name}" if folder else e.name
        if e.is_dir(follow_symlinks=False):
            if e.name not in excluded:
                hidden = _hidden(path + "/", rules + last)
                yield (path, "pruned" if hidden else "folder", None, None, hidden, None if hidden else carried)
        elif e.is_file():
            size = e.stat()
            yield (path, "file", size.st_size, datetime.fromtimestamp(size.st_mtime, UTC), _hidden(path, rules + last), None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _ARROW.types, strict=True)], schema=_ARROW)


def walked(spark: SparkSession, root: str, ignore: list[str] | None = None, ignore_files: tuple[str, ...] = (".gitignore", ".ignore"), excluded: tuple[str, ...] = P.EXCLUDED_DIRS) -> DataFrame:
    """path (relative), kind, length, modificationTime and ignored of all files, and of the folders on the way. ``ignore``: rules that go before those of the tree's ignore files."""
    base = "/" + root.split(":", 1)[-1].lstrip("/") if root.startswith("file:") else os.path.abspath(root)
    last, skip = [list(r) for r in P.ignore_regex(ignore or [])], frozenset(excluded)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, rules in zip(b.column("path").to_pylist(), b.column("rules").to_pylist(), strict=True):
                rows = []
                for row in _entries(base, folder, json.loads(rules), last, skip, ignore_files):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = spark.createDataFrame([("", "[]")], "path string, rules string")
    out = None
    while True:
        level = cut(frontier.repartition(parts, "path").mapInArrow(listed, LISTED))
        out = level if out is None else out.unionByName(level)
        frontier = level.filter("kind = 'folder'").select("path", "rules")
        if not frontier.limit(1).count():
            return out.drop("rules")


def with_contents(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, ...) with their ``content``, read in tasks; null where a file has gone since."""
    base = "/" + root.split(":", 1)[-1].lstrip("/") if root.startswith("file:") else os.path.abspath(root)
    names = files.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = size = 0
            held: list[bytes | None] = []
            for i, path in enumerate(b.column("path").to_pylist()):
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        held.append(f.read())
                except FileNotFoundError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= BYTES or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*b.slice(at, len(held)).columns, pa.array(held, pa.binary())], names=[*names, "content"])
                    at, size, held = i + 1, 0, []

    kinds = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return files.mapInArrow(read, f"{kinds}, content binary")


def files_of(walk: DataFrame) -> DataFrame:
    """The files of a walk: path, length, modificationTime, ignored."""
    return walk.filter(F.col("kind") == "file").drop("kind")
