"""Many strings looked for in many texts in one pass: an Aho-Corasick automaton in each task.

The strings are dealt into slices of bounded size by their hash, most corpora
of names being one slice. Each slice is an automaton that is sent to all tasks
and run once over each text, which costs the text's length and the matches,
however many strings there are. So neither texts nor words are shuffled, no
word is a join key, and the driver holds one slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of strings in a slice, and rows of a batch that goes back.
SLICE_BYTES, ROWS = 4_000_000, 20_000


def slices(patterns: DataFrame, size: int = SLICE_BYTES) -> Iterator[list[str]]:
    """The distinct strings of ``patterns`` (pattern) in lists of about ``size`` bytes; null and empty ones are left out."""
    p = patterns.select("pattern").filter("length(pattern) > 0").distinct()
    total = p.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    n = -(-total // size)
    part = F.pmod(F.xxhash64("pattern"), F.lit(n))
    for i in range(n):
        yield [r["pattern"] for r in p.filter(part == i).collect()]


def _matcher(spark: SparkSession, some: list[str], keys: list[str], whole_words: bool, places: bool):
    shared = spark.sparkContext.broadcast(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for s in shared.value:
            a.add_word(s, s)
        a.make_automaton()

        def found(text: str) -> list[tuple[str, int]]:
            every = a.iter(text)
            if whole_words:
                every = ((end, s) for end, s in every if _whole(text, end + 1 - len(s), end + 1))
            return [(s, end + 2 - len(s)) for end, s in every] if places else [(s, 0) for s in {s for _, s in every}]

        for b in batches:
            rows, patterns, at = [], [], []

            def batch(b=b) -> pa.RecordBatch:
                take = pa.array(rows, pa.int64())  # noqa: B023
                return pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in keys), pa.array(patterns, pa.string()), *([pa.array(at, pa.int64())] if places else [])], names=[*keys, "pattern", *(["at"] if places else [])])  # noqa: B023

            texts = b.column("_text")
            for i in range(b.num_rows):
                text = texts[i].as_py()
                for s, k in found(text) if text else ():
                    rows.append(i)
                    patterns.append(s)
                    at.append(k)
                if len(rows) >= ROWS:
                    yield batch()
                    rows, patterns, at = [], [], []
            yield batch()

    return run


def _joins(c: str) -> bool:
    return c.isalnum() or c == "_"


def _whole(text: str, start: int, end: int) -> bool:
    """Whether neither end of a match lies within a word."""
    return not (start and _joins(text[start - 1]) and _joins(text[start])) and not (end < len(text) and _joins(text[end]) and _joins(text[end - 1]))


def occurrences(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str = "text", places: bool = False, whole_words: bool = False, size: int = SLICE_BYTES) -> DataFrame:
    """``keys`` of every row of ``texts`` with each distinct ``pattern`` that its text holds; with ``places``, a row for each occurrence, ``at`` counting characters from 1.

    ``whole_words``: only occurrences that no letter, digit or underscore
    joins to the word before or after. Rows stay rows: a null or repeated key
    is found as often as it stands there. Null texts hold nothing.
    """
    spark, types = texts.sparkSession, dict(texts.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", pattern string" + (", at long" if places else "")
    d = texts.select(*keys, F.col(text).alias("_text"))
    out = None
    for some in slices(patterns, size):
        hits = d.mapInArrow(_matcher(spark, some, keys, whole_words, places), schema)
        out = hits if out is None else out.unionAll(hits)
    return out if out is not None else spark.createDataFrame([], schema)
