"""Token-id files: whole texts encoded, coded in independent blocks, and read back.

A file is the ids of the documents of one task, in order of doc_id; files are
in that order too. It is a row group of blocks in a Parquet table of the shared
folder, so any store that Spark writes will do and a lost executor's file is
written again as a whole. A block holds whole documents, at least
``block_ids`` ids but for the last of a file (a longer document is a block by
itself), with their doc_ids and lengths beside the coded ids, and decodes
without any other. See ``rangecoder`` for the coding.

Null text counts as empty and has the end id alone. Rows of a null doc_id come
first. Repeated rows stay, each with its own ids; rows of one doc_id stand in
order of the hash of their texts, then of the texts. An empty table makes files without blocks. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rangecoder
from .common import in_pieces, kept, only
from .tokens import Encoder

SCHEMA = "file int, block int, file_start long, n_ids long, doc_ids binary, no_id binary, lengths binary, payload binary"
_ARROW = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("file_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("no_id", pa.binary()), ("lengths", pa.binary()), ("payload", pa.binary())])


#: Characters of text that are encoded at once: arrays of 8 bytes a character then stay in a processor's cache.
PIECE_CHARS = 250_000


def _write(path: str, end_id: int, block_ids: int, together: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()
        encoder, end = Encoder(path, words=False, bits=22, lasting=True), np.array([end_id], "<u4").tobytes()
        docs: list[int | None] = []
        ids: list[bytes] = []
        size = block = start = 0
        ready: list[tuple[list[int | None], list[int], np.ndarray]] = []

        def close() -> None:
            nonlocal docs, ids, size
            ready.append((docs, [len(x) // 4 for x in ids], np.frombuffer(b"".join(ids), "<u4")))
            docs, ids, size = [], [], 0

        def coded() -> pa.RecordBatch:
            nonlocal block, start, ready
            rows = []
            for (d, n, x), data in zip(ready, rangecoder.encode([x for _, _, x in ready]), strict=True):
                rows.append((file, block, start, len(x), np.array([i or 0 for i in d], "<i8").tobytes(), np.array([i is None for i in d], "u1").tobytes(), np.array(n, "<u4").tobytes(), data))
                block, start = block + 1, start + len(x)
            ready = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

        for b in in_pieces(batches, chars=PIECE_CHARS):
            every, bounds = encoder.encode(b.column("text"))
            data, at = every.astype("<u4").tobytes(), bounds.tolist()
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                docs.append(d)
                ids.append(data[4 * at[i] : 4 * at[i + 1]] + end)
                size += at[i + 1] - at[i] + 1
                if size >= block_ids:
                    close()
            while len(ready) >= together:
                rest, ready = ready[together:], ready[:together]
                yield coded()
                ready = rest
        if docs:
            close()
        if ready:
            yield coded()

    return run


def _read(before: dict[int, int], together: int = 64):
    """Documents of decoded blocks, ``together`` at most at once; ``before``: ids in the files before each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = -(-b.num_rows // -(-b.num_rows // together)) if b.num_rows else 1  # like parts, as few blocks cost more each
            for i in range(0, b.num_rows, each):
                part = b.slice(i, each).to_pydict()
                for k, ids in enumerate(rangecoder.decode(part["payload"])):
                    n = np.frombuffer(part["lengths"][k], "<u4").astype(np.int64)
                    at = np.cumsum(n) - n
                    data = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(data[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), n.tolist(), strict=True)]
                    doc = pa.array(np.frombuffer(part["doc_ids"][k], "<i8"), mask=np.frombuffer(part["no_id"][k], "u1").astype(bool))
                    start = at + (part["file_start"][k] + before[part["file"][k]])
                    yield pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_files(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2, block_ids: int = 1 << 16, together: int = 64, to: str | None = None) -> DataFrame:
    """The table of blocks, written to the new folder ``to``, or to a scratch one in the shared folder; ``path`` is the tokenizer's."""
    d = only(docs, doc_id="long", text="string")
    parts = max(d.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = d.repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.asc_nulls_first("text"))
    blocks = order.mapInArrow(_write(path, end_id, block_ids, together), SCHEMA)
    if to is None:
        return kept(spark, blocks)
    blocks.write.parquet(to)
    return spark.read.schema(blocks.schema).parquet(to)


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the decoded blocks."""
    # a row for each file, of which there are as many as tasks that wrote: some bytes each
    sizes = sorted((r["file"], r["n"]) for r in files.groupBy("file").agg(F.sum("n_ids").alias("n")).collect())
    before, total = {}, 0
    for file, n in sizes:
        before[file] = total
        total += n
    return files.mapInArrow(_read(before), "doc_id long, start long, n_tokens long, ids_crc32 long")


def decoded(files: DataFrame) -> DataFrame:
    """file, doc_id, and the ids themselves, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                (ids,) = rangecoder.decode([r["payload"]])
                n = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                doc = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["no_id"], "u1").astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), r["file"], np.int32)), doc, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int64)))], names=["file", "doc_id", "ids"])

    return files.mapInArrow(run, "file int, doc_id long, ids array<long>")
