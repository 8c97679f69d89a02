"""What the operators share: reading tables, shared scratch tables, batches of bounded size."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handled at once by a Python worker. One longer text is a batch of its own.
BATCH_CHARS = 1_000_000
#: Rows of an Arrow batch between Spark and Python; Spark's 10,000 documents would be too much memory for a worker.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a directory of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster, spark.checkpoint.dir; a temporary one where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loamworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loamworks-{uuid.uuid4().hex}"


def kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage ends there, and lost executors cost no recomputation."""
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Removes the files of tables made by kept() that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def bounded(df: DataFrame) -> DataFrame:
    """``df``; batches that go to Python from now on have at most BATCH_ROWS rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


#: Ids up to which they are sent to all tasks (8 MB); beyond it the documents are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def by_ids(spark: SparkSession, docs: DataFrame, ids: DataFrame, how: str, column: str = "doc_id") -> DataFrame:
    """``docs`` with (left_semi) or without (left_anti) the values of ``column`` in ``ids``, none of them null; texts are shuffled only for very many ids."""
    some = kept(spark, ids.select(column).distinct())
    return docs.join(F.broadcast(some) if some.count() <= BROADCAST_IDS else some, column, how).select(docs.columns)


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns, cast; whatever else the input carries is left behind. A missing column is null."""
    bounded(df)
    have = set(df.columns)
    return df.select(*[(df[f"`{c}`"] if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def in_pieces(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the text of each has at most about ``chars`` bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        at = total = 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and total + n > chars:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        yield b.slice(at)
    _give_back()


def hold_memory() -> None:
    """A worker keeps up to 64 MB of what it frees until _give_back(): arrays of a MB or so that are made again and again cost page faults otherwise."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # not this C library
        pass


def _give_back() -> None:
    """Freed memory of a worker that waits for its next task goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def sums(values: np.ndarray, chunk: int, kind: str) -> pa.RecordBatch:
    """An array in chunks of whole numbers or doubles, as rows for summed()."""
    at = range(0, len(values), chunk)
    return pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array([values[i : i + chunk].astype(kind).tobytes() for i in at])], names=["chunk", "values"])


def summed(spark: SparkSession, rows: DataFrame, size: int, chunk: int, kind: str) -> np.ndarray:
    """The sum of arrays that tasks sent in chunks (chunk, values): each chunk is added up by one task, the driver gets one array of ``size``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # a task has few chunks, of bounded size each
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, kind).astype(np.float64 if kind[1] == "f" else np.int64)
                held[k] = held[k] + x if k in held else x
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()])], names=["chunk", "values"])

    out = np.zeros(size, np.float64 if kind[1] == "f" else np.int64)
    for r in rows.repartition("chunk").mapInArrow(add, "chunk int, values binary").collect():
        x = np.frombuffer(r["values"], out.dtype)
        out[r["chunk"] * chunk : r["chunk"] * chunk + len(x)] = x
    return out
