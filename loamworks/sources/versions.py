"""Versions of a set of tables in one folder: a version is written beside the others and then published by a marker file.

Readers take the highest published version, so they never see one half written,
and those that read an older one go on doing so. A marker is created only if it
is not there: of two writers of one version the second fails.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def published(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the published versions, in order."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path))
    return sorted(int(m.group(1)) for m in map(re.compile(r"v([0-9]{8})\.done$").match, names) if m)


def read(spark: SparkSession, folder: str, names: tuple[str, ...], version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by default of the highest one."""
    version = published(spark, folder)[-1] if version is None else version
    return {n: spark.read.parquet(f"{folder}/v{version:08d}/{n}") for n in names}


def write(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> int:
    """Writes the next version and publishes it; its number."""
    version = max(published(spark, folder), default=0) + 1
    for name, d in tables.items():
        d.write.mode("overwrite").parquet(f"{folder}/v{version:08d}/{name}")  # what a writer that failed left behind goes
    fs, _ = _files(spark, folder)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{version:08d}.done"), False).close()
    return version
