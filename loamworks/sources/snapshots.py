"""Snapshots of trees as Merkle trees of folders, and the difference of two.

An entry is a file or folder with its parent, name and digest; a folder's
digest is the number of its entries and two sums of their 64-bit hashes, so it
is added up before the shuffle, however large the folder, and two folders of
one digest hold the same but for a chance of 2^-128. The difference goes down from the root, level by level, and only into
folders whose digests differ: equal subtrees are neither joined nor read, if
the entries lie sorted by depth and parent, as written_snapshot() lays them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.graph import cut

#: depth of the parent's entries: 0 in the root
ENTRIES = "depth int, parent string, name string, folder boolean, digest string"
#: Folders of a level that are asked for by name, so that a scan skips the rest; more are joined.
NAMED = 1000


def snapshot(files: DataFrame) -> DataFrame:
    """ENTRIES of a tree from its files (path, version_hash). One round for each level, from the deepest up; of rows of one path the least hash counts, a null path or hash is left out."""
    f = files.filter("path is not null and version_hash is not null").groupBy("path").agg(F.min("version_hash").alias("digest"))
    parent = P.parent_dir(F.col("path"))
    own = cut(f.select((F.size(F.split("path", "/")) - 1).alias("depth"), parent.alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(False).alias("folder"), "digest"))
    deepest = own.agg(F.max("depth")).first()[0]
    levels, below = [], None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = own.filter(F.col("depth") == depth)
        level = level if below is None else level.unionByName(below)
        levels.append(level)
        if depth:
            sums = [F.sum(F.xxhash64(F.lit(seed), "folder", "name", "digest").cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
            up = level.groupBy("parent").agg(F.concat_ws("/", F.count("*").cast("string"), *sums).alias("digest"))
            below = cut(up.select(F.lit(depth - 1).alias("depth"), P.parent_dir(F.col("parent")).alias("parent"), F.element_at(F.split("parent", "/"), -1).alias("name"), F.lit(True).alias("folder"), "digest"))
    out = own.limit(0)
    for level in levels:
        out = out.unionByName(level)
    return out


def written_snapshot(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """The snapshot, written to ``folder`` in order of depth and parent."""
    entries = snapshot(files)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries.repartitionByRange(parts, "depth", "parent", "name").sortWithinPartitions("depth", "parent", "name").write.parquet(folder)
    return spark.read.schema(entries.schema).parquet(folder)


def difference(old: DataFrame, new: DataFrame) -> tuple[DataFrame, int]:
    """(path and change of every file that is added, removed or modified, the number of entries looked at) between two snapshots."""
    found, looked = None, 0
    frontier: DataFrame | None = None
    depth = 0
    while True:
        sides = []
        for side, entries in (("old", old), ("new", new)):
            at = entries.filter(F.col("depth") == depth)
            if frontier is not None:
                names = [r["path"] for r in frontier.limit(NAMED + 1).collect()]
                at = at.filter(F.col("parent").isin(names)) if len(names) <= NAMED else at.join(frontier.withColumnRenamed("path", "parent"), "parent", "left_semi")
            sides.append(at.select("parent", "name", F.struct("folder", "digest").alias(side)))
        met = cut(sides[0].join(sides[1], ["parent", "name"], "full_outer"))
        looked += met.agg(F.count("old") + F.count("new")).first()[0]
        differ = met.filter(~F.col("old").eqNullSafe(F.col("new"))).withColumn("path", F.concat(F.when(F.col("parent") != "", F.concat("parent", F.lit("/"))).otherwise(""), "name"))
        was, now = F.coalesce(~F.col("old.folder"), F.lit(False)), F.coalesce(~F.col("new.folder"), F.lit(False))
        files = differ.filter(was | now).select("path", F.when(was & now, "modified").when(was, "removed").otherwise("added").alias("change"))
        found = files if found is None else found.unionByName(files)
        # both folders, or a folder that is there on one side only, whose files are all added or removed
        frontier = differ.filter(F.coalesce("old.folder", F.lit(False)) | F.coalesce("new.folder", F.lit(False))).select("path")
        if not frontier.limit(1).count():
            return found, looked
        depth += 1
