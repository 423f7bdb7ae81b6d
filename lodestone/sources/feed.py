"""The change feed of a folder of record files: what a sweep finds new, changed and deleted, as rows.

A manifest holds, for each file that a record was read from, its time, its length and the record's id. A sweep compares it
with the folder, reads only files that differ, and gives the records to be put in place (`upserts`), the ids to be taken
out (`deletes`) and the next manifest. Derived tables (postings, vectors, edges) follow with `write.changed`.

- Of several files with one id the newest counts (of equal times the one that comes last by name). If it goes, the next
  one takes its place.
- A file whose id changes takes its old record along, unless another file has that id.
- A file that cannot be read as a record any more leaves its record as it was and is tried again with every sweep.

The driver holds the list of the files that a sweep reads, as Spark's file index does; contents stay on executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources import records as R
from lodestone.sources import scratch

MANIFEST = "file string, modified timestamp, length long, id string"


class Sweep(NamedTuple):
    manifest: DataFrame
    upserts: DataFrame
    deletes: DataFrame
    quarantined: DataFrame


def listing(spark: SparkSession, path: str) -> DataFrame:
    """file, modified, length of all record files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length")


def differences(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, modified, length, id, kind): the three-way comparison; kind is new, changed, deleted or same."""
    known = manifest.select("file", F.col("modified").alias("was"), F.col("length").alias("had"), "id")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("modified").isNull(), "deleted").when((F.col("modified") != F.col("was")) | (F.col("length") != F.col("had")), "changed").otherwise("same")
    return listed.join(known, "file", "full_outer").withColumn("kind", kind)


def owners(manifest: DataFrame) -> DataFrame:
    """(id, file, modified): the file that counts for each id."""
    w = Window.partitionBy("id").orderBy(F.desc("modified"), F.desc("file"))
    return manifest.withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "file", "modified", "length")


def _parsed(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    paths = [r.file for r in files.select("file").collect()]
    if not paths:
        empty = spark.createDataFrame([], "file string, modified timestamp, raw string")
        return R.front_matter(empty)
    found = spark.read.format("binaryFile").load(paths)
    return R.front_matter(found.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("raw")))


def sweep(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> Sweep:
    """What has changed below path since the manifest was made; everything is new without one."""
    before = manifest if manifest is not None else spark.createDataFrame([], MANIFEST)
    found = scratch.written(differences(listing(spark, path), before), "differences")
    read, bad = _parsed(spark, found.where("kind IN ('new', 'changed')"))
    read = scratch.written(read, "read")
    fresh = read.select("file", "id").join(found.where("kind IN ('new', 'changed')").select("file", "modified", "length"), "file")
    unread = before.join(bad.select("file"), "file", "left_semi")
    same = found.where("kind = 'same'").select("file", "modified", "length", "id")
    after = scratch.written(same.unionByName(unread.select(same.columns)).unionByName(fresh.select(same.columns)), "manifest")
    moved = scratch.written(owners(after).join(owners(before), ["id", "file", "modified", "length"], "left_anti"), "moved")
    # The file that counts for an id now may not have changed itself: it is read too.
    more, _ = _parsed(spark, moved.join(read.select("file"), "file", "left_anti"))
    upserts = read.unionByName(more).join(moved.select("id", "file"), ["id", "file"], "left_semi")
    deletes = before.select("id").distinct().join(after.select("id"), "id", "left_anti")
    return Sweep(after, scratch.written(upserts, "upserts"), scratch.written(deletes, "deletes"), bad)


def as_records(found: DataFrame) -> DataFrame:
    """Parsed files with the columns that derived tables read."""
    time = lambda c: F.try_to_timestamp(c)
    return found.select(
        "id", "title", "essence", F.coalesce("project", F.lit("general")).alias("project"), "status", "importance", "layer", "tags", "related", "contradicts",
        F.coalesce("source_session", F.lit("")).alias("session"), time("created").alias("created_at"), time("invalid_at").alias("invalid_at"),
    )
