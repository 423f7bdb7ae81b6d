"""A keyed table that grows by deltas: upserts and deletes write what they bring, readers merge, compaction folds deltas in.

Rows lie in Parquet folders, dealt by a hash of their key into a fixed number of buckets. A version of the table is a small
JSON file that lists folders, each with its sequence number and the buckets of it that count. So

- an upsert writes its own rows and a new version file, whatever the size of the table;
- a reader takes one version and, of the rows of a key, the one with the highest sequence number; it sees nothing of what is
  written meanwhile, and may ask for an older version;
- a version is committed by renaming its file to a name that must not exist. The second of two writers finds it there. It
  may go on with the next number if the commits in between touched none of its buckets (or it said that any order will do);
  else it gets `Conflict` and its rows are not part of the table;
- compaction writes chosen buckets anew and commits a version without their deltas; a commit to one of those buckets
  meanwhile makes it a conflict, and nothing is lost;
- a commit may carry the number of a stream's batch: one that was applied is not applied again.

The file system must have a rename that fails if the target exists (as HDFS; local files are linked instead); version files list folders, not
rows, so they stay small.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(Exception):
    """Another writer has changed buckets of this commit since the version it is based on."""


class Version(NamedTuple):
    number: int
    entries: list[dict]  # folder, seq, base, buckets
    applied: dict[str, int]  # stream to batch
    touched: list[int]  # buckets of this commit


class Table:
    """key: names of the key columns; schema: of the rows, as a DDL string."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema)
        self.columns = self.schema.fieldNames()

    # --- versions -----------------------------------------------------------------------------------------------------

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        root, fs = self._hadoop(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The newest version (0, an empty one, before the first commit), or a given one."""
        if number is None:
            number = max(self.numbers(), default=0)
        if number == 0:
            return Version(0, [], {}, [])
        p, fs = self._hadoop(f"{self.path}/versions/{number:010d}.json")
        stream = fs.open(p)
        try:
            text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return Version(**json.loads(text))

    def _publish(self, version: Version) -> bool:
        """Whether the version's name was free."""
        jvm = self.spark._jvm
        temp, fs = self._hadoop(f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(version._asdict()).encode()))
        out.close()
        target, _ = self._hadoop(f"{self.path}/versions/{version.number:010d}.json")
        try:
            if fs.getScheme() == "file":  # its rename replaces what is there; a link does not
                os.link(temp.toUri().getPath(), target.toUri().getPath())
                fs.delete(temp, False)
            else:
                rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
                how = self.spark.sparkContext._gateway.new_array(rename, 1)
                how[0] = rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, target, how)
        except Exception as e:
            fs.delete(temp, False)
            if isinstance(e, FileExistsError) or "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _commit(self, based: Version, touched: list[int], build: Callable[[Version, int], list[dict]], applied: dict[str, int], anyway: bool) -> Version:
        while True:
            last = self.version()
            between = [self.version(n) for n in self.numbers() if n > based.number]
            clash = sorted({b for v in between for b in v.touched} & set(touched))
            if clash and not anyway:
                raise Conflict(f"buckets {clash[:5]} changed after version {based.number}")
            version = Version(last.number + 1, build(last, last.number + 1), last.applied | applied, touched)
            if self._publish(version):
                return version

    # --- writing ------------------------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        root, fs = self._hadoop(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return folder, sorted(int(n.removeprefix("_bucket=")) for n in names if n.startswith("_bucket="))

    def upsert(self, rows: DataFrame, order: Column | None = None, based: Version | None = None, stream: str | None = None, batch: int | None = None, gone: bool = False) -> Version:
        """Rows take the place of those with their key; of several with one key the first by `order`.

        based: the version that the rows were worked out from. With it, a commit since then to one of their buckets is a
        Conflict; without it the rows go on top of whatever is there. stream, batch: a batch that was applied is passed over.
        """
        last = self.version()
        if stream is not None and last.applied.get(stream, -1) >= batch:
            return last
        w = Window.partitionBy(*self.key).orderBy(order if order is not None else F.lit(0))
        one = rows.select(*(F.col(c).cast(self.schema[c].dataType).alias(c) if c in rows.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.columns))
        if order is not None:
            one = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*self.columns)
        folder, touched = self._write(one.withColumn("_gone", F.lit(gone)).withColumn("_bucket", self._bucket()))
        entry = lambda v, n: [*v.entries, {"folder": folder, "seq": n, "base": False, "buckets": touched}]
        return self._commit(based or last, touched, entry, {stream: batch} if stream is not None else {}, anyway=based is None)

    def delete(self, keys: DataFrame, based: Version | None = None) -> Version:
        return self.upsert(keys.select(*self.key).distinct(), based=based, gone=True)

    def compact(self, buckets: list[int] | None = None) -> Version:
        """Folds the deltas of buckets (all that have some) into one base each."""
        based = self.version()
        with_delta = sorted({b for e in based.entries if not e["base"] for b in e["buckets"]})
        chosen = [b for b in (with_delta if buckets is None else buckets) if b in with_delta]
        if not chosen:
            return based
        rows = self._merged(based, chosen).withColumn("_gone", F.lit(False)).withColumn("_bucket", self._bucket())
        folder, held = self._write(rows)

        def build(last: Version, number: int) -> list[dict]:
            rest = [e | {"buckets": [b for b in e["buckets"] if b not in chosen]} for e in last.entries]
            return [e for e in rest if e["buckets"]] + ([{"folder": folder, "seq": number, "base": True, "buckets": held}] if held else [])

        return self._commit(based, chosen, build, {}, anyway=False)

    def vacuum(self, keep: int = 10) -> int:
        """Deletes all but the last `keep` versions and the folders that none of those has; returns how many folders went.

        Folders of commits under way belong to no version yet: run it while nothing is being written.
        """
        numbers = self.numbers()
        kept = {e["folder"] for n in numbers[-keep:] for e in self.version(n).entries}
        for n in numbers[:-keep]:
            p, fs = self._hadoop(f"{self.path}/versions/{n:010d}.json")
            fs.delete(p, False)
        root, fs = self._hadoop(f"{self.path}/data")
        old = [s.getPath() for s in fs.listStatus(root) if f"data/{s.getPath().getName()}" not in kept] if fs.exists(root) else []
        for p in old:
            fs.delete(p, True)
        return len(old)

    # --- reading ------------------------------------------------------------------------------------------------------

    def _merged(self, version: Version, buckets: list[int] | None = None) -> DataFrame:
        stored = StructType([*self.schema.fields]).add("_gone", "boolean")
        rows = None
        for e in version.entries:
            own = [b for b in e["buckets"] if buckets is None or b in buckets]
            if own:
                part = self.spark.read.schema(stored).parquet(*(f"{self.path}/{e['folder']}/_bucket={b}" for b in own)).withColumn("_seq", F.lit(e["seq"]).cast("long"))
                rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        if sum(not e["base"] for e in version.entries) == 0:  # bases alone have each key once
            return rows.select(*self.columns)
        rest = [c for c in self.columns if c not in self.key]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct("_gone", *rest), "_seq").alias("_r")).where("NOT _r._gone")
        return last.select(*(F.col(c) if c in self.key else F.col(f"_r.{c}").alias(c) for c in self.columns))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the newest version, or of a given one: one snapshot, whatever is committed later."""
        return self._merged(self.version(number))

    def lookup(self, *key) -> DataFrame:
        """The row of one key: only its bucket is read."""
        one = self.spark.createDataFrame([key], StructType([self.schema[k] for k in self.key]))
        bucket = one.select(self._bucket()).first()[0]
        found = self._merged(self.version(), [bucket])
        for k, v in zip(self.key, key, strict=True):
            found = found.where(F.col(k) == F.lit(v))
        return found


def upserting(table: Table, stream: str, order: Column, work: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch effect: each batch is one delta, and a batch that is repeated is applied once."""

    def effect(batch: DataFrame, number: int) -> None:
        table.upsert(work(batch) if work else batch, order, stream=stream, batch=number)

    return effect
