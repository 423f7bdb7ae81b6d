"""Tables in the folder that driver and executors share.

An intermediate result that is read more than once is written there as Parquet, which cuts the lineage: a lost
executor costs the tasks it ran and nothing that was written.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import ship

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; a temporary one only for a local master without it (tests).

    Elsewhere a missing setting is an error: executors of a cluster do not see each other's temporary folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _fallback.setdefault("dir", tempfile.mkdtemp(prefix="lodestone-"))


class Workspace:
    """A folder of intermediate tables that belong to one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df and returns a reader of what was written."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this workspace that nothing reads any more."""
        for table in tables:
            for file in table.inputFiles()[:1]:
                self._delete(file.rpartition("/")[0])

    def keep(self, table: DataFrame) -> None:
        """Deletes every other table of this workspace; `table` is what the operator returns."""
        kept = {file.rpartition("/")[0].rpartition("/")[2] for file in table.inputFiles()[:1]}
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        for status in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root):
            if status.getPath().getName() not in kept:
                self._delete(status.getPath().toString())

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
