"""Tables that one job writes and reads again, in the folder that driver and executors share.

Writing cuts the lineage: a lost executor costs the tasks it ran, and a table that is read several times is made once.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; without it a temporary one, for a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="scratch-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own that is read back."""
    path = f"{shared_dir(df.sparkSession)}/scratch-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """DataFrames of one schema (one at least), each written when its turn comes, as one table that is read back."""
    path = None
    for df in parts:
        path = path or f"{shared_dir(df.sparkSession)}/scratch-{uuid.uuid4().hex}/{name}"
        df.write.mode("append").parquet(path)
        spark, schema = df.sparkSession, df.schema
    return spark.read.schema(schema).parquet(path)
