"""Small settings files: the registry of vaults, and other names of projects."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import records as R


def _json(spark: SparkSession, path: str) -> object:
    """The content of a JSON file that Spark can open; None without one, or if it is broken."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    rows = spark.read.text(path, wholetext=True).collect()  # one settings file
    try:
        return json.loads(rows[0].value) if rows else None
    except ValueError:
        return None


def vaults(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, folder) of the registered vaults; entries without a name or a path are left out, of one name the last counts."""
    found = _json(spark, path)
    entries = found.get("vaults", []) if isinstance(found, dict) else found if isinstance(found, list) else []
    named = {e["name"]: e["path"] for e in entries if isinstance(e, dict) and isinstance(e.get("name"), str) and isinstance(e.get("path"), str) and e["name"] and e["path"]}
    return list(named.items())


def registered(spark: SparkSession, path: str) -> DataFrame | None:
    """Valid records of all registered vaults (Parquet folders) with the name of each; a vault whose folder is gone is left
    out, None without any."""
    readers = {}
    for name, folder in vaults(spark, path):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            readers[name] = spark.read.parquet(folder)
    return R.vaults(readers) if readers else None


def aliases(spark: SparkSession, path: str, fixed: dict[str, str] | None = None) -> dict[str, str]:
    """Other names of projects, lower case: `fixed` ones, and over them those of the file (name to project)."""
    found = _json(spark, path)
    own = {k: v for k, v in found.items() if isinstance(v, str)} if isinstance(found, dict) else {}
    return {k.lower(): v for k, v in ((fixed or {}) | own).items()}


def project(name: Column, names: dict[str, str]) -> Column:
    """A project by its own name or another one; `general` for none."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[low] if names else F.lit(None).cast("string")
    return F.coalesce(known, F.when(low.isin("", "default"), "general").otherwise(F.trim(name)))
