"""The test tables as the entities of the engine: records, queries, vectors, turns, calls.

Every binding reads whole tables. `NOW` is the reference time of all time-dependent queries, for results must not depend
on when they run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T

NOW = "2024-01-31 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id8(ident: Column) -> Column:
    """An integer id as the eight-digit key that records are addressed by."""
    return F.lpad(F.lower(F.hex(ident)), 8, "0")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents (and labels) as records: id, title, essence, project, tags, importance, layer, times, state."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = docs.join(labels, "doc_id", "left")
    importance = F.when(F.col("quality") == 1, 5).when(F.col("quality") == 0, 1).otherwise(3)
    created = now() - F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    return joined.select(
        "doc_id",
        id8(F.col("doc_id")).alias("id"),
        T.title(F.col("text")).alias("title"),
        F.col("text").alias("essence"),
        F.col("source").alias("project"),
        F.array("lang").alias("tags"),
        F.lit("").alias("keys"),
        importance.alias("importance"),
        F.when(F.col("doc_id") % 4 < 3, F.col("doc_id") % 4).cast("int").alias("layer"),
        created.alias("created_at"),
        F.when(F.col("toxic") == 1, created + F.make_dt_interval(days=F.lit(1))).alias("invalid_at"),
        F.when(F.col("quality") == 0, "deprecated").otherwise("active").alias("status"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access counts by record key: events count as accesses of the record with the user's number."""
    return table(spark, sf_dir, "events").groupBy(id8(F.col("user_id")).alias("id")).agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as queries, with their whole texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a recall log: call type, session, latency, the returned id and the cited one."""
    e = table(spark, sf_dir, "events")
    cited = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", "ts", F.col("event_type").alias("call_type"), F.col("user_id").alias("session"), F.floor("value").cast("long").alias("latency_ms"), (F.col("event_id") % 100).alias("returned"), cited.alias("cited"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "role", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("project"))
