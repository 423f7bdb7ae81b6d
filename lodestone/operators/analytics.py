"""Usage analytics: recall logs, citations, replays and comparisons of engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.functions import text as T


def calls_by(calls: DataFrame, *keys) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"))


def median_latency(calls: DataFrame, by: str) -> DataFrame:
    """The middle latency, or the floor of the mean of the two in the middle; exact."""
    return calls.groupBy(by).agg(F.floor(F.percentile("latency_ms", 0.5)).cast("long").alias("median_ms"), F.count("*").alias("calls"))


def citation_rate(calls: DataFrame) -> DataFrame:
    """For each call type the share of distinct returned ids that were cited in it too."""
    returned = calls.select("call_type", F.col("returned").alias("id")).distinct()
    cited = calls.select("call_type", F.col("cited").alias("id"), F.lit(1).alias("hit")).distinct()
    joined = returned.join(cited, ["call_type", "id"], "left")
    return joined.groupBy("call_type").agg(F.count("*").alias("returned"), F.sum(F.coalesce("hit", F.lit(0))).alias("cited"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("rate"))


def top(calls: DataFrame, key: str, n: int) -> DataFrame:
    return calls.groupBy(key).agg(F.count("*").alias("times")).orderBy(F.desc("times"), key).limit(n)


def ema(history: DataFrame, by: str) -> DataFrame:
    """Moving average of outcomes (ts, event_id, outcome) in the order of time."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "outcome"))), lambda x: x["outcome"])
    return history.groupBy(by).agg(S.moving_average(ordered).alias("score"))


def replay(baseline: DataFrame, current: DataFrame, k: int) -> DataFrame:
    """(query_id, jaccard, top_stable, rank_delta) of two rankings (query_id, ids)."""
    b, c = baseline.select("query_id", F.col("ids").alias("old")), current.select("query_id", F.col("ids").alias("new"))
    j = b.join(c, "query_id")
    same_top = F.coalesce(F.try_element_at("old", F.lit(1)) == F.try_element_at("new", F.lit(1)), F.lit(False))
    moved = F.filter(F.transform("old", lambda x, i: F.when(F.array_position("new", x) > 0, F.abs(F.array_position("new", x) - 1 - i))), lambda d: d.isNotNull())
    delta = F.when(F.size(moved) > 0, F.aggregate(moved, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(moved))
    return j.select("query_id", T.jaccard(F.col("old"), F.col("new"), k).alias("jaccard"), same_top.alias("top_stable"), delta.alias("rank_delta"))


def replay_summary(replayed: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """One row of a replay: queries, mean Jaccard, share of stable first places, mean move; with latency (query_id, ms) its
    median and 95th percentile."""
    j = replayed.join(latency.select("query_id", "ms"), "query_id", "left") if latency is not None else replayed.withColumn("ms", F.lit(None).cast("double"))
    return j.agg(F.count("*").alias("queries"), F.avg("jaccard").alias("mean_jaccard"), F.avg(F.col("top_stable").cast("double")).alias("stable"), F.avg("rank_delta").alias("mean_delta"), F.percentile("ms", 0.5).alias("median_ms"), F.percentile("ms", 0.95).alias("p95_ms"))


def worst(replayed: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, jaccard, rank_delta, place): the n queries that changed most; a bounded sort."""
    first = replayed.orderBy("jaccard", F.desc(F.coalesce("rank_delta", F.lit(0.0))), "query_id").limit(n)
    w = Window.orderBy("jaccard", F.desc(F.coalesce("rank_delta", F.lit(0.0))), "query_id")  # n rows
    return first.select("query_id", "jaccard", "rank_delta", F.row_number().over(w).alias("place"))


def rankings(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, ids) in the order of rank."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    return hits.where(F.col("rank") <= k).groupBy("query_id").agg(ids.alias("ids"))


def precision(hits: DataFrame, expected: DataFrame, by: str | None = None, fold: bool = True) -> DataFrame:
    """Hits (query_id, text) that hold one of their query's keywords, over all hits; by category with a total.

    fold: whether case does not count.
    """
    told = F.lower if fold else F.col
    j = hits.join(expected, "query_id").withColumn("good", F.exists("keywords", lambda k: F.contains(told("text"), F.lower(k) if fold else k)))
    measures = [F.count("*").alias("hits"), F.count_if("good").alias("good"), F.round(F.count_if("good") / F.count("*"), 6).alias("precision")]
    return j.rollup(by).agg(*measures) if by else j.agg(*measures)


