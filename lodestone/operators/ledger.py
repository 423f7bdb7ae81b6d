"""Logs and what is counted over them: recalls, citations, session recalls, lessons, status, rules, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.search import best

MOST_QUERY, MOST_IDS, KEPT_DAYS = 500, 20, 30
#: Queries of self-tests, whole and in part.
TEST_QUERIES, TEST_PARTS = ("test query", "warmup query"), ("alpha beta memory", "cache test memory")


def recall_entries(calls: DataFrame) -> DataFrame:
    """Log rows of calls (ts, call_type, query, ids, latency_ms, source): cut, and without those of tests; partitioned by
    day by the writer. Sources other than production are kept as a tag."""
    kept = calls.where(F.coalesce(F.col("source_tag"), F.lit("")) != "test")
    tag = F.nullif(F.col("source_tag"), F.lit(""))
    return kept.select("ts", F.to_date("ts").alias("day"), "call_type", F.substring("query", 1, MOST_QUERY).alias("query"), F.slice("ids", 1, MOST_IDS).alias("returned_ids"), "latency_ms", "source", tag.alias("source_tag"))


def append(rows: DataFrame, path: str) -> None:
    """Appends log rows as Parquet by day, so a tail or a horizon reads its days only."""
    rows.write.mode("append").partitionBy("day").parquet(path)


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows of a log; a bounded sort, no full one."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def advisory(rows: DataFrame) -> DataFrame:
    """How many rows come from tests: by their query, a part of it, or their tag."""
    part = F.lit(False)
    for p in TEST_PARTS:
        part = part | F.contains("query", F.lit(p))
    test = F.col("query").isin(*TEST_QUERIES) | part | F.col("source_tag").isNotNull()
    return rows.agg(F.count_if(F.coalesce(test, F.lit(False))).alias("test_rows"), F.count("*").alias("rows"))


def returned(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.sum(F.size("returned_ids")).alias("returned"), F.count("*").alias("calls"))


def citations_since(cites: DataFrame, now: Column, days: int = KEPT_DAYS) -> DataFrame:
    """(id, n): citations of the last days by eight-character key."""
    recent = cites.where((F.col("ts") >= now - F.make_dt_interval(days=F.lit(days))) & (F.col("ts") <= now))
    return recent.groupBy(T.id_prefix(F.col("id")).alias("id")).agg(F.count("*").alias("n"))


def session_recalls(recalls: DataFrame, now: Column, days: int = KEPT_DAYS) -> DataFrame:
    """(session, ts, recalls): each session's recalled records once; sessions without a recall in the last days are gone."""
    key = F.substring(F.col("session").cast("string"), 1, 12)
    grouped = recalls.groupBy(key.alias("session")).agg(F.max("ts").alias("ts"), F.sort_array(F.collect_set(T.id_prefix(F.col("id")))).alias("recalls"))
    return grouped.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days)))


def learned(scores: DataFrame, recalls: DataFrame, outcomes: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(id, score): relevance scores after sessions (session, outcome): each record a session recalled moves towards it."""
    moved = recalls.select("session", F.explode("recalls").alias("id")).join(outcomes, "session").groupBy("id").agg(F.avg("outcome").alias("outcome"))
    j = scores.join(moved, "id", "full_outer")
    old = F.coalesce("score", F.lit(0.0))
    return j.select("id", F.when(F.col("outcome").isNotNull(), (1 - alpha) * old + alpha * F.col("outcome")).otherwise(old).alias("score"))


def emitted(recalls: DataFrame, turns: DataFrame, window_seconds: int = 1800) -> DataFrame:
    """(session, ids): the records that a session recalled and its assistant then named by their eight-digit keys.

    recalls: session (null in old rows), ts, id; turns: session, role, text, ts. Rows without a session count for turns
    within the window. Works on a stream of turns against a static log.
    """
    named = turns.where("role = 'assistant'").select("session", F.col("ts").alias("said"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[0-9a-f]{8}\b"), F.lit(0)))).alias("key"))
    known = recalls.select(F.col("session").alias("of"), "ts", T.id_prefix(F.col("id")).alias("key"))
    near = F.abs(F.unix_seconds(F.col("said").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) <= window_seconds
    j = named.join(known, "key").where((F.col("of") == F.col("session")) | (F.col("of").isNull() & near))
    return j.groupBy("session").agg(F.sort_array(F.collect_set("key")).alias("ids"))


def first_rule(text: Column) -> Column:
    """The first line that is not blank, or the first that is no heading where that one is; 100 characters of it."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.filter(lines, lambda x: ~F.startswith(x, F.lit("#")))
    return F.substring(F.when(F.startswith(F.try_element_at(lines, F.lit(1)), F.lit("#")), F.coalesce(F.try_element_at(plain, F.lit(1)), F.try_element_at(lines, F.lit(1)))).otherwise(F.try_element_at(lines, F.lit(1))), 1, 100)


def working_rules(records: DataFrame, cited: DataFrame, by: str, budget: int = 1200, head: str = "## Working rules") -> DataFrame:
    """(by, id, line, place): valid records as rules, most cited first, then newest, up to the first that exceeds a budget."""
    ranked = records.where("invalid_at IS NULL").join(cited, "id", "left").withColumn("line", first_rule(F.col("essence"))).where("line <> ''")
    return _within(ranked, by, F.concat(F.lit("- "), "line"), budget, head, F.desc(F.coalesce("n", F.lit(0))), F.desc("created_at"), F.col("id"))


def episode_index(records: DataFrame, by: str, most: int = 25, budget: int = 1600, head: str = "## Episode index") -> DataFrame:
    """(by, id, line, place): the newest records with their date and title, up to a budget."""
    ranked = best(records, most, F.desc("created_at"), F.col("id"), by=by, rank="newest")
    line = F.concat(F.lit("- "), F.substring("id", 1, 8), F.lit(" ["), F.date_format("created_at", "yyyy-MM-dd"), F.lit("]: "), F.substring("title", 1, 80))
    return _within(ranked, by, line, budget, head, F.col("newest"))


def _within(rows: DataFrame, by: str, line: Column, budget: int, head: str, *order: Column) -> DataFrame:
    told = rows.withColumn("line", line)
    w = Window.partitionBy(by).orderBy(*order)
    used = F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) + len(head) + 1
    return told.withColumn("used", used).withColumn("place", F.row_number().over(w)).where(F.col("used") <= budget).select(by, "id", "line", "place")


def mode(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value): the commonest value of each group, the smallest of equals."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    return best(counts, 1, F.desc("n"), F.col(value), by=by).select(by, value)


def status(records: DataFrame) -> DataFrame:
    """One row of counts of a store."""
    linked = F.count_if(F.size(F.coalesce("related", F.array().cast("array<string>"))) > 0)
    return records.agg(
        F.count("*").alias("records"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "deprecated").alias("deprecated"),
        F.countDistinct("project").alias("projects"), linked.alias("linked"), F.floor(linked * 100 / F.count("*")).cast("long").alias("linked_percent"),
        F.count_if(F.coalesce("layer", F.lit(2)) == 0).alias("layer_0"), F.count_if(F.coalesce(F.col("decay_immune"), F.lit(False))).alias("immune"),
    )


def attempts(state: DataFrame, most: int = 5) -> DataFrame:
    """The sessions that were tried most often and are not done."""
    return state.where(F.col("status").isin("retrying", "failed", "blocked") & (F.col("attempts") > 0)).orderBy(F.desc("attempts"), "session").limit(most)


def recent(state: DataFrame, most: int = 5) -> DataFrame:
    return state.orderBy(F.desc("updated_at"), "session").limit(most)


def scorecard(rows: DataFrame, ok: Column, by: str) -> DataFrame:
    """The share of rows that came out as expected, by group and in all."""
    return rows.rollup(by).agg(F.count("*").alias("cases"), F.round(F.avg(ok.cast("double")), 6).alias("accuracy"))


def proposals(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("proposals"))


def starts(deltas: DataFrame, key: str, order: str, every: int = 25) -> DataFrame:
    """The productive deltas (key, order, found) after which consolidation starts: every 25th of a key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return deltas.where("found > 0").withColumn("nth", nth).where(F.col("nth") % every == 0)
