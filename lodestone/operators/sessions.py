"""Turns, pairs, budgets, sessions and feedback over conversations and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(session, pair, user_text, assistant_text): runs of user turns with the assistant turns that follow them.

    A pair begins with the first user turn after an assistant turn (or at the start); other roles are dropped before.
    """
    talk = turns.where("role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''")
    w = Window.partitionBy("session").orderBy("pos")
    begins = (F.col("role") == "user") & (F.coalesce(F.lag("role").over(w), F.lit("assistant")) == "assistant")
    numbered = talk.withColumn("begins", begins).withColumn("pair", F.sum(F.col("begins").cast("int")).over(w)).where("pair > 0")
    text = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    return numbered.groupBy("session", "pair").agg(text("user").alias("user_text"), text("assistant").alias("assistant_text"))


def within_budget(rows: DataFrame, by: str, size: Column, budget: int, *order: Column) -> DataFrame:
    """The leading rows of each group whose sizes add up to no more than a budget."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def fitting(lines: DataFrame, by: str, budget: int, order: str, line: str) -> DataFrame:
    """(by, kept, dropped): lines in order while they fit; a line that does not fit is left out, later ones may."""
    listed = lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("lines"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(0).alias("dropped"))

    def step(acc: Column, x: Column) -> Column:
        size = F.length(x[line]) + 1
        fits = acc["used"] + size <= budget
        return F.struct(
            F.when(fits, F.concat(acc["kept"], F.array(x[line]))).otherwise(acc["kept"]).alias("kept"),
            F.when(fits, acc["used"] + size).otherwise(acc["used"]).alias("used"),
            F.when(fits, acc["dropped"]).otherwise(acc["dropped"] + 1).alias("dropped"),
        )

    return listed.select(by, F.aggregate("lines", start, step).alias("r")).select(by, "r.kept", "r.used", "r.dropped")


def sessionize(events: DataFrame, by: str, ts: str, gap_seconds: int = 1800) -> DataFrame:
    """(by, started, ended, events): runs of events without a pause longer than the gap."""
    w = Window.partitionBy(by).orderBy(ts, "event_id")
    pause = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) > gap_seconds * 1_000_000
    numbered = events.withColumn("session_no", F.sum(F.coalesce(pause, F.lit(True)).cast("int")).over(w))
    return numbered.groupBy(by, "session_no").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"))


def timeline(anchors: DataFrame, candidates: DataFrame, before: int, after: int) -> DataFrame:
    """For anchors (anchor, at) and candidates (anchor, id, ts): the last `before` earlier and the first `after` later."""
    c = candidates.join(anchors, "anchor").withColumn("side", F.when(F.col("ts") < F.col("at"), "before").otherwise("after"))
    near = Window.partitionBy("anchor", "side").orderBy(F.when(F.col("side") == "before", -F.unix_micros(F.col("ts").cast("timestamp"))).otherwise(F.unix_micros(F.col("ts").cast("timestamp"))), "id")
    limit = F.when(F.col("side") == "before", before).otherwise(after)
    return c.withColumn("place", F.row_number().over(near)).where(F.col("place") <= limit)


def tail(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def strip_noise(text: Column) -> Column:
    """Text without injected reminder and command blocks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<system-reminder>.*?</system-reminder>", ""), r"(?s)<(command-[a-z]+|local-command-stdout)>.*?</\1>", ""))


def path_tokens(text: Column, strict: bool = True) -> Column:
    """Path-like words: strict ones begin with / or ~ or have both a dot and a slash, the others have either."""
    words = F.regexp_extract_all(text, F.lit(r"[\w~./-]+"), F.lit(0))
    has = lambda w, c: F.contains(w, F.lit(c))
    test = (lambda w: F.startswith(w, F.lit("/")) | F.startswith(w, F.lit("~")) | (has(w, ".") & has(w, "/"))) if strict else (lambda w: has(w, "/") | has(w, "."))
    return F.filter(words, test)


def sections(pages: DataFrame, id_col: str, html: str, least: int = 20, most: int = 2000) -> DataFrame:
    """(id, section, heading, body): a page's text at its headings, bodies of more than `least` characters, cut at `most`."""
    parts = F.split(F.col(html), r"(?i)<h[1-3][^>]*>")
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("section", "raw")).where("section > 0")
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    split = F.split("raw", r"(?i)</h[1-3]>", 2)
    rows = rows.select("id", "section", clean(split[0]).alias("heading"), F.substring(clean(F.coalesce(F.try_element_at(split, F.lit(2)), F.lit(""))), 1, most).alias("body"))
    return rows.where(F.length("body") > least)


def newest_first(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """(key, order): each key at its newest row, the newest keys first; a combined maximum, then a bounded sort."""
    return rows.groupBy(key).agg(F.max(order).alias(order)).orderBy(F.desc(order), key).limit(most)
