"""Upkeep of a store: session discovery, citations, profiles, purges, index lines, batches, plans, checks."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import edit, rules
from lodestone.functions import text as T

# --- sessions ---------------------------------------------------------------------------------------------------------


def terminal(version: str, most_attempts: int = 5) -> Column:
    """Whether a session needs no more work: tried too often, or done by this version and not grown past its offset."""
    done = (F.col("status") == "complete") & (F.col("version") == version) & (F.coalesce("offset_bytes", F.lit(0)) >= F.col("size"))
    return F.coalesce((F.col("attempts") >= most_attempts) | done, F.lit(False))


def settled_sessions(files: DataFrame, state: DataFrame, now: Column, version: str, excluded: list[str], least_bytes: int = 5000, quiet_seconds: int = 1800, installed: Column | None = None) -> DataFrame:
    """Transcript files (session, project, size, modified, first_text, has_credential) that are ready to be mined, oldest first.

    Left out: excluded projects, subagents, small files, files older than the install, files still growing, terminal
    sessions, sessions that an own prompt began, and those that hold credentials.
    """
    f = files.where(~F.col("project").isin(*excluded) & ~F.contains("session", F.lit("subagent")) & ~F.endswith("project", F.lit("-root")))
    f = f.where((F.col("size") >= least_bytes) & (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("modified").cast("timestamp")) >= quiet_seconds) & ~F.col("has_credential"))
    if installed is not None:
        f = f.where(F.col("modified") >= installed)
    s = state.select("session", "status", "version", "attempts", "offset_bytes")
    joined = f.join(s, "session", "left").where(~terminal(version))
    return joined.select(*files.columns).orderBy("modified", "session")


def own_prompt(first_text: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a session's first user text begins with one of the engine's own prompts."""
    out = F.coalesce(first_text, F.lit("")).rlike(r"\A# .*— Project Playbook")
    for p in prefixes:
        out = out | F.startswith(F.coalesce(first_text, F.lit("")), F.lit(p))
    return out


def citations(turns: DataFrame, recalls: DataFrame, minutes: int = 30) -> DataFrame:
    """(session, id): eight-digit keys that a session's assistant turns name and that were recalled for it.

    A recall belongs to the session it names; one without a session to those with a turn within some minutes, which is
    joined on the two time buckets that may hold such a turn rather than on all pairs.
    """
    said = turns.where("role = 'assistant'").select("session", "ts", F.explode(F.regexp_extract_all("text", F.lit(r"\b([0-9a-f]{8})\b"), F.lit(1))).alias("id")).distinct()
    given = recalls.select(F.col("session").alias("of"), F.col("ts").alias("at"), F.explode(F.transform("ids", lambda x: F.substring(x, 1, 8))).alias("id"))
    named = said.join(given.where("of IS NOT NULL"), "id").where("session = of").select("session", "id")
    bucket = lambda ts: F.floor(F.unix_seconds(ts.cast("timestamp")) / (60 * minutes))
    left = said.withColumn("bucket", bucket(F.col("ts")))
    right = given.where("of IS NULL").withColumn("bucket", F.explode(F.array(bucket(F.col("at")) - 1, bucket(F.col("at")), bucket(F.col("at")) + 1)))
    near = left.join(right, ["id", "bucket"]).where(F.abs(F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))) <= 60 * minutes)
    return named.unionByName(near.select("session", "id")).distinct()


def tool_digest(blocks: DataFrame) -> DataFrame:
    """(session, pos, line) of tool blocks (session, pos, name, path, command, result): what was done, and errors."""
    name, path = F.col("name"), F.coalesce("path", F.lit(""))
    line = (
        F.when(name.isin("Read", "Glob", "Grep"), F.concat(F.lit("read "), path))
        .when(name.isin("Edit", "Write", "NotebookEdit"), F.concat(F.lit("edit "), path))
        .when(name == "Bash", F.concat(F.lit("run "), F.substring(F.coalesce("command", F.lit("")), 1, 200)))
        .otherwise(F.concat(F.lit("tool "), name))
    )
    failed = F.substring(F.coalesce("result", F.lit("")), 1, 200).rlike(r"(?i)\b(error|failed|traceback|exception)\b")
    return blocks.select("session", "pos", F.concat(line, F.when(failed, " (error)").otherwise("")).alias("line"))


# --- profiles ---------------------------------------------------------------------------------------------------------


def profile_facts(texts: DataFrame) -> DataFrame:
    """(profile, section, pos, line) of profile texts (profile, text): bullets under the heading they follow."""
    lines = texts.select("profile", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    w = Window.partitionBy("profile").orderBy("pos")
    heading = F.when(F.startswith("raw", F.lit("## ")), F.trim(F.substring("raw", 4, 1 << 20)))
    under = lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))
    return under.where(F.startswith("raw", F.lit("- "))).select("profile", "section", "pos", F.trim(F.substring("raw", 3, 1 << 20)).alias("line"))


def valid_sections(proposals: DataFrame, sections: DataFrame) -> DataFrame:
    """Proposals (profile, section, ...) with the schema's name of their section, null for none; "and" equals "&"."""
    plain = lambda c: F.replace(F.lower(F.trim(c)), F.lit(" and "), F.lit(" & "))
    known = sections.select("profile", F.col("section").alias("known"), plain(F.col("section")).alias("key"))
    return proposals.withColumn("key", plain(F.col("section"))).join(known, ["profile", "key"], "left").drop("key")


def append_facts(facts: DataFrame, new: DataFrame, most_chars: int = 2500, most_line: int = 200) -> DataFrame:
    """Facts (profile, section, line) to be added: short, harmless, not there yet, and as many as the profile's size allows."""
    known = facts.select("profile", F.lower("line").alias("low")).distinct()
    fresh = new.where((F.length("line") <= most_line) & rules.threat(F.col("line")).isNull()).withColumn("low", F.lower("line"))
    fresh = fresh.join(known, ["profile", "low"], "left_anti").dropDuplicates(["profile", "low"])
    used = facts.groupBy("profile").agg(F.sum(F.length("line") + 3).alias("used"))
    w = Window.partitionBy("profile").orderBy("pos", "line").rowsBetween(Window.unboundedPreceding, 0)
    sized = fresh.join(used, "profile", "left").withColumn("through", F.coalesce("used", F.lit(0)) + F.sum(F.length("line") + 3).over(w))
    return sized.where(F.col("through") <= most_chars).select("profile", "section", "pos", "line")


# --- plans ------------------------------------------------------------------------------------------------------------


def batches(records: DataFrame, by: str, size: int = 20) -> DataFrame:
    """Records with the number of their batch within their group."""
    w = Window.partitionBy(by).orderBy("id")
    return records.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def reflection_due(records: DataFrame, since: Column, least: int = 8) -> DataFrame:
    """Projects with enough new episodes since a time."""
    new = records.where((F.col("created_at") > since) & F.array_contains("tags", "kind:episode"))
    return new.groupBy("project").agg(F.count("*").alias("episodes")).where(F.col("episodes") >= least)


def apply_plan(plan: DataFrame, records: DataFrame, additive_only: bool = False) -> DataFrame:
    """What becomes of planned steps (kind, id, expected_hash): applied, stale (the record has changed), missing, held."""
    now = records.select("id", F.sha2("essence", 256).alias("hash"))
    destructive = F.col("kind").isin("demote", "merge", "rewrite", "invalidate")
    fate = (
        F.when(F.lit(additive_only) & destructive, "held")
        .when(destructive & F.col("hash").isNull(), "missing")
        .when(destructive & F.col("expected_hash").isNotNull() & (F.col("hash") != F.col("expected_hash")), "stale")
        .otherwise("applied")
    )
    return plan.join(now, "id", "left").select("kind", "id", fate.alias("fate"))


def purge_plan(records: DataFrame, markers: tuple[str, ...], keep: DataFrame) -> DataFrame:
    """Ids of mined or marked records that are not to be kept."""
    marked = rules.contains_any(F.concat_ws(" ", "title", "essence"), tuple(m.lower() for m in markers))
    return records.where(F.array_contains("tags", "mined") | marked).join(keep.select("id"), "id", "left_anti").select("id")


def index_lines(records: DataFrame) -> DataFrame:
    """(project, place, id, line): the index as rows, a line for each record, by project with the newest first.

    A writer that wants a file writes rows in this order; no project's lines are gathered in one row.
    """
    day = F.date_format("created_at", "yyyy-MM-dd")
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("] ("), F.col("id"), F.lit(", "), day, F.lit(")"))
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc(day), F.desc("id")))
    return records.select("project", place.alias("place"), "id", line.alias("line"))


def playbook_due(records: DataFrame, hashes: DataFrame, least: int = 5) -> DataFrame:
    """Projects of enough records whose content hash is not the stored one."""
    from lodestone.operators.store import content_hash

    now = content_hash(records).where(F.col("records") >= least)
    return now.join(hashes.select("project", "source_hash"), ["project", "source_hash"], "left_anti")


# --- checks -----------------------------------------------------------------------------------------------------------


def canaries(planted: DataFrame, hits: DataFrame, most_rank: int = 5) -> DataFrame:
    """(canary_id, found): whether a planted title is among the first hits (canary_id, title, rank) of its query."""
    near = hits.where(F.col("rank") <= most_rank).select("canary_id", F.col("title").alias("hit"))
    return planted.join(near, "canary_id", "left").groupBy("canary_id").agg(F.coalesce(F.max(F.contains("hit", F.col("title"))), F.lit(False)).alias("found"))


def compare_positions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two artifacts (pos, query, ids) side by side by position, as far as both go."""
    return old.toDF("pos", "old_query", "old_ids").join(new.toDF("pos", "new_query", "new_ids"), "pos")


def abilities(results: DataFrame) -> DataFrame:
    """Cases passed and failed by ability, and the total."""
    return results.rollup("ability").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """`edit.token_set` of each pair."""
    return pd.Series([edit.token_set(x, y) for x, y in zip(a, b, strict=True)], index=a.index, dtype=float)


def best_matches(new: DataFrame, old: DataFrame, least_shared: int = 1) -> DataFrame:
    """(new_id, id, score): for each new text the old record of the largest token-set ratio among those that share a word."""
    ratio = F.pandas_udf(token_set_ratio, "double")
    words = lambda df, key, col: df.select(key, F.explode(F.array_distinct(F.filter(F.split(col, r"\s+"), lambda w: w != ""))).alias("word"))
    shared = words(new, "new_id", "text").join(words(old, "id", "body"), "word").groupBy("new_id", "id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)
    scored = shared.join(new.select("new_id", "text"), "new_id").join(old.select("id", "body"), "id").withColumn("score", ratio("text", "body"))
    w = Window.partitionBy("new_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(w)).where("place = 1").select("new_id", "id", "score")


def salvage_json(text: str | None) -> str | None:
    """The first JSON array or object in a model's answer, repaired where only its end is missing; None without one."""
    if not text:
        return None
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)
    text = fence[1] if fence else text
    start = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1)
    if start < 0:
        return None
    stack, quoted, escaped = [], False, False
    for i, c in enumerate(text[start:], start):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                text = text[start : i + 1]
                break
    else:
        text = re.sub(r",\s*$", "", text[start:] + ('"' if quoted else "")) + "".join(reversed(stack))
    text = re.sub(r",(\s*[\]}])", r"\1", text)
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except ValueError:
        return None


def valid_candidates(rows: DataFrame) -> DataFrame:
    """Mined candidates (title, content, importance, keys, kind) cut and defaulted; those without a title or text drop out."""
    keys = F.slice(F.filter(F.transform(F.coalesce("keys", F.array().cast("array<string>")), lambda k: F.substring(F.trim(k), 1, 60)), lambda k: k != ""), 1, 8)
    importance = F.coalesce(F.col("importance").try_cast("int"), F.lit(3))
    out = rows.select(F.substring(F.trim("title"), 1, 120).alias("title"), F.substring(F.trim("content"), 1, 2000).alias("content"), F.least(F.lit(5), F.greatest(F.lit(1), importance)).alias("importance"), keys.alias("keys"), "kind")
    return out.where("title <> '' AND length(content) >= 10")


def blocks(parts: dict[str, DataFrame], budgets: dict[str, int], total: int = 5500) -> DataFrame:
    """(block, pos, line): the blocks of a session start, each within its budget, in order while the total lasts."""
    out = None
    for number, (name, lines) in enumerate(parts.items()):
        one = lines.select(F.lit(number).alias("number"), F.lit(name).alias("block"), "pos", "line", F.lit(budgets[name]).alias("budget"))
        out = one if out is None else out.unionByName(one)
    size = F.length("line") + 1
    own = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = out.withColumn("used", F.sum(size).over(own)).where("used <= budget")
    every = Window.partitionBy(F.lit(0)).orderBy("number", "pos").rowsBetween(Window.unboundedPreceding, 0)  # a few kilobytes
    return kept.withColumn("through", F.sum(size).over(every)).where(F.col("through") <= total).select("block", "pos", "line")


def sniffed(name: Column, head: Column) -> Column:
    """What kind of chat export a file is, by its name and first characters; null for none."""
    lower, start = F.lower(name), F.substring(head, 1, 1000)
    return F.when(F.contains(lower, F.lit("conversations")) | start.rlike(r'"(mapping|chat_messages|conversation_id)"\s*:'), "json_export").when(start.rlike(r"(?im)^\s*(user|human|assistant|you)\s*:"), "role_prefixed")


def compact_line(record_id: Column, title: Column, project: Column) -> Column:
    return F.format_string("%s | %s | %s", T.id_prefix(record_id), F.substring(title, 1, 80), project)
