"""The record store: versions in two times, upserts by full outer join, reconcile decisions, links and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def valid_now(records: DataFrame) -> DataFrame:
    return records.where("status <> 'deprecated' AND invalid_at IS NULL")


def as_of(records: DataFrame, at: Column) -> DataFrame:
    """Records as they stood at a time."""
    return records.where((F.col("valid_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)))


def scoped(records: DataFrame, project: str, deprecated: bool = False) -> DataFrame:
    kept = records if deprecated else records.where("status <> 'deprecated'")
    return kept if project in ("", "default", "general") else kept.where(F.col("project") == project)


def lookup(records: DataFrame, keys: DataFrame) -> DataFrame:
    """One record for each key: the exact id, else the first by id that begins with a key of eight characters or more."""
    exact = keys.join(records, keys.key == records.id).withColumn("how", F.lit(0))
    begun = keys.where("length(key) >= 8").withColumn("key8", F.substring("key", 1, 8)).join(records.withColumn("key8", T.id_prefix(F.col("id"))), "key8").where(F.startswith("id", F.col("key"))).drop("key8").withColumn("how", F.lit(1))
    w = Window.partitionBy("key").orderBy("how", "id")
    return exact.unionByName(begun).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "how")


def lookup_unambiguous(records: DataFrame, keys: DataFrame) -> DataFrame:
    """As lookup, but a prefix that several records share finds none."""
    exact = keys.join(records, keys.key == records.id)
    rest = keys.join(records.select(F.col("id").alias("key")), "key", "left_anti").where("length(key) >= 8")
    begun = rest.withColumn("key8", F.substring("key", 1, 8)).join(records.withColumn("key8", T.id_prefix(F.col("id"))), "key8").where(F.startswith("id", F.col("key"))).drop("key8")
    one = begun.groupBy("key").count().where("count = 1").select("key")
    return exact.unionByName(begun.join(one, "key", "left_semi"))


def upsert(records: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """A new snapshot: changed records get new texts and the union of tags, in order; unknown ids are inserted.

    records and changes: id, title, essence, tags, valid_at, updated_at. The last change of an id wins. One shuffle on
    id joins both sides.
    """
    w = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("essence"))
    last = changes.withColumn("n", F.row_number().over(w)).where("n = 1").select("id", *(F.col(c).alias(f"new_{c}") for c in ("title", "essence", "tags")))
    joined = records.join(last, "id", "full_outer")
    changed = F.col("new_essence").isNotNull()
    return joined.select(
        "id",
        F.coalesce("new_title", "title").alias("title"),
        F.coalesce("new_essence", "essence").alias("essence"),
        F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("new_tags", F.array().cast("array<string>"))).alias("tags"),
        F.coalesce("valid_at", now).alias("valid_at"),
        F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def invalidate(records: DataFrame, successors: DataFrame, now: Column) -> DataFrame:
    """Closes records (id, replaced_by) at a time; the rows stay, and what was closed before keeps its time."""
    return records.join(successors.select("id", F.col("replaced_by").alias("successor"), F.lit(True).alias("closing")), "id", "left").select(
        *(c for c in records.columns if c not in ("invalid_at", "replaced_by")),
        F.when(F.col("closing"), F.coalesce("invalid_at", now)).otherwise(F.col("invalid_at")).alias("invalid_at"),
        F.when(F.col("closing") & F.col("invalid_at").isNull(), F.col("successor")).otherwise(F.col("replaced_by")).alias("replaced_by"),
    )


def deprecate(records: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    gone = ids.select("id", F.lit(True).alias("gone")).distinct()
    return records.join(gone, "id", "left").withColumn("status", F.when(F.col("gone"), "deprecated").otherwise(F.col("status"))).withColumn("valid_to", F.when(F.col("gone"), now)).drop("gone")


def delete(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id"), "id", "left_anti")


def link(records: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with both directions of pairs (a, b) in `related`, pairs with linked / already_linked / invalid_target)."""
    known = records.select("id", "related")
    ends = pairs.join(known.toDF("a", "a_related"), "a", "left").join(known.toDF("b", "b_related"), "b", "left")
    missing = F.col("a_related").isNull() | F.col("b_related").isNull() | (F.col("a") == F.col("b"))
    told = ends.select("a", "b", F.when(missing, "invalid_target").when(F.array_contains("a_related", F.col("b")) & F.array_contains("b_related", F.col("a")), "already_linked").otherwise("linked").alias("outcome"))
    both = told.where("outcome = 'linked'").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("x"))
    new = both.select("x.id", "x.to").groupBy("id").agg(F.sort_array(F.collect_set("to")).alias("more"))
    joined = records.join(new, "id", "left").withColumn("related", F.array_union("related", F.coalesce("more", F.array().cast("array<string>")))).drop("more")
    return joined, told


def contradictions(new: DataFrame, old: DataFrame, candidates: DataFrame, negation: Column, least_overlap: float = 0.3) -> DataFrame:
    """Candidate pairs (new_id, id) of enough common words in which the new text has a negation that the old one lacks."""
    pairs = candidates.join(new.select("new_id", "new_text", T.word_set(F.col("new_text")).alias("new_words")), "new_id")
    pairs = pairs.join(old.select("id", F.col("essence").alias("old_text"), T.word_set(F.col("essence")).alias("old_words")), "id")
    pairs = pairs.withColumn("overlap", T.containment(F.col("new_words"), F.col("old_words"))).withColumn("signal", negation)
    return pairs.where((F.round("overlap", 9) >= least_overlap) & F.col("signal").isNotNull()).select("new_id", "id", "overlap", "signal")


def reconcile(decisions: DataFrame, targets: DataFrame, most_supersedes: int = 3, most_profiles: int = 5) -> DataFrame:
    """What each decision comes to: `effect` is add, update, supersede, noop or profile.

    decisions: session, index, op, target, content, valid (content and section pass their checks); targets: id, status,
    protected, essence. Unknown or inactive targets, protected ones, contents that lose most of the old text, and what
    exceeds the caps of a session degrade to add; an invalid profile line is dropped to noop.
    """
    t = targets.select(F.col("id").alias("target"), "status", "protected", F.length("essence").alias("old_length"))
    d = decisions.join(t, "target", "left")
    order = Window.partitionBy("session", "op").orderBy("index")
    d = d.withColumn("nth", F.row_number().over(order))
    known = F.col("status") == "active"
    safe = known & ~F.coalesce("protected", F.lit(False))
    short = (F.length("content") < 10) | (F.length("content") < 0.3 * F.col("old_length"))
    effect = (
        F.when(F.col("op") == "NOOP", "noop")
        .when(F.col("op") == "PROFILE", F.when(F.col("valid") & (F.col("nth") <= most_profiles), "profile").otherwise("noop"))
        .when(F.col("op") == "UPDATE", F.when(F.coalesce(safe & ~short, F.lit(False)), "update").otherwise("add"))
        .when(F.col("op") == "SUPERSEDE", F.when(F.coalesce(safe, F.lit(False)) & (F.col("nth") <= most_supersedes), "supersede").otherwise("add"))
        .otherwise("add")
    )
    return d.select("session", "index", "op", "target", "content", effect.alias("effect"))


def bump(events: DataFrame, key: str, ts: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("access_count"), F.max(ts).alias("last_accessed"))


def content_hash(records: DataFrame, by: str = "project", buckets: int = 4096) -> DataFrame:
    """A hash of each group's records that does not depend on their order, and their number.

    Each record is hashed where it lies (id and text); a group's records are hashed by bucket of their id, and the ordered
    hashes of its buckets once more. So no text leaves its row and no group is one row of texts, whatever its size; a change
    of any record changes the group's hash, which is all that it is for.
    """
    one = records.select(by, F.pmod(F.crc32("id"), F.lit(buckets)).alias("bucket"), F.struct("id", F.sha2(F.concat("id", F.lit(":"), "essence", F.lit("\n")), 256).alias("h")).alias("r"))
    hashes = lambda xs: F.sha2(F.array_join(F.transform(F.array_sort(xs), lambda x: x["h"]), ""), 256)
    part = one.groupBy(by, "bucket").agg(hashes(F.collect_list("r")).alias("h"), F.count("*").alias("n"))
    return part.groupBy(by).agg(hashes(F.collect_list(F.struct("bucket", "h"))).alias("source_hash"), F.sum("n").alias("records"))
