"""Applying a consolidation plan to a store: all effects of a plan are one commit, and a plan is applied once.

A plan is a table of steps (step, kind, ids, layer, title, content, expected_hash, winner, supporting, project, tags):
- demote: the record's layer. invalidate: the record is closed, replaced by `winner`.
- merge: a new record of `content`; of the cluster `ids` those that `supporting` names are closed, replaced by it.
- rewrite: the record's text, if it still has the expected hash and the new text is at least half as long.
- reflect: a new record of `content` that is related to `supporting`.

Records that are protected, gone, or have changed since the plan was made stay as they are, which the report tells. With
`additive_only`, steps that close or demote records are held back. Ids of new records follow from plan and step, so a plan
that is worked out again makes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import identity
from lodestone.sources import scratch
from lodestone.sources.keyed import Conflict, Table

STEPS = "step int, kind string, ids array<string>, layer int, title string, content string, expected_hash string, winner string, supporting array<string>, project string, tags array<string>"
RECORDS = "id string, title string, essence string, project string, tags array<string>, related array<string>, layer int, status string, protected boolean, created_at timestamp_ntz, updated_at timestamp_ntz, invalid_at timestamp_ntz, replaced_by string"
DESTRUCTIVE, ADDING = ("demote", "invalidate", "merge"), ("merge", "reflect")


def new_id(plan: str, step: Column) -> Column:
    return identity.uuid5(F.concat(F.lit(f"plan:{plan}:"), step.cast("string")))


def fates(steps: DataFrame, records: DataFrame, additive_only: bool = False) -> DataFrame:
    """(step, kind, id, fate) for each step and record it names: applied, held, missing, protected, stale, too_short or
    unsupported (a member of a cluster that the merge does not rest on). Steps that add a record have an `added` row."""
    named = steps.where("kind <> 'reflect'").select("*", F.explode("ids").alias("id"))
    own = records.select("id", "protected", F.sha2("essence", 256).alias("hash"), F.length("essence").alias("old_length"))
    j = named.join(own, "id", "left")
    supported = F.exists(F.coalesce("supporting", F.array().cast("array<string>")), lambda s: F.substring(s, 1, 8) == F.substring(F.col("id"), 1, 8))
    rewrite = F.col("kind") == "rewrite"
    fate = (
        F.when(F.lit(additive_only) & F.col("kind").isin(*DESTRUCTIVE), "held")
        .when((F.col("kind") == "merge") & ~supported, "unsupported")
        .when(F.col("hash").isNull(), "missing")
        .when(F.coalesce("protected", F.lit(False)), "protected")
        .when(rewrite & ~F.coalesce(F.col("hash") == F.col("expected_hash"), F.lit(False)), "stale")
        .when(rewrite & ~F.coalesce(F.length("content") >= 0.5 * F.col("old_length"), F.lit(False)), "too_short")
        .otherwise("applied")
    )
    adding = steps.where(F.col("kind").isin(*ADDING)).select("step", "kind", F.lit(None).cast("string").alias("id"), F.when(F.lit(additive_only) & (F.col("kind") == "merge"), "held").otherwise("added").alias("fate"))
    return j.select("step", "kind", "id", fate.alias("fate")).unionByName(adding)


def changes(steps: DataFrame, records: DataFrame, plan: str, now: Column, told: DataFrame) -> DataFrame:
    """The records that a plan changes or adds, as they are afterwards. Of several steps that set one field the last counts."""
    done = told.where("fate = 'applied'").select("step", "id").join(steps, "step")
    of = lambda kind: F.col("kind") == kind
    last = lambda c, when: F.max_by(c, F.when(when, F.col("step")))
    closing = F.when(of("merge"), new_id(plan, F.col("step"))).when(of("invalidate"), F.col("winner"))
    set_to = done.groupBy("id").agg(
        last(F.when(of("demote"), F.col("layer")), of("demote")).alias("new_layer"),
        last(F.when(of("rewrite"), F.col("content")), of("rewrite")).alias("new_text"),
        F.max(of("merge") | of("invalidate")).alias("closes"),
        last(closing, of("merge") | of("invalidate")).alias("by"),
    )
    j = records.join(set_to, "id")
    first = F.col("closes") & F.col("invalid_at").isNull()
    changed = j.select(
        *(c for c in records.columns if c not in ("essence", "layer", "updated_at", "invalid_at", "replaced_by")),
        F.coalesce("new_text", "essence").alias("essence"), F.coalesce("new_layer", "layer").alias("layer"), now.alias("updated_at"),
        F.when(first, now).otherwise(F.col("invalid_at")).alias("invalid_at"), F.when(first, F.col("by")).otherwise(F.col("replaced_by")).alias("replaced_by"),
    )
    adding = steps.join(told.where("fate = 'added'").select("step"), "step")
    empty = F.array().cast("array<string>")
    tags = F.coalesce("tags", F.when(of("reflect"), F.array(F.lit("type:insight"), F.lit("mined-reflection"))).otherwise(F.array(F.lit("kind:consolidated"), F.lit("consolidated"))))
    added = adding.select(
        new_id(plan, F.col("step")).alias("id"), "title", F.col("content").alias("essence"), F.coalesce("project", F.lit("general")).alias("project"), tags.alias("tags"),
        F.when(of("reflect"), F.coalesce("supporting", empty)).otherwise(empty).alias("related"), F.lit(2).alias("layer"), F.lit("active").alias("status"), F.lit(False).alias("protected"),
        now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("invalid_at"), F.lit(None).cast("string").alias("replaced_by"),
    )
    return changed.unionByName(added)


def apply(table: Table, plan: str, steps: DataFrame, now: Column, additive_only: bool = False, tries: int = 3) -> DataFrame | None:
    """The report (step, kind, id, fate) of a plan that is now in the table, in one commit; None if it was there before.

    A plan is worked out on one version; if its records' buckets change meanwhile, it is worked out again.
    """
    stream = f"plan:{plan}"
    for left in reversed(range(tries)):
        based = table.version()
        if stream in based.applied:
            return None
        records = table.read(based.number)
        told = scratch.written(fates(steps, records, additive_only), "fates")
        try:
            table.upsert(changes(steps, records, plan, now, told), based=based, stream=stream, batch=0)
        except Conflict:
            if not left:
                raise
            continue
        return told
    return None
