"""Moving facts of the first layers into profiles: proposals are made, kept for review, and applied once reviewed.

A dry run collects the candidates, asks for a proposal on each and keeps the proposals with a report. Applying uses the kept
ones if they are not older than `MOST_DAYS` and there are as many candidates as then; else they are made anew.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import maintenance, profiles
from lodestone.sources.keyed import Table
from lodestone.sources.state import State

MOST_DAYS, BATCH = 7, 20
PROPOSALS = "id string, project string, action string, profile string, section string, line string"


class Run(NamedTuple):
    proposals: DataFrame
    report: DataFrame
    reused: bool


def candidates(records: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Records of layers 0 and 1 with the number of their batch within their project."""
    found = records.where("layer IN (0, 1) AND status <> 'deprecated' AND invalid_at IS NULL")
    if excluded is not None:
        found = found.join(excluded.select("id"), "id", "left_anti")
    return maintenance.batches(found, "project", BATCH)


def report(proposals: DataFrame) -> DataFrame:
    """(project, action, n, lines): what would be done, with the lines that would go into profiles."""
    line = F.when(F.col("action") == "PROFILE", F.concat_ws(" / ", "profile", "section", "line"))
    return proposals.groupBy("project", "action").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(line)).alias("lines"))


def proposed(state: State, table: Table, records: DataFrame, propose: Callable[[DataFrame], DataFrame], now: dt.datetime, excluded: DataFrame | None = None, reuse: bool = False) -> Run:
    """Proposals for all candidates, kept in `table`; with `reuse`, those kept before if they are fresh.

    propose: from candidates (with batch) to rows of PROPOSALS, action PROFILE or KEEP.
    """
    found = candidates(records, excluded)
    if reuse:
        at, n = state.get("proposals_at"), state.get("proposals_n")
        if at and (now - dt.datetime.fromisoformat(at)).total_seconds() <= MOST_DAYS * 86400 and int(n) == found.count():
            return Run(table.read(), report(table.read()), True)
    made = propose(found).select(*(f.split()[0] for f in PROPOSALS.split(", ")))
    table.delete(table.read().select("id"))
    table.upsert(made)
    state.put("proposals_at", now.isoformat())
    state.put("proposals_n", str(found.count()))
    return Run(table.read(), report(table.read()), False)


def applied(proposals: DataFrame, facts: DataFrame, compact: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary of outcomes with the number kept, facts afterwards). Applying again changes nothing: lines are duplicates."""
    lines = proposals.where("action = 'PROFILE'").select("profile", "section", F.xxhash64("id").alias("seq"), "line")
    out = profiles.append(facts, lines, compact)
    told = out.where("kind = 'outcome'").groupBy("outcome").agg(F.count("*").alias("n"))
    kept = proposals.where("action <> 'PROFILE'").agg(F.lit("kept").alias("outcome"), F.count("*").alias("n"))
    return told.unionByName(kept), out.where("kind = 'fact'").select("profile", "section", F.col("seq").alias("pos"), "line")
