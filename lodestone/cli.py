"""The engine from a command line: `python -m lodestone.cli COMMAND --records PATH ...`; results are printed as JSON lines.

Commands mirror the calls of `api.Engine` (search, get, timeline, slice, save), the store's reports (status, list, sources,
audit), the graph around records (related, reverse, links), what saving texts or importing a folder would come to (similar,
import), and the replay of a query set against another engine's hits (replay, summary, worst).
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.api import Engine
from lodestone.functions import rules
from lodestone.operators import analytics, fuzzy, graph, ledger, store
from lodestone.session import session
from lodestone.sources import imports


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("texts", nargs="*", help="queries, or keys of records")
    p.add_argument("--records", required=True, help="Parquet of records")
    p.add_argument("--edges", help="Parquet of edges")
    p.add_argument("--baseline", help="Parquet of hits (query_id, id, rank) that a replay is compared with")
    p.add_argument("--scope", default="general")
    p.add_argument("--limit", type=int, default=int(os.environ.get("LODESTONE_LIMIT", "10")))
    p.add_argument("--now", help="reference time; unset: the current one")
    p.add_argument("--since", help="only records of the last 7d, 24h or 30m")
    return p.parse_args(argv)


def _queries(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.createDataFrame(list(enumerate(a.texts)), "query_id long, query string")


def _keys(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.createDataFrame([(k, i) for i, k in enumerate(a.texts)], "key string, pos int")


def _replay(spark: SparkSession, e: Engine, a: argparse.Namespace) -> DataFrame:
    """Jaccard, first place and moves of each query against the baseline, by running the queries again."""
    old = analytics.rankings(spark.read.parquet(a.baseline), a.limit)
    new = analytics.rankings(e.search(_queries(spark, a), a.limit, a.scope).select("query_id", "id", F.col("place").alias("rank")), a.limit)
    return analytics.replay(old, new, a.limit)


def _near(spark: SparkSession, a: argparse.Namespace, rows: DataFrame, end: str) -> DataFrame:
    """Rows of the records whose keys (or first characters of them) are asked for; all without any."""
    if not a.texts:
        return rows
    keys = [F.startswith(F.col(end), F.lit(k)) for k in a.texts]
    return rows.where(reduce(or_, keys))


COMMANDS = {
    "search": lambda spark, e, a: e.search(_queries(spark, a), a.limit, a.scope).orderBy("query_id", "place"),
    "slice": lambda spark, e, a: e.slice(_queries(spark, a), a.limit, a.scope).orderBy("query_id", "hop", "place"),
    "assemble": lambda spark, e, a: e.assemble(_queries(spark, a), a.scope, a.limit).orderBy("query_id", "origin", "place"),
    "get": lambda spark, e, a: e.get(_keys(spark, a)),
    "timeline": lambda spark, e, a: e.timeline(_keys(spark, a).select("key")),
    "save": lambda spark, e, a: e.save(_queries(spark, a)),
    "list": lambda spark, e, a: store.scoped(e.records, a.scope).orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(a.limit).select("id", "title", "project", "importance"),
    "status": lambda spark, e, a: ledger.status(e.records.withColumn("decay_immune", F.lit(False))),
    "audit": lambda spark, e, a: graph.audit_report(graph.audit(e.edges, e.records)).orderBy("finding"),
    "replay": _replay,
    "summary": lambda spark, e, a: analytics.replay_summary(_replay(spark, e, a)),
    "worst": lambda spark, e, a: analytics.worst(_replay(spark, e, a), a.limit).orderBy("place"),
    "similar": lambda spark, e, a: fuzzy.bands(_queries(spark, a).select(F.col("query_id").alias("new_id"), F.col("query").alias("text")), store.scoped(e.valid, a.scope).select("id", F.col("essence").alias("body"))).orderBy("new_id"),
    "import": lambda spark, e, a: imports.new_records(spark, a.texts[0], e.valid, e.now, a.scope),
    "related": lambda spark, e, a: _near(spark, a, graph.suggestions(e.edges, a.limit), "src").orderBy("src", "rank"),
    "reverse": lambda spark, e, a: _near(spark, a, graph.reverse_neighbours(e.edges, a.limit), "dst").orderBy("dst", "rank"),
    "links": lambda spark, e, a: _near(spark, a, graph.report(e.edges, a.limit), "id").orderBy("id"),
    "sources": lambda spark, e, a: e.records.groupBy("project").agg(F.count("*").alias("records"), F.count_if(F.col("status") == "active").alias("active")).orderBy("project"),
}


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    a = arguments(argv)
    now = F.lit(a.now).cast("timestamp_ntz") if a.now else F.current_timestamp().cast("timestamp_ntz")
    records = spark.read.parquet(a.records)
    if a.since:
        hours = rules.duration_hours(F.lit(a.since))
        records = records.where(F.col("created_at") >= now - F.make_dt_interval(secs=hours * 3600))
    engine = Engine(records, now, edges=spark.read.parquet(a.edges) if a.edges else None)
    return COMMANDS[a.command](spark, engine, a)


def main() -> None:
    for row in run(session("lodestone"), sys.argv[1:]).toLocalIterator():
        print(json.dumps(row.asDict(True), default=str))


if __name__ == "__main__":
    main()
