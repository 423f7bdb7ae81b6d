"""The write path: new records with their links, contradictions, postings, vectors and edges, each table by its changed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import graph, retrieval, store


#: Records whose postings one task counts.
RECORDS = 4096


def postings(records: DataFrame) -> DataFrame:
    """(id, term, tf): the full-text rows of records, over title, text and tags.

    Records are dealt by id before their words are: so a record's words meet in the task that makes them, none is shuffled,
    and what a task counts does not grow with the store or with the files that it is read from.
    """
    usual = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(records.sparkSession.sparkContext.defaultParallelism, -(-records.count() // RECORDS))
    # Records that a join has dealt by id to the usual number would stay in its tasks, which Spark unites as it finds them small.
    tasks += tasks == usual
    records = records.select("id", "title", "essence", "tags").repartition(tasks, "id")
    text = F.concat_ws(" ", "title", "essence", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    return records.select("id", F.explode(T.tokens(text)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def replaced(table: DataFrame, changed: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """A table in which the rows of changed keys are those given: one anti join on the key, no rebuild."""
    return table.join(changed.select(key).distinct(), key, "left_anti").unionByName(rows.select(table.columns))


def embedded(records: DataFrame, encoder) -> DataFrame:
    """(id, vector) by an encoder of whole batches of texts: title, a dash, text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def encode(text):  # noqa: ANN001, ANN202
        return encoder(text)

    return records.select("id", encode(F.concat_ws(" — ", "title", "essence")).alias("vector"))


class Tables:
    """A store: records, postings, vectors and the state of its graph (the last two may be None)."""

    def __init__(self, records: DataFrame, terms: DataFrame | None = None, vectors: DataFrame | None = None, state: graph.State | None = None):
        self.records, self.vectors, self.state = records, vectors, state
        self.postings = postings(records) if terms is None else terms

    @property
    def edges(self) -> DataFrame | None:
        return graph.published(self.state.own) if self.state else None


def changed(tables: Tables, new: DataFrame, gone: DataFrame | None = None, encoder=None) -> Tables:
    """The store after records were added or replaced (new, with the columns of the records) and deleted (gone: id).

    Every derived table follows for the ids that changed: postings and vectors by one anti join, the graph by what their
    tokens can reach (`graph.maintained`). Equal to a full build over the records that there are then.
    """
    touched = new.select("id").union(gone.select("id")).distinct() if gone is not None else new.select("id").distinct()
    records = replaced(tables.records, touched, new)
    out = Tables(records, replaced(tables.postings, touched, postings(new)), tables.vectors, tables.state)
    if encoder is not None and tables.vectors is not None:
        out.vectors = replaced(tables.vectors, touched, embedded(new, encoder))
    if tables.state is not None:
        out.state = graph.maintained(tables.state, store.valid_now(records), touched)
    return out


def insert(tables: Tables, new: DataFrame, now: Column, encoder=None) -> Tables:
    """The store after new records: related ones are linked, all derived tables follow for the ids that changed only.

    new has the columns of the records. A record that exists already (by id) is replaced.
    """
    asked = new.select(F.col("id").alias("query_id"), F.col("essence").alias("query"), "project", F.col("id").alias("own"))
    found = retrieval.related(asked, store.valid_now(tables.records)).groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("to")))), lambda x: x["to"]).alias("found"))
    linked = new.join(found, "id", "left").withColumn("related", F.array_union(F.coalesce("related", F.array().cast("array<string>")), F.coalesce("found", F.array().cast("array<string>")))).drop("found")
    return changed(tables, linked.select(new.columns), encoder=encoder)


def added(mined: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates all added as they are, where no decision on them could be had; ids that are there already stay out."""
    return candidates.join(mined.select("id"), "id", "left_anti")
