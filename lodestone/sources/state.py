"""What an engine remembers between runs, as keyed tables: session states, names and times, scores, lessons, canaries.

Every write is one commit of a `keyed.Table`; what is inserted only if it is absent is worked out on one version and again
if another writer was faster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import identity
from lodestone.sources.keyed import Conflict, Table

SESSIONS = "session string, status string, attempts int, offset_bytes long, mtime_ns long, size long, version string, updated_at string, message string, last_error string"
LESSONS = "id string, targeted string, query_class string, anti_pattern string, evidence string, source string, created_at timestamp_ntz"
CANARIES = "canary_id string, title string, query string, planted_at timestamp_ntz"


def insert_absent(table: Table, rows: DataFrame, tries: int = 5) -> int:
    """Adds rows whose key the table lacks (of several with one key any one); returns the version's number."""
    for left in reversed(range(tries)):
        based = table.version()
        new = rows.dropDuplicates(table.key).join(table.read(based.number).select(*table.key), table.key, "left_anti")
        try:
            return table.upsert(new, based=based).number
        except Conflict:
            if not left:
                raise
    return table.version().number


class State:
    """The tables below one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark = spark
        make = lambda name, key, schema: Table(spark, f"{path.rstrip('/')}/{name}", key, schema, buckets)
        self.sessions = make("sessions", ["session"], SESSIONS)
        self.names = make("names", ["name"], "name string, value string")
        self.scores = make("scores", ["query_class", "id"], "query_class string, id string, score double")
        self.telemetry = make("telemetry", ["id"], "id string, access_count long, last_accessed timestamp_ntz")
        self.recalls = make("recalls", ["session"], "session string, ids array<string>, updated_at timestamp_ntz")
        self.lessons = make("lessons", ["id"], LESSONS)
        self.canaries = make("canaries", ["canary_id"], CANARIES)

    # --- sessions -----------------------------------------------------------------------------------------------------

    def mined(self, sessions: DataFrame) -> int:
        """Records sessions (session) as mined, those that are there already excepted."""
        return insert_absent(self.sessions, sessions.select("session", F.lit("complete").alias("status")))

    def migrated(self, lines: DataFrame) -> str:
        """Takes over states from the lines of a log (line); what is here already counts. Returns what the log was:
        `states`, `ids` (a plain list of sessions, which says no states: nothing is taken over), `corrupt` or `empty`."""
        fields = "session_id string, status string, attempts int, offset_bytes long, mtime_ns long, size long, version string, updated_at string, message string"
        told = lines.where("trim(line) <> ''").select(F.trim("line").alias("line"))
        rows = told.where(F.startswith("line", F.lit("{"))).select(F.from_json("line", fields).alias("s")).where("trim(coalesce(s.session_id, '')) <> ''")
        kinds = told.agg(F.count("*").alias("n"), F.count_if(F.col("line").rlike(r"^[a-zA-Z0-9._/-]+$")).alias("ids")).first()
        if not kinds.n:
            return "empty"
        if kinds.ids == kinds.n:
            return "ids"
        if rows.isEmpty():
            return "corrupt"
        message = F.coalesce("s.message", F.lit(""))
        insert_absent(self.sessions, rows.select(
            F.trim("s.session_id").alias("session"), F.coalesce("s.status", F.lit("complete")).alias("status"), F.coalesce("s.attempts", F.lit(0)).alias("attempts"), F.coalesce("s.offset_bytes", F.lit(0).cast("long")).alias("offset_bytes"),
            "s.mtime_ns", "s.size", F.coalesce("s.version", F.lit("")).alias("version"), F.coalesce("s.updated_at", F.lit("")).alias("updated_at"), message.alias("message"), message.alias("last_error"),
        ))
        return "states"

    # --- names and times ----------------------------------------------------------------------------------------------

    def put(self, name: str, value: str | None) -> None:
        """A named value: the time of the last run, the time of the install; None takes it away."""
        row = self.spark.createDataFrame([(name, value)], "name string, value string")
        self.names.upsert(row) if value is not None else self.names.delete(row)

    def get(self, name: str, default: str | None = None) -> str | None:
        found = self.names.lookup(name).first()
        return found.value if found else default

    def ensured(self, name: str, value: str) -> str:
        """A named value that is set once: the first that anybody gave."""
        insert_absent(self.names, self.spark.createDataFrame([(name, value)], "name string, value string"))
        return self.get(name)

    # --- point reads --------------------------------------------------------------------------------------------------

    def used(self, ident: str) -> tuple[int, object]:
        """(access count, last access) of a record by its eight-character key; (0, None) if it was never used."""
        found = self.telemetry.lookup(ident.strip()[:8]).first()
        return (found.access_count, found.last_accessed) if found else (0, None)

    def recalled(self, session: str) -> list[str]:
        """The ids recalled in a session, by the first twelve characters of its name; none if nothing was."""
        found = self.recalls.lookup(session.strip()[:12]).first()
        return list(found.ids) if found and found.ids else []

    # --- lessons and canaries -----------------------------------------------------------------------------------------

    def learn(self, lessons: DataFrame, now: Column) -> int:
        """Records lessons (targeted, query_class, anti_pattern, evidence, source); the same lesson again is one row."""
        made = lessons.select(
            identity.uuid5(F.concat_ws("\n", F.lit("lesson"), "targeted", "query_class", "anti_pattern")).alias("id"), "targeted", "query_class", F.substring("anti_pattern", 1, 200).alias("anti_pattern"),
            F.substring(F.coalesce("evidence", F.lit("")), 1, 500).alias("evidence"), F.coalesce("source", F.lit("manual")).alias("source"), now.alias("created_at"),
        )
        return insert_absent(self.lessons, made)

    def plant(self, canaries: DataFrame, now: Column) -> DataFrame:
        """Adds canaries (canary_id, title, query) and returns all there are; a planted one stays as it is."""
        insert_absent(self.canaries, canaries.select("canary_id", "title", "query", now.alias("planted_at")))
        return self.canaries.read()


def isolated(records: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `run` makes of a copy of the records that nothing else reads or writes."""
    from lodestone.sources import scratch

    return scratch.written(run(scratch.written(records, "copy")), "result")
