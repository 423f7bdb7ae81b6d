"""Incremental ingestion with Structured Streaming: transcripts, sessions, counters, idempotent effects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions import identity
from lodestone.streaming import growing

#: Days for which the state of a silent key is kept.
KEPT_DAYS = 30
MESSAGE = "type string, uuid string, sessionId string, timestamp string, role string, text string, content string, message struct<role:string,content:string>"


def transcript_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of JSONL files that do not grow, as a stream: line, file. Spark reads each file once; for files that grow, see
    `appended` and `advance`."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def appended(spark: SparkSession, path: str, offsets: DataFrame | None) -> DataFrame:
    """(file, offset, line): what files have gained beyond their offsets (file, offset), by whole lines, each with the place
    after it. Only what is new is read, see `growing`; the driver holds one length for each file."""
    since = {r.file: r.offset for r in offsets.select("file", "offset").collect()} if offsets is not None else {}
    return growing.tail(spark, path, since).select("file", F.col("ends").alias("offset"), "line")


def advance(spark: SparkSession, path: str, state: str, work: Callable[[DataFrame, int], None]) -> int:
    """One pass over grown files: `work` gets their new lines (line, file) and the pass's number.

    What a pass reads is fixed in the checkpoint under `state` before it runs. A pass that fails is given the same lines
    and number again, whatever the files have gained since; a pass that ended well is not repeated. Returns the number of
    files with new lines.
    """
    grown, failed = [0], []

    def effect(batch: DataFrame, number: int) -> None:
        files = batch.select("file").distinct().count()
        if files:
            try:
                work(batch.select("line", "file"), number)
            except Exception as e:
                failed.append(e)
                raise
        grown[0] += files

    query = growing.stream(spark, path).writeStream.foreachBatch(effect).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if failed:
            raise failed[-1] from None
        raise
    return grown[0]


def reopened(files: DataFrame, state: DataFrame) -> DataFrame:
    """Sessions (session, size) that were done but have grown past their offset: late rows open them again."""
    done = state.where("status = 'complete'").select("session", "offset_bytes")
    return files.join(done, "session").where(F.col("size") > F.coalesce("offset_bytes", F.lit(0))).select("session", "offset_bytes", "size")


def stale(files: DataFrame, mined: DataFrame, now: Column, quiet_seconds: int = 600, most: int = 3) -> DataFrame:
    """Unmined files (session, modified) that have been quiet, the oldest first, at most `most` a trigger."""
    quiet = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("modified").cast("timestamp")) >= quiet_seconds
    return files.where(quiet).join(mined.select("session"), "session", "left_anti").orderBy("modified", "session").limit(most)


def counted(path: str, every: int, start: Callable[[int], None], found: str = "found") -> Callable[[DataFrame, int], None]:
    """A foreachBatch effect that counts productive deltas and calls `start` for every `every`th, keeping the rest.

    The count is written by batch number, so a batch that is repeated counts once; `start` must bear being called again.
    """

    def effect(batch: DataFrame, number: int) -> None:
        before = latest(batch.sparkSession, path, number)
        total = (before.first()[0] if before is not None else 0) + batch.where(F.col(found) > 0).count()
        for _ in range(total // every):
            start(number)
        batch.sparkSession.createDataFrame([(total % every,)], "n long").write.mode("overwrite").parquet(f"{path}/v={number}")

    return effect


def episodes(turns: DataFrame) -> DataFrame:
    """(id, session, title, essence, updated_at): one record for each session, under the same id however often it is made.

    The title is the first user message, the essence the turns as text; a summary of it is the caller's.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ts", "uuid", "role", "text")))
    users = F.filter(ordered, lambda x: x["role"] == "user")
    said = F.array_join(F.transform(ordered, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n\n")
    made = turns.groupBy("session").agg(F.substring(F.try_element_at(users, F.lit(1))["text"], 1, 120).alias("title"), said.alias("essence"), F.max("ts").alias("updated_at"))
    return made.select(identity.uuid5(F.concat(F.lit("episode:"), F.col("session"))).alias("id"), "session", F.coalesce("title", F.lit("")).alias("title"), "essence", "updated_at")


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, rejected): user, assistant and system turns with text; lines that are no JSON objects go to a quarantine."""
    v = lines.withColumn("j", F.from_json("line", MESSAGE, {"mode": "PERMISSIVE"}))
    good = F.try_parse_json("line").isNotNull() & F.startswith(F.trim("line"), F.lit("{"))
    content = F.coalesce("j.message.content", "j.text", "j.content")
    blocks = F.from_json(content, "array<struct<type:string,text:string,name:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: F.trim(b["text"])), "\n")
    text = F.trim(F.when(F.startswith(F.trim(content), F.lit("[")), F.coalesce(joined, F.lit(""))).otherwise(content))
    role = F.coalesce("j.message.role", "j.role", "j.type")
    turns = v.where(good).select(F.coalesce("j.sessionId", F.col("file")).alias("session"), F.col("j.uuid").alias("uuid"), F.try_to_timestamp("j.timestamp").alias("ts"), role.alias("role"), text.alias("text"))
    rejected = v.where(~F.coalesce(good, F.lit(False)) & (F.trim("line") != "")).select("line", "file")
    return turns.where(F.col("role").isin("user", "assistant", "system") & (F.coalesce("text", F.lit("")) != "")), rejected


def settled(events: DataFrame, key: str, ts: str, quiet: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a quiet period: key, started, ended, events, each once it is final.

    Rows later than the watermark allows are dropped here; `sessions.sessionize` over the stored events is the backstop
    that opens their session again.
    """
    w = F.session_window(ts, quiet)
    return events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def daily(events: DataFrame, ts: str, *keys: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), *keys, "n")


def backoff(batches: DataFrame, key: str, found: str, empties: int = 3, skip: int = 5, kept_days: int = KEPT_DAYS) -> DataFrame:
    """For each delta (key, seq, found): whether to work on it. After `empties` deltas without a find, `skip` are passed over.

    The state of a key that has been silent for `kept_days` is dropped.
    """

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        streak, passing = state.get if state.exists else (0, 0)
        for pdf in pdfs:
            out = []
            for row in pdf.sort_values("seq").itertuples():
                if passing > 0:
                    passing, work = passing - 1, False
                else:
                    work = True
                    streak = 0 if getattr(row, found) > 0 else streak + 1
                    if streak >= empties:
                        streak, passing = 0, skip
                out.append((k[0], int(row.seq), work))
            yield pd.DataFrame(out, columns=[key, "seq", "work"])
        state.update((streak, passing))
        state.setTimeoutDuration(kept_days * 86_400_000)

    kind = batches.schema[key].dataType.simpleString()
    return batches.select(key, "seq", found).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq long, work boolean", "streak int, passing int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def moving_average(events: DataFrame, key: str, outcome: str, keep: float = 0.7, kept_days: int = KEPT_DAYS) -> DataFrame:
    """The moving average of outcomes (key, seq, outcome) after each batch, kept as state until a key has been silent for
    `kept_days`."""

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        score = state.get[0] if state.exists else 0.0
        for pdf in pdfs:
            for x in pdf.sort_values("seq")[outcome]:
                score = keep * score + (1 - keep) * float(x)
        state.update((score,))
        state.setTimeoutDuration(kept_days * 86_400_000)
        yield pd.DataFrame({key: [k[0]], "score": [score]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "seq", outcome).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, score double", "score double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_into(path: str, key: list[str], order: Column, work: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch effect that may run again: rows of a batch replace those with their key, version by version.

    Each batch writes the folder `v=<batch>`; a reader takes the highest. A batch that is repeated writes the same folder.
    """

    def effect(batch: DataFrame, number: int) -> None:
        rows = work(batch) if work else batch
        newest = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_place = 1").drop("_place")
        before = latest(rows.sparkSession, path, number)
        if before is not None:
            newest = newest.unionByName(before.join(newest.select(key), key, "left_anti"))
        newest.write.mode("overwrite").parquet(f"{path}/v={number}")

    return effect


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    whole = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in whole if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def latest(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest finished version under path (below a number), None without one."""
    numbers = [n for n in _versions(spark, path) if below is None or n < below]
    return spark.read.parquet(f"{path}/v={numbers[-1]}") if numbers else None
