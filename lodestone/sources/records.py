"""Record files: Markdown with front matter, JSONL logs, imports, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: Field names of the record format.
SCALARS = ("id", "title", "project", "source_type", "source_session", "status", "created", "updated", "last_accessed_at", "valid_at", "invalid_at", "valid_to", "replaced_by")
NUMBERS = {"importance": 3, "layer": None, "schema_version": 0}
LISTS = ("tags", "related", "contradicts", "references", "keys", "paths")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """file, modified, raw: one row for each Markdown file below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("raw"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that known (file, modified) lacks or has in another version."""
    return files.join(known, ["file", "modified"], "left_anti")


def front_matter(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined): fields of the block between the first two --- lines, the rest as essence.

    Numbers that do not parse take their defaults and a stored 0 stays; files without a block or an id are quarantined.
    """
    block = F.regexp_extract("raw", r"\A---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|\z)", 1)
    body = F.trim(F.regexp_replace("raw", r"\A---\r?\n[\s\S]*?\r?\n---(?:\r?\n|\z)", ""))
    base = files.select("file", "modified", block.alias("block"), body.alias("body"))
    field = lambda name: F.nullif(F.regexp_replace(F.trim(F.regexp_extract("block", rf"(?m)^{name}:[ \t]*(.*)$", 1)), r"^[\"']|[\"']$", ""), F.lit(""))
    records = base.select(
        "file", "modified", *(field(n).alias(n) for n in SCALARS if n not in ("title", "status")),
        F.coalesce(field("title"), T.title(F.col("body"))).alias("title"), F.coalesce(field("status"), F.lit("active")).alias("status"),
        *(F.coalesce(field(n).try_cast("int"), F.lit(d).cast("int")).alias(n) for n, d in NUMBERS.items()),
        F.coalesce(F.lower(field("decay_immune")).isin("true", "1", "yes"), F.lit(False)).alias("decay_immune"),
        *(listed(n).alias(n) for n in LISTS), F.trim(F.regexp_replace("body", r"(?s)\n## Related\b.*$", "")).alias("essence"),
    )
    return records.where("id IS NOT NULL"), records.where("id IS NULL").select("file", "modified")


def listed(name: str) -> Column:
    """A list field, inline as [a, b] or as lines that begin with a dash."""
    inline = F.regexp_extract("block", rf"(?m)^{name}:[ \t]*\[(.*)\][ \t]*$", 1)
    lines = F.regexp_extract("block", rf"(?m)^{name}:[ \t]*\r?\n((?:[ \t]*- .*(?:\r?\n|$))+)", 1)
    strip = lambda xs: F.filter(F.transform(xs, lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")), lambda x: x != "")
    return F.when(F.trim(inline) != "", strip(F.split(inline, ","))).otherwise(strip(F.regexp_extract_all(lines, F.lit(r"(?m)^[ \t]*- (.+)$"), F.lit(1))))


def to_markdown(records: DataFrame) -> DataFrame:
    """id and the record as a Markdown text with its fields in canonical order."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise("")
    clean = lambda c: F.regexp_replace(c.cast("string"), r"[\r\n]+", " ")
    arrays = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: T.sanitised_tag(x)), ", "), F.lit("]")))
    parts = [line(n, clean(F.col(n))) for n in (*SCALARS, *NUMBERS) if n in records.columns] + [line(n, arrays(F.col(n))) for n in LISTS if n in records.columns]
    return records.select("id", F.concat(F.lit("---\n"), *parts, F.lit("---\n"), F.coalesce("essence", F.lit("")), F.lit("\n")).alias("text"))


def log(spark: SparkSession, path: str, schema: str, now: Column, days: float | None = None, tagged: bool = False) -> DataFrame:
    """An append-only JSONL log; malformed lines drop out, as do rows older than `days` and, by default, tagged ones."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if days is not None:
        rows = rows.where(F.try_to_timestamp(F.col("ts").cast("string")) >= now - F.make_dt_interval(secs=F.lit(days * 86400)))
    return rows if tagged or "source_tag" not in rows.columns else rows.where("source_tag IS NULL")


def vaults(readers: dict[str, DataFrame]) -> DataFrame:
    """Valid records of several stores with the name of each."""
    out = None
    for name, df in readers.items():
        one = df.where("status <> 'deprecated' AND invalid_at IS NULL").withColumn("vault", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
