"""Imports of a folder: Markdown by section, JSON by item, text files whole, as records that the store does not have yet.

Markdown is cut at headings of one to three marks; a section counts with more than 20 characters, its title is the heading
(the file's name before the first one). A JSON object is one item; of an array up to 20, those with more than 20 characters
(an item's `title` is its title). Text files are one item. Items are cut at 2,000 characters. Files under 20 characters,
other kinds of files and JSON that does not parse give nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import identity
from lodestone.operators import fuzzy

MOST_CHARS, LEAST_CHARS, MOST_ITEMS = 2000, 20, 20
MARKDOWN, TEXT = (".md", ".markdown"), (".txt", ".text", ".rst")


def items_of(name: str, content: str) -> list[tuple[str, str]]:
    """(title, text) of what a file holds."""
    path = PurePosixPath(name)
    kind, stem = path.suffix.lower(), path.stem
    if len(content.strip()) < LEAST_CHARS:
        return []
    if kind in MARKDOWN:
        out, title, body = [], stem, ""
        for part in (*re.split(r"^(#{1,3}\s+.+)$", content, flags=re.MULTILINE), None):
            if part is None or re.match(r"#{1,3}\s+", part.strip()):
                if len(body.strip()) > LEAST_CHARS:
                    out.append((title, body.strip()[:MOST_CHARS]))
                title, body = (part or "").strip().lstrip("# ").strip(), ""
            elif part.strip():
                body += part.strip() + "\n"
        return out
    if kind == ".json":
        try:
            data = json.loads(content)
        except ValueError:
            return []
        if isinstance(data, dict):
            return [(stem, json.dumps(data, indent=2)[:MOST_CHARS])]
        out = []
        for item in data[:MOST_ITEMS] if isinstance(data, list) else []:
            text = item if isinstance(item, str) else json.dumps(item, indent=2)
            if len(text) > LEAST_CHARS:
                out.append((str(item.get("title", stem))[:60] if isinstance(item, dict) else stem, text[:MOST_CHARS]))
        return out
    return [(stem, content.strip()[:MOST_CHARS])] if kind in TEXT else []


def items(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, title, text) of all files below path; each file is read by the task that cuts it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown,json,txt,text,rst,MD,JSON,TXT}").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, i, t, x) for f, c in zip(b.column(0).to_pylist(), b.column(1), strict=True) for i, (t, x) in enumerate(items_of(f, c.as_py().decode("utf-8", "ignore")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], ["file", "pos", "title", "text"])

    return files.select("path", "content").mapInArrow(run, "file string, pos int, title string, text string")


def new_records(spark: SparkSession, path: str, records: DataFrame, now: Column, project: str = "general", least: float = fuzzy.LEAST) -> DataFrame:
    """Records to be saved: what the store (id, essence), and what was imported before it in order of files, is not like."""
    found = items(spark, path).withColumn("new_id", F.concat("file", F.lit("#"), F.lpad(F.col("pos").cast("string"), 4, "0")))
    fresh = fuzzy.fresh(found, records.select("id", F.col("essence").alias("body")), least)
    return fresh.select(
        identity.uuid5(F.concat(F.lit("import:"), F.col("new_id"))).alias("id"), "title", F.col("text").alias("essence"), F.lit(project).alias("project"),
        F.array(F.lit("imported")).alias("tags"), F.lit("import").alias("source_type"), now.alias("created_at"),
    )
