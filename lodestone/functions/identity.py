"""Identifiers and names that follow from content: stable ids, hashes, projects, dates, conversation text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators import sessions

#: Fixed value: the URL namespace of name-based UUIDs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def stable_id(kind: Column, payload: Column) -> Column:
    """Twelve hexadecimal digits that depend on a kind and a payload alone."""
    return F.substring(F.md5(F.concat(kind, F.lit(":"), payload)), 1, 12)


def essence_hash(essence: Column) -> Column:
    return F.sha2(F.coalesce(essence, F.lit("")), 256)


def uuid5(seed: Column) -> Column:
    """The name-based UUID (version 5) of a seed in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(seed, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def mined_id(session: Column, title: Column, content: Column) -> Column:
    """The id of a mined record: the same session, title and content give the same id in every run."""
    return uuid5(F.concat_ws("\n", session, F.trim(title), F.trim(content)))


def project_of_path(path: Column, home: str) -> Column:
    """The project of a transcript file: its folder's name, which holds the working folder with - for /, without the home."""
    munged = home.replace("/", "-")
    folder = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    inner = F.when(F.startswith(folder, F.lit(munged + "-")), F.substring(folder, F.lit(len(munged) + 2), F.length(folder))).otherwise(folder)
    return F.when((folder == munged) | (folder == ""), "general").otherwise(inner)


def project_of_title(title: Column, project: Column) -> Column:
    """The name in square brackets that a title begins with, else the record's project."""
    named = F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), r"^\[([^\]]+)\]", 1), F.lit(""))
    return F.coalesce(named, F.nullif(project, F.lit("")), F.lit("general"))


def filename_id(name: Column) -> Column:
    """The part of a record's file name after its last dash."""
    return F.substring_index(F.regexp_replace(name, r"\.md$", ""), "-", -1)


def date_key(value: Column) -> Column:
    """A sortable time; what does not parse comes before all others."""
    return F.coalesce(F.try_to_timestamp(value), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def conversation_line(role: Column, text: Column) -> Column:
    """A turn as a line with its role; noise leaves user turns only, and a turn without text has no line."""
    user = F.nullif(sessions.strip_noise(text), F.lit(""))
    return F.when(role == "user", F.concat(F.lit("User: "), user)).when(role == "assistant", F.concat(F.lit("Assistant: "), F.nullif(text, F.lit(""))))


def tool_line(block: Column) -> Column:
    """A tool call (name, input map) as a short line; null for other blocks."""
    name, given = block["name"], block["input"]
    at = lambda key: F.try_element_at(given, F.lit(key))
    file = F.coalesce(at("file_path"), F.lit(""))
    line = (
        F.when(name.isin("Read", "Glob", "Grep"), F.concat(F.lit("[Tool: "), name, F.lit(" "), F.coalesce(at("file_path"), at("pattern"), F.lit("")), F.lit("]")))
        .when(name.isin("Edit", "Write"), F.concat(F.lit("[Tool: "), name, F.lit(" "), file, F.lit("]")))
        .when(name == "Bash", F.concat(F.lit("[Tool: Bash] "), F.substring(F.coalesce(at("command"), F.lit("")), 1, 200)))
        .otherwise(F.concat(F.lit("[Tool: "), F.coalesce(name, F.lit("")), F.lit("]")))
    )
    return F.when(block["type"] == "tool_use", line)


def tool_summary(blocks: Column) -> Column:
    """The tool calls of a message's blocks, a line each; null without one."""
    lines = F.filter(F.transform(blocks, tool_line), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))
