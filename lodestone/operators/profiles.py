"""Profiles: short texts of facts by section, to which accepted lines are added one after the other.

Each accepted line changes what the next one is compared with, so lines are folded in order, profile by profile: a line that
is like one of its section (token-set ratio from 0.85) is a duplicate; one that would make the rendered profile longer than
`most` characters has the profile compacted first, or is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import edit, rules
from lodestone.operators.fold import folded

MOST, LIKE, MOST_LINE = 2500, 0.85, 200
#: Sections of the user's profile and of a project's.
USER_SECTIONS, PROJECT_SECTIONS = ("Preferences", "Conventions", "Environment"), ("Identity", "Stack & Structure", "Conventions")
OUTCOMES = ("appended", "duplicate", "invalid_section", "compacted+appended", "rejected_full", "error")


def sections_of(profile: str) -> tuple[str, ...]:
    return USER_SECTIONS if profile == "user" else PROJECT_SECTIONS


def canonical(profile: str, section: str | None) -> str | None:
    """The schema's name of a section; case does not count and "and" is "&"."""
    plain = lambda s: s.strip().lower().replace(" and ", " & ")
    return {plain(s): s for s in sections_of(profile)}.get(plain(section or ""))


def title(profile: str) -> str:
    return "User Profile" if profile == "user" else f"{profile} Profile"


def rendered(profile: str, facts: dict[str, list[str]]) -> str:
    """The profile as Markdown: all sections in order, a bullet for each fact."""
    lines = [f"# {title(profile)}", ""]
    for section in sections_of(profile):
        lines += [f"## {section}", *(f"- {x}" for x in facts.get(section, [])), ""]
    return "\n".join(lines).rstrip() + "\n"


class Profile:
    """The state of a fold: facts by section."""

    def __init__(self):
        self.facts: dict[str, list[str]] = {}

    def add(self, profile: str, section: str | None, line: str | None, threat: str | None, compact: Callable | None, most: int) -> str:
        name = canonical(profile, section)
        if name is None:
            return "invalid_section"
        line = (line or "").replace("\n", " ").replace("\r", " ").strip()
        if not line or len(line) > MOST_LINE or threat:
            return "error"
        if any(edit.token_set(line, x, LIKE) >= LIKE for x in self.facts.get(name, [])):
            return "duplicate"
        longer = self.facts | {name: [*self.facts.get(name, []), line]}
        if len(rendered(profile, longer)) <= most:
            self.facts = longer
            return "appended"
        shorter = compact(profile, longer) if compact else None
        if shorter is None or len(rendered(profile, shorter)) > most:
            return "rejected_full"
        self.facts = shorter
        return "compacted+appended"


def append(facts: DataFrame, proposals: DataFrame, compact: Callable[[str, dict[str, list[str]]], dict[str, list[str]] | None] | None = None, most: int = MOST) -> DataFrame:
    """(kind, profile, section, seq, line, outcome): an `outcome` row for each proposal (profile, section, seq, line), and the
    `fact` rows of every profile afterwards (seq: place in its section).

    facts: (profile, section, pos, line), as `maintenance.profile_facts` reads them; those of unknown sections are ignored.
    compact: makes the facts of a profile shorter (a model, for one); it gets those with the new line among them.
    """
    old = facts.select("profile", F.lit(0).alias("kind"), F.col("pos").cast("long").alias("seq"), "section", "line", F.lit(None).cast("string").alias("threat"))
    new = proposals.select("profile", F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), "section", "line", rules.threat(F.col("line")).alias("threat"))

    def step(state: Profile, row) -> list[tuple]:
        if row.kind == 0:
            name = canonical(row.profile, row.section)
            if name is not None:
                state.facts.setdefault(name, []).append(row.line)
            return []
        return [("outcome", row.profile, row.section, row.seq, row.line, state.add(row.profile, row.section, row.line, row.threat, compact, most))]

    def finish(key: tuple, state: Profile) -> list[tuple]:
        return [("fact", key[0], s, i, line, None) for s in sections_of(key[0]) for i, line in enumerate(state.facts.get(s, []))]

    return folded(old.unionByName(new), ["profile"], ["kind", "seq", "section", "line"], Profile, step, finish, "kind string, profile string, section string, seq long, line string, outcome string")


def texts(facts: DataFrame) -> DataFrame:
    """(profile, text) of fact rows: a profile is bounded, so its lines fit one row."""
    lines = F.array_sort(F.collect_list(F.struct("section", "seq", "line")))

    @F.udf("string")
    def text(profile, rows):  # noqa: ANN001, ANN202
        own: dict[str, list[str]] = {}
        for r in rows:
            own.setdefault(r["section"], []).append(r["line"])
        return rendered(profile, own)

    return facts.groupBy("profile").agg(lines.alias("rows")).select("profile", text("profile", "rows").alias("text"))


def injected(profile_texts: DataFrame, scopes: DataFrame, most: int = 1200) -> DataFrame:
    """(scope, text): what a session starts with: the user's profile and, but for `general`, the project's, each cut before
    the line that would take it over `most` characters; empty without either."""
    lines = F.split("text", "\n")
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x) + 1)
    first = F.filter(lines, lambda x, i: size(F.slice(lines, 1, i + 1)) <= most)
    cut = profile_texts.select("profile", F.rtrim(F.when(F.length("text") <= most, F.col("text")).otherwise(F.array_join(first, "\n")), F.lit(" \n")).alias("part")).where("part <> ''")
    asked = scopes.select("scope").distinct()
    both = asked.select("scope", F.lit(0).alias("n"), F.lit("user").alias("profile")).unionByName(asked.where("scope NOT IN ('', 'general', 'user')").select("scope", F.lit(1).alias("n"), F.col("scope").alias("profile")))
    parts = both.join(cut, "profile").groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n\n").alias("text"))
    return asked.join(parts, "scope", "left").select("scope", F.coalesce("text", F.lit("")).alias("text"))
