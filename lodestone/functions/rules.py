"""Rule predicates over texts: threats, credentials, acknowledgements, negation, tense, time phrases, personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists, in the order in which they are tried.
INVISIBLE = ("​", "‌", "‍", "⁠", "﻿", "‪", "‫", "‬", "‭", "‮")
THREATS = (
    (r"ignore\s+.{0,20}(previous|prior|above|all)\s+.{0,10}instructions", "prompt_injection"),
    (r"ignore\s+(previous|all|above|prior)\s+instructions", "prompt_injection"),
    (r"you\s+are\s+now\s+", "role_hijack"),
    (r"do\s+not\s+tell\s+the\s+user", "deception"),
    (r"system\s+prompt\s+override", "sys_prompt_override"),
    (r"disregard\s+(your|all|any)\s+(instructions|rules|guidelines)", "disregard_rules"),
    (r"act\s+as\s+(if|though)\s+you\s+(have\s+no|don't\s+have)\s+(restrictions|limits|rules)", "bypass_restrictions"),
    (r"curl\s+[^\n]*\$\{?\w*(KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|API)", "exfil_curl"),
    (r"wget\s+[^\n]*\$\{?\w*(KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|API)", "exfil_wget"),
    (r"cat\s+[^\n]*(\.env|credentials|\.netrc|\.pgpass|\.npmrc|\.pypirc)", "read_secrets"),
    (r"authorized_keys", "ssh_backdoor"),
    (r"\$HOME/\.ssh|~/\.ssh", "ssh_access"),
)
CREDENTIALS = (
    r"ghp_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"gh[oush]_[A-Za-z0-9]{20,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"sk-ant-[A-Za-z0-9_-]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"xox[abprs]-[A-Za-z0-9-]{20,}",
)
NEGATIONS = ("removed", "no longer", "replaced", "deprecated", "instead of", "stopped using", "switched from", "ripped out", "deleted", "no more", "eliminated", "dropped", "abandoned", "reversed")
FUTURE = r"(?i)\b(will|plan(?:ning)?\s+to|going\s+to|next\s+week|tomorrow|upcoming)\b"
ACKNOWLEDGED = r"(?i)^\s*(ok|yes|go|thanks|sure|nope|no)\s*\.?\s*$"
POSITIVE = (r"(?i)\b(yes|perfect|exactly|great|good|correct|nice|thanks|approved|lgtm|ship it)\b", r"(?i)\b(works?|working|done|merged|pushed|committed)\b")
NEGATIVE = (r"(?i)\b(wrong|don't|stop|revert|undo|rollback|broken|bug|fail|incorrect)\b", r"(?i)\b(that's not right|not what I|try again|start over|scrap)\b")
ASCII_BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
LESSON_STOP = ("a", "an", "the", "is", "of", "in", "on", "to", "for", "and", "or")
DEPENDENCE = ("depends on", "requires", "prerequisite", "must run before", "needs ")
VERSION, DATE = r"\bv\d+\.\d+(?:\.\d+)?\b", r"\b\d{4}-\d{2}-\d{2}\b"
PERSONAL = (
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED_JWT]"),
    (r"\bsk-(ant-)?[A-Za-z0-9_-]{20,}\b", "[REDACTED_APIKEY]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "[REDACTED_GITHUB_PAT]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"\bxox[bpoa]-[0-9]+-[A-Za-z0-9-]+\b", "[REDACTED_SLACK_TOKEN]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._-]{20,}\b", "Bearer [REDACTED_TOKEN]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
)
CARD, CARD_LABEL = r"\b(?:\d[ -]?){13,19}\b", "[REDACTED_CC]"
PHONE, PHONE_LABEL = r"(?:\+\d{1,3}[ .-])?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}\b", "[REDACTED_PHONE]"


def threat(text: Column) -> Column:
    """The name of the first threat a text matches; null for a clean one."""
    text = F.coalesce(text, F.lit(""))
    out = F.when(text.rlike("[" + "".join(INVISIBLE) + "]"), "invisible_unicode")
    for pattern, name in THREATS:
        out = out.when(text.rlike("(?i)" + pattern), name)
    return out


def has_credential(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("|".join(CREDENTIALS))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    text = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def first_negation(new: Column, old: Column) -> Column:
    """The first negating phrase that the new text has and the old one lacks."""
    new, old = (F.lower(F.coalesce(x, F.lit(""))) for x in (new, old))
    return F.coalesce(*(F.when(F.contains(new, F.lit(p)) & ~F.contains(old, F.lit(p)), p) for p in NEGATIONS))


def is_trivial(delta: Column, least: int = 100) -> Column:
    """Too short, or nothing but an acknowledgement behind role prefixes."""
    text = F.coalesce(delta, F.lit(""))
    bare = F.regexp_replace(text, r"(?im)^\s*(user|assistant):\s*", "")
    return (F.length(F.trim(text)) < least) | bare.rlike(ACKNOWLEDGED)


def has_literal(query: Column) -> Column:
    """A version number or a date in the query."""
    return query.rlike(VERSION) | query.rlike(DATE)


def literals(query: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(query, F.lit(VERSION), F.lit(0)), F.regexp_extract_all(query, F.lit(DATE), F.lit(0))))


def time_window(query: Column, now: Column) -> Column:
    """(start, end) of the first time phrase of a query, null without one."""
    q = F.lower(F.coalesce(query, F.lit("")))
    back = lambda hours: now - F.make_dt_interval(hours=hours)
    count = lambda unit: F.regexp_extract(q, rf"(\d+)\s+{unit}s?\s+ago", 1).try_cast("int")
    span = lambda start, end: F.struct(back(start).alias("start"), back(end).alias("end"))
    days, hours = count("day"), count("hour")
    out = F.when(days.isNotNull(), span((days + 1) * 24, days * 24)).when(hours.isNotNull(), span(hours + 1, hours))
    for phrase, start, end in (("this morning", 24, 0), ("yesterday", 48, 24), ("last week", 336, 168), ("this week", 168, 0), ("today", 24, 0)):
        out = out.when(F.contains(q, F.lit(phrase)), span(F.lit(start), F.lit(end)))
    return out


def hits(text: Column, patterns: tuple[str, ...], ascii_words: bool = False) -> Column:
    """How often patterns occur. ascii_words: only a-z, A-Z, 0-9 and _ make words, so a letter beyond them ends one."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.regexp_count(text, F.lit(p.replace(r"\b", ASCII_BOUNDARY) if ascii_words else p))
    return out


def lesson_applies(query: Column, query_class: Column) -> Column:
    """A query belongs to a class that it contains, or with which it shares two words that say something."""
    q, c = (F.lower(F.coalesce(x, F.lit(""))) for x in (query, query_class))
    words = lambda x: F.array_except(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array(*map(F.lit, LESSON_STOP)))
    return (q != "") & (c != "") & (F.contains(q, c) | (F.size(F.array_intersect(words(q), words(c))) >= 2))


def scrub(text: Column) -> Column:
    """The text without tokens, addresses, checked card numbers and phone numbers, in this order."""
    for pattern, label in PERSONAL:
        text = F.regexp_replace(text, pattern, label.replace("$", r"\$"))
    # Every card-like run that passes Luhn is replaced, run by run: split around the runs, judge, join again.
    runs = F.regexp_extract_all(text, F.lit(CARD), F.lit(0))
    rest = F.split(text, CARD)
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    card = lambda x: (F.length(digits(x)) >= 13) & (F.length(digits(x)) <= 19) & F.call_function("luhn_check", digits(x))
    judged = F.transform(runs, lambda x: F.when(card(x), CARD_LABEL).otherwise(x))
    text = F.array_join(F.flatten(F.zip_with(rest, judged, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.regexp_replace(text, PHONE, PHONE_LABEL)


def luhn(number: Column) -> Column:
    digits = F.regexp_replace(number, r"\D", "")
    return (F.length(digits) >= 13) & (F.length(digits) <= 19) & F.call_function("luhn_check", digits)


def duration_hours(spec: Column) -> Column:
    """Hours of 7d, 24h or 30m; null for anything else."""
    n = F.regexp_extract(spec, r"^\s*(\d+)\s*([dhm])\s*$", 1).try_cast("double")
    unit = F.regexp_extract(spec, r"^\s*(\d+)\s*([dhm])\s*$", 2)
    return F.when(unit == "d", n * 24).when(unit == "h", n).when(unit == "m", n / 60)


def age(seconds: Column) -> Column:
    """A short age such as 5s, 12m, 3h or 2d."""
    whole = lambda d: F.floor(seconds / d).cast("string")
    return F.when(seconds < 60, F.concat(whole(1), F.lit("s"))).when(seconds < 3600, F.concat(whole(60), F.lit("m"))).when(seconds < 86400, F.concat(whole(3600), F.lit("h"))).otherwise(F.concat(whole(86400), F.lit("d")))
