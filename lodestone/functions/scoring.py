"""Scores of records: usage, decay, damping, rank fusion, bands."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_since(ts: Column, now: Column) -> Column:
    """Hours from ts to now, 0 for a missing or a later time."""
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return F.greatest(F.coalesce((micros(now) - micros(ts)) / 3.6e9, F.lit(0.0)), F.lit(0.0))


def usage(accesses: Column, last: Column, now: Column, half_life: float = 168.0, cap: float = 20.0) -> Column:
    """Half recency (halved each week; 0 for what was never read), half frequency (log, capped)."""
    recency = F.when(last.isNull(), 0.0).otherwise(F.pow(F.lit(2.0), -hours_since(last, now) / half_life))
    return 0.5 * recency + 0.5 * F.least(F.lit(1.0), F.log1p(F.coalesce(accesses, F.lit(0)).cast("double")) / math.log(1 + cap))


def damping(n: Column) -> Column:
    """1 up to five accesses, falling to one half at twenty, and from a lower level on logarithmically beyond."""
    n = n.cast("double")
    return F.when(n <= 5, 1.0).when(n <= 20, 1 - 0.5 * (n - 5) / 15).otherwise(0.5 / (1 + F.log(1 + n - 20)))


def strength(importance: Column, accesses: Column, last: Column, now: Column, half_life: float = 720.0) -> Column:
    """Importance that fades with time, the slower the more often a record was read."""
    n = F.coalesce(accesses, F.lit(0))
    slower = 1 + 0.5 * n * damping(n)
    return (0.6 + 0.2 * (importance - 1)) * F.exp(-hours_since(last, now) * math.log(2) / (half_life * slower))


def protected(layer: Column, immune: Column) -> Column:
    return (F.coalesce(layer, F.lit(2)) == 0) | F.coalesce(immune, F.lit(False))


def suggested_layer(strength: Column, layer: Column, immune: Column, floor: float = 0.2) -> Column:
    """The next lower layer for a faded record that may be demoted, else null."""
    at = F.coalesce(layer, F.lit(2))
    return F.when((strength < floor) & ~protected(layer, immune) & (at < 3), at + 1)


def reciprocal_rank(rank: Column, missing: Column, k: int = 60) -> Column:
    return 1.0 / (k + F.coalesce(rank, missing))


def multiplier(usage: Column, scope: Column, link: Column, importance: Column) -> Column:
    return 1 + 0.15 * usage + 0.10 * scope + 0.10 * link + 0.10 * importance


def band(similarity: Column, reject: float = 0.92, merge: float = 0.70) -> Column:
    """What to do with a new record that is this similar to the best old one."""
    return F.when(similarity >= reject, "reject").when(similarity >= merge, "merge").otherwise("insert")


def outcome(positive: Column, negative: Column, messages: Column) -> Column:
    """From -1 to 1; 0 for fewer than two messages or none that says anything."""
    total = positive + negative
    return F.when((messages < 2) | (total == 0), 0.0).otherwise((positive - negative) / total)


def moving_average(history: Column, keep: float = 0.7) -> Column:
    """The last value of new = keep * old + (1 - keep) * x over an ordered array, from 0."""
    return F.aggregate(history, F.lit(0.0), lambda a, x: keep * a + (1 - keep) * x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different or no length."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(0.0)
