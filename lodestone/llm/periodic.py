"""Periodic runs: stretches of words that repeat with a period, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and length >= max(6, 4 * q) that
no neighbouring word extends keeping that period. All runs of a text are found, by block matching:

1. For each scale s = 1, 2, 4, ... the words are cut into blocks of s at multiples of s. A run whose period q is in
   [s, 2 * s) holds a whole aligned block that occurs again q words later, for it is four periods long.
2. The blocks are the integer-sequence keys of an Aho-Corasick automaton, which is run over the words. Keys of one scale
   have one length, so a place is the end of at most one occurrence, and exactly one aligned block lies [s, 2 * s) words
   before it: an occurrence gives one seed at most, and a text of n words at most n of them.
3. A seed (block, distance) is extended in both directions as far as words that distance apart are equal. Seeds inside a
   run of a smaller period are passed over: by Fine and Wilf's theorem what they grow to is that run.

The automaton is only run where a run of its scale can be: within a run all words (from scale 4 on, all groups of four
words) occurred at most q places before, so a scale looks at stretches of at least 3 * s - 3 such places (3 * s for single
words). That is a necessary condition for every run; nothing is lost by it.

A word is dropped from the collapsed text if any run holds it after that run's first q words.

Everything happens in the task that reads a text; nothing is shuffled, and equal or hot rows need no care. A batch is cut
into parts of limited volume; a very long text is a part of its own and is never cut. A null or empty text, or one without
words, has no runs and an empty collapsed text. Repeated rows give repeated results, ties do not arise (two runs of a text
differ in start or period), an empty table gives an empty result, further columns are ignored, a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import words

#: A run has this many periods, and this many words, at least.
TIMES, LEAST = 4, 6
#: Words that are compared as one from this scale on when stretches are looked for.
GROUP = 4
#: What separates words, as a Java pattern.
SPACES = r"[\x20\x09-\x0D]+"


def backward(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many places before each place its code last occurred in the same text; very many if it did not."""
    far = np.iinfo(np.int64).max
    out = np.full(len(codes), far)
    if len(codes):
        key = np.repeat(np.arange(len(first) - 1), np.diff(first)) * (int(codes.max()) + 1) + codes
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def groups(codes: np.ndarray) -> np.ndarray:
    """A code for each place and the GROUP - 1 places after it; the last places of a text are cut off by the caller."""
    out = codes
    for k in range(1, GROUP):
        pair = out[: len(codes) - k] * (int(codes.max(initial=0)) + 1) + codes[k:]
        out = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    return out


def stretches(near: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[begin, end) of the maximal runs of True that are `least` long."""
    if len(near) < least or not near.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).view(np.int8)))
    begin, end = edges[::2], edges[1::2]
    keep = end - begin >= least
    return list(zip(begin[keep].tolist(), end[keep].tolist(), strict=True))


def _windows(single: np.ndarray, grouped: np.ndarray, s: int, n: int) -> list[tuple[int, int]]:
    """Where runs with a period in [s, 2 * s) can be, merged and in order."""
    reach = 2 * s - 1
    if s < GROUP:
        found = [(a - reach, b) for a, b in stretches(single <= reach, 3 * s)]
    else:
        found = [(a - reach, b + GROUP - 1) for a, b in stretches(grouped <= reach, 3 * s - GROUP + 1)]
    merged: list[tuple[int, int]] = []
    for a, b in found:
        a, b = max(a, 0), min(b, n)
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def seeds(codes: np.ndarray, a: int, b: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Aligned blocks of s words in [a, b) and how far on each occurs again, at distances in [s, 2 * s)."""
    lowest = -(-a // s)
    count = max(b // s - lowest, 0)
    base = lowest * s
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = codes[base:b].tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    key_of = np.empty(count, np.int64)
    for k in range(count):
        block = tuple(values[k * s : (k + 1) * s])
        key_of[k] = automaton.get(block, -1)
        if key_of[k] < 0:
            key_of[k] = k
            automaton.add_word(block, k)
    automaton.make_automaton()
    found = np.fromiter((x for hit in automaton.iter(tuple(values)) for x in hit), np.int64).reshape(-1, 2)
    begin, key = found[:, 0] - s + 1, found[:, 1]
    before = begin // s - 1
    hit = (before >= 0) & (key_of[np.maximum(before, 0)] == key)
    return base + before[hit] * s, begin[hit] - before[hit] * s


def _matching(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common prefix, looked for in steps that double."""
    n, done, step = min(len(x), len(y)), 0, 32
    x, y = x[:n], y[:n]
    while done < n:
        differ = x[done : done + step] != y[done : done + step]
        if differ.any():
            return done + int(differ.argmax())
        done, step = min(done + step, n), step * 2
    return n


def extended(codes: np.ndarray, at: int, distance: int) -> tuple[int, int]:
    """[begin, end) of the maximal stretch around codes[at : at + distance] whose words `distance` apart are equal."""
    ahead = _matching(codes[at:], codes[at + distance :])
    back = _matching(codes[:at][::-1], codes[: at + distance][::-1])
    return at - back, at + distance + ahead


def find_runs(codes: np.ndarray, single: np.ndarray | None = None, grouped: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of integers, by start and period."""
    n = len(codes)
    whole = np.array([0, n])
    if single is None:
        single = backward(codes, whole)
    if grouped is None:
        joined = groups(codes) if n >= GROUP else np.zeros(0, np.int64)
        grouped = backward(joined, np.array([0, len(joined)]))
    runs: list[tuple[int, int, int]] = []
    s = 1
    while TIMES * s <= n:
        windows = _windows(single, grouped, s, n)
        if windows:
            # The furthest end of a run of a smaller scale that begins at or before a place.
            covered = np.zeros(n + 1, np.int64)
            for start, length, _ in runs:
                covered[start] = max(covered[start], start + length)
            covered = np.maximum.accumulate(covered)
        found: dict[tuple[int, int], int] = {}
        for a, b in windows:
            at, distance = seeds(codes, a, b, s)
            new = covered[at] < at + distance + s
            last: dict[int, int] = {}
            for p, d in sorted(zip(at[new].tolist(), distance[new].tolist(), strict=True)):
                if last.get(d, -1) >= p + d + s:  # inside the stretch that was grown last for this distance
                    continue
                begin, end = extended(codes, p, d)
                last[d] = end
                if end - begin >= max(LEAST, TIMES * d):
                    found[begin, end] = min(d, found.get((begin, end), d))
        known = {(start, length) for start, length, _ in runs}
        runs += [(a, b - a, d) for (a, b), d in found.items() if (a, b - a) not in known]
        s *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _part(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    split = pc.ascii_split_whitespace(texts)
    flat, parent = split.flatten(), pc.list_parent_indices(split).to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    flat, parent = flat.filter(some), parent[some.to_numpy(zero_copy_only=False)]
    first = np.searchsorted(parent, np.arange(len(texts) + 1))
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    single = backward(codes, first)
    # Groups that reach into the next text are told apart from all others by their text, and cut off below.
    joined = groups(codes) if len(codes) >= GROUP else np.zeros(0, np.int64)
    grouped = backward(joined, np.minimum(first, len(joined)))
    keep = np.ones(len(codes), bool)
    offsets, rows = [0], []
    for a, b in zip(first[:-1], first[1:], strict=True):
        runs = find_runs(codes[a:b], single[a:b], grouped[a : max(b - GROUP + 1, a)])
        for start, length, period in runs:
            keep[a + start + period : a + start + length] = False
        rows += runs
        offsets.append(len(rows))
    table = np.array(rows, np.int64).reshape(-1, 3)
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], ["start", "length", "period"]))
    left = np.concatenate([[0], np.cumsum(keep)])[first]
    kept = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), flat.filter(pa.array(keep)))
    collapsed = pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first), pa.int64()), runs, collapsed], ["doc_id", "n_words", "runs", "collapsed"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period), collapsed (kept words, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.slices(whole, "text"):
                yield _part(b.column(0), words.texts_of(b, "text"))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, of which one document in ten is made periodic from some word on, by its id alone.

    With h = crc32 of the decimal id and g = floor(h / 10): where h % 10 = 0 each word i >= a becomes word
    a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), n being the number of words.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    split = F.filter(F.split(text, SPACES), lambda w: w != "")

    def rearranged(own: Column) -> Column:
        n = F.size(own).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(own, place(i).cast("int"))))

    # The array of words is bound once by transforming an array that holds it.
    made = F.transform(F.array(split), lambda own: F.when(F.size(own) > 0, rearranged(own)).otherwise(F.lit("")))[0]
    return F.when(h % 10 == 0, made).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
