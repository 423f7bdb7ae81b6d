"""Phrases whose words belong together, mined level by level with hashed bucket counts (PCY, DHP) and Apriori pruning.

A text in lower case (A-Z) is cut into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words at spaces and tabs. Within each
language, f(phrase) counts all contiguous occurrences inside pieces, overlaps included. Phrases of 2 to 4 words with
f >= `least` are candidates. One pass over the texts for each length k:

1. The pass counts phrases of k words exactly, but only those that can be frequent: the bucket of the phrase reached
   `least` in the pass before (PCY), and both its parts of k - 1 words are in a bitmap of the frequent ones (Apriori).
2. In the same pass it hashes phrases of k + 1 words into `BUCKETS` buckets and counts those (DHP: only phrases both of
   whose parts of k words passed the tests of 1).
3. Buckets become a bitmap, and so do the frequent phrases of k words; both go to all tasks of the next pass. A bitmap
   has BUCKETS bits (2 MB), however large the corpus is. False positives cost counting and change no result; if a corpus is
   so large that most buckets are full, Apriori still prunes.

Counting is by words, not by hashes: within a part of a batch, phrases are pairs of exact codes; their counts are summed
by Spark on (lang, phrase), in each task before they are shuffled, so neither a hot language nor a hot phrase meets in one
task unsummed. Bucket
counts stop at `least` (255 at most), which loses no frequent phrase, so a task's table is one byte for each bucket; tables travel
in `CHUNKS` chunks and are added as a stream, one chunk in memory at a time.

A candidate cut after its first k words has l = f(first part), r = f(rest) and the score floor(2000000 * a / (l + r)); its
lowest-scoring cut counts (ties: the smallest k). Arithmetic is on decimals of 38 digits. A candidate is dropped if its
words lie contiguously inside a longer candidate (dropped or not) with 100 * f(longer) >= 80 * a. Each language's best
`top` are ranked by score and count, both descending, and phrase in UTF-8 order, so there are no ties.

A null text is empty, a null language is `und`. Empty texts have no words; a very long one is a part of a batch of its own,
read whole. Repeated rows count as often as they occur, documents' ids play no part, an empty table gives an empty result
and further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import words
from lodestone.llm.tables import Workspace
from lodestone.llm.words import U64

LONGEST, LEAST, TOP = 4, 30, 2000
SCALE, ABSORB = 2_000_000, 80
BUCKETS, CHUNKS = 1 << 24, 256
#: Bytes of the texts whose phrases are counted together.
TOGETHER = 4_000_000
SALTS = 32
COUNTS = "lang string, phrase string, n long, chunk int, buckets binary"

_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = _CUTS.copy()
_BLANK[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of some texts: exact codes, a hash of each (with its language), and where pieces end."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = words.utf8(texts)
        data = _LOWER[data]
        solid = np.concatenate([[False], ~_BLANK[data], [False]])
        begins, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] |= solid[inner + 1]
        ends[inner - 1] |= solid[inner]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        text = np.searchsorted(offsets, starts, side="right") - 1
        #: Words of one piece share a number that no other piece has.
        self.piece = (np.cumsum(_CUTS[data])[starts] if len(starts) else starts) + text * (len(data) + 1)
        joined = data[solid[1:-1]]
        places = np.concatenate([[0], np.cumsum(ends - starts)])
        spelled = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(joined.tobytes()))
        coded = spelled.dictionary_encode()
        self.langs = langs.dictionary_encode()
        own = self.langs.indices.to_numpy().astype(np.int64)[text] if len(starts) else np.zeros(0, np.int64)
        self.spelling = coded.dictionary
        pair = own * max(len(self.spelling), 1) + coded.indices.to_numpy().astype(np.int64)
        self.kinds, self.codes = np.unique(pair, return_inverse=True)
        self.codes = self.codes.astype(np.int64)
        hashed = spelled_hashes(self.spelling)[self.kinds % max(len(self.spelling), 1)] if len(self.kinds) else np.zeros(0, U64)
        tongues = spelled_hashes(self.langs.dictionary)
        if len(self.kinds):
            hashed = words.mix(hashed + words.mix(tongues, 21)[self.kinds // len(self.spelling)], 22)
        self.hashes = hashed[self.codes] if len(self.kinds) else hashed

    def places(self, k: int) -> np.ndarray:
        """Where phrases of k words begin."""
        n = len(self.codes) - k + 1
        return np.flatnonzero(self.piece[: max(n, 0)] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def buckets(self, at: np.ndarray, k: int) -> np.ndarray:
        return phrase_buckets([self.hashes[at + i] for i in range(k)])

    def counted(self, at: np.ndarray, k: int) -> pa.Table:
        """lang, phrase and n of the phrases of k words at these places, by their exact codes."""
        code, wide = self.codes[at], np.int64(len(self.kinds) + 1)
        for i in range(1, k):
            code = np.unique(code, return_inverse=True)[1] * wide + self.codes[at + i]
        _, one, n = np.unique(code, return_index=True, return_counts=True)
        kinds = [self.kinds[self.codes[at[one] + i]] for i in range(k)]
        size = max(len(self.spelling), 1)
        parts = [self.spelling.take(pa.array(x % size)) for x in kinds]
        phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        return pa.table({"lang": self.langs.dictionary.take(pa.array(kinds[0] // size)), "phrase": phrase, "n": pa.array(n)})


def spelled_hashes(values: pa.Array) -> np.ndarray:
    """A hash of each string by its bytes."""
    data, offsets = words.utf8(values)
    out = words.mix(np.arange(1, dtype=U64), 23).repeat(len(values))
    some = np.flatnonzero(np.diff(offsets))
    out[some] = words.hash_spans(data, offsets[some], offsets[some + 1], lower=False)
    return out


def phrase_buckets(hashes: list[np.ndarray]) -> np.ndarray:
    """A bucket for each phrase, from the hashes of its words."""
    total = np.zeros(len(hashes[0]), U64)
    for i, h in enumerate(hashes):
        total += h * words._ORDER[i]
    return (words.mix(total, 24 + len(hashes)) & U64(BUCKETS - 1)).astype(np.int64)


class Bits:
    """Which buckets are set."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    def has(self, bucket: np.ndarray) -> np.ndarray:
        return (self.packed[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)


def counted_up(counts: np.ndarray, buckets: np.ndarray, most: int) -> None:
    """Adds buckets to a table of counts that stop at `most`."""
    buckets = np.sort(buckets)
    edges = np.flatnonzero(np.diff(buckets, prepend=-1))
    some = buckets[edges]
    counts[some] = np.minimum(np.diff(edges, append=len(buckets)) + counts[some], most)


def _rows(found: pa.Table) -> Iterator[pa.RecordBatch]:
    blank = pa.nulls(len(found), pa.int32())
    whole = pa.table([found["lang"].cast(pa.string()), found["phrase"].cast(pa.large_string()), found["n"].cast(pa.int64()), blank, pa.nulls(len(found), pa.binary())], ["lang", "phrase", "n", "chunk", "buckets"])
    for b in whole.to_batches(max_chunksize=50_000):
        yield b.set_column(1, "phrase", b.column(1).cast(pa.string()))


def _chunks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    wide = BUCKETS // CHUNKS
    for c in range(CHUNKS):
        own = counts[c * wide : (c + 1) * wide]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([c], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)])], ["lang", "phrase", "n", "chunk", "buckets"])


def scan(docs: DataFrame, k: int, last: bool, least: int, buckets: Broadcast | None, frequent: Broadcast | None) -> DataFrame:
    """The pass for phrases of k words: their counts where they may be frequent, and bucket counts of k + 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint8)
        full = Bits(buckets.value) if buckets else None
        known = Bits(frequent.value) if frequent else None
        for whole in batches:
            for b in words.slices(whole, "text", TOGETHER):
                text = Words(words.texts_of(b, "text"), words.texts_of(b, "lang"))
                at = text.places(k)
                if k > 1:
                    at = at[full.has(text.buckets(at, k))]
                    at = at[known.has(text.buckets(at, k - 1)) & known.has(text.buckets(at + 1, k - 1))]
                if len(at):
                    yield from _rows(text.counted(at, k))
                if not last:
                    passed = np.zeros(len(text.codes) + 1, bool)
                    passed[at] = True
                    longer = text.places(k + 1)
                    counted_up(counts, text.buckets(longer[passed[longer] & passed[longer + 1]], k + 1), min(least, 255))
        yield from _chunks(counts)

    return docs.mapInArrow(run, COUNTS)


def added(chunks: DataFrame, least: int) -> np.ndarray:
    """The bitmap of buckets that reach `least`, from chunks of counts: BUCKETS / 8 bytes on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(zlib.decompress(raw.as_buffer()), np.uint8).astype(np.int64)
                if chunk != at:
                    if at is not None:
                        yield packed(at, total)
                    at, total = chunk, own
                else:
                    total += own
        if at is not None:
            yield packed(at, total)

    def packed(chunk: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], ["chunk", "bits"])

    bits = np.zeros(BUCKETS // 8, np.uint8)
    wide = len(bits) // CHUNKS
    for r in chunks.select("chunk", "buckets").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk int, bits binary").collect():
        bits[r.chunk * wide : (r.chunk + 1) * wide] = np.frombuffer(r.bits, np.uint8)
    return bits


def marked(frequent: DataFrame) -> np.ndarray:
    """The bitmap of the buckets of these phrases (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint8)
        for b in batches:
            # One phrase a text, in pieces that no cut divides: words of a phrase hold no cuts.
            text = Words(b.column(1).cast(pa.large_string()), b.column(0).cast(pa.large_string()))
            size = np.diff(np.concatenate([np.flatnonzero(np.diff(text.piece, prepend=-1)), [len(text.piece)]]))
            first = np.cumsum(size) - size
            for k in np.unique(size):
                counts[text.buckets(first[size == k], int(k))] = 1
        yield from _chunks(counts)

    return added(frequent.select("lang", "phrase").mapInArrow(run, COUNTS), 1)


def frequent_phrases(docs: DataFrame, space: Workspace, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to `longest` words with f >= least (lang, phrase, k, f), and n of each language."""
    context = docs.sparkSession.sparkContext
    levels, totals, buckets, frequent = [], None, None, None
    for k in range(1, longest + 1):
        found = space.write(scan(docs, k, k == longest, least, buckets, frequent), f"counts{k}")
        counts = found.where("chunk IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            totals = space.write(found.where("chunk IS NULL").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        levels.append(space.write(counts.where(F.col("f") >= least).withColumn("k", F.lit(k)), f"frequent{k}"))
        for old in (buckets, frequent):
            if old is not None:
                old.unpersist()
        if k < longest:
            buckets = context.broadcast(added(found.where("chunk IS NOT NULL"), min(least, 255)))
            frequent = context.broadcast(marked(levels[-1]))
        space.drop(found)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def scored(frequent: DataFrame) -> DataFrame:
    """Candidates with a, l, r and score of their lowest-scoring cut."""
    text = F.split("phrase", " ")
    some = frequent.where("k > 1")
    cuts = some.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"), text.alias("w"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    of = lambda end, f: frequent.select("lang", F.col("phrase").alias(end), F.col("f").alias(f))
    both = cuts.join(of("head", "l"), ["lang", "head"]).join(of("rest", "r"), ["lang", "rest"])
    both = both.withColumn("score", F.expr(f"cast({SCALE} as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + r)"))
    best = both.groupBy("lang", "phrase").agg(F.first("k").alias("k"), F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def absorbed(frequent: DataFrame) -> DataFrame:
    """lang, phrase and `longer`: the largest f of the candidates that hold the phrase contiguously and are longer."""
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    some = frequent.where("k > 2").select("lang", "f", "k", F.split("phrase", " ").alias("w"))
    return some.select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    space = Workspace(docs.sparkSession, "collocations")
    docs = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    frequent, totals = frequent_phrases(docs, space, longest, least)
    kept = scored(frequent).join(absorbed(frequent), ["lang", "phrase"], "left").where(f"longer IS NULL OR cast(100 as decimal(3, 0)) * longer < cast({ABSORB} as decimal(3, 0)) * a")
    # A language's first ones come out of the first ones of its shares, so none is ranked whole in one task.
    order = (F.col("score").desc(), F.col("a").desc(), "phrase")
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = space.write(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    space.keep(out)
    return out
