"""Near-duplicate documents by MinHash bands, odd sketches and an exact check of full shingle sets.

Words are runs of characters other than ASCII white space, with A-Z in lower case. The set of a document holds its
distinct shingles of five words; a shorter text is one shingle. Documents whose sets meet `percent` (intersection
against union, in whole per cents) are linked, and the links' components are the groups.

1. One pass over the texts gives each document a fingerprint of its set, `bands` keys of `rows` MinHash values each, and
   an odd sketch: the parity of its MinHash samples over `SKETCH_BITS` places. The population count of the XOR of two
   sketches estimates how alike two sets are.
2. Equal sets are one node from here on, represented by their smallest doc_id.
3. Two nodes are candidates when they share a band. Each is first compared with the smallest node of its band (a star,
   not all pairs). Sketches and a bitmap of each set refute most pairs that fall short: a bit that one set has and the
   other lacks is a shingle that they do not share, so the bound that bitmaps give is certain. What is left is checked
   on the full sets.
4. What the stars leave apart is settled in rounds. Within a band whose members are not all of one component, the
   members outside its largest component (and, of two such, that of the smaller component) each name the `reach` nearest
   members of other components that sketches and bitmaps allow; the pairs are checked on full sets and components grow.
   Those whose list was cut short ask again with a wider reach, until none was: so in the end every candidate pair is
   either inside one component or has been refuted. Rounds order the work and drop none of it.

Bands miss a pair at exactly 75 per cent with probability (1 - 0.75**rows) ** bands, 3.5e-6 here, and less above. Sketches
refute such a pair from an estimate below `SKETCH_FLOOR` on: 5e-7 of 2,000,000 simulated pairs at 75 per cent. No pair is
linked unless its full sets meet the threshold.

Hot bands: stars and set checks are dealt by (hub, block). In a round, the members of a band wait in blocks of `BLOCK`,
once each, and only those that ask are copied to all blocks; so a band of n members, s of which are outside its largest
component, makes n + s * n / BLOCK rows. A task holds a block and a part of those that ask, whatever their number.

Crowded bands: where the stars leave more than `CROWD` components in a band, its members have parts of their texts in common
(a template) but few are near copies, and comparing all of them would grow with the square of the band. Their nodes leave
such bands and meet on the rarest shingles of their sets instead: two sets of n and m shingles that meet the threshold have
`percent` per cent of the larger one in common, so of the (100 - percent) per cent (and one more) of each set that come first
in any fixed order, one is in both. The order is by how often a shingle's bucket occurs in these nodes, so what a template
brings comes last and is no meeting place. This loses no pair that the band had.

Rows with a null text, an empty text or no words have an empty set and no links. A very long text is read whole, in a part
of its own. Rows that share a doc_id are one node whose links are pooled; equal texts are one node. Components are named by
their smallest doc_id, so there are no ties. Rows without a doc_id have no links, a null component and are kept. An empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bloom, words
from lodestone.llm.components import connected, merged
from lodestone.llm.tables import Workspace
from lodestone.llm.words import U64

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 33, 4
SKETCH_BITS = 512
SKETCH_FLOOR = 0.5
BLOCK, HUB_BLOCK = 512, 512
FIRST_REACH, WIDEN = 2, 16
#: Components of a band beyond which its nodes meet on rare shingles.
CROWD = 1024
#: Probes that a task compares with a block at a time.
PROBES = 4096
#: Buckets of the table that says how often shingles occur, and the parts in which it travels.
BUCKETS, CHUNKS = 1 << 20, 64

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.int64).astype(U64) | U64(1)
_B = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.int64).astype(U64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, first, _, _ = words.hashed_words(texts)
    shingles, begin = words.runs(hashes, first, SHINGLE)
    return [np.unique(shingles[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS * ROWS minima for each non-empty set."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), BANDS * ROWS), U64)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat((flat ^ _B[k]) * _A[k], begin)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, SKETCH_BITS / 64 integers each."""
    n = len(samples)
    place = (words.mix(samples + np.arange(samples.shape[1], dtype=U64)) % U64(SKETCH_BITS)).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + place).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.int64)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the population count of the XOR of two odd sketches."""
    share = np.minimum(2 * differing / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * np.log1p(-share)


#: The largest population count at which the estimate is SKETCH_FLOOR at least.
MOST_DIFFERING = int(SKETCH_BITS / 2 * -np.expm1((SKETCH_FLOOR - 1) * 4 * BANDS * ROWS / SKETCH_BITS))


def bitmaps(sets: list[np.ndarray]) -> list[np.ndarray]:
    """A bitmap of each set in 64-bit integers, a power of two of them with four places or more for each shingle.

    Places are low bits of a hash, so the two halves of a bitmap put over each other are the bitmap of half the size.
    """
    out = []
    for s in sets:
        n = 1 << max(0, int(np.ceil(np.log2(max(len(s), 1) / 16))))
        bits = np.zeros(64 * n, np.uint8)
        bits[(words.mix(s, 60) & U64(64 * n - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits).view(np.int64))
    return out


def _bitmap_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in words.slices(whole, "text"):
            maps = bitmaps(shingle_sets(words.texts_of(b, "text")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.list_(pa.int64()))], ["node", "bitmap"])


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, fp1 and fp2 (fingerprint of the set), bands, sketch; the last four null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.slices(whole, "text"):
                sets = shingle_sets(words.texts_of(b, "text"))
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                fp = np.zeros((2, len(sets)), np.int64)
                bands: list = [None] * len(sets)
                sketch: list = [None] * len(sets)
                if len(some):
                    flat, begin = np.concatenate([sets[i] for i in some]), np.cumsum(sizes[some]) - sizes[some]
                    for k in range(2):
                        fp[k, some] = np.add.reduceat(words.mix(flat, 3 + k), begin).view(np.int64)
                    samples = minhashes([sets[i] for i in some])
                    keys = np.zeros((len(some), BANDS), U64)
                    for r in range(ROWS):
                        keys = words.mix(keys ^ samples[:, r::ROWS], 5 + r)
                    keys = words.mix(keys + np.arange(BANDS, dtype=U64), 11).view(np.int64)
                    for i, k, s in zip(some, keys, odd_sketches(samples), strict=True):
                        bands[i], sketch[i] = k, s
                empty = sizes == 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(sizes), pa.array(fp[0], mask=empty), pa.array(fp[1], mask=empty), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (hub, node) whose full sets meet the threshold.

    The text of a hub goes once to each block of its partners, that of a node to each of its hubs. A task reads its
    blocks in order and holds one hub's set at a time.
    """
    counts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(counts, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blank = F.lit(None)
    hubs = counts.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    hubs = hubs.join(texts, hubs.hub == texts.doc_id).select("hub", "block", blank.cast(pairs.schema["node"].dataType).alias("node"), "text")
    nodes = dealt.join(texts, dealt.node == texts.doc_id).select("hub", "block", "node", "text")
    both = hubs.unionByName(nodes).repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("node").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for whole in batches:
            for b in words.slices(whole, "text"):
                sets = shingle_sets(words.texts_of(b, "text"))
                hub, block, node = (b.column(i).to_pylist() for i in range(3))
                out: tuple[list, list] = ([], [])
                for h, k, n, s in zip(hub, block, node, sets, strict=True):
                    if n is None:
                        held = held if at == (h, k) else []
                        at = (h, k)
                        if not any(np.array_equal(x, s) for x in held):
                            held.append(s)
                    elif at == (h, k) and any(_meets(x, s, percent) for x in held):
                        out[0].append(h)
                        out[1].append(n)
                yield pa.RecordBatch.from_arrays([pa.array(x, b.schema.field(0).type) for x in out], ["hub", "node"])

    kind = pairs.schema["hub"].dataType.simpleString()
    return both.mapInArrow(run, f"hub {kind}, node {kind}").distinct()


def _meets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _likely(pairs: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """Those pairs (hub, node) that sizes, sketches and bitmaps do not refute. Size 0 marks a node of several sets."""
    of = lambda end: traits.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("size", "sketch", "bitmap")))
    both = pairs.join(of("node"), "node").join(of("hub"), "hub")
    total = lambda a, b, f: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(f(x, y))), F.lit(0), lambda s, x: s + x)
    a, b, n, m = (F.col(c) for c in ("hub_bitmap", "node_bitmap", "hub_size", "node_size"))
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), F.floor(F.size(x) / 2).cast("int")), F.slice(x, F.floor(F.size(x) / 2).cast("int") + 1, F.floor(F.size(x) / 2).cast("int")), lambda x, y: x.bitwiseOR(y))
    a, b = F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    alone = lambda x, y: total(x, y, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))
    common = F.least(n - alone(a, b), m - alone(b, a))
    alike = (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (total(F.col("hub_sketch"), F.col("node_sketch"), lambda x, y: x.bitwiseXOR(y)) <= MOST_DIFFERING)
    return both.where((n == 0) | (m == 0) | (alike & (common * 100 >= (n + m - common) * percent))).select("hub", "node")


class _Block:
    """The nodes of one band block: what refutes pairs of them, without their sets."""

    def __init__(self, size: np.ndarray, sketch: np.ndarray, bitmap: pa.ChunkedArray, percent: int):
        self.size, self.bits, self.percent = size, sketch.view(U64), percent
        flat = bitmap.combine_chunks()
        offsets, values = np.asarray(flat.offsets, np.int64), np.asarray(flat.values, np.int64).view(U64)
        self.width = np.diff(offsets)
        self.rows: dict[int, np.ndarray] = {}
        self.maps: dict[int, np.ndarray] = {}
        for w in np.unique(self.width):
            rows = np.flatnonzero(self.width == w)
            self.maps[w] = values[offsets[rows][:, None] + np.arange(w)]
            self.rows[w] = np.full(len(size), -1)
            self.rows[w][rows] = np.arange(len(rows))

    def _at(self, nodes: np.ndarray, width: int) -> np.ndarray:
        """Bitmaps of nodes, all of one width, brought to `width` by folding."""
        own = int(self.width[nodes[0]])
        maps = self.maps[own][self.rows[own][nodes]]
        while maps.shape[1] > width:
            maps = maps[:, : maps.shape[1] // 2] | maps[:, maps.shape[1] // 2 :]
        return maps

    def near(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of others that may meet the threshold with i, and the largest intersection each may have."""
        n, sizes = self.size[i], self.size[others]
        wild = (sizes == 0) | (n == 0)
        fits = 100 * np.minimum(sizes, n) >= self.percent * np.maximum(sizes, n)
        others = others[wild | fits]
        differing = np.bitwise_count(self.bits[others] ^ self.bits[i]).sum(1)
        wild = (self.size[others] == 0) | (n == 0)
        others = others[wild | (differing <= MOST_DIFFERING)]
        common = np.zeros(len(others), np.int64)
        for w in np.unique(self.width[others]):
            at = np.flatnonzero(self.width[others] == w)
            width = int(min(w, self.width[i]))
            theirs, mine = self._at(others[at], width), self._at(np.array([i]), width)
            only_theirs, only_mine = np.bitwise_count(theirs & ~mine).sum(1).astype(np.int64), np.bitwise_count(mine & ~theirs).sum(1).astype(np.int64)
            common[at] = np.minimum(self.size[others[at]] - only_theirs, n - only_mine)
        wild = (self.size[others] == 0) | (n == 0)
        keep = wild | (100 * common >= self.percent * (self.size[others] + n - common))
        return others[keep], common[keep]


def _dealt(rooted: DataFrame, weights: DataFrame, traits: DataFrame, asking: DataFrame | None) -> DataFrame:
    """The rows that a round compares: key, block, own, node, root, weight, probe, size, sketch, bitmap.

    A band whose members have one root is settled and stays out. Every other member stands in the one block of its band
    that its hash names, and waits there. Probes are copied to all blocks of their band: in the first round the members
    outside the band's largest component, later those of `asking` (key, node). So rows follow the members and what the
    largest component leaves over, not the square of a band.
    """
    sized = rooted.join(weights, "root", "left").withColumn("weight", F.coalesce("weight", F.lit(1)).cast("long"))
    if asking is None:
        sized = sized.withColumn("asks", F.lit(True))
    else:
        sized = sized.join(asking.withColumn("asks", F.lit(True)), ["key", "node"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    band = sized.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("weight", "root")).alias("top"), F.max("asks").alias("asked"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # A join of its own shuffle, which adaptive execution splits where a key is hot.
    rows = sized.join(band.where("low < high AND asked"), "key")
    rows = rows.withColumn("probe", F.col("root") != F.col("top.root") if asking is None else F.col("asks"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("block", F.explode(F.when(F.col("probe"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    return rows.join(traits, "node").select("key", "block", "own", "node", "root", "weight", "probe", "size", "sketch", "bitmap")


def _near_pairs(members: DataFrame, reach: int, percent: int) -> DataFrame:
    """Pairs (key, hub, node) of different components within a band that may meet the threshold.

    The probe is the node; each gets its `reach` nearest of those that wait in a block. `cut`: it had more. Of two
    probes the one whose component is smaller asks, so a pair is told once.
    """
    members = members.withColumn("visits", (F.col("own") != F.col("block")).cast("int")).drop("own")
    spread = members.select("key", "block", "visits", "node", "root", "weight", "probe", "size", "sketch", "bitmap").repartition("key", "block").sortWithinPartitions("key", "block", "visits")

    def settle(key: int, columns: list, waits: int, first: int) -> Iterator[tuple[np.ndarray, ...]]:
        """The first `waits` rows wait; those from `first` on ask."""
        node, root, weight, probe, size, sketch, bitmap = columns
        probe = probe.astype(bool)
        block, waiting = _Block(size, sketch, bitmap, percent), np.arange(waits)
        for i in first + np.flatnonzero(probe[first:]):
            # Those that only wait are asked by every probe.
            later = ~probe[:waits] | (weight[:waits] > weight[i]) | ((weight[:waits] == weight[i]) & (root[:waits] > root[i]))
            others = waiting[later & (root[:waits] != root[i])]
            if not len(others):
                continue
            ahead, common = block.near(i, others)
            if len(ahead):
                best = np.argsort(-common / np.maximum(size[ahead] + size[i] - common, 1), kind="stable")[:reach]
                yield np.full(len(best), key), node[ahead[best]], np.full(len(best), node[i]), np.full(len(best), len(ahead) > reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = None, []
        for key, columns in _grouped(batches, 3, ragged=("bitmap",), most=PROBES):
            if not key[2]:
                at, waiting = key[:2], columns
                found = list(settle(key[0], waiting, len(waiting[0]), 0))
            elif at == key[:2]:
                both = [np.concatenate([x, y]) if isinstance(x, np.ndarray) else pa.chunked_array([*x.chunks, *y.chunks]) for x, y in zip(waiting, columns, strict=True)]
                found = list(settle(key[0], both, len(waiting[0]), len(waiting[0])))
            else:  # nobody waits in this block
                continue
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["key", "hub", "node", "cut"])

    return spread.mapInArrow(run, "key long, hub long, node long, cut boolean")


def _rarity(texts: DataFrame) -> np.ndarray:
    """For each bucket of shingles the size (binary digits) of how often it occurs in the sets of texts: BUCKETS bytes."""
    wide = BUCKETS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for b in words.slices(whole, "text"):
                for s in shingle_sets(words.texts_of(b, "text")):
                    np.add.at(total, _bucket(s), 1)
        for c in range(CHUNKS):
            if total[c * wide : (c + 1) * wide].any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(total[c * wide : (c + 1) * wide].tobytes(), 1)])], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(wide, np.int64)
        told = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.ceil(np.log2(total + 1)).astype(np.uint8).tobytes()])], ["chunk", "digits"])
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if chunk != at:
                    if at is not None:
                        yield told()
                    at, total = chunk, np.zeros(wide, np.int64)
                total += np.frombuffer(zlib.decompress(raw.as_buffer()), np.int64)
        if at is not None:
            yield told()

    out = np.zeros(BUCKETS, np.uint8)
    parts = texts.mapInArrow(count, "chunk int, counts binary").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, digits binary")
    for r in parts.collect():
        out[r.chunk * wide : (r.chunk + 1) * wide] = np.frombuffer(r.digits, np.uint8)
    return out


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (words.mix(shingles, 61) & U64(BUCKETS - 1)).astype(np.int64)


def rare_shingles(texts: DataFrame, percent: int) -> DataFrame:
    """(key, node): for each text (doc_id, text) those of its shingles that come first by rarity, one of which two sets that
    meet the threshold share."""
    digits = texts.sparkSession.sparkContext.broadcast(_rarity(texts))  # BUCKETS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.slices(whole, "text"):
                nodes, keys = [], []
                for node, s in zip(b.column(0).to_pylist(), shingle_sets(words.texts_of(b, "text")), strict=True):
                    first = len(s) + (-percent * len(s)) // 100 + 1 if len(s) else 0
                    order = np.argsort(digits.value[_bucket(s)], kind="stable")[:first]  # sets are sorted, so ties go by hash
                    keys.append(words.mix(s[order], 12).view(np.int64))
                    nodes.append(np.full(len(order), node))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(nodes), pa.int64())], ["key", "node"])

    return texts.mapInArrow(run, "key long, node long")


def _uncrowded(bands: DataFrame, roots: DataFrame, texts: DataFrame, space: Workspace, percent: int) -> DataFrame:
    """Meeting places (key, node): bands, but for crowded ones, whose nodes meet on rare shingles."""
    rooted = bands.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    crowded = space.write(rooted.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key"), "crowded")
    if crowded.isEmpty():
        return bands.select("key", "node")
    nodes = bands.join(crowded, "key", "left_semi").select(F.col("node").alias("doc_id")).distinct()
    rare = space.write(rare_shingles(texts.join(nodes, "doc_id", "left_semi"), percent), "rare")
    met = rare.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    return space.write(bands.select("key", "node").join(crowded, "key", "left_anti").unionByName(rare.join(met, "key", "left_semi").select("key", "node").distinct()), "meeting")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, ragged: tuple[str, ...] = (), most: int = 0) -> Iterator[tuple[list, list]]:
    """Groups of rows with equal leading columns, from batches sorted by them: (key, other columns as arrays).

    Lists of one length become matrices; `ragged` columns stay as they are. With `most`, groups whose last key is not 0 come
    in parts of about that many rows.
    """
    key, parts, rows = None, [], 0

    def arrays() -> list:
        table = pa.Table.from_batches(parts)
        return [c if name in ragged else _matrix(c) if pa.types.is_list(c.type) else c.to_numpy() for name, c in zip(table.column_names[keys:], table.columns[keys:], strict=True)]

    for b in batches:
        if not b.num_rows:
            continue
        heads = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)])
        edges = [0, *(np.flatnonzero((heads[:, 1:] != heads[:, :-1]).any(0)) + 1), b.num_rows]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            now = heads[:, a].tolist()
            if parts and (now != key or (most and now[-1] and rows >= most)):
                yield key, arrays()
                parts, rows = [], 0
            key = now
            parts.append(b.slice(a, z - a))
            rows += int(z - a)
    if parts:
        yield key, arrays()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is the component's)."""
    spark = docs.sparkSession
    space = Workspace(spark, "neardup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = space.write(signatures(docs, "doc_id", "text"), "signatures")
    some = sigs.where("fp1 IS NOT NULL AND doc_id IS NOT NULL")
    nodes = space.write(some.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    reps = some.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumnRenamed("doc_id", "node")

    keyed = reps.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    bands = space.write(keyed.join(shared.select("key", "hub"), "key").distinct(), "bands")
    in_bands = bands.select("node").distinct()
    texts = space.write(bloom.rows_with(docs, "doc_id", in_bands), "texts")
    maps = texts.mapInArrow(_bitmap_rows, "node long, bitmap array<long>").groupBy("node").agg(F.min("bitmap").alias("bitmap"))
    sets = reps.join(in_bands, "node", "left_semi").groupBy("node").agg(F.count_distinct("fp1").alias("sets"), F.max("n_shingles").alias("size"), F.max("sketch").alias("sketch"))
    sets = sets.withColumn("size", F.when(F.col("sets") == 1, F.col("size")).otherwise(0)).drop("sets")
    traits = space.write(sets.join(maps, "node"), "traits")

    stars = space.write(_likely(bands.where("hub < node").select("hub", "node").distinct(), traits, percent), "stars")
    edges = space.write(confirmed(stars, texts, percent), "edges")
    # A doc_id whose rows hold different sets ties those sets together.
    pooled = some.join(nodes, ["fp1", "fp2"]).where("doc_id <> node").select(F.col("node").alias("hub"), F.col("doc_id").alias("node"))
    pooled = pooled.join(nodes.select("node"), "node", "left_semi").distinct()
    roots = connected(edges.unionByName(pooled).toDF("a", "b"), space)

    places = _uncrowded(bands, roots, texts, space, percent)
    reach, asking = FIRST_REACH, None
    while True:
        rooted = places.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        weights = roots.groupBy("root").agg(F.count("*").alias("weight"))
        found = space.write(_near_pairs(_dealt(rooted, weights, traits, asking), reach, percent), "near")
        told = found.agg(F.count("*").alias("n"), F.coalesce(F.max("cut"), F.lit(False)).alias("cut")).first()
        if not told.n:
            break
        new = space.write(confirmed(found.select("hub", "node").distinct(), texts, percent), "edges")
        if not new.isEmpty():
            roots = merged(roots, new.toDF("a", "b"), space)
        if not told.cut:
            break
        asking = found.where("cut").select("key", "node").distinct()
        reach *= WIDEN

    grouped = nodes.join(roots, "node", "left").select("fp1", "fp2", F.coalesce("root", "node").alias("component_id"))
    linked = sigs.select("doc_id", "n_shingles", "fp1", "fp2").join(grouped, ["fp1", "fp2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = linked.select("doc_id", "n_shingles", component.alias("component_id"))
    out = space.write(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "result")
    space.keep(out)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each group: that with the smallest id. Rows without an id stay.

    A document is an id. Of its rows that agree in the text the one whose further columns come first as JSON stays, once;
    rows of one id with different texts are all that document's and stay with it.
    """
    kept = near_duplicates(docs, id_col, text_col, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    with_id = docs.join(kept, id_col, "left_semi")
    if rest:
        further = F.struct(*(F.col(f"`{c}`") for c in rest))
        one = with_id.groupBy(id_col, text_col).agg(F.min_by(further, F.to_json(further)).alias("_rest"))
        with_id = one.select(id_col, text_col, *(F.col("_rest")[c].alias(c) for c in rest))
    else:
        with_id = with_id.distinct()
    return with_id.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
