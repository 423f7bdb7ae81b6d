"""Packing whole documents into sequences of a fixed window by non-negative least squares over length combinations.

Four steps, of which only the middle two meet on the driver, with a table whose size is fixed by the window:

1. Every document is tokenised once. Its ids (with the end id) are cut at multiples of the window; what remains is its
   tail. A tail keeps the CRC-32 of each of its prefixes at multiples of `unit` ids, so that a later cut at such a place
   needs no ids any more: the checksum of the part follows from two prefixes. Ids never move between machines.
2. The histogram of tail lengths in units has window / unit entries. Combinations of up to three lengths that fill the
   window are the columns of a non-negative least squares problem whose right side is the histogram; its solution,
   rounded down, says how often to build each combination.
3. Lengths that are left over are packed greedily: a window takes the longest length that is left and then, again and
   again, the longest that still fits, as often as their counts allow. Windows that this fills to within `GAP` units are
   kept; lengths that it cannot fill so are laid end to end and cut where a window ends, which wastes nothing but cuts a text.
4. The k-th tail of a length belongs to the combination or window that claims rank k of that length. Ranks come from counts of (partition, length), so no length
   is ever gathered in one task, however many documents share it.

Padding is at most unit - 1 ids for each tail and `GAP` units for each greedy window, besides the last window. Texts that
hold the vocabulary's end string are tokenised as ordinary text, as its notes recommend. A null text counts as empty (one piece: the end
id); a very long one is tokenised whole. Ties between equal lengths go by their rank. Repeated rows are documents of their own, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tables import Workspace

WINDOW, UNIT, END_ID = 2048, 8, 1
#: Units that a greedy window may stay short.
GAP = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place int"


# --- least squares ----------------------------------------------------------------------------------------------------


def combinations(units: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of lengths that add up to `units`: one, two or three pieces."""
    a, b = np.meshgrid(np.arange(1, units + 1), np.arange(units + 1), indexing="ij")
    c = units - a - b
    keep = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[keep], b[keep], c[keep]], 1)


def solve_counts(histogram: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Non-negative least squares by an active set: the repeat count of each combination that best explains the histogram.

    histogram[k] is the number of pieces of k units. The residual is weighed by length, for a long piece that stays over
    costs more than a short one. Every round lowers the sum of squares, so no active set comes back and the rounds end.
    """
    units = len(histogram) - 1
    lengths = np.arange(units + 1)
    weight = np.sqrt(lengths / units)
    dense = np.zeros((units + 1, len(rows)))
    for k in range(3):
        np.add.at(dense, (rows[:, k], np.arange(len(rows))), 1.0)
    dense[0] = 0
    dense *= weight[:, None]
    target = histogram * weight
    x, active = np.zeros(len(rows)), np.zeros(len(rows), bool)
    scale = max(1.0, float(np.abs(target).max()))
    least = np.inf
    while True:
        rest = target - dense @ x
        now = float(rest @ rest)
        if now >= least * (1 - 1e-12):
            break
        least = now
        gain = dense.T @ rest
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-6 * scale:
            break
        active[best] = True
        while active.any():
            chosen = np.flatnonzero(active)
            part = dense[:, chosen]
            y = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(chosen)), part.T @ target)
            if (y > 0).all():
                x[:] = 0
                x[chosen] = y
                break
            low = chosen[y <= 0]
            step = (x[low] / np.maximum(x[low] - y[y <= 0], 1e-300)).min()
            x[chosen] += step * (y - x[chosen])
            x[x < 1e-9] = 0
            active &= x > 0
    return x


def greedy(left: np.ndarray, units: int, gap: int = GAP) -> Iterator[tuple[list[int], int]]:
    """Windows (lengths, repeats) that the lengths left over fill, longest first; `left` is counted down by the caller.

    A step uses a length up or gives it up, so there are fewer steps than lengths, however many pieces there are.
    """
    tried = np.zeros(len(left), bool)
    while True:
        open_lengths = np.flatnonzero((left > 0) & ~tried)
        open_lengths = open_lengths[open_lengths > 0]
        if not len(open_lengths):
            return
        chosen, room, count = [int(open_lengths[-1])], units - int(open_lengths[-1]), left.copy()
        count[chosen[0]] -= 1
        while room:
            fits = np.flatnonzero(count[1 : room + 1] > 0)
            if not len(fits):
                break
            chosen.append(int(fits[-1]) + 1)
            count[chosen[-1]] -= 1
            room -= chosen[-1]
        if room > gap:
            tried[chosen[0]] = True
            continue
        parts, need = np.unique(chosen, return_counts=True)
        yield chosen, int((left[parts] // need).min())


class Plan:
    """Which combination claims which ranks of each length; its size is bounded by the window, whatever the corpus."""

    def __init__(self, histogram: np.ndarray):
        units = len(histogram) - 1
        rows = combinations(units)
        wished = np.floor(solve_counts(histogram.astype(float), rows) + 1e-6).astype(np.int64)
        left = histogram.astype(np.int64).copy()
        claims: list[tuple[int, int, int, int, int]] = []  # length, first rank, repeats, first sequence, place
        sequences = 0

        def claim(lengths: list[int], times: int) -> None:
            nonlocal sequences
            for place, length in enumerate(lengths):
                claims.append((length, int(histogram[length] - left[length]), times, sequences, place))
                left[length] -= times
            sequences += times

        for p in np.argsort(-wished, kind="stable"):
            parts, need = np.unique(rows[p][rows[p] > 0], return_counts=True)
            times = int(min(wished[p], (left[parts] // need).min()))
            if times > 0:
                claim(sorted((int(k) for k in rows[p] if k), reverse=True), times)
        self.combined = int((histogram - left).sum())
        for chosen, times in greedy(left, units):
            claim(chosen, times)
        self.units, self.sequences, self.left = units, sequences, left
        self.used = histogram - left
        claims.sort()
        self.claims = np.array(claims, np.int64).reshape(-1, 5)
        #: Where the unclaimed pieces of each length begin in the stream that is cut at windows.
        self.base = np.concatenate([[0], np.cumsum(left * np.arange(units + 1))])[: units + 1]
        self.windows = -(-int((left * np.arange(units + 1)).sum()) // units)

    def claim(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, place) of each piece that a combination claims; sequence -1 for the others."""
        if not len(self.claims):
            return np.full(len(rank), -1), np.zeros(len(rank), np.int64)
        far = int(self.claims[:, 1].max() + self.claims[:, 2].max()) + int(rank.max(initial=0)) + 1
        at = np.searchsorted(self.claims[:, 0] * far + self.claims[:, 1], length * far + rank, side="right") - 1
        hit = self.claims[np.maximum(at, 0)]
        inside = (at >= 0) & (hit[:, 0] == length) & (rank < hit[:, 1] + hit[:, 2])
        return np.where(inside, hit[:, 3] + rank - hit[:, 1], -1), hit[:, 4]


# --- checksums of parts -----------------------------------------------------------------------------------------------


def _zero_operators(steps: int) -> list[list[int]]:
    """operators[k]: what 4 * 2**k zero bytes do to a CRC-32 register, as 32 columns."""
    column = [0xEDB88320] + [1 << i for i in range(31)]
    apply = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    for _ in range(5):  # from one bit to 32 bits
        column = [apply(column, v) for v in column]
    out = [column]
    for _ in range(steps - 1):
        column = [apply(column, v) for v in column]
        out.append(column)
    return out


def _xor(values) -> int:
    total = 0
    for v in values:
        total ^= v
    return total


_OPERATORS = _zero_operators(24)


def crc_of_part(before: int, through: int, ids: int) -> int:
    """CRC-32 of the last `ids` 32-bit ids of a prefix, from that of the shorter and of the whole prefix."""
    k = 0
    while ids:
        if ids & 1:
            before = _xor(c for i, c in enumerate(_OPERATORS[k]) if before >> i & 1)
        ids >>= 1
        k += 1
    return before ^ through


# --- Spark ------------------------------------------------------------------------------------------------------------

_encoders: dict = {}


def encoder(path: str):
    """ids(text) for a vocabulary file: a list of byte-level BPE ranks, or a tokenizers file. Cached in each worker."""
    if path not in _encoders:
        if path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            _encoders[path] = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return _encoders[path]


def tokenise(docs: DataFrame, vocabulary: str, window: int, unit: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: full windows (units = window / unit) and tails, numbered by length within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids_of = TaskContext.get().partitionId(), encoder(vocabulary)
        seen = np.zeros(window // unit + 1, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*ids_of(text.as_py() or ""), end_id], "<u4")
                n = len(ids)
                raw = memoryview(ids.tobytes())
                cuts = [*range(0, n, window), n]
                for a, b in pairwise(cuts):
                    units = -(-(b - a) // unit)
                    full = b - a == window
                    crc, prefixes = 0, [0]
                    for k in range(a, b, window if full else unit):
                        crc = zlib.crc32(raw[4 * k : 4 * min(b, k + (window if full else unit))], crc)
                        prefixes.append(crc)
                    row = (doc, a, b - a, n, part, 0 if full else units, int(seen[0 if full else units]), crc, None if full else np.array(prefixes, "<u4").tobytes())
                    seen[0 if full else units] += 1
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "part", "units", "local_rank", "crc", "prefixes"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, part int, units int, local_rank long, crc long, prefixes binary"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, unit: int = UNIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences that hold one whole window of a document have negative numbers (-1, -2, ...), the others count from 0.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    pieces = space.write(tokenise(docs, vocabulary, window, unit, end_id, id_col, text_col), "pieces")
    counts = space.write(pieces.groupBy("part", "units").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "units", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = np.zeros(window // unit + 1, np.int64)
    for row in counts.groupBy("units").agg(F.sum("n").alias("n")).collect():  # window / unit rows at most
        histogram[row.units] = row.n
    histogram[0] = 0  # whole windows need no company
    plan = Plan(histogram)
    ranked = pieces.join(firsts, ["part", "units"]).withColumn("rank", F.col("first") + F.col("local_rank"))
    kind = docs.schema[id_col].dataType.simpleString()
    placed = ranked.select("doc_id", "start", "length", "doc_tokens", "units", "rank", "crc", "prefixes").mapInArrow(_placer(plan, unit), PIECES.replace("doc_id long", f"doc_id {kind}"))
    whole = placed.where("sequence_id < 0").withColumn("offset", F.lit(0).cast("long"))
    ahead = Window.partitionBy("sequence_id").orderBy("place", F.col("start"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    shared = placed.where("sequence_id >= 0").withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    out = space.write(whole.unionByName(shared).drop("place"), "packed")
    space.drop(pieces, counts)
    return out


def _placer(plan: Plan, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, prefixes = b.column(0), b.column(7)
            start, length, tokens, units, rank, crc = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 7))
            units = units.astype(np.int64)
            sequence, place = plan.claim(units, rank)
            place = place.copy()
            sequence[units == 0] = -1 - rank[units == 0]
            loose = np.flatnonzero((units > 0) & (sequence < 0))
            stream = plan.base[units[loose]] + (rank[loose] - plan.used[units[loose]]) * units[loose]
            sequence[loose] = plan.sequences + stream // plan.units
            place[loose] = stream % plan.units
            keep, crcs, extra = length.copy(), crc.copy(), []
            room = (plan.units - place[loose]) * unit
            for i, ids in zip(loose[length[loose] > room], room[length[loose] > room], strict=True):
                table = np.frombuffer(prefixes[int(i)].as_py(), "<u4")
                head = int(table[ids // unit])
                keep[i], crcs[i] = ids, head
                extra.append((int(i), start[i] + ids, length[i] - ids, crc_of_part(head, int(table[-1]), int(length[i] - ids)), sequence[i] + 1))
            rows = np.concatenate([np.arange(len(start)), np.array([e[0] for e in extra], np.int64)])
            more = [np.array([e[k] for e in extra], np.int64) for k in range(1, 5)]
            columns = [
                doc.take(pa.array(rows)),
                *(pa.array(np.concatenate([x, y]), pa.int64()) for x, y in ((start, more[0]), (keep, more[1]), (crcs, more[2]))),
                pa.array(tokens[rows], pa.int64()),
                pa.array(np.concatenate([sequence, more[3]]), pa.int64()),
                pa.array(np.concatenate([place, np.full(len(extra), -1)]), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"])

    return run
