"""Structure statistics of whole texts, and bounded labelled samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import words

STRUCTURE = ("log_bytes", "upper", "digit", "punctuation", "symbol", "pipe", "line_end", "not_ascii", "word_length", "distinct_words", "distinct_lines", "words_a_line")


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, np.int32)
    for low, high in ranges:
        table[low : high + 1] = 1
    return table


_CLASSES = [_class((65, 90)), _class((48, 57)), _class((33, 33), (39, 39), (44, 44), (46, 46), (58, 59), (63, 63)), _class((35, 38), (42, 43), (60, 62), (64, 64), (91, 96), (123, 123), (125, 126)), _class((124, 124)), _class((10, 10)), _class((128, 255))]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def distinct_share(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the share of its keys that are distinct; 1 where it has none."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.where(counts > 0, np.bincount(o, fresh, len(counts)) / np.maximum(counts, 1), 1.0)


def structure(texts: pa.Array) -> np.ndarray:
    """One row of the STRUCTURE columns for each text; shares are of its bytes."""
    data, offsets = words.utf8(texts)
    n = np.maximum(np.diff(offsets), 1)
    shares = [_sums(table[data], offsets) / n for table in _CLASSES]
    starts, ends, first = words.word_spans(data, offsets)
    hashes = words.hash_spans(data, starts, ends)
    counts = np.maximum(np.diff(first), 1)
    # Lines: runs of bytes between line ends, told apart by the sum of the hashes of their words.
    breaks = np.cumsum(np.concatenate([[0], data == 10]))
    line = np.repeat(np.arange(len(first) - 1), np.diff(first)) + breaks[starts]
    new = np.ones(len(line), bool)
    new[1:] = line[1:] != line[:-1]
    at = np.flatnonzero(new)
    lines = np.add.reduceat(words.mix(hashes), at) if len(at) else np.zeros(0, words.U64)
    first_line = np.searchsorted(at, first)
    columns = [
        np.log1p(np.diff(offsets)),
        *shares,
        _sums(ends - starts, first) / counts,
        distinct_share(hashes, first),
        distinct_share(lines, first_line),
        np.log1p(counts / np.maximum(np.diff(first_line), 1)),
    ]
    return np.stack(columns, 1)


def labelled(labels: DataFrame, targets: dict[str, Column], most: int, train_only: bool = False, docs: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """doc_id and 0/1 targets of at most `most` labelled documents, taken in the order of a hash of their ids.

    Repeated labels of a document are averaged and rounded. With train_only, ids whose crc32 leaves 0 modulo 5 are held
    out. The bound is what a model is fitted on; it is a parameter, and nothing else is bounded by it. With docs, only
    labels of its documents count. With by, each kind of that target gets its share of the bound, and the rarer one a
    tenth of the bound at least or all it has.
    """
    rows = labels.select("doc_id", *(c.cast("double").alias(name) for name, c in targets.items())).where(F.col("doc_id").isNotNull())
    if train_only:
        rows = rows.where(~held_out(F.col("doc_id")))
    rows = rows.dropna().groupBy("doc_id").agg(*(F.round(F.avg(name)).cast("int").alias(name) for name in targets))
    if docs is not None:
        rows = rows.join(docs.select("doc_id"), "doc_id", "left_semi")
    if by is None:
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col(by) > 0).alias("ones")).first()
    ones, zeros = counts.ones, counts.n - counts.ones
    least = most // 10
    taken = round(most * ones / max(counts.n, 1))
    taken = min(ones, max(taken, min(ones, least), most - zeros, 0))
    taken = min(taken, most - min(zeros, least))
    kinds = [rows.where(F.col(by) > 0), taken], [rows.where(F.col(by) <= 0), most - taken]
    parts = [kind.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for kind, n in kinds]
    return parts[0].unionByName(parts[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
