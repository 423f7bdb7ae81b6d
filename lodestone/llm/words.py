"""Words of whole texts as 64-bit hashes, for a batch of texts at a time.

A word is a maximal run of characters other than the six ASCII white-space characters, so a text can be cut on its
UTF-8 bytes. Everything here works on the buffers of an Arrow array with NumPy; there is no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators where punctuation is not part of a word either.
_LOOSE = _SPACE.copy()
_LOOSE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = U64(0x9E3779B97F4A7C15)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U64) | U64(1)
_powers = np.ones(1, U64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, U64), np.cumprod(np.full(max(n, 64), _BASE, U64), dtype=U64)])
    return _powers


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the offsets of its texts in them."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, punctuation: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in data, and for each text the number of its first word (one more entry: all).

    Without `punctuation`, ASCII punctuation separates words as white space does.
    """
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~(_SPACE if punctuation else _LOOSE)[data]
    begins, finishes = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= solid[inner + 1]
    finishes[inner - 1] |= solid[inner]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, number of each text's first word, starts, ends) for a string array without nulls."""
    data, offsets = utf8(texts)
    starts, ends, first = word_spans(data, offsets)
    return hash_spans(data, starts, ends, lower), first, starts, ends


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(at[-1] + lengths[-1]) - np.repeat(at, lengths)
    solid = data[place + np.repeat(starts, lengths)]
    table = _power_table(int(lengths.max()))
    return mix(np.add.reduceat((_LOWER if lower else _BYTE)[solid] * table[place], at) + lengths.astype(U64))


def runs(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and the number of each text's first run. A text of 1 to n-1 words gives one run."""
    counts = np.diff(first)
    out = np.maximum(counts - n + 1, (counts > 0).astype(counts.dtype))
    begin = np.cumsum(out) - out
    if not out.sum():
        return np.zeros(0, U64), np.concatenate([begin, [0]])
    at = np.arange(out.sum()) - np.repeat(begin, out) + np.repeat(first[:-1], out)
    width = np.minimum(np.repeat(counts, out), n)
    total = np.zeros(len(at), U64)
    last = max(len(hashes) - 1, 0)
    for k in range(n):
        part = hashes[np.minimum(at + k, last)] * _ORDER[k]
        total += part if k == 0 else np.where(width > k, part, U64(0))
    return mix(total + width.astype(U64), 1), np.concatenate([begin, [out.sum()]])


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of limited text volume; a longer text is a part of its own. No text is cut."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    total, start = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most_bytes:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as a string array in which a null is the empty text."""
    return pa.compute.fill_null(batch.column(column).cast(pa.large_string()), "")
