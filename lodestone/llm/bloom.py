"""Rows whose key is wanted, without moving the others: a Bloom filter of bounded size, then an exact semi join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import words
from lodestone.llm.words import U64

#: Places for each key, and the least and the most bits of a filter's size: 128 KB to 16 MB are broadcast. With more keys
#: than fit (some 33 million) the filter would let most rows through; then none is made and the semi join does all.
PLACES, LEAST_BITS, MOST_BITS, PROBES = 8, 20, 27, 4


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    base = words.mix(keys.astype(np.int64).view(U64), 40)
    step = words.mix(base, 41) | U64(1)
    return np.concatenate([((base + U64(k) * step) >> U64(64 - bits)).astype(np.int64) for k in range(PROBES)])


def rows_with(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose long `key` occurs in the only column of wanted."""
    wanted = wanted.toDF("wanted_key").where("wanted_key IS NOT NULL").distinct()
    exact = lambda rows: rows.join(wanted, F.col(key) == F.col("wanted_key"), "left_semi")
    size = max(LEAST_BITS, (PLACES * max(1, wanted.count()) - 1).bit_length())
    if size > MOST_BITS + 1:
        return exact(df)
    size = min(size, MOST_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << size, bool)
        for b in batches:
            bits[_places(b.column(0).to_numpy(zero_copy_only=False), size)] = True
        packed = np.packbits(bits).view(np.int64)
        place = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(packed[place])], ["place", "bits"])

    parts = wanted.mapInArrow(fill, "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2**MOST_BITS / 64 rows at most
    packed = np.zeros((1 << size) // 64, np.int64)
    packed[np.asarray(parts["place"], np.int64)] = np.asarray(parts["bits"], np.int64)
    table = df.sparkSession.sparkContext.broadcast(packed.view(np.uint8))
    at = df.columns.index(key)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for b in batches:
            column = b.column(at)
            places = _places(np.asarray(pa.compute.fill_null(column, 0), np.int64), size)
            hit = (bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).reshape(PROBES, -1).all(0)
            yield b.filter(pa.compute.and_(pa.array(hit), column.is_valid()))

    return exact(df.mapInArrow(keep, df.schema))
