"""Token ids of whole documents in ORC files, in order of document ids, and readers that touch only what they need.

The format. A folder of ORC files, one for each part; parts follow each other in ascending id order (nulls last; rows of
one id by a hash of their text). A row is a document: `doc_id`, `part` (number of the file), `first` (ids before it in
its part), `size` (their number) and `ids`. ORC cuts a file into stripes, writes integers in its run-length encoding, keeps least and largest
values for each stripe and each `stride` rows (row index), and here also Bloom filters of `doc_id`. So

- `documents` reads stripes in parallel: Spark deals a file out by its stripes, and no reader needs another's rows;
- `lookup` pushes ids into the reader, which passes over files and stripes by their ranges and over row groups by Bloom filter;
- `span` reads a stretch of the whole stream of ids: the parts that hold it, and in them the row groups whose `first` does.

Texts are dealt by range of their ids once and tokenised where they are sorted, so ids never move between machines. Ids of
one hot document id are spread over parts by the hash, and no part is held whole: it is sorted by Spark, which spills, and
its ids are written as they come.

Byte-level BPE first splits a text into words, and no word of it goes on over white space that follows another character,
or from a letter to a stop. Texts are cut there, and each different piece is encoded once in a batch and kept for the next
ones (a bounded cache). The ids are those of the whole text.

A null or empty text has the end id alone. Very long texts are a part of a batch of their own and one row. Repeated rows
are documents of their own, next to each other; rows of one id with different texts go by hash. Rows without an id come
last and keep a null id. An empty table gives files without rows and an empty result. Further columns are ignored. Text
that spells the vocabulary's end token is ordinary text, as its notes recommend.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import words

END_ID = 2
#: Rows of a row group, bytes of a stripe.
STRIDE, STRIPE = 1000, 32 << 20
#: Pieces kept from batch to batch, and the mean length up to which those of a batch are kept.
CACHED, LONGEST = 600_000, 64
#: Bytes of the texts that are encoded together.
TOGETHER = 4_000_000

_BLANK, _STOP, _LETTER = np.zeros((3, 256), bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STOP[[*b".,;:!?"]] = True
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes, in order, where no id reaches across: before ASCII white space that follows a character other
    than white space, and before a stop that follows an ASCII letter."""
    before, here = data[:-1], data[1:]
    cut = (_BLANK[here] & (before > 0x20)) | (_STOP[here] & _LETTER[before])
    at = np.flatnonzero(cut) + 1
    # White space beyond ASCII is two bytes after 0xC2, or three after 0xE1 to 0xE3; what else these are does no harm.
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = ((two == 0xC2) & (one >= 0x80)) | ((three >= 0xE1) & (three <= 0xE3) & (two >= 0x80) & (one >= 0x80))
    return at[~wide]


class Encoder:
    """Ids of many texts at once, by the tokenizers library; ids of short pieces are kept, the first `CACHED` of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(CACHED, np.int64), np.zeros(CACHED, np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in `self.ids`, and how many there are."""
        index = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        at, size = self.at[index], self.size[index]
        places = np.flatnonzero(index < 0)
        if len(places):
            new = [pieces[i] for i in places.tolist()]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            begin = self.used + np.cumsum(sizes) - sizes
            end = self.used + int(sizes.sum())
            if end > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * end - self.used, np.uint32)])
            self.ids[self.used : end] = np.fromiter(chain.from_iterable(found), np.uint32, end - self.used)
            at[places], size[places] = begin, sizes
            count = len(self.known)
            if count + len(new) <= CACHED and sum(map(len, new)) <= LONGEST * len(new):
                self.known.update(zip(new, range(count, count + len(new)), strict=True))
                self.at[count : count + len(new)], self.size[count : count + len(new)] = begin, sizes
                self.used = end
        return at, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids after each other, and for each text the number of its first one (one more entry: all)."""
        data, offsets = words.utf8(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[boundaries(data)] = begins[offsets] = True
        cuts = np.flatnonzero(begins)
        flat = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = flat.dictionary_encode()
        at, size = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = coded.indices.to_numpy().astype(np.int64)
        length = size[codes]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(at[codes] - (ends - length), length) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """Cached in each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, part, first, size, ids of each row, in the order that rows of a partition have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, ids_of = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for whole in batches:
            for b in words.slices(whole, "text", TOGETHER):
                ids, first = ids_of.encode(words.texts_of(b, "text"))
                first = np.asarray(first, np.int64)
                ids = np.insert(ids, first[1:], end_id).astype(np.int32)
                offsets = first + np.arange(len(first))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(before + offsets[:-1], pa.int64()), pa.array(np.diff(offsets), pa.int32()), lists], ["doc_id", "part", "first", "size", "ids"])
                before += len(ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, first long, size int, ids array<int>")


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, stride: int = STRIDE, stripe: int = STRIPE) -> None:
    """Writes the ids of all documents to `path`; `parts` is the number of files (none: as Spark sizes its shuffles)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keys = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ordered = (docs.repartitionByRange(parts, *keys) if parts else docs.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    writer = encode(ordered, vocabulary, end_id).write.option("orc.compress", "ZSTD").option("orc.stripe.size", stripe)
    writer = writer.option("orc.rows.between.memory.checks", 100)  # stripes end near their size although rows are long
    writer.option("orc.row.index.stride", stride).option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def parts_of(files: DataFrame) -> DataFrame:
    """part, before (ids in all earlier parts), n_ids: one row for each file, from its short columns."""
    sizes = files.groupBy("part").agg(F.max(F.col("first") + F.col("size")).alias("n_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"), "n_ids")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all from the files."""
    files = read(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at = np.asarray(lists.offsets, np.int64)
            ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
            raw = memoryview(ids).cast("B")
            crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(at), pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    kind = files.schema["doc_id"].dataType.simpleString()
    summed = files.select("doc_id", "part", "first", "ids").mapInArrow(run, f"doc_id {kind}, part int, first long, n_tokens long, ids_crc32 long")
    return summed.join(parts_of(files), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """doc_id and ids of the documents named; the reader passes over row groups by range and Bloom filter."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def span(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """start, ids: the documents' shares of a stretch of the whole stream of ids, cut at its ends."""
    files, end = read(spark, path), start + length
    near = parts_of(files).where((F.col("before") < end) & (F.col("before") + F.col("n_ids") > start)).collect()  # the files of the stretch
    shares = []
    for p in near:
        own = files.where((F.col("part") == p.part) & (F.col("first") < end - p.before))
        at = F.col("first") + p.before
        skip = F.greatest(F.lit(start) - at, F.lit(0))
        cut = F.slice("ids", (skip + 1).cast("int"), F.least(F.size("ids") - skip, F.lit(end) - at - skip).cast("int"))
        shares.append(own.where(at + F.col("size") > start).select((at + skip).alias("start"), cut.alias("ids")))
    if not shares:
        return files.limit(0).select(F.col("first").alias("start"), "ids")
    out = shares[0]
    for s in shares[1:]:
        out = out.unionByName(s)
    return out
