import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing
from lodestone.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, offset string, units int"


def plain_ids():
    """ids by the tokenizers library and the vocabulary file that the contract names."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, texts, window=packing.WINDOW):
    """Pieces cover each document once, checksums match, sequences are gapless and fit the window."""
    ids_of = plain_ids()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*ids_of(texts[doc] or ""), 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(by_sequence) * window - sum(r.length for r in rows)


def test_round_trip_of_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs, vocabulary()).collect()
    padding = check(rows, texts)
    assert padding < 0.02 * sum(r.length for r in rows)


def test_nulls_empty_long_and_clashing_columns(spark):
    texts = {1: None, 2: "", 3: "word " * 30_000, 4: "x" * 50_000, 5: "short"}
    docs = spark.createDataFrame([(k, v, "a", 9) for k, v in texts.items()], SCHEMA)
    check(packing.pack(docs, vocabulary()).collect(), texts)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), vocabulary()).collect() == []


def test_one_length_for_all_is_cut_and_not_padded(spark):
    text = "one two three " * 420
    texts = {i: text for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    rows = packing.pack(docs, vocabulary()).collect()
    assert check(rows, texts) < 0.01 * sum(r.length for r in rows) + packing.WINDOW


def test_plan_claims_each_rank_once():
    rng = np.random.default_rng(0)
    histogram = np.concatenate([[0], rng.integers(0, 60, 64)])
    plan = packing.Plan(histogram)
    load = {}
    for length in range(1, 65):
        ranks = np.arange(histogram[length])
        sequence, place = plan.claim(np.full(len(ranks), length), ranks)
        assert (sequence >= 0).sum() == plan.used[length]
        for s, p in zip(sequence, place, strict=True):
            if s >= 0:
                load.setdefault(s, []).append((p, length))
    assert all(64 - packing.GAP <= sum(n for _, n in x) <= 64 and len({p for p, _ in x}) == len(x) for x in load.values())
    assert len(load) == plan.sequences and plan.left.sum() < 0.3 * histogram.sum()


def test_least_squares_is_not_negative_and_optimal():
    histogram = np.array([0, 5, 0, 7, 4, 0, 2, 3, 1], float)
    rows = packing.combinations(8)
    x = packing.solve_counts(histogram, rows)
    assert (x >= 0).all()
    dense = np.zeros((9, len(rows)))
    for k in range(3):
        np.add.at(dense, (rows[:, k], np.arange(len(rows))), 1.0)
    dense[0] = 0
    weight = np.arange(9) / 8
    gain = dense.T @ (weight * (histogram - dense @ x))
    assert gain.max() < 1e-4 and np.abs(gain[x > 0]).max(initial=0) < 1e-4


@pytest.mark.parametrize("ids", [1, 7, 8, 100, 2047])
def test_checksum_of_a_part(ids):
    a, b = np.arange(40, dtype="<u4").tobytes(), np.arange(ids, dtype="<u4").tobytes()
    assert packing.crc_of_part(zlib.crc32(a), zlib.crc32(a + b), ids) == zlib.crc32(b)


def test_every_document_has_the_ids_of_the_named_vocabulary(spark):
    mine, plain = packing.encoder(vocabulary()), plain_ids()
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for text in [*texts, "a <|endoftext|> b", "<|endoftext|>", "é\u0301\u200b 中文 \r\n\t x  y", "\x00\x7f", "9" * 3000]:
        assert list(mine(text)) == plain(text)


def test_what_is_left_over_is_packed_greedily():
    histogram = np.zeros(257, np.int64)
    histogram[[200, 50, 40, 30, 20, 10, 3]] = [10, 40, 3, 7, 11, 5, 100]
    left, filled = histogram.copy(), []
    for chosen, times in packing.greedy(left, 256):
        assert 256 - packing.GAP <= sum(chosen) <= 256 and times > 0
        for length in chosen:
            left[length] -= times
        filled.append((sum(chosen), times))
    assert (left >= 0).all() and sum(n * t for n, t in filled) > 0.9 * (histogram * np.arange(257)).sum()


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_most_tails_are_placed_whole(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    rows = packing.pack(docs, vocabulary()).collect()
    cut = len(rows) - sum(-(-n // packing.WINDOW) for n in {r.doc_id: r.doc_tokens for r in rows}.values())
    assert cut < 0.05 * docs.count()
    assert 1 - sum(r.length for r in rows) / (len({r.sequence_id for r in rows}) * packing.WINDOW) < 0.01
