import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import topk


def brute(rows, k, is_query):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, w) in enumerate(vectors):
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(w, v, strict=True)), i) for b, (i, v) in enumerate(vectors) if a != b and len(v) == len(w))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_small_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = topk.search(table, F.col("vec_id") % 50 == 0, candidates=64, queries=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, lambda i: i % 50 == 0)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 0.0]), (7, [1.0]), (0, [0.25, 1.0]), (None, [1.0, 1.0]), (50, [-1.0, 0.001]), (100, [2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "'x' AS score")
    got = topk.search(table, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, lambda i: i % 50 == 0)
    assert topk.search(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("large", [1, 40_000, 400_000_000])
def test_bounds_lose_nothing(large):
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (5000, 6)) * large
    x[:7] = [[9 * large] * 6] * 7
    asked = rng.integers(0, 5000, 30)
    ids = rng.permutation(5000)
    best = topk.tile_top(np.arange(5000), ids, x, asked, x[asked], np.full(30, topk.NONE), 5)
    for i in range(30):
        scores = x @ x[asked[i]]
        want = sorted((-s, b) for j, (s, b) in enumerate(zip(scores, ids, strict=True)) if j != asked[i])[:5]
        assert [(-a, b) for a, b in zip(best.scores[best.rows == i], best.ids[best.rows == i], strict=True)] == want


def test_bounds_rule_out_candidates_before_lists_end(monkeypatch):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x = np.floor(256 * np.array(table["embedding"].to_pylist(), float)).astype(np.int64)
    asked = np.arange(0, len(x), 50)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = topk.NONE
    floor = np.sort(scores, axis=1)[:, -5]
    rows, _, found, read = topk.block_top(x, x[asked], asked, floor, 5)
    assert read <= 0.7 * x.size * len(asked) and len(rows) < 0.03 * scores.size
    assert (found.max(), len(np.unique(rows))) == (scores.max(), len(asked))
    monkeypatch.setattr(topk, "STOPS", (0.5,))
    none = np.full(len(asked), topk.NONE)
    half, alone = (len(topk.block_top(x, x[asked], asked, f, 5)[0]) for f in (floor, none))
    assert half < 0.4 * scores.size and half < alone


def test_a_vector_of_many_dimensions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=20_000).tolist()) for i in range(6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(table, F.col("vec_id") < 2).collect())) == brute(rows, 5, lambda i: i < 2)
