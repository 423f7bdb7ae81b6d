import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def cost(flows, patterns):
    """(words not placed, convex cost) of what the patterns give."""
    total = 0
    for (_, size), flow in zip(patterns, flows, strict=True):
        left, k = sum(flow.values()), 0
        while left > 0 and size:
            total += k * k * min(size, left)
            left, k = left - size, k + 1
    return sum(sum(f.values()) for f in flows), total


def best(patterns, wanted, most):
    """All integer flows, tried one by one."""
    arcs = [(i, s) for i, (sources, _) in enumerate(patterns) for s in sources]
    found = None
    for amounts in itertools.product(*(range(min(most * patterns[i][1], wanted[s]) + 1) for i, s in arcs)):
        flows = [{} for _ in patterns]
        for (i, s), a in zip(arcs, amounts, strict=True):
            flows[i][s] = a
        if any(sum(f.values()) > most * p[1] for f, p in zip(flows, patterns, strict=True)):
            continue
        if any(sum(f.get(s, 0) for f in flows) > w for s, w in enumerate(wanted)):
            continue
        placed, price = cost(flows, patterns)
        found = max(found or (-1, 0), (placed, -price))
    return found[0], -found[1]


@pytest.mark.parametrize("seed", range(6))
def test_route_is_a_minimum_cost_flow(seed):
    rnd = random.Random(seed)
    patterns = [((0,), rnd.randrange(1, 3)), ((0, 1), rnd.randrange(1, 3)), ((1,), rnd.randrange(0, 3))]
    wanted = [rnd.randrange(1, 7), rnd.randrange(1, 7)]
    assert cost(mixing.route(patterns, wanted, 3), patterns) == best(patterns, wanted, 3)


def test_quotas_share_the_excess():
    assert mixing.quotas(100, [90, 10], [1, 1]) == [70, 30]
    assert mixing.quotas(30, [10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.quotas(0, [0, 0], [1, 2]) == [0, 0] and mixing.quotas(0, [], []) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    run = lambda: sorted(map(tuple, mixing.mix(docs, F.array("source")).select("doc_id", "size", "target", "taken", "copies", F.col("pattern")[0]).collect()))
    rows = run()
    assert rows == run() and len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    taken, target, largest = {}, {}, {}
    for doc, size, goal, took, copies, source in rows:
        assert size == words(texts[doc]) and took == copies * size and 0 <= copies <= 3
        taken[source] = taken.get(source, 0) + took
        target[source] = goal
    assert sum(target.values()) == pytest.approx(sum(map(words, texts.values())))
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 50, (s, taken[s], target[s], largest)


def test_many_buckets_and_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 10)
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 4}") for i in range(900)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.array("source")).collect()
    for s in {r.pattern[0] for r in out}:
        own = [r for r in out if r.pattern[0] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4


def test_edges(spark):
    rows = [(1, None, None), (2, "", "b"), (3, "x  y\tz", None), (3, "x  y\tz", None), (4, " one word ", "a"), (None, "p q", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    out = mixing.mix(docs, F.array("source"))
    assert sorted((r.doc_id or -1, r.size) for r in out.collect()) == [(-1, 2), (1, 0), (2, 0), (3, 3), (3, 3), (4, 1)]
    assert mixing.repeat(docs, out).columns == docs.columns
    assert mixing.mix(docs.limit(0), F.array("source")).collect() == []


def test_overlapping_sources_serve_both(spark):
    rows = [(i, "w " * 10, ["a"] if i < 2 else ["a", "b"] if i < 4 else ["b"]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    out = mixing.mix(docs, F.col("sources"), weights=(1.0, 1.0)).collect()
    assert all(r.copies == 1 for r in out)


def test_the_query_goes_through_the_flow(spark, monkeypatch):
    from lodestone.llm import queries

    called, plain = [], mixing.flow
    monkeypatch.setattr(mixing, "flow", lambda *a: called.append(a) or plain(*a))
    docs = queries.op5_mixing(spark, "/root/testdata/sf0.001")
    assert len(called) == docs.select("source").distinct().count() > 3


def test_repeated_rows_and_many_shelves(spark, monkeypatch):
    """A third of all rows are one row; buckets are of few documents and shelves of few buckets."""
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 5)
    monkeypatch.setattr(mixing, "SHELF", 3)
    rows = [(7, "same words here", "a")] * 400 + [(i, "w " * (1 + i % 5), "ab"[i % 3 == 0]) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.mix(df, F.array("source"))
    got = out.collect()
    assert len(got) == len(rows) and sum(r.doc_id == 7 for r in got) == 401
    for s in "ab":
        own = [r for r in got if r.pattern[0] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
    again = mixing.mix(df.repartition(3), F.array("source")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
