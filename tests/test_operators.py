import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import analytics, consolidate, graph, search, sessions, store


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, "d"), (4, "")], "id long, text string")
    queries = spark.createDataFrame([(9, "c a")], "query_id long, query string")
    got = {r.id: r.score for r in search.bm25(docs, queries, "id", T.spaced(F.col("text")), T.spaced(F.col("query"))).collect()}
    n, avg = 3, 2.0
    raw = {t: math.log((n - df + 0.5) / (df + 0.5)) for t, df in {"a": 2, "b": 1, "c": 1, "d": 1}.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / 4 for t, x in raw.items()}
    part = lambda t, tf, dl: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({1: part("a", 1, 2), 2: part("a", 1, 3) + part("c", 2, 3)})


def test_fusion_counts_a_missing_rank_after_the_last(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (1, "y", 1.0)], "query_id long, id string, score double")
    b = spark.createDataFrame([(1, "y", 5.0)], a.schema)
    got = {r.id: r.score for r in search.fuse([a, b, a.limit(0)]).collect()}
    assert got == pytest.approx({"x": 1 / 61 + 1 / 62, "y": 1 / 62 + 1 / 61})


def test_diversity_prefers_the_unlike(spark):
    rows = [(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.7, [0.0, 1.0]), (1, 4, 0.1, None)]
    pool = spark.createDataFrame(rows, "query_id long, id long, score double, vector array<float>")
    assert [r.id for r in sorted(search.diversify(pool, 2).collect(), key=lambda r: r.place)] == [1, 3]
    assert [r.id for r in sorted(search.diversify(pool, 8).collect(), key=lambda r: r.place)] == [1, 2, 3, 4]


def test_cosine_top_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    got = {(r.query_id, r.rank): r.id for r in search.cosine_top(v.where("id < 3").withColumnRenamed("id", "query_id"), v, 4).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(3):
        order = [i for i in np.argsort(-(unit @ unit[q])) if i != q][:4]
        assert [got[q, k + 1] for k in range(4)] == order


RECORD = "id string, title string, essence string, project string, tags array<string>, importance int, layer int, related array<string>, contradicts array<string>, session string, status string"


def _records(spark, n=40, seed=1):
    rnd = random.Random(seed)
    vocab = [f"word{i}" for i in range(60)]
    rows = [(f"{i:08x}", f"title {i}", " ".join(rnd.choices(vocab, k=rnd.randrange(5, 30))), f"p{i % 3}", [f"t{i % 4}"], 1 + i % 5, None if i % 5 == 4 else i % 4, [f"{(i * 7) % n:08x}"], [f"{i + 1:08x}"] if i % 10 == 0 else [], f"s{i // 4}" if i % 2 else "", "active") for i in range(n)]
    return rows, spark.createDataFrame(rows, RECORD)


def test_graph_scores_and_edges_equal_plain_python(spark):
    rows, df = _records(spark)
    feats = graph.features(df)
    pairs = graph.candidates(feats)
    got = {(r.src, r.dst): r for r in graph.score_pairs(pairs, feats).collect()}

    def grams(text, n):
        t = text.split()
        return {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}

    sets = spark.createDataFrame([(r[0], f"{r[1]} {r[2]}") for r in rows], "id string, t string").select("id", T.word_set(F.col("t")).alias("w")).collect()
    words = {r.id: set(r.w) for r in sets}
    by = {r[0]: r for r in rows}
    contain = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0.0
    assert len(got) > 200
    for (s, d), r in got.items():
        a, b = by[s], by[d]
        ta, tb = f"{a[1]} {a[2]}", f"{b[1]} {b[2]}"
        lexical = 0.5 * contain(words[s], words[d]) + 0.3 * contain(grams(ta, 2), grams(tb, 2)) + 0.2 * contain(grams(ta, 3), grams(tb, 3))
        layer = lambda x: 2 if x is None else x
        struct = 0.5 * max(0, 1 - abs(layer(a[6]) - layer(b[6])) / 3) + 0.5 * (a[5] + b[5]) / 10
        score = 0.45 * lexical + 0.2 * (a[4] == b[4]) + 0.15 * (a[3] == b[3]) + 0.1 * (a[9] != "" and a[9] == b[9]) + 0.05 * struct + 0.05 * max(d in a[7], d in a[8])
        assert r.lexical == pytest.approx(lexical) and r.score == pytest.approx(score)
        want = "contradicts" if d in a[8] else "same_topic" if round(lexical, 9) >= 0.25 else "supports" if a[4] == b[4] and round(lexical, 9) >= 0.12 else "same_session" if a[9] and a[9] == b[9] else "same_project"
        assert r.relation == want
    edges = graph.edges(graph.score_pairs(pairs, feats))
    keys = [(r.src, r.dst, r.relation) for r in edges.collect()]
    assert len(keys) == len(set(keys)) and {(d, s, k) for s, d, k in keys if k in graph.RECIPROCAL} <= set(keys)


def test_expand_and_audit(spark):
    e = spark.createDataFrame([("a", "b", "same_topic", 0.5), ("b", "c", "same_topic", 0.4), ("b", "d", "same_topic", 0.2), ("c", "e", "same_topic", 0.9), ("a", "z", "contradicts", 0.9)], "src string, dst string, relation string, score double")
    seeds = spark.createDataFrame([(1, "a")], "query_id long, id string")
    assert {(r.id, r.hop) for r in graph.expand(seeds, e).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    records = spark.createDataFrame([("a", "active"), ("b", "active"), ("c", "deprecated"), ("d", "active"), ("e", "active"), ("q", "active")], "id string, status string")
    found = {(r.finding, r.id) for r in graph.audit(e, records).collect()}
    assert {("orphan", "q"), ("dangling", "a>z:contradicts"), ("one_way", "a>b:same_topic"), ("deprecated_linked", "c")} <= found


def test_upsert_invalidate_and_lookup(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    schema = "id string, title string, essence string, tags array<string>, valid_at timestamp_ntz, updated_at timestamp_ntz"
    old = spark.createDataFrame([("1", "a", "x", ["p"], t0, t0), ("2", "b", "y", ["q"], t0, t0)], schema)
    new = spark.createDataFrame([("2", "B", "z", ["r", "q"], None, t0), ("2", "BB", "zz", ["r"], None, t1), ("3", "c", "w", [], None, t0)], schema)
    out = {r.id: (r.title, r.essence, r.tags) for r in store.upsert(old, new, F.lit("2024-02-02").cast("timestamp_ntz")).collect()}
    assert out == {"1": ("a", "x", ["p"]), "2": ("BB", "zz", ["q", "r"]), "3": ("c", "w", [])}
    versions = old.select("id", "valid_at", F.lit(None).cast("timestamp_ntz").alias("invalid_at"), F.lit(None).cast("string").alias("replaced_by"))
    closed = store.invalidate(versions, spark.createDataFrame([("1", "9")], "id string, replaced_by string"), F.lit("2024-01-15").cast("timestamp_ntz"))
    assert {r.id for r in store.as_of(closed, F.lit("2024-01-10").cast("timestamp_ntz")).collect()} == {"1", "2"}
    assert {r.id for r in store.as_of(closed, F.lit("2024-01-20").cast("timestamp_ntz")).collect()} == {"2"}
    records = spark.createDataFrame([("abcdefgh1",), ("abcdefgh2",), ("zzzzzzzz9",)], "id string")
    keys = spark.createDataFrame([("abcdefgh",), ("zzzzzzzz9",), ("zzzzzzzz",), ("abc",)], "key string")
    assert {(r.key, r.id) for r in store.lookup(records, keys).collect()} == {("abcdefgh", "abcdefgh1"), ("zzzzzzzz9", "zzzzzzzz9"), ("zzzzzzzz", "zzzzzzzz9")}
    assert {(r.key, r.id) for r in store.lookup_unambiguous(records, keys).collect()} == {("zzzzzzzz9", "zzzzzzzz9"), ("zzzzzzzz", "zzzzzzzz9")}


def test_links_both_ways(spark):
    records = spark.createDataFrame([("a", ["b"]), ("b", ["a"]), ("c", [])], "id string, related array<string>")
    out, told = store.link(records, spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "x")], "a string, b string"))
    assert {r.id: r.related for r in out.collect()} == {"a": ["b", "c"], "b": ["a"], "c": ["a"]}
    assert {(r.a, r.b): r.outcome for r in told.collect()} == {("a", "b"): "already_linked", ("a", "c"): "linked", ("a", "x"): "invalid_target"}


def test_turn_pairs_and_budgets(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "user", "u2"), (1, 3, "assistant", "a1"), (1, 4, "assistant", "a2"), (1, 5, "user", "u3"), (2, 0, "assistant", "lost"), (2, 1, "user", "x")], "session long, pos long, role string, text string")
    got = {(r.session, r.pair): (r.user_text, r.assistant_text) for r in sessions.turn_pairs(turns).collect()}
    assert got == {(1, 1): ("u1\nu2", "a1\na2"), (1, 2): ("u3", ""), (2, 1): ("x", "")}
    lines = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "b" * 20), (1, 2, "cc")], "session long, pos long, line string")
    r = sessions.fitting(lines, "session", 10, "pos", "line").first()
    assert (r.kept, r.used, r.dropped) == (["aaaa", "cc"], 8, 1)
    kept = sessions.within_budget(lines, "session", F.length("line"), 10, F.col("pos")).collect()
    assert [r.pos for r in kept] == [0]


@pytest.mark.parametrize(("forward", "want"), [(False, {(1, 1), (1, 2), (1, 3)}), (True, {(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)})])
def test_greedy_clusters(spark, forward, want):
    pairs = spark.createDataFrame([("p", 1, 2), ("p", 1, 3), ("p", 3, 4), ("p", 4, 5)], "project string, a long, b long")
    assert {(r.seed, r.id) for r in consolidate.greedy_clusters(None, pairs, 3 if not forward else 2, forward).collect()} == want


def test_attribution_literals(spark):
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    ids = spark.createDataFrame([("aaaaaaaa",), ("bbbbbbbb",)], "id string")
    ts = lambda d: dt.datetime(2024, 1, 31) - dt.timedelta(days=d)
    cites = spark.createDataFrame([("aaaaaaaa", ts(1)), ("aaaaaaaa", ts(3)), ("bbbbbbbb", ts(20))], "id string, ts timestamp_ntz")
    assert {r.id: r.score for r in consolidate.attribution(cites, ids, now).collect()} == pytest.approx({"aaaaaaaa": 2 / 3, "bbbbbbbb": 0.0})
    assert {r.score for r in consolidate.attribution(cites.limit(0), ids, now).collect()} == {None}


def test_replay(spark):
    a = spark.createDataFrame([(1, ["x", "y", "z"]), (2, [])], "query_id long, ids array<string>")
    b = spark.createDataFrame([(1, ["y", "x", "q"]), (2, [])], a.schema)
    got = {r.query_id: r for r in analytics.replay(a, b, 3).collect()}
    assert got[1].jaccard == pytest.approx(0.5) and not got[1].top_stable and got[1].rank_delta == 1
    assert got[2].jaccard == 1.0 and not got[2].top_stable and got[2].rank_delta is None
