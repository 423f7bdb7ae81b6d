import hashlib
import re
import zlib

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from lodestone.llm import periodic, queries

SMALL = "/root/testdata/sf0.001"


def smallest_period(x):
    return next(q for q in range(1, len(x) + 1) if all(x[i] == x[i + q] for i in range(len(x) - q)))


def brute(x):
    """Every run by its definition: for each period, the maximal stretches, checked for a smaller period."""
    out, n = [], len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and smallest_period(x[i : i + 2 * q]) in (q,) and smallest_period(x[i : j + q]) == q:
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def by_numpy(x):
    """The same for long sequences: maximal stretches of each distance, the smallest distance of each stretch."""
    found = {}
    for q in range(1, len(x) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.r_[0, (x[:-q] == x[q:]).astype(np.int8), 0]))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(6, 4 * q):
                found.setdefault((a, b - a + q), q)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 7)), max_size=6)


@settings(max_examples=600, deadline=None)
@given(pieces)
@example([([0], 7), ([0, 0, 1], 6)])
def test_runs_equal_their_definition(parts):
    x = [v for block, times in parts for v in block * times]
    assert periodic.find_runs(np.array(x, np.int64)) == brute(x)
    assert by_numpy(np.array(x, np.int64)) == brute(x)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(1, 4), st.integers(0, 60), st.integers(1, 3))
def test_long_periods(period, times, tail, letters):
    rng = np.random.default_rng(period * 7 + tail)
    block = rng.integers(0, letters * 20, period)
    x = np.concatenate([rng.integers(0, 50, tail), np.tile(block, times + 3)[: period * (times + 3) - tail % period], rng.integers(0, 50, 30)])
    assert periodic.find_runs(x) == by_numpy(x)


def test_one_word_without_end_takes_few_steps(monkeypatch):
    grown = []
    plain = periodic.extended
    monkeypatch.setattr(periodic, "extended", lambda *a: grown.append(a) or plain(*a))
    n = 1 << 16
    assert periodic.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic.find_runs(np.arange(n) % 700) == [(0, n, 700)]
    assert len(grown) < 20


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(doc_id, text):
    own = words_of(text)
    n = len(own)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    codes = np.array([{w: k for k, w in enumerate(dict.fromkeys(own))}[w] for w in own], np.int64) if n < 200 else np.unique(own, return_inverse=True)[1]
    runs = by_numpy(codes)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(runs),
        *(top or (None, None, None)),
        1000 * top[1] // top[2] if top else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(own) if i not in gone)),
    )


def plain(r):
    return r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op12_periodic(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    assert sum(r.n_runs for r in got) > 30
    for r in got:
        assert plain(r) == expected(r.doc_id, docs[r.doc_id])


def test_edge_cases(spark):
    long = " ".join(f"w{i % 997}" for i in range(120_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b"), (4, "a " * 50), (4, "a " * 50), (10, "a\x0bb\x0ca\rb a b a b"), (11, "é x é x " * 8),
        (12, "A a A a A a A a"), (13, long), (14, "a\x1cb " * 6), (None, "x y " * 10), (15, "a a a a a"), (22, "a b c d e f g h i j"), (29, "q " * 3 + "r"),
    ]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, runs string").repartition(3)
    made = docs.withColumn("text", periodic.planted(docs.doc_id, docs.text))
    got = periodic.digest(periodic.detect(made)).collect()
    want = sorted(((i, *expected(i, t)) for i, t in rows if i is not None), key=str)
    assert sorted(((r.doc_id, *plain(r)) for r in got if r.doc_id is not None), key=str) == want
    (lost,) = [r for r in got if r.doc_id is None]
    assert (lost.n_runs, lost.length, lost.period) == (1, 20, 2)
    assert periodic.digest(periodic.detect(docs.limit(0))).collect() == []
