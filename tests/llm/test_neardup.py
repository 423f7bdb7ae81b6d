import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import components, neardup, words
from lodestone.llm.tables import Workspace

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def shingles(text):
    w = [x for x in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """Components over all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for g in by.values() for k, b in enumerate(g) for a in g[:k]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[root(b)] = root(a)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return {rows[i][0]: (len(sets[i]), min(groups[root(i)])) for i in range(len(rows))}


def run(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, n_shingles int, kept boolean").repartition(parts)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}


def test_small_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_a_large_group_at_the_threshold(spark, monkeypatch):
    """Copies of one text with their own edits: most pairs fall short of the threshold, and chains must still be found."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(1, 8)):
            w[rnd.randrange(150)] = f"e{rnd.randrange(10**6)}"
        rows.append((i * 3 + 1, " ".join(w)))
    monkeypatch.setattr(neardup, "FIRST_REACH", 1)
    monkeypatch.setattr(neardup, "WIDEN", 2)
    assert run(spark, rows) == brute(rows)


def test_a_group_of_five_thousand_near_copies(spark):
    """One hot band group of copies with edits of every strength, against all pairs by a matrix product."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(5000):
        w = list(base)
        for _ in range(rnd.choice((1, 2, 3, 4, 6, 8))):
            w[rnd.randrange(120)] = f"e{rnd.randrange(10**6)}"
        rows.append((i * 2 + 3, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    number = {x: k for k, x in enumerate(shingles(" ".join(base)))}
    held = np.zeros((len(rows), len(number)), np.float32)
    for i, s in enumerate(sets):
        held[i, [number[x] for x in s if x in number]] = 1
    both, size = held @ held.T, np.array([len(s) for s in sets])
    linked = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, True)
    label = np.arange(len(rows))
    while True:
        low = np.where(linked, label[None, :], len(rows)).min(1)
        if (low == label).all():
            break
        label = low
    got = run(spark, rows, 8)
    assert {k: v[1] for k, v in got.items()} == {r[0]: rows[label[i]][0] for i, r in enumerate(rows)}
    assert len(set(label.tolist())) > 100


def test_rows_of_one_id_with_different_texts_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "p q r s t u", "y"), (1, "p q r s t u", "x"), (2, "p q r s t u", "z"), (3, "k l m", "z")], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in neardup.deduplicate(docs).collect()) == [(1, "a b c d e f", "x"), (1, "p q r s t u", "x"), (3, "k l m", "z")]


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "ONE  two"), (10, "one two three"), (11, "a b c d e"), (3, "A b C d E"), (12, "x y z " * 40_000)]
    got = run(spark, rows)
    assert got == brute(rows) and got[5] == (0, 5) and got[9] == (1, 8) and got[11] == (1, 3)
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "p q"), (1, "p q"), (2, "p q")], "doc_id long, text string")
    out = sorted((r.doc_id or -1, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert out == [(-1, None, True), (-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sorted(r.doc_id or -1 for r in neardup.deduplicate(docs).collect()) == [-1, -1, 1]
    assert neardup.near_duplicates(docs.limit(0)).collect() == []


def test_words_and_runs_follow_the_text():
    texts = ["Ab  c\nd é f", "", "   ", "x", "Ab c d é f g"]
    hashes, first, _, _ = words.hashed_words(pa.array(texts, pa.string()))
    assert np.diff(first).tolist() == [5, 0, 0, 1, 6]
    assert len(set(hashes.tolist())) == len({w.lower() for t in texts for w in t.split()})
    runs, begin = words.runs(hashes, first, 5)
    assert np.diff(begin).tolist() == [1, 0, 0, 1, 2] and runs[0] == runs[2]


def test_sketch_estimates_high_similarities():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.95, 0.8, 0.6):
        size = 1000
        cut = round(size * (1 - share) / (1 + share))
        sets = [np.unique(pool[:size]), np.unique(pool[cut : size + cut])]
        sketches = neardup.odd_sketches(neardup.minhashes(sets)).view(np.uint64)
        assert abs(neardup.estimate(np.bitwise_count(sketches[0] ^ sketches[1]).sum()) - share) < 0.15


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label


def test_bitmaps_refute_only_what_falls_short():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 500, rng.integers(5, 220)).astype(np.uint64)) for _ in range(120)]
    size = np.array([len(s) for s in sets])
    maps = pa.chunked_array([pa.array(neardup.bitmaps(sets), pa.list_(pa.int64()))])
    block = neardup._Block(size, neardup.odd_sketches(neardup.minhashes(sets)), maps, 0)
    neardup_most, neardup.MOST_DIFFERING = neardup.MOST_DIFFERING, 10**6
    try:
        for i in range(0, 120, 7):
            others, common = block.near(i, np.arange(120))
            for j, most in zip(others, common, strict=True):
                assert len(np.intersect1d(sets[i], sets[j])) <= most
            assert len(others) == 120
    finally:
        neardup.MOST_DIFFERING = neardup_most


def templated(n, rnd):
    """Texts with 100 words in common and 60 of their own; every fiftieth has a near copy."""
    common = [f"c{rnd.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(n):
        own = [f"o{rnd.randrange(10**9)}" for _ in range(60)]
        rows.append((2 * i + 1, " ".join(common + own)))
        if i % 50 == 0:
            own[rnd.randrange(60)] = "edited"
            rows.append((2 * i + 2, " ".join(common + own)))
    return rows


def test_crowded_bands_grow_with_their_members(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD", 40)
    monkeypatch.setattr(neardup, "BLOCK", 32)
    monkeypatch.setattr(neardup, "PROBES", 8)
    dealt, made = neardup._dealt, []

    def counted(*a):
        out = dealt(*a)
        made.append(out.count())
        return out

    monkeypatch.setattr(neardup, "_dealt", counted)
    rows_of = {}
    for n in (250, 1000):
        made.clear()
        rows = templated(n, random.Random(n))
        assert run(spark, rows) == brute(rows)
        rows_of[n] = sum(made)
    assert rows_of[1000] <= 6 * rows_of[250] + 200


def test_probes_in_parts_and_rare_shingles_lose_nothing(spark, monkeypatch):
    """A chain of edits in crowded bands, where every limit is small."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(1, 9)):
            w[rnd.randrange(150)] = f"e{rnd.randrange(10**6)}"
        rows.append((i * 3 + 1, " ".join(w)))
    for name, value in (("CROWD", 2), ("BLOCK", 16), ("PROBES", 4), ("FIRST_REACH", 1), ("WIDEN", 2)):
        monkeypatch.setattr(neardup, name, value)
    assert run(spark, rows) == brute(rows)


def test_two_sets_at_the_threshold_share_a_rare_shingle(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        w = [f"t{k}" for k in range(40)] + [f"x{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 40))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: len(w) - rnd.randrange(0, max(1, len(w) // 5))] + ["z"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {}
    for r in neardup.rare_shingles(docs, 75).collect():
        keys.setdefault(r.node, set()).add(r.key)
    sets = {i: shingles(t) for i, t in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 100 * len(a & b) >= 75 * len(a | b):
                assert keys[i] & keys[j]
