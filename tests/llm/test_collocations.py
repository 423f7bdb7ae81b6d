import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import collocations, queries

COLUMNS = "lang rank phrase a l r n score".split()


def brute(rows, least, top=2000, longest=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    some = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in some.items():
        score, cut = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        if any(o == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (o, q), b in some.items()):
            continue
        out.append((lang, " ".join(p), a, f[lang, p[:cut]], f[lang, p[cut:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, told = Counter(), []
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= top:
            told.append((r[0], rank[r[0]], *r[1:]))
    return told


def mined(docs, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations.mine(docs, **options).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB. \n\té\x1c", max_size=14), max_size=5))
def test_words_and_pieces(texts):
    w = collocations.Words(pa.array(texts, pa.large_string()), pa.array(["x"] * len(texts), pa.large_string()))
    low = [t.replace("B", "b") for t in texts]
    pieces = [re.findall(r"[^\x20\x09]+", p) for t in low for p in re.split(r"[.,;:!?\x0A-\x0D]", t)]
    spelled = w.spelling.take(pa.array(w.kinds[w.codes])).to_pylist() if len(w.codes) else []
    assert spelled == [x for p in pieces for x in p]
    assert len(w.places(2)) == sum(max(len(p) - 1, 0) for p in pieces)


def test_whole_table_equals_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    told = c.execute(queries.ORACLE["op11_collocations"])
    names = [x[0] for x in told.description]
    want = sorted(tuple(r[names.index(k)] for k in COLUMNS) for r in told.fetchall())
    df = queries.op11_collocations(spark, "/root/testdata/sf0.01")
    assert {k: t for k, t in df.dtypes if k not in ("lang", "phrase")} == dict.fromkeys("rank a l r n score".split(), "bigint")
    assert sorted(tuple(r[k] for k in COLUMNS) for r in df.collect()) == want
    assert len(want) > 200


def test_small_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.lang, r.text) for r in docs.collect()], 8, 50)
    assert mined(docs, least=8, top=50) == want and any(len(r[2].split()) == 4 for r in want)


@pytest.mark.parametrize("buckets", [1 << 12, 1 << 22])
def test_full_buckets_change_no_result(monkeypatch, buckets):
    """Even where every bucket is full, only what is frequent is told; here with the kernel alone."""
    monkeypatch.setattr(collocations, "BUCKETS", buckets)
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"w{int(i)}" for i in rng.zipf(1.6, 60) % 500) for _ in range(200)], pa.large_string())
    w = collocations.Words(texts, pa.array(["x"] * 200, pa.large_string()))
    counts = Counter(w.buckets(w.places(2), 2).tolist())
    table = w.counted(w.places(2), 2)
    exact = dict(zip(table["phrase"].to_pylist(), table["n"].to_pylist(), strict=True))
    own = collocations.Words(pa.array(list(exact), pa.large_string()), pa.array(["x"] * len(exact), pa.large_string()))
    assert all(counts[b] >= n for b, n in zip(own.buckets(own.places(2), 2).tolist(), exact.values(), strict=True))


def test_edge_cases(spark):
    rows = [("en", "A b. a B, a b"), (None, "a b a b"), ("und", "a b"), ("en", None), ("en", ""), ("en", " .,; "), ("xx", "q " * 30_000), ("en", "a b c d e a b c d e"), ("en", "a b c d e a b c d e"), ("", "é b é b é b"), ("zz", "a\x1cb c a\x1cb c a\x1cb c")]
    docs = spark.createDataFrame([(t, lang, 1, "x") for lang, t in rows], "text string, lang string, n int, phrase string").repartition(3)
    want = brute(rows, 3)
    assert mined(docs, least=3) == sorted(want)
    assert mined(docs, least=3, top=2) == sorted(brute(rows, 3, 2))
    assert mined(docs.limit(0)) == []
