import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import queries, tokenfiles

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
plain = Tokenizer.from_file(VOCABULARY)
plain.encode_special_tokens = True


def ids_of(text):
    return plain.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé1,à.\n\t\r\x0b\x1c\x85\xa0 　​漢-", max_size=24), max_size=6))
@example(["a  b", " a", "a ", "a \nb", "a\n b", "a \n b", "a\xa0 \xa0b", "　 　a", "don't 's", "", " ", "  "])
def test_pieces_give_the_ids_of_whole_texts(texts):
    ids, first = tokenfiles.encoder(VOCABULARY).encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [ids_of(t) for t in texts]


def expected(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*ids_of(text), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [tuple(r) for r in queries.op13_token_files(spark, "/root/testdata/sf0.01").select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert got == expected(sorted((r.doc_id, r.text) for r in docs.collect()))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ids") / "files")
    rng = np.random.default_rng(5)
    rows = [(3 * i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 20 + 7 * (i % 40)))) for i in range(6000)]
    tokenfiles.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, VOCABULARY, parts=2, stride=1000, stripe=512 << 10)
    return path, expected(rows), [i for _, t in rows for i in [*ids_of(t), 2]]


def test_files_have_stripes_and_integer_runs(spark, files):
    from pyarrow import orc

    path = files[0]
    parts = sorted(f for f in spark.read.orc(path).inputFiles())
    assert len(parts) == 2
    for p in parts:
        f = orc.ORCFile(p.removeprefix("file://"))
        assert f.nstripes > 1 and f.row_index_stride == 1000
        assert f.content_length < 4 * sum(len(x) for x in f.read(["ids"])["ids"].to_pylist())  # runs, not plain integers


def scanned(df):
    """Rows that left the scan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.getClass().getSimpleName()
    if text == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_lookups_pass_over_row_groups(spark, files):
    path, want, _ = files
    got = tokenfiles.lookup(spark, path, [3000, 6000, 6001])
    assert sorted((r.doc_id, len(r.ids)) for r in got.collect()) == [(w[0], w[2]) for w in want if w[0] in (3000, 6000)]
    assert scanned(tokenfiles.lookup(spark, path, [3000])) <= 1000
    # No document has this id, and it lies within the range of a row group: only a Bloom filter can tell.
    assert sum(scanned(tokenfiles.lookup(spark, path, [3000 + 3 * k + 1])) for k in range(5)) <= 1000


def test_spans(spark, files):
    path, want, stream = files
    for start, length in ((0, 10), (want[1999][1] + 3, 5000), (len(stream) - 7, 100), (5, len(stream)), (len(stream), 5)):
        parts = tokenfiles.span(spark, path, start, length).orderBy("start").collect()
        assert [i for p in parts for i in p.ids] == stream[start : start + length]
        assert all(stream[p.start] == p.ids[0] for p in parts)


def test_edge_cases(spark, tmp_path):
    long = "a very long text without an end " * 20_000
    rows = [(5, "b a"), (5, "b a"), (5, "c"), (1, None), (2, ""), (4, long), (None, "no id"), (None, None), (7, "<|endoftext|> x")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, ids string").repartition(4)
    tokenfiles.write(docs, str(tmp_path / "a"), VOCABULARY, parts=3)
    got = [tuple(r) for r in tokenfiles.documents(spark, str(tmp_path / "a")).orderBy("start").collect()]
    assert [g[0] for g in got] == [1, 2, 4, 5, 5, 5, 7, None, None]
    assert sorted(((g[0], *g[2:]) for g in got), key=str) == sorted(((e[0], *e[2:]) for e in expected(rows)), key=str)
    assert [g[1] for g in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    same = [g for g in got if g[0] == 5 and g[2] == len(ids_of("b a")) + 1]
    assert len(same) == 2 and abs(same[0][1] - same[1][1]) == same[0][2]
    tokenfiles.write(docs.limit(0), str(tmp_path / "b"), VOCABULARY)
    assert tokenfiles.documents(spark, str(tmp_path / "b")).collect() == []
