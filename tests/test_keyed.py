import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.sources.keyed import Conflict, Table, upserting


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/t", ["k"], "k long, v string, n int", buckets=4)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string, n int")


def rows(df):
    return sorted(map(tuple, df.collect()))


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_snapshots_upserts_and_deletes(spark, table):
    assert rows(table.read()) == []
    one = table.upsert(frame(spark, (1, "a", 1), (2, "b", 2), (3, None, None)))
    before = table.read()
    table.upsert(frame(spark, (2, "late", 9), (2, "B", 1), (4, "d", 4)), F.col("n"))
    table.delete(frame(spark, (1, None, None), (77, None, None)))
    assert rows(table.read()) == [(2, "B", 1), (3, None, None), (4, "d", 4)]
    assert rows(before) == rows(table.read(one.number)) == [(1, "a", 1), (2, "b", 2), (3, None, None)]
    assert rows(table.lookup(2)) == [(2, "B", 1)] and rows(table.lookup(1)) == []
    table.upsert(frame(spark, (1, "again", 0)))
    assert rows(table.lookup(1)) == [(1, "again", 0)]


def test_bytes_follow_the_batch(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", ["k"], "k long, v string, n int")
    t.upsert(spark.range(100_000).selectExpr("id AS k", "sha2(string(id), 256) AS v", "1 AS n"))
    whole = size(tmp_path)
    t.upsert(frame(spark, (5, "x", 1)))
    assert size(tmp_path) - whole < whole / 500
    assert t.read().count() == 100_000 and rows(t.lookup(5)) == [(5, "x", 1)]


def test_two_writers_conflict_cleanly(spark, table):
    table.upsert(frame(spark, *((i, "old", 0) for i in range(20))))
    based = table.version()
    add = lambda v: table.read(based.number).where("k = 7").withColumn("n", F.col("n") + v)
    table.upsert(add(1), based=based)
    with pytest.raises(Conflict):
        table.upsert(add(10), based=based)
    assert [r.n for r in table.lookup(7).collect()] == [1]
    other = next(k for k in range(20) if _bucket(spark, table, k) != _bucket(spark, table, 7))
    table.upsert(table.read(based.number).where(F.col("k") == other).withColumn("n", F.lit(5)), based=based)
    assert [r.n for r in table.lookup(other).collect()] == [5]


def _bucket(spark, table, k):
    return frame(spark, (k, None, None)).select(table._bucket()).first()[0]


def test_the_name_of_a_version_is_taken_once(spark, table):
    """Two that publish one number at the same time: one wins, the other is told."""
    table.upsert(frame(spark, (1, "a", 1)))
    v = table.version()
    won = []
    threads = [threading.Thread(target=lambda: won.append(table._publish(v._replace(number=v.number + 1)))) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False, True]


def test_many_writers_lose_nothing(spark, table):
    def write(k):
        table.upsert(frame(spark, (k, f"w{k}", k), (100, f"w{k}", k)))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = {r.k: r.v for r in table.read().collect()}
    assert {k: got[k] for k in range(6)} == {k: f"w{k}" for k in range(6)} and got[100] in got.values()
    assert table.version().number == 6


def test_compaction(spark, table, tmp_path):
    for k in range(5):
        table.upsert(frame(spark, (k, "a", k), (9, f"v{k}", k)))
    table.delete(frame(spark, (0, None, None)))
    want, old = rows(table.read()), table.version()
    table.compact()
    assert rows(table.read()) == want and all(e["base"] for e in table.version().entries)
    assert rows(table.read(old.number)) == want
    assert table.compact().number == table.version().number  # nothing to do
    assert table.vacuum(keep=1) > 0 and rows(table.read()) == want
    table.upsert(frame(spark, (9, "last", 9)))
    assert (9, "last", 9) in rows(table.read())


def test_a_commit_during_compaction_wins(spark, table, monkeypatch):
    table.upsert(frame(spark, (1, "a", 1)))
    write = table._write

    def late(df):
        out = write(df)
        monkeypatch.setattr(table, "_write", write)
        table.upsert(frame(spark, (1, "b", 2)))
        return out

    monkeypatch.setattr(table, "_write", late)
    with pytest.raises(Conflict):
        table.compact()
    assert rows(table.read()) == [(1, "b", 2)]


def test_a_stream_batch_is_applied_once(spark, table):
    effect = upserting(table, "s", F.col("n").desc())
    effect(frame(spark, (1, "a", 1), (1, "b", 2)), 0)
    effect(frame(spark, (1, "c", 3)), 1)
    effect(frame(spark, (1, "b", 2)), 0)
    assert rows(table.read()) == [(1, "c", 3)] and table.version().number == 2
