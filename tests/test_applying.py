import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.operators import applying
from lodestone.sources import scratch
from lodestone.sources.keyed import Conflict, Table

def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def table(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", ["id"], applying.RECORDS, buckets=4)
    rows = [(f"{k * 8}", f"title {k}", f"the text of {k}", "p", ["t"], [], 1, "active", k == "d") for k in "abcdefg"]
    t.upsert(spark.createDataFrame(rows, "id string, title string, essence string, project string, tags array<string>, related array<string>, layer int, status string, protected boolean"))
    return t


def steps(spark, *rows):
    names = [f.split()[0] for f in applying.STEPS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in ({"step": i, **r} for i, r in enumerate(rows))], applying.STEPS)


def plan(spark):
    return steps(
        spark, {"kind": "demote", "ids": ["a" * 8], "layer": 3}, {"kind": "demote", "ids": ["d" * 8], "layer": 3}, {"kind": "demote", "ids": ["zzzz"], "layer": 3},
        {"kind": "merge", "ids": ["a" * 8, "b" * 8, "c" * 8, "d" * 8], "supporting": ["bbbbbbbb-more", "cccccccc", "dddddddd"], "title": "both", "content": "b and c"},
        {"kind": "rewrite", "ids": ["e" * 8], "content": "the new text", "expected_hash": sha("the text of e")}, {"kind": "rewrite", "ids": ["f" * 8], "content": "the new text", "expected_hash": sha("other")},
        {"kind": "rewrite", "ids": ["g" * 8], "content": "new", "expected_hash": sha("the text of g")}, {"kind": "reflect", "supporting": ["a" * 8], "title": "insight", "content": "so it is"},
        {"kind": "invalidate", "ids": ["f" * 8], "winner": "a" * 8},
    )


def test_effects_and_report(spark, table):
    told = sorted((r.step, r.id or "", r.fate) for r in applying.apply(table, "p1", plan(spark), now()).collect())
    assert told == [
        (0, "a" * 8, "applied"), (1, "d" * 8, "protected"), (2, "zzzz", "missing"), (3, "", "added"), (3, "a" * 8, "unsupported"), (3, "b" * 8, "applied"), (3, "c" * 8, "applied"), (3, "d" * 8, "protected"),
        (4, "e" * 8, "applied"), (5, "f" * 8, "stale"), (6, "g" * 8, "too_short"), (7, "", "added"), (8, "f" * 8, "applied"),
    ]
    r = {x.id if len(x.id) == 8 else x.title: x for x in table.read().collect()}
    assert r["a" * 8].layer == 3 and r["d" * 8].layer == 1 and r["e" * 8].essence == "the new text" and r["f" * 8].essence == "the text of f"
    assert r["b" * 8].replaced_by == r["c" * 8].replaced_by == r["both"].id and r["a" * 8].invalid_at is None and r["f" * 8].replaced_by == "a" * 8
    assert r["insight"].related == ["a" * 8] and r["both"].tags == ["kind:consolidated", "consolidated"] and len(r) == 9


def test_a_plan_is_applied_once_and_in_one_commit(spark, table):
    before = table.version().number
    applying.apply(table, "p1", plan(spark), now())
    once = sorted(map(str, table.read().collect()))
    assert table.version().number == before + 1
    assert applying.apply(table, "p1", plan(spark), now()) is None
    assert sorted(map(str, table.read().collect())) == once and table.version().number == before + 1


def test_additive_only(spark, table):
    told = {(r.step, r.fate) for r in applying.apply(table, "p1", plan(spark), now(), additive_only=True).collect()}
    assert {(0, "held"), (3, "held"), (4, "applied"), (7, "added"), (8, "held")} <= told
    assert {r.title for r in table.read().collect()} >= {"insight"} and table.read().where("invalid_at IS NOT NULL").count() == 0


def test_a_writer_in_between_has_the_plan_worked_out_again(spark, table, monkeypatch):
    written, late = scratch.written, []

    def slow(df, name):
        out = written(df, name)
        if not late:
            late.append(1)
            table.upsert(table.read().where("substr(id, 1, 1) = 'e'").withColumn("essence", F.lit("changed meanwhile")))
        return out

    monkeypatch.setattr(applying.scratch, "written", slow)
    told = {(r.step, r.fate) for r in applying.apply(table, "p1", plan(spark), now()).collect()}
    assert (4, "stale") in told and table.read().where("essence = 'changed meanwhile'").count() == 1
    assert table.version().number == 3


def test_conflicts_without_end_are_told(spark, table, monkeypatch):
    monkeypatch.setattr(table, "upsert", lambda *a, **k: (_ for _ in ()).throw(Conflict("always")))
    with pytest.raises(Conflict):
        applying.apply(table, "p1", plan(spark), now(), tries=2)
