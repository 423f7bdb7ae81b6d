import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import migration, profiles
from lodestone.sources import state as S
from lodestone.sources.keyed import Table


@pytest.fixture
def state(spark, tmp_path):
    return S.State(spark, f"file://{tmp_path}/s", buckets=2)


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "line string")


def test_sessions_are_taken_over_once(spark, state):
    assert state.migrated(lines(spark, "", "  ")) == "empty" and state.migrated(lines(spark, "abc-1", "d/e.f")) == "ids" and state.migrated(lines(spark, "{broken", "x y")) == "corrupt"
    assert state.sessions.read().count() == 0
    state.mined(spark.createDataFrame([("s1",), ("s1",)], "session string"))
    log = lines(spark, '{"session_id": "s1", "status": "failed", "attempts": 3}', '{"session_id": " s2 ", "message": "m", "size": 7}', '{"status": "x"}', "garbage")
    for _ in range(2):
        assert state.migrated(log) == "states"
    got = {r.session: (r.status, r.attempts, r.last_error, r.size) for r in state.sessions.read().collect()}
    assert got == {"s1": ("complete", None, None, None), "s2": ("complete", 0, "m", 7)}


def test_names_scores_and_point_reads(spark, state):
    assert state.get("last_run") is None and state.get("last_run", "never") == "never"
    state.put("last_run", "2024-01-01")
    state.put("last_run", "2024-01-02")
    assert state.get("last_run") == "2024-01-02"
    state.put("last_run", None)
    assert state.get("last_run") is None
    assert [state.ensured("installed", v) for v in ("1", "2")] == ["1", "1"]
    state.scores.upsert(spark.createDataFrame([("c", "a", 0.5), ("c", "b", 0.1)], "query_class string, id string, score double"))
    state.scores.upsert(spark.createDataFrame([("c", "a", 0.7)], "query_class string, id string, score double"))
    assert sorted(map(tuple, state.scores.read().collect())) == [("c", "a", 0.7), ("c", "b", 0.1)]
    assert state.used("12345678-rest") == (0, None) and state.recalled("none") == []
    state.telemetry.upsert(spark.createDataFrame([("12345678", 3, dt.datetime(2024, 1, 1))], "id string, access_count long, last_accessed timestamp_ntz"))
    assert state.used(" 12345678-rest") == (3, dt.datetime(2024, 1, 1))
    state.recalls.upsert(spark.createDataFrame([("0123456789ab", ["x"], None)], "session string, ids array<string>, updated_at timestamp_ntz"))
    assert state.recalled("0123456789abcdef") == ["x"]


def test_lessons_canaries_and_copies(spark, state):
    lesson = spark.createDataFrame([("r1", "deploys", "p" * 300, None, None)], "targeted string, query_class string, anti_pattern string, evidence string, source string")
    state.learn(lesson, now())
    state.learn(lesson, now())
    (row,) = state.lessons.read().collect()
    assert (row.targeted, len(row.anti_pattern), row.evidence, row.source) == ("r1", 200, "", "manual")
    plant = lambda *rows: state.plant(spark.createDataFrame(list(rows), "canary_id string, title string, query string"), now())
    assert plant(("c1", "t", "q")).count() == 1 and sorted(r.title for r in plant(("c1", "other", "q"), ("c2", "u", "q")).collect()) == ["t", "u"]
    assert S.isolated(lesson, lambda df: df.select("targeted")).collect()[0].targeted == "r1"


def test_a_migration_is_reviewed_and_applied(spark, state, tmp_path):
    table = Table(spark, f"file://{tmp_path}/p", ["id"], migration.PROPOSALS, 2)
    rows = [("a", "p", 0, "active", None, "uses pytest for tests"), ("b", "p", 1, "active", None, "prefers dark mode"), ("c", "p", 2, "active", None, "x"), ("d", "p", 0, "deprecated", None, "x"), ("e", "q", 1, "active", None, "keep me")]
    records = spark.createDataFrame(rows, "id string, project string, layer int, status string, invalid_at timestamp, essence string")
    asked = []

    def propose(found):
        asked.append(sorted(r.id for r in found.collect()))
        profile = F.when(F.col("project") == "p", "user")
        return found.select("id", "project", F.when(profile.isNotNull(), "PROFILE").otherwise("KEEP").alias("action"), profile.alias("profile"), F.lit("Preferences").alias("section"), F.col("essence").alias("line"))

    day = dt.datetime(2024, 1, 1)
    run = migration.proposed(state, table, records, propose, day)
    assert not run.reused and sorted((r.project, r.action, r.n) for r in run.report.collect()) == [("p", "PROFILE", 2), ("q", "KEEP", 1)]
    assert migration.proposed(state, table, records, propose, day + dt.timedelta(days=6), reuse=True).reused
    assert not migration.proposed(state, table, records, propose, day + dt.timedelta(days=8), reuse=True).reused
    fewer = migration.proposed(state, table, records.where("id <> 'e'"), propose, day + dt.timedelta(days=8), reuse=True)
    assert not fewer.reused and asked == [["a", "b", "e"], ["a", "b", "e"], ["a", "b"]]
    none = spark.createDataFrame([], "profile string, section string, pos long, line string")
    told, facts = migration.applied(run.proposals, none)
    assert sorted(map(tuple, told.collect())) == [("appended", 2), ("kept", 1)]
    again, after = migration.applied(run.proposals, facts)
    assert sorted(map(tuple, again.collect())) == [("duplicate", 2), ("kept", 1)] and after.count() == 2


def test_injection_is_cut_at_lines(spark):
    user = profiles.rendered("user", {"Preferences": [f"fact number {i:04d}" for i in range(100)]})
    texts = spark.createDataFrame([("user", user), ("p", profiles.rendered("p", {"Identity": ["is p"]}))], "profile string, text string")
    got = {r.scope: r.text for r in profiles.injected(texts, spark.createDataFrame([("p",), ("general",), ("none",)], "scope string")).collect()}
    cut, size = [], 0
    for line in user.splitlines():
        size += len(line) + 1
        if size > 1200:
            break
        cut.append(line)
    assert got["general"] == got["none"] == "\n".join(cut).rstrip() and got["p"] == got["general"] + "\n\n" + profiles.rendered("p", {"Identity": ["is p"]}).rstrip()
    assert profiles.injected(texts.limit(0), spark.createDataFrame([("p",)], "scope string")).first().text == ""
