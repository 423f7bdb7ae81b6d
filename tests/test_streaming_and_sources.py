import json

from pyspark.sql import functions as F

from lodestone.api import Engine
from lodestone.sources import bindings as B
from lodestone.sources import records as R
from lodestone.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_transcripts_are_parsed_and_bad_lines_set_aside(spark, tmp_path):
    lines = [
        json.dumps({"type": "user", "uuid": "1", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "hello"}}),
        json.dumps({"type": "assistant", "uuid": "2", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "text", "text": " hi "}, {"type": "tool_use", "name": "Read"}]}}),
        "not json",
        "",
        json.dumps({"role": "user", "text": "flat"}),
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    turns, rejected = ingest.parsed(ingest.transcript_lines(spark, str(tmp_path)))
    assert sorted((r.role, r.text) for r in run(turns, "turns")) == [("assistant", "hi"), ("user", "flat"), ("user", "hello")]
    assert [r.line for r in run(rejected, "rejected")] == ["not json"]


def test_backoff_and_moving_average_keep_state(spark, tmp_path):
    spark.createDataFrame([("k", i, 1 if i == 1 else 0) for i in range(1, 13)], "key string, seq long, found long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, found long").parquet(str(tmp_path / "in"))
    work = sorted((r.seq, r.work) for r in run(ingest.backoff(stream, "key", "found"), "backoff"))
    assert [w for _, w in work] == [True] * 4 + [False] * 5 + [True] * 3
    score = run(ingest.moving_average(stream, "key", "found"), "ema", "update")[0].score
    assert abs(score - 0.3 * 0.7**11) < 1e-9


def test_upserts_may_run_again(spark, tmp_path):
    path = str(tmp_path / "out")
    effect = ingest.upsert_into(path, ["id"], F.desc("n"))
    one = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "id long, n long")
    two = spark.createDataFrame([(2, 9), (3, 1)], "id long, n long")
    for batch, number in ((one, 0), (two, 1), (two, 1)):
        effect(batch, number)
    assert sorted(map(tuple, ingest.latest(spark, path).collect())) == [(1, 2), (2, 9), (3, 1)]


def test_settled_sessions(spark, tmp_path):
    B.table(spark, SMALL, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "e"))
    got = run(ingest.settled(stream, "user_id", "ts"), "settled")
    assert 0 < sum(r.events for r in got) <= B.table(spark, SMALL, "events").count() and all(r.started < r.ended for r in got)


def test_front_matter_round_trip(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\nid: abc\ntitle: "T: x"\nproject: p\nimportance: 0\nlayer: bad\ntags: [a, b]\nrelated:\n  - r1\n  - r2\n---\nBody line\n---\nid: no\n## Related\n- x\n')
    (tmp_path / "b.md").write_text("no block")
    good, bad = R.front_matter(R.markdown(spark, str(tmp_path)))
    r = good.first()
    assert (r.id, r.title, r.importance, r.layer, r.tags, r.related, r.status) == ("abc", "T: x", 0, None, ["a", "b"], ["r1", "r2"], "active")
    assert r.essence == "Body line\n---\nid: no" and bad.count() == 1
    text = R.to_markdown(good).first().text
    assert text.startswith("---\nid: abc\ntitle: T: x\nproject: p\n") and "related: [r1, r2]\n" in text


def test_engine_calls(spark):
    r = B.records(spark, SMALL).withColumn("related", F.array(B.id8(F.col("doc_id") + 1))).withColumn("contradicts", F.array().cast("array<string>")).withColumn("session", F.lit(""))
    e = Engine(r, B.now(), telemetry=B.telemetry(spark, SMALL))
    queries = B.query_set(spark, SMALL).limit(3)
    hits = e.search(queries, 5).collect()
    assert {h.query_id for h in hits} == {q.query_id for q in queries.collect()} and max(h.place for h in hits) <= 7
    assert e.get(spark.createDataFrame([("00000005", 0), ("00000002", 1)], "key string, pos int")).count() == 2
    assert e.save(queries).where("band IS NULL").count() == 0
    assert e.timeline(spark.createDataFrame([("00000005",)], "key string"), 2, 2).count() <= 4
