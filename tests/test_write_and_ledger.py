import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions import identity
from lodestone.functions import text as T
from lodestone.operators import graph, ledger, retrieval, write
from lodestone.plans import catalog
from lodestone.sources import bindings as B
from lodestone.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def records(spark):
    return catalog._graph_records(spark, SMALL)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_insert_keeps_derived_tables_as_a_full_build_makes_them(spark):
    r = records(spark).where("doc_id < 70")
    ids = [x.id for x in r.select("id").orderBy("id").limit(4).collect()]
    old, new = r.where(~F.col("id").isin(ids)), r.where(F.col("id").isin(ids))
    state = graph.built(old.where("invalid_at IS NULL")).written()
    length = lambda texts: texts.map(lambda t: [float(len(t))])
    tables = write.insert(write.Tables(old, vectors=write.embedded(old, length), state=state), new, B.now(), length)
    assert tables.records.count() == r.count() and rows(tables.postings) == rows(write.postings(tables.records))
    assert rows(tables.vectors) == rows(write.embedded(tables.records, length))
    linked = tables.records.where(F.col("id").isin(ids)).select("id", "related").collect()
    assert any(len(x.related) > 1 for x in linked) and all(x.id not in x.related[1:] for x in linked)
    after = [(e.src, e.dst, e.relation) for e in tables.edges.collect()]
    assert len(set(after)) == len(after) and any(src in ids for src, _, _ in after)
    whole = graph.published(graph.built(tables.records.where("status <> 'deprecated' AND invalid_at IS NULL")).own)
    assert sorted(after) == sorted((e.src, e.dst, e.relation) for e in whole.collect())


def test_edges_are_upserted_clamped_and_removed(spark):
    columns = "src string, dst string, relation string, score double, updated_at long"
    old = spark.createDataFrame([("aaaaaaaa1", "b", "supports", 0.5, 1), ("b", "c", "supports", 0.4, 1)], columns)
    new = spark.createDataFrame([("b", "c", "supports", 7.0, 2), ("aaaaaaaa1", "aaaaaaaa2", "supports", 0.5, 2), ("c", "d", "same_topic", -1.0, 2)], columns)
    got = graph.upsert_edges(old, new)
    assert rows(got.select("src", "dst", "score")) == [("aaaaaaaa1", "b", 0.5), ("b", "c", 1.0), ("c", "d", 0.0)]
    assert rows(graph.remove_edges(got, spark.createDataFrame([("aaaaaaaa",)], "id string")).select("src")) == [("b",), ("c",)]
    with pytest.raises(Exception, match="unknown relation"):
        graph.clamped(spark.createDataFrame([("a", "b", "likes", 1.0, 1)], columns)).collect()
    told = graph.decoded(spark.createDataFrame([('{"lexical": 0.5}',), ("broken",), (None,)], "evidence string"))
    assert [r.evidence for r in told.collect()] == [{"lexical": 0.5}, {}, {}]
    assert graph.audit_report(spark.createDataFrame([("hub", "x"), ("hub", "a")], "finding string, id string")).first().line == "hub: 2 (a, x)"


def test_stable_ids_are_those_of_the_standard(spark):
    got = spark.range(1).select(identity.uuid5(F.lit("s\nt\nc")).alias("u"), identity.mined_id(F.lit("s"), F.lit(" t "), F.lit("c")).alias("m"), identity.filename_id(F.lit("a-title-0f3c.md")).alias("f")).first()
    assert got.u == got.m == str(uuid.uuid5(uuid.NAMESPACE_URL, "s\nt\nc")) and got.f == "0f3c"
    p = spark.createDataFrame([("/h/p/-home-u/a.jsonl",), ("/h/p/-home-u-x-y/a.jsonl",), ("/h/p/else/a.jsonl",)], "p string")
    assert [r[0] for r in p.select(identity.project_of_path(F.col("p"), "/home/u")).collect()] == ["general", "x-y", "else"]
    t = spark.createDataFrame([("[api] fix", "p"), ("fix", "p"), ("fix", ""), (None, None)], "t string, p string")
    assert [r[0] for r in t.select(identity.project_of_title(F.col("t"), F.col("p"))).collect()] == ["api", "p", "general", "general"]


def test_tool_calls_are_told_in_lines(spark):
    blocks = [("tool_use", "Read", {"file_path": "a.py"}), ("tool_use", "Bash", {"command": "x" * 300}), ("text", None, None), ("tool_use", "Other", {})]
    df = spark.createDataFrame([(blocks,), ([("text", None, None)],)], "b array<struct<type:string,name:string,input:map<string,string>>>")
    one, two = (r[0] for r in df.select(identity.tool_summary(F.col("b"))).collect())
    assert one == "[Tool: Read a.py]\n[Tool: Bash] " + "x" * 200 + "\n[Tool: Other]" and two is None


def test_related_equals_plain_python(spark):
    r = B.records(spark, SMALL).limit(60)
    asked = B.query_set(spark, SMALL).limit(5).withColumn("project", F.lit("general")).withColumn("own", F.lit(None).cast("string"))
    sets = lambda col: [T.word_set(col), T.ngrams(T.tokens(col), 2), T.ngrams(T.tokens(col), 3)]
    q = {x[0]: x[1:] for x in asked.select("query_id", *sets(F.col("query"))).collect()}
    d = {x[0]: x[1:] for x in r.select("id", *sets(F.concat_ws(" ", "essence", "title"))).collect()}
    share = lambda a, b: len(set(a) & set(b)) / min(len(set(a)), len(set(b))) if a and b else 0.0
    for k, mine in q.items():
        scored = sorted((-round(sum(w * share(a, b) for w, a, b in zip((0.5, 0.3, 0.2), mine, theirs, strict=True)), 9), i) for i, theirs in d.items())
        want = [(i, -s) for s, i in scored if -s > 0.15][:3]
        got = [(x.id, round(x.score, 9)) for x in retrieval.related(asked.where(F.col("query_id") == k), r).orderBy("rank").collect()]
        assert got == want


def test_citations_are_emitted_for_recalled_ids_only(spark):
    at = dt.datetime(2024, 1, 1, 12)
    recalls = spark.createDataFrame([("s", at, "0000000a-full"), (None, at, "0000000b"), (None, at - dt.timedelta(hours=2), "0000000c"), ("t", at, "0000000d")], "session string, ts timestamp, id string")
    turns = spark.createDataFrame([("s", "assistant", "see 0000000a, 0000000b, 0000000c, 0000000d, 0000000a", at), ("s", "user", "0000000d", at), ("u", "assistant", "none", at)], "session string, role string, text string, ts timestamp")
    assert rows(ledger.emitted(recalls, turns)) == [("s", ["0000000a", "0000000b"])]


def test_scores_move_towards_outcomes(spark):
    scores = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "id string, score double")
    recalls = spark.createDataFrame([("s", ["a", "c"])], "session string, recalls array<string>")
    outcomes = spark.createDataFrame([("s", -1.0)], "session string, outcome double")
    assert [(i, round(x, 9)) for i, x in rows(ledger.learned(scores, recalls, outcomes))] == [("a", 0.4), ("b", 0.5), ("c", -0.3)]


def test_growing_files_are_read_from_where_they_were_left(spark, tmp_path):
    folder, state, seen = tmp_path / "logs", str(tmp_path / "state"), []
    folder.mkdir()
    a = folder / "a.jsonl"
    work = lambda lines, n: seen.append((n, sorted(r.line for r in lines.collect())))
    a.write_text('{"n": 1}\n{"n": 2}\n{"half')
    assert ingest.advance(spark, str(folder), state, work) == 1
    assert ingest.advance(spark, str(folder), state, work) == 0
    with a.open("a") as f:
        f.write('": "é"}\n')
    (folder / "b.jsonl").write_text("{}\n")

    def broken(lines, n):
        raise OSError("down")

    with pytest.raises(OSError):
        ingest.advance(spark, str(folder), state, broken)
    assert ingest.advance(spark, str(folder), state, work) == 2
    assert ingest.advance(spark, str(folder), state, work) == 0
    a.write_text('{"new": 1}\n')
    assert ingest.advance(spark, str(folder), state, work) == 1
    assert seen == [(0, ['{"n": 1}', '{"n": 2}']), (1, ['{"half": "é"}', "{}"]), (2, ['{"new": 1}'])]


def test_sessions_open_again_and_stale_ones_are_few(spark):
    files = spark.createDataFrame([("a", 10), ("b", 20)], "session string, size long")
    state = spark.createDataFrame([("a", "complete", 10), ("b", "complete", 15), ("c", "failed", 0)], "session string, status string, offset_bytes long")
    assert [r.session for r in ingest.reopened(files, state).collect()] == ["b"]
    old = [(f"s{i}", dt.datetime(2024, 1, 1, 0, i)) for i in range(30)]
    quiet = ingest.stale(spark.createDataFrame(old, "session string, modified timestamp"), spark.createDataFrame([("s0",)], "session string"), F.lit("2024-01-01 00:20:00").cast("timestamp"))
    assert [r.session for r in quiet.collect()] == ["s1", "s2", "s3"]


def test_starts_are_counted_once_for_each_batch(spark, tmp_path):
    started = []
    effect = ingest.counted(str(tmp_path / "n"), 3, started.append)
    batch = lambda n: spark.createDataFrame([(1,)] * n + [(0,)], "found int")
    for number, n in ((0, 2), (1, 2), (1, 2), (2, 5)):
        effect(batch(n), number)
    assert started == [1, 1, 2, 2] and ingest.latest(spark, str(tmp_path / "n")).first()[0] == 0


def test_episodes_keep_their_ids(spark):
    turns = spark.createDataFrame([("s", "2", "assistant", "hi", dt.datetime(2024, 1, 2)), ("s", "1", "user", "hello", dt.datetime(2024, 1, 1))], "session string, uuid string, role string, text string, ts timestamp")
    one = ingest.episodes(turns).first()
    assert one.id == str(uuid.uuid5(uuid.NAMESPACE_URL, "episode:s")) and (one.title, one.essence) == ("hello", "user: hello\n\nassistant: hi")


def test_logs_are_appended_by_day(spark, tmp_path):
    calls = spark.createDataFrame([(dt.datetime(2024, 1, d), "slice", "q" * 600, ["i"] * 30, 5, "x", t) for d, t in ((1, ""), (2, "test"), (3, "eval"))], "ts timestamp, call_type string, query string, ids array<string>, latency_ms int, source string, source_tag string")
    ledger.append(ledger.recall_entries(calls), str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log")).orderBy("ts").collect()
    assert [(len(r.query), len(r.returned_ids), r.source_tag) for r in back] == [(500, 20, None), (500, 20, "eval")]


def test_command_line(spark, tmp_path):
    path = str(tmp_path / "r")
    records(spark).write.parquet(path)
    told = cli.run(spark, ["search", "error in the log", "--records", path, "--now", B.NOW, "--limit", "3"]).collect()
    assert told and json.dumps([r.asDict() for r in told], default=str)
    assert cli.run(spark, ["status", "--records", path, "--now", B.NOW]).first().records == records(spark).count()
    assert len(cli.run(spark, ["list", "--records", path, "--now", B.NOW, "--since", "24h"]).collect()) <= 10


def test_commands_on_edges_folders_and_texts(spark, tmp_path):
    path, edges = str(tmp_path / "r"), str(tmp_path / "e")
    r = records(spark).where("doc_id < 30")
    r.write.parquet(path)
    spark.createDataFrame([("00000001", "00000002", "same_topic", 0.8), ("00000003", "00000002", "supports", 0.5), ("00000001", "00000004", "same_project", 0.4)], "src string, dst string, relation string, score double").write.parquet(edges)
    run = lambda *a: cli.run(spark, [*a, "--records", path, "--edges", edges, "--now", B.NOW]).collect()
    assert [(x.src, x.rank) for x in run("reverse", "00000002")] == [("00000001", 1), ("00000003", 2)]
    assert [x.dst for x in run("related", "00000001")] == ["00000002"] and len(run("links")) == 2
    known = r.where("status <> 'deprecated' AND invalid_at IS NULL").orderBy("id").first()
    assert [x.band for x in run("similar", known.essence, "zzz qqq")] == ["reject", "insert"]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("a line that no record is like in any way")
    (folder / "b.txt").write_text(known.essence[:1900])
    assert [x.title for x in run("import", str(folder))][:1] == ["a"] and sum(x.records for x in run("sources")) == r.count()


def test_related_records_and_vaults_make_no_row_for_each_pair(spark):
    """Scores, own records, projects and vaults by brute force; nothing is joined by words."""
    docs = [(f"{i:08x}", " ".join(f"w{(i * k) % 7} running auth" for k in range(i % 5)), f"t{i % 3} es tested", f"p{i % 2}") for i in range(40)] + [("000000ff", None, "", None)]
    r = spark.createDataFrame(docs, "id string, essence string, title string, project string")
    asked = spark.createDataFrame([(1, "w1 running auth w2 tests", "p1", "00000003"), (2, "t1 es w3 authentication", "general", None), (3, "", "p0", None), (4, None, None, None)], "query_id long, query string, project string, own string")
    sets = lambda col: [T.word_set(col), T.ngrams(T.tokens(col), 2), T.ngrams(T.tokens(col), 3)]
    share = lambda a, b: len(set(a) & set(b)) / min(len(set(a)), len(set(b))) if a and b else 0.0
    q = {x[0]: x[1:] for x in asked.select("query_id", "project", "own", *sets(F.col("query"))).collect()}
    d = {x[0]: x[1:] for x in r.select("id", "project", *sets(F.concat_ws(" ", "essence", "title"))).collect()}
    want = []
    for k, (project, own, *mine) in q.items():
        scored = [(0.5 * share(mine[0], x[0]) + 0.3 * share(mine[1], x[1]) + 0.2 * share(mine[2], x[2]), i, p) for i, (p, *x) in d.items() if i != own]
        scored = sorted((-round(s + (0.05 if p == project and p != "general" and p is not None else 0.0), 9), i) for s, i, p in scored if round(s, 9) > 0.15)
        want += [(k, i, -s) for s, i in scored[:3]]
    found = retrieval.related(asked, r)
    assert sorted(want) == sorted((x.query_id, x.id, round(x.score, 9)) for x in found.collect()) and len(want) == 6
    vaults = r.select(F.col("project").alias("vault"), "id", "title", "essence")
    near = retrieval.across_vaults(asked, vaults)
    words = lambda c: {x[0]: set(x[1]) for x in c.collect()}
    query = words(asked.select("query_id", T.word_set(F.col("query"))))
    title = words(r.select("id", T.word_set(F.col("title"))))
    body = words(r.select("id", F.coalesce(T.word_set(F.trim(F.concat("title", F.lit(" "), F.substring("essence", 1, 100)))), F.array())))
    want = []
    for k, w in query.items():
        scored = [(min(1.0, (2 * len(w & title[i]) + len(w & body[i] - title[i])) / len(w)), p, i) for i, _, _, p in docs if w]
        want += [(k, p, i, round(s, 9)) for s, p, i in sorted((x for x in scored if x[0] > 0), key=lambda x: (-round(x[0], 9), x[1] or "", x[2]))[:3]]
    assert sorted(want) == sorted((x.query_id, x.vault, x.id, round(x.similarity, 9)) for x in near.collect()) and want
    for df in (found, near.select("query_id", "id", "similarity")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(t" not in plan and "gram" not in plan and "count_if" not in plan


def test_postings_are_counted_where_their_words_are_made(spark):
    """One exchange, of records by id: before, each word went through one, and a task counted all that a file held."""
    rows = [("a", "T", "x y x", ["z"]), ("b", None, "x", None), ("a", "T", "x", []), (None, "n", "n", []), ("c", "", "", [])]
    found = write.postings(spark.createDataFrame(rows, "id string, title string, essence string, tags array<string>"))
    assert sorted((r.id or "", r.term, r.tf) for r in found.collect()) == [("", "n", 2), ("a", "t", 2), ("a", "x", 3), ("a", "y", 1), ("a", "z", 1), ("b", "x", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    # Also where a join has dealt them by id before.
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = spark.range(100).selectExpr("CAST(id AS string) AS id", "'t' AS title", "'x' AS essence", "array('y') AS tags")
    joined = joined.hint("merge").join(spark.range(50).selectExpr("CAST(id AS string) AS id"), "id", "left")
    assert f", {usual + 1}), REPARTITION_BY_NUM" in write.postings(joined)._jdf.queryExecution().executedPlan().toString()
