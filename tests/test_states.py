import json

from lodestone.streaming import growing, states

V = "2"
EVENTS = "session string, seq long, kind string, size long, version string"


def run(*events):
    s, out = states.START, []
    for kind, size in events:
        s = states.step(s, kind, size, V, V)
        out.append((s[0], s[1], s[2], states.terminal(s, V)))
    return out


def test_growth_opens_what_was_done():
    assert run(("grown", 100), ("started", None), ("done", 100)) == [("pending", 0, 0, False), ("running", 1, 0, False), ("complete", 1, 100, True)]
    assert run(("grown", 100), ("started", None), ("done", 100), ("grown", 100), ("grown", 150))[-2:] == [("complete", 1, 100, True), ("pending", 0, 100, False)]
    assert run(("grown", 100), ("started", None), ("grown", 130), ("done", 100))[-1] == ("pending", 0, 100, False)
    assert run(("grown", 100), ("started", None), ("done", 100), ("grown", 40))[-1] == ("pending", 0, 0, False)


def test_a_capped_session_is_tried_again_only_for_what_is_new():
    tries = [("grown", 100)] + [("started", None), ("failed", None)] * 5
    assert [x[0] for x in run(*tries)[2::2]] == ["retrying"] * 4 + ["failed"]
    assert run(*tries)[-1] == ("failed", 5, 100, True)
    assert run(*tries, ("grown", 100))[-1] == ("failed", 5, 100, True)
    assert run(*tries, ("grown", 101))[-1] == ("pending", 0, 100, False)
    assert not run(("grown", 10), ("blocked", None))[-1][3]


def test_another_version_opens_a_done_session():
    s = ("complete", 1, 50, 50, "1", 0)
    assert not states.terminal(s, V) and states.step(s, "grown", 50, None, V)[:3] == ("pending", 0, 0)


def test_a_replayed_stream_ends_as_the_batch_does(spark, tmp_path):
    """Events come in files, batch by batch, a session's late growth among them; states taken over from another store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = ["grown", "started", "failed", "started", "done", "grown", "blocked", "started", "done", "grown"]
    events = [(f"s{i % 7}", i, kinds[(i // 7 + i % 3) % 10], 10 * (1 + (i * 5) % 13), "2") for i in range(140)]
    known = [("s0", "failed", 5, 0, 40, "2"), ("s1", "complete", 1, 30, 30, "1"), ("new", "complete", 1, 9, 9, "2")]
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []

    def step():
        lines = growing.stream(spark, str(folder)).selectExpr(f"from_json(line, '{EVENTS}') AS e").select("e.*")
        start = spark.createDataFrame(known, "session string, status string, attempts int, offset long, size long, version string")
        q = states.stream(lines, V, start).writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    for cut in (0, 50, 100):
        with (folder / "log.jsonl").open("a") as f:
            for e in events[cut : cut + 50]:
                f.write(json.dumps(dict(zip(("session", "seq", "kind", "size", "version"), e, strict=True))) + "\n")
        step()
    plain = {}
    for s, status, attempts, offset, size, version in known:
        plain[s] = (status, attempts, offset or size, size, version, 0)
    want = []
    for s, seq, kind, size, version in events:
        plain[s] = states.step(plain.get(s, states.START), kind, size, version, V)
        want.append(states._told(s, seq, plain[s], V))
    assert sorted(map(tuple, seen), key=lambda r: r[1]) == want
    fresh = [e for e in events if e[0] not in ("s0", "s1")]
    got = states.batch(spark.createDataFrame(fresh, EVENTS).repartition(3), V).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [w for w in want if w[0] not in ("s0", "s1")]
