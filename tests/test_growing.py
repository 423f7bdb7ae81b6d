import json
import threading

import pytest

from lodestone.streaming import growing, ingest


def body(n, first=0):
    return "".join(f'{{"n": {i}}}\n' for i in range(first, first + n))


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000])
def test_ranges_cut_anywhere_give_each_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(growing, "READ", 5)
    text = "first\n\r\n\nünï\r\n" + "x" * 40 + "\nlast without end"
    (tmp_path / "a.jsonl").write_bytes(text.encode())
    for cut in range(len(text.encode()) + 1):
        parts = growing.ranges({}, {str(tmp_path / "a.jsonl"): cut}, size)
        parts += growing.ranges({str(tmp_path / "a.jsonl"): cut}, {str(tmp_path / "a.jsonl"): len(text.encode())}, size)
        got = [x for p in parts for x in growing.range_lines(str(tmp_path), p)]
        assert [line.decode() for _, line in got] == ["first", "", "", "ünï", "x" * 40]
        assert [end for end, _ in got] == [i + 1 for i, c in enumerate(text.encode()) if c == 10]


def test_a_pass_is_fixed_before_it_runs(spark, tmp_path):
    """The file grows while a pass works on it: the new line comes in the next pass, and only there."""
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    a = folder / "a.jsonl"
    a.write_text(body(1))

    def work(lines, number):
        with a.open("a") as f:
            f.write(body(1, number + 1))
        seen.append((number, sorted(r.line for r in lines.collect())))

    for _ in range(3):
        assert ingest.advance(spark, str(folder), str(tmp_path / "state"), work) == 1
    assert seen == [(i, [f'{{"n": {i}}}']) for i in range(3)]


def test_restarts_and_failures(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    (folder / "deep").mkdir(parents=True)
    (folder / "a.jsonl").write_text(body(3))
    (folder / "deep" / "b.jsonl").write_text(body(2, 10))
    (folder / "_c.jsonl").write_text(body(1, 90))
    (folder / "d.txt").write_text("no data\n")

    def run(fail=False):
        def effect(batch, number):
            seen.append((number, sorted(json.loads(r.line)["n"] for r in batch.collect())))
            if fail:
                raise OSError("down")

        q = growing.stream(spark, str(folder), range="4").writeStream.foreachBatch(effect).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="down"):
        run(fail=True)
    with (folder / "a.jsonl").open("a") as f:
        f.write(body(1, 3))
    run()
    run()
    assert seen[:2] == [(0, [0, 1, 2, 10, 11])] * 2
    assert [x for _, xs in seen[2:] for x in xs] == [3]


def test_every_line_once_while_a_writer_goes_on(spark, tmp_path):
    folder, seen, done = tmp_path / "in", [], threading.Event()
    folder.mkdir()

    def writer():
        for k in range(40):
            with (folder / f"{k % 3}.jsonl").open("a") as f:
                text = body(25, 25 * k)
                f.write(text[: len(text) // 2 + 3])
                f.flush()
                done.wait(0.03)
                f.write(text[len(text) // 2 + 3 :])

    t = threading.Thread(target=writer)
    t.start()
    work = lambda lines, number: seen.extend(json.loads(r.line)["n"] for r in lines.collect())
    for _ in range(3):
        ingest.advance(spark, str(folder), str(tmp_path / "state"), work)
    t.join()
    ingest.advance(spark, str(folder), str(tmp_path / "state"), work)
    assert sorted(seen) == list(range(1000)) and len(seen) == 1000


def test_only_the_tail_is_read(spark, tmp_path, monkeypatch):
    f = tmp_path / "a.jsonl"
    f.write_text(body(100_000))
    size = f.stat().st_size
    with f.open("a") as out:
        out.write(body(2, 7))
    (part,) = growing.ranges({str(f): size}, growing.lengths(str(tmp_path), ".jsonl"))
    assert part.end - part.begin == len(body(2, 7))
    offsets = spark.createDataFrame([(str(f), size)], "file string, offset long")
    got = ingest.appended(spark, str(tmp_path), offsets).orderBy("offset").collect()
    assert [json.loads(r.line)["n"] for r in got] == [7, 8] and got[-1].offset == f.stat().st_size
    assert ingest.appended(spark, str(tmp_path), None).count() == 100_002


def test_shorter_and_missing_files(spark, tmp_path):
    assert growing.lengths(str(tmp_path / "none"), ".jsonl") == {}
    f = tmp_path / "a.jsonl"
    f.write_text(body(3))
    since = growing.lengths(str(tmp_path), ".jsonl")
    f.write_text(body(1, 50))
    assert [json.loads(r.line)["n"] for r in growing.tail(spark, str(tmp_path), since).collect()] == [50]
    f.unlink()
    assert growing.tail(spark, str(tmp_path), since).count() == 0
