import random

from pyspark.sql import functions as F

from lodestone.operators import graph, store, write
from lodestone.sources import feed, records

WORDS = "index vault search token graph edge note record session decay score merge shard cache query plan stream file".split()


def note(ident, rng, project="p"):
    words = " ".join(rng.choices(WORDS, k=12))
    return f"---\nid: {ident}\ntitle: {' '.join(rng.choices(WORDS, k=3))}\nproject: {project}\ntags: [{rng.choice(WORDS)}, {rng.choice(WORDS)}]\nimportance: {rng.randint(1, 5)}\nrelated: [r{rng.randint(0, 16):07d}]\nstatus: {rng.choice(['active', 'active', 'active', 'deprecated'])}\n---\n{words}.\n"


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.collect()), key=str)


def lengths(texts):
    return texts.map(lambda t: [float(len(t))])


def full(spark, path):
    """All tables of the folder as a full build makes them: of one id the newest file counts."""
    found, _ = records.front_matter(records.markdown(spark, path))
    newest = found.groupBy("id").agg(F.max(F.struct("modified", "file", *[c for c in found.columns if c not in ("id", "modified", "file")])).alias("r")).select("id", "r.*")
    r = feed.as_records(newest)
    return r, write.postings(r), write.embedded(r, lengths), graph.published(graph.built(store.valid_now(r)).own)


def test_tables_follow_random_edits(spark, tmp_path):
    rng = random.Random(3)
    folder = tmp_path / "vault"
    folder.mkdir()
    for i in range(16):
        (folder / f"{i}.md").write_text(note(f"r{i:07d}", rng))
    manifest, tables = None, None
    for step in range(3):
        s = feed.sweep(spark, str(folder), manifest)
        new = feed.as_records(s.upserts)
        if tables is None:
            tables = write.Tables(new, vectors=write.embedded(new, lengths), state=graph.built(store.valid_now(new)).written())
        else:
            tables = write.changed(tables, new, s.deletes, lengths)
        tables = write.Tables(*(spark.createDataFrame(t.collect(), t.schema) for t in (tables.records, tables.postings, tables.vectors)), state=tables.state.written())
        manifest = spark.createDataFrame(s.manifest.collect(), s.manifest.schema)
        for got, want in zip((tables.records, tables.postings, tables.vectors, tables.edges), full(spark, str(folder)), strict=True):
            assert rows(got.select(want.columns)) == rows(want)
        assert feed.sweep(spark, str(folder), manifest).upserts.count() == 0
        for _ in range(5):  # edits for the next step
            i = rng.randrange(20)
            if rng.random() < 0.4:
                (folder / f"{i}.md").unlink(missing_ok=True)
            else:
                (folder / f"{i}.md").write_text(note(f"r{rng.randrange(20):07d}", rng) + "x" * step)


def test_ids_that_move_and_files_that_break(spark, tmp_path):
    rng, a, b = random.Random(1), tmp_path / "a.md", tmp_path / "b.md"
    a.write_text(note("one", rng))
    first = feed.sweep(spark, str(tmp_path))
    assert rows(first.upserts.select("id")) == [("one",)] and first.deletes.count() == 0
    b.write_text(note("one", rng, "q"))
    second = feed.sweep(spark, str(tmp_path), first.manifest)
    assert rows(second.upserts.select("id", "project")) == [("one", "q")]
    b.unlink()  # the older file of the id counts again, although it has not changed
    third = feed.sweep(spark, str(tmp_path), second.manifest)
    assert rows(third.upserts.select("id", "project")) == [("one", "p")] and third.deletes.count() == 0
    a.write_text("no front matter")
    fourth = feed.sweep(spark, str(tmp_path), third.manifest)
    assert (fourth.upserts.count(), fourth.deletes.count(), fourth.quarantined.count()) == (0, 0, 1)
    a.write_text(note("two", rng))
    fifth = feed.sweep(spark, str(tmp_path), fourth.manifest)
    assert rows(fifth.upserts.select("id")) == [("two",)] and rows(fifth.deletes) == [("one",)]
    a.unlink()
    last = feed.sweep(spark, str(tmp_path), fifth.manifest)
    assert rows(last.deletes) == [("two",)] and last.manifest.count() == 0
