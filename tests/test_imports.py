import json
import random

from pyspark.sql import functions as F

from lodestone.functions import edit
from lodestone.operators import fuzzy, retrieval
from lodestone.sources import imports, registry

LONG = "a text of some thirty characters {}"


def test_files_become_items():
    md = f"{LONG.format('before')}\n# One\nshort\n## Two  \n{LONG.format(2)}\n\n{LONG.format(3)}\n#### not a heading\nx\n### Three\n" + "y" * 3000
    got = imports.items_of("d/notes.md", md)
    assert [t for t, _ in got] == ["notes", "Two", "Three"] and len(got[2][1]) == 2000 and "#### not a heading" in got[1][1]
    assert imports.items_of("a.json", json.dumps({"k": "v" * 30})) == [("a", json.dumps({"k": "v" * 30}, indent=2))]
    listed = [{"title": "T" * 70, "x": "y" * 30}, "s" * 30, "short", 7] + [f"item {i} of a long list of them" for i in range(30)]
    got = imports.items_of("a.json", json.dumps(listed))
    assert got[0][0] == "T" * 60 and got[1] == ("a", "s" * 30) and len(got) == 18
    assert imports.items_of("a.json", "{broken" + " " * 30 + "x" * 30) == [] and imports.items_of("a.txt", " tiny ") == [] and imports.items_of("a.py", "x" * 40) == []
    assert imports.items_of("A.TXT", f"  {LONG} \n") == [("A", LONG)]


def test_only_what_is_new_is_imported(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text("the cache of the index is kept in memory for speed")
    (tmp_path / "b.txt").write_text("the cache of the index is kept in memory for more speed")
    (tmp_path / "deep" / "c.md").write_text("# Known\nthe store has this sentence about backups\n# New\nnothing else is like this other line at all")
    (tmp_path / "d.bin").write_text("not imported at all, whatever it holds")
    store = spark.createDataFrame([("r1", "the store has this sentence about nightly backups")], "id string, essence string")
    got = imports.new_records(spark, str(tmp_path), store, F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted((r.title, r.essence.split()[0]) for r in got) == [("New", "nothing"), ("a", "the")]
    again = imports.new_records(spark, str(tmp_path), store.unionByName(spark.createDataFrame([(r.id, r.essence) for r in got], "id string, essence string")), F.lit("2024-01-01").cast("timestamp"))
    assert again.count() == 0


def test_items_are_saved_in_order(spark):
    """Against saving one by one, each compared with the store and with what was saved before."""
    rng = random.Random(6)
    vocabulary = [chr(97 + i) * 5 for i in range(14)]
    new = [" ".join(rng.choices(vocabulary, k=6)) for _ in range(40)]
    old = [" ".join(rng.choices(vocabulary, k=6)) for _ in range(3)]
    saved, kept = list(old), []
    for i, text in enumerate(new):
        if not any(edit.token_set(text, x) >= 0.7 for x in saved):
            saved.append(text)
            kept.append(i)
    items = spark.createDataFrame(list(enumerate(new)), "new_id long, text string")
    got = fuzzy.fresh(items, spark.createDataFrame(list(enumerate(old)), "id long, body string"), share=0.05)
    assert sorted(r.new_id for r in got.collect()) == kept and 3 < len(kept) < 37


def test_reconciled_and_scoped(spark):
    new = spark.createDataFrame([(1, "alpha beta gamma delta", "p"), (2, "alpha beta gamma other", "p"), (3, "alpha beta gamma delta", "q"), (4, None, "p")], "new_id long, text string, project string")
    old = spark.createDataFrame([("a", "alpha beta gamma delta", "p"), ("b", "alpha beta epsilon zeta", "p")], "id string, body string, project string")
    got = {r.new_id: (r.decision, r.neighbours) for r in fuzzy.reconciled(new, old, within="project").collect()}
    assert got == {1: ("noop", []), 2: (None, ["a", "b"]), 3: (None, []), 4: (None, [])}


def test_lessons_meet_queries_as_all_pairs_do(spark):
    rng = random.Random(8)
    words = ["a", "the", "cat", "catalog", "log", "x", "of log", "is the", "?!", "cat log", "log cat of the"]
    queries = [" ".join(rng.choices(words, k=rng.randrange(0, 5))) for _ in range(40)]
    lessons = [(rng.choice(words) + rng.choice(["", " " + rng.choice(words)]), i) for i in range(40)] + [("", 99), (None, 98)]
    from lodestone.functions import rules

    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    ls = spark.createDataFrame(lessons, "query_class string, id long")
    want = q.crossJoin(ls).where(rules.lesson_applies(F.col("query"), F.col("query_class"))).select("query_id", "id").distinct()
    assert sorted(map(tuple, retrieval.excluded(q, ls).collect())) == sorted(map(tuple, want.collect()))


def test_registry_and_aliases(spark, tmp_path):
    spark.createDataFrame([("r", "active", None)], "id string, status string, invalid_at timestamp").write.parquet(str(tmp_path / "v1"))
    (tmp_path / "r.json").write_text(json.dumps({"vaults": [{"name": "one", "path": str(tmp_path / "v1")}, {"name": "gone", "path": str(tmp_path / "v2")}, {"path": "x"}, 7]}))
    assert [(r.vault, r.id) for r in registry.registered(spark, str(tmp_path / "r.json")).collect()] == [("one", "r")]
    assert registry.vaults(spark, str(tmp_path / "none.json")) == [] and registry.registered(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "a.json").write_text('{"Old": "new", "bad": 7}')
    names = registry.aliases(spark, str(tmp_path / "a.json"), {"earlier": "memory", "old": "older"})
    got = spark.createDataFrame([("OLD",), ("earlier",), ("else",), (None,), ("default",)], "p string").select(registry.project(F.col("p"), names).alias("p")).collect()
    assert [r.p for r in got] == ["new", "memory", "else", "general", "general"]
    (tmp_path / "a.json").write_text("broken")
    assert registry.aliases(spark, str(tmp_path / "a.json")) == {}
