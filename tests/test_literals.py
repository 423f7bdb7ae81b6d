import random
import re

from pyspark.sql import functions as F

from lodestone.operators import search


def test_literals_equal_all_pairs(spark):
    """Literals within longer numbers, versions, dates, signs, capitals, empty ones and ones without a digit."""
    rng = random.Random(5)
    alphabet = ["1", "2", "12", "v1.2", "V1.2.1", "2024-01-02", ".", "-", " ", "x", "é", "/", "_", "\n", "Beta"]
    text = lambda most: "".join(rng.choices(alphabet, k=rng.randint(0, most)))
    docs = [(f"{i:03}", None if i == 7 else text(3), text(14)) for i in range(120)]
    queries = [(i, [text(3) for _ in range(rng.randint(0, 3))]) for i in range(80)] + [(80, None), (81, ["", None]), (82, ["Beta"]), (83, ["v1.2"])]
    d = spark.createDataFrame(docs, "id string, title string, essence string")
    q = spark.createDataFrame(queries, "query_id long, lits array<string>")
    got = sorted((r.query_id, r.rank, r.id) for r in search.literal_hits(q, d, F.col("lits")).collect())
    want = []
    for i, lits in queries:
        hits = [a for a, t, e in docs if any(x is not None and x.lower() in " ".join(y for y in (t, e) if y is not None).lower() for x in lits or [])]
        want += [(i, n, a) for n, a in enumerate(sorted(hits)[:2], 1)]
    assert got == sorted(want)


def test_literals_meet_by_a_key(spark):
    """No literal with a digit is compared with every text."""
    d = spark.createDataFrame([("a", "t", "v1.2")], "id string, title string, essence string")
    q = spark.createDataFrame([(1, ["v1.2"])], "query_id long, lits array<string>")
    plan = search.literal_hits(q, d, F.col("lits"))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*\(key#\d+L? = key#\d+L?\)", plan)
