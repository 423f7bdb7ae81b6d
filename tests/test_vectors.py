import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.operators import consolidate, search

ODD = [[1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [1.0, 1.0], [1.0], [3.0], [], None, [1.0, None], [1.0, math.nan], [-1.0, 0.5], [1.0, 0.2]]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, v, p) for p in (0, 1) for i, v in enumerate(ODD * 2, 100 * p)]
    return spark.createDataFrame(rows, "id long, vector array<double>, project long")


def plain(rows):
    return sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("block", [5, 4096])
@pytest.mark.parametrize("least", [-1.0, 0.0, 0.9])
def test_similar_pairs_equal_the_column_function(spark, odd, block, least):
    a, b = odd.select("project", F.col("id").alias("a"), F.col("vector").alias("x")), odd.select("project", F.col("id").alias("b"), F.col("vector").alias("y"))
    want = a.join(b, "project").where("a < b").select("project", "a", "b", S.cosine(F.col("x"), F.col("y")).alias("c")).where(F.round("c", 9) >= least)
    assert plain(consolidate.similar_pairs(odd, least, block).collect()) == plain(want.collect())


def test_pairs_meet_in_few_rows(spark, odd):
    """Each block of vectors is a matrix: no row is made for a pair that is not similar."""
    plan = consolidate.similar_pairs(odd, 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # that with the sizes of projects


def test_cosine_top_equals_all_pairs(spark, odd):
    v = odd.select("id", "vector")
    q = v.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    all_pairs = q.join(v, F.col("id") != F.col("query_id")).select("query_id", "id", S.cosine(F.col("q"), F.col("vector")).alias("score"))
    want = search.best(all_pairs, 4, F.desc(F.round("score", 9)), F.col("id"))
    assert plain(search.cosine_top(q.withColumnRenamed("q", "vector"), v, 4).select("query_id", "id", "score", "rank").collect()) == plain(want.select("query_id", "id", "score", "rank").collect())
