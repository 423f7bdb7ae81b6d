import re
from collections import Counter
from itertools import pairwise

import pytest

from lodestone.functions import tables
from lodestone.plans import catalog


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "A b, c! a"), (2, None), (3, "")], "id long, text string").createOrReplaceTempView("texts_of_test")
    got = spark.sql("SELECT id, pos, word FROM texts_of_test, LATERAL words_of(text) ORDER BY id, pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "a")]
    tri = spark.sql("SELECT * FROM texts_of_test, LATERAL ngrams_of(text, 3)")
    assert tri.columns == ["id", "text", "pos", "w1", "w2", "w3"] and [tuple(r)[2:] for r in tri.collect()] == [(0, "a", "b", "c"), (1, "b", "c", "a")]
    with pytest.raises(Exception, match="constant from 1 to 8"):
        spark.sql("SELECT * FROM texts_of_test, LATERAL ngrams_of(text, 9)").collect()


def test_word_pairs_of_the_query_stay_in_the_jvm(spark):
    found = catalog.QUERIES["sql_ngrams"](spark, "/root/testdata/sf0.001")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    lists = [(d.lang, re.findall("[a-z0-9]+", (d.text or "").lower())) for d in docs]
    want = Counter((lang, a, b) for lang, w in lists for a, b in pairwise(w))
    assert {(r.lang, r.w1, r.w2): r.n for r in found.collect()} == {k: n for k, n in want.items() if n >= 10}
