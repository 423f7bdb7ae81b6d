from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import mixing, pii
from tests.llm.test_neardup import brute

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages, columns, rows = dict(corpus_pipeline.STAGES), docs.columns, {}
    assert list(stages) == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    for name, stage in stages.items():
        before = docs.collect()
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns and len(rows[name]) > 0
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            gone = {r.doc_id for r in before} - {r.doc_id for r in rows[name]}
            assert len(gone) < 0.25 * len(before) and sum(labels.get(i) == 0 for i in gone) <= 2
        if name == "near_duplicates":
            groups = brute([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in rows[name]) == sorted(i for i, (_, c) in groups.items() if i == c)
        if name == "personal_data":
            texts = {r.doc_id: r.text for r in before}
            assert {r.doc_id: r.text for r in rows[name]} == {i: pii.mask(t) for i, t in texts.items()}
            assert all(r.n_chars == len(r.text) for r in rows[name])
        if name == "mixing":
            mixed = mixing.mix(spark.read.parquet(str(tmp_path / "personal_data")), F.array("source"))
            assert Counter(r.doc_id for r in rows[name]) == Counter({r.doc_id: r.copies for r in mixed.where("copies > 0").collect()})
    copies = Counter(r.doc_id for r in rows["mixing"])
    once = {r.doc_id: r.text for r in rows["mixing"]}
    lengths = Counter()
    for r in rows["packing"]:
        lengths[r.doc_id] += r.length
    tokens = {r.doc_id: r.doc_tokens for r in rows["packing"]}
    assert set(once) == set(tokens) and all(lengths[i] == copies[i] * tokens[i] for i in once)


def test_run_and_small_inputs(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a plain text", "en", "s", 12), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "a plain text", "en", "t", 12), (5, "call +1 (555) 555-0100 now please", "en", "t", 30)]
    for name, docs in (("some", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in out} <= {1, 2, 3, 4, 5} and (name == "none") == (not out)
        assert 4 not in {r.doc_id for r in out}
