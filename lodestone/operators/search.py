"""Ranked retrieval: BM25 in two variants, full text with all terms, cosine, rank fusion, signals, diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.functions import text as T
from lodestone.functions.vectors import Block, cosines, whole


def best(scored: DataFrame, k: int, *order: Column, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The first k rows for each query, numbered from 1."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def postings(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    """(id, term, tf, dl): counts are combined before they are shuffled."""
    listed = docs.select(F.col(id_col).alias("id"), words.alias("words"))
    exploded = listed.select("id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    return exploded.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def query_terms(queries: DataFrame, words: Column) -> DataFrame:
    """(query_id, term, qf): a term that a query repeats counts as often."""
    return queries.select("query_id", F.explode(words).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, doc_words: Column, query_words: Column, k1: float = 1.5, b: float = 0.75, floor: float | None = None) -> DataFrame:
    """(query_id, id, score) of every document that shares a term with a query.

    floor None: a negative idf becomes a quarter of the mean idf of the vocabulary. Otherwise idf is at least `floor`.
    Only the terms of queries are joined to postings; document frequencies come from one map-side combined count.
    """
    sized = docs.select(F.col(id_col).alias("id"), doc_words.alias("words")).where(F.size("words") > 0)
    stats = sized.agg(F.count("*").cast("double").alias("n"), F.avg(F.size("words")).alias("avgdl"))
    frequency = sized.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("df"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = frequency.crossJoin(F.broadcast(stats)).withColumn("raw", raw)  # one row of totals
    if floor is None:
        mean = idf.agg((F.avg("raw") * 0.25).alias("mean"))
        idf = idf.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("raw") < 0, F.col("mean")).otherwise(F.col("raw")))
    else:
        idf = idf.withColumn("idf", F.greatest(F.col("raw"), F.lit(floor)))
    asked = query_terms(queries, query_words).join(idf.select("term", "idf", "avgdl"), "term")
    held = sized.select("id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    # The terms asked for come first: all other postings end in the scan's own stage.
    held = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return held.join(asked, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.countDistinct("term").alias("terms"))


def all_terms(scored: DataFrame, queries: DataFrame, query_words: Column) -> DataFrame:
    """Only documents that hold every term of their query."""
    needed = queries.select("query_id", F.size(F.array_distinct(query_words)).alias("needed")).where("needed > 0")
    return scored.join(needed, "query_id").where("terms = needed").drop("needed")


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int, block: int = 20_000) -> DataFrame:
    """(query_id, id, score, rank): exact, all vectors against the stated queries (query_id, vector), in blocks.

    Each vector sits in one block of about `block` (16 blocks at least) and each query visits all blocks, where it meets
    its vectors as a matrix and keeps what may be among its first k; so what a task holds does not grow with the store.
    """
    blocks = max(16, -(-vectors.count() // block))
    of = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    held = vectors.select("id", whole(F.col("vector")).alias("vector"), of.alias("block"))
    asked = queries.select("query_id", whole(F.col("vector")).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": vectors.schema["id"].dataType.simpleString()}

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, own, found = b["id"].to_numpy(), a["query_id"].to_numpy(), []
        if len(a) and len(b):
            for at, c in cosines(Block(a["q"].tolist()), Block(b["vector"].tolist())):
                c = np.where(own[at : at + len(c), None] == ids[None, :], -np.inf, c)
                high = np.where(np.isnan(c), np.inf, c)
                # Scores are told apart by nine places, and ties go by id: what is equal to the last kept stays.
                least = np.partition(high, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))] - 2e-9
                i, j = np.nonzero((high >= least[:, None]) & (high > -np.inf))
                found.append((own[at + i], ids[j], c[i, j]))
        x, y, z = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (own[:0], ids[:0], np.zeros(0))
        return pd.DataFrame({"query_id": x, "id": y, "score": z})

    scored = asked.groupBy("block").cogroup(held.groupBy("block")).applyInPandas(meet, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    scored = scored.withColumn("score", F.coalesce("score", F.lit(float("nan"))))  # pandas hands NaN on as null
    return best(scored, k, F.desc(F.round("score", 9)), F.col("id"))


def fuse(channels: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of channels (query_id, id, score): a channel that lacks an id counts it after its last.

    Channels are stacked and pivoted in one aggregation rather than outer-joined: one shuffle, whatever their number.
    """
    ranked = None
    for number, c in enumerate(channels):
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        one = c.select("query_id", "id", F.lit(number).alias("channel"), F.row_number().over(w).alias("rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    sizes = ranked.groupBy("query_id").agg(*(F.count_if(F.col("channel") == i).alias(f"n{i}") for i in range(len(channels))))
    wide = ranked.groupBy("query_id", "id").agg(*(F.min(F.when(F.col("channel") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(channels))))
    total = F.lit(0.0)
    for i in range(len(channels)):
        total = total + F.when(F.col(f"n{i}") > 0, S.reciprocal_rank(F.col(f"r{i}"), F.col(f"n{i}") + 1, k)).otherwise(0.0)
    return wide.join(sizes, "query_id").select("query_id", "id", total.alias("score"))


def normalised(pool: DataFrame) -> DataFrame:
    """Scores of each query from 0 to 1; 1 where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return pool.withColumn("norm", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def signals(pool: DataFrame, records: DataFrame, telemetry: DataFrame, scope: Column, now: Column, seeds: int = 5) -> DataFrame:
    """The pool (query_id, id, rank, norm) with usage, scope, link and importance signals and the boosted score.

    records: id, project, importance, related (array of ids). A record is linked when one of the first `seeds` of its
    query lists it, or when it lists one of them.
    """
    wide = pool.join(records.select("id", "project", "importance", "related"), "id").join(telemetry.select("id", "access_count", "last_accessed"), "id", "left")
    first = wide.where(F.col("rank") <= seeds).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("related"))).alias("forward"), F.collect_list("id").alias("seed_ids"))
    wide = wide.join(first, "query_id", "left")
    listed = F.array_contains(F.coalesce("forward", F.array().cast("array<string>")), F.col("id"))
    lists = F.arrays_overlap(F.array_remove(F.col("related"), F.col("id")), F.array_remove(F.coalesce("seed_ids", F.array().cast("array<string>")), F.col("id")))
    return wide.select(
        "query_id", "id", "rank", "norm",
        S.usage(F.col("access_count"), F.col("last_accessed"), now).alias("usage"),
        F.when(F.col("project") == scope, 1.0).otherwise(0.0).alias("scope"),
        F.when(listed | F.coalesce(lists, F.lit(False)), 1.0).otherwise(0.0).alias("link"),
        (F.col("importance") / 5.0).alias("importance"),
    ).withColumn("boosted", F.col("norm") * S.multiplier(F.col("usage"), F.col("scope"), F.col("link"), F.col("importance")))


def diversify(pool: DataFrame, k: int = 8, relevance: float = 0.7) -> DataFrame:
    """Maximal marginal relevance in each query's bounded pool (query_id, id, score, vector): the picks and their places.

    Each pick maximises relevance * score - (1 - relevance) * (largest cosine to what is picked); a record without a
    vector is like no other; ties go to the better pool place. A pool of k or fewer keeps its order.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        width = max((len(v) for v in pdf["vector"] if v is not None), default=0)
        unit = np.zeros((len(pdf), width))
        for i, v in enumerate(pdf["vector"]):
            if v is not None and len(v) == width:
                x = np.asarray(v, float)
                unit[i] = x / max(np.linalg.norm(x), 1e-9)
        near, left, order = np.zeros(len(pdf)), list(range(len(pdf))), []
        if len(pdf) <= k:
            order = left
        while len(order) < min(k, len(pdf)):
            gain = relevance * pdf["score"].to_numpy()[left] - (1 - relevance) * (near[left] if order else 0)
            i = left.pop(int(np.argmax(np.round(gain, 12))))
            order.append(i)
            near = np.maximum(near, unit @ unit[i]) if len(order) > 1 else unit @ unit[i]
        out = pdf.loc[order, ["query_id", "id", "score"]].reset_index(drop=True)
        return out.assign(place=np.arange(1, len(out) + 1, dtype=np.int32))

    kinds = {f.name: f.dataType.simpleString() for f in pool.schema}
    return pool.select("query_id", "id", "score", "vector").groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, place int")


def rerank_pairs(candidates: DataFrame, scorer, top_k: int = 50, most_chars: int = 512) -> DataFrame:
    """Candidates (query_id, id, query, text, rank) ordered by a pair scorer: scorer(queries, texts) on whole batches."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def scores(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(scorer(query, text), index=query.index)

    pool = candidates.where(F.col("rank") <= top_k).withColumn("pair_score", scores("query", F.substring("text", 1, most_chars)))
    return best(pool, top_k, F.desc("pair_score"), F.col("rank"), rank="place")


#: What a literal and a text meet on: runs of digits and of what stands between those of a version or a date.
_RUN = r"[0-9.:/_-]*[0-9][0-9.:/_-]*"


def literal_hits(queries: DataFrame, records: DataFrame, lits: Column, k: int = 2) -> DataFrame:
    """The first k records by id that hold one of a query's literals (versions, dates) in title or body.

    A literal's first run of digits and their separators lies within such a run of each text that holds it. So texts tell the
    parts of their runs that are as long as some literal's, and meet literals on equal ones; a literal that is more than its
    run is then looked for as a whole. Of each distinct literal only its first k records are kept. Literals without a digit
    are compared with all texts.
    """
    asked = queries.select("query_id", F.explode(lits).alias("literal")).withColumn("literal", F.lower("literal"))
    literals = asked.select("literal").distinct().withColumn("key", F.regexp_extract("literal", _RUN, 0))
    texts = records.select("id", F.lower(F.concat_ws(" ", "title", "essence")).alias("blob"))
    lengths = literals.where("key <> ''").agg(F.array_sort(F.collect_set(F.length("key"))).alias("lengths"))  # one row of lengths
    runs = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("blob", F.lit(_RUN), F.lit(0)))).alias("run")).crossJoin(F.broadcast(lengths))
    sizes = runs.select("id", "run", F.explode("lengths").alias("n")).where(F.length("run") >= F.col("n"))
    parts = sizes.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - F.col("n") + 1), lambda i: F.substring(F.col("run"), i, F.col("n")))).alias("key"))
    met = parts.distinct().join(literals.where("key <> ''"), "key")
    plain = met.where("key = literal").select("literal", "id")
    more = met.where("key <> literal").join(texts, "id").where(F.contains("blob", F.col("literal"))).select("literal", "id")
    wordy = texts.join(literals.where("key = ''"), F.contains("blob", F.col("literal"))).select("literal", "id")
    first = best(plain.unionByName(more).unionByName(wordy).distinct(), k, F.col("id"), by="literal").drop("rank")
    return best(asked.join(first, "literal").select("query_id", "id").distinct(), k, F.col("id"))


def overlap_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) by the share of a query's distinct words that a document has; exact, by blocks."""
    from lodestone.operators import blocks

    found = blocks.covering(docs, queries, "id", T.tokens(F.col("text")), F.array_distinct(T.tokens(F.col("query"))), k)
    return best(found, k, F.desc("score"), F.col("id"))
