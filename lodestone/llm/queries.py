"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tables import read_table


def vocabulary() -> str:
    """Ranks of the vocabulary of byte_bpe_50k.json: the same ids, several times as fast to compute."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import topk

    return topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import packing

    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import quality

    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import toolcalls

    calls, results = toolcalls.as_calls(read_table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, toolcalls.REPLY)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import mixing

    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), F.array("source"))
    return mixed.select("doc_id", "size", F.col("pattern")[0].alias("source"), F.col("pattern_size").alias("source_size"), "target", "copies", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import toxicity

    return toxicity.toxic_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import passages

    return passages.repeated(read_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import pii

    return pii.digest(pii.detect(read_table(spark, sf_dir, "documents")))


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import audio

    return audio.recordings(read_table(spark, sf_dir, "embeddings"), from_vectors=True)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import neardup

    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import collocations

    return collocations.mine(read_table(spark, sf_dir, "documents"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import periodic

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = docs.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text")))
    return periodic.digest(periodic.detect(made))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm import tokenfiles
    from lodestone.llm.tables import Workspace

    space = Workspace(spark, "tokens")
    path = f"{space.root}/ids"
    tokenfiles.write(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.documents(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_tool_calls": op4_tool_calls,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_passages": op7_passages,
    "op8_pii": op8_pii,
    "op9_audio": op9_audio,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_collocations": op11_collocations,
    "op12_periodic": op12_periodic,
    "op13_token_files": op13_token_files,
}

ORACLE: dict[str, str] = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored
        ) WHERE rank <= 5
    """,
    "op4_tool_calls": """
        WITH users AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
        calls AS (
            SELECT u.conv_id, u.turn, u.conv_id || '-' || u.turn AS call_id, u.text, b.turn IS NOT NULL AS follows,
                   row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY u.text) AS again
            FROM users u LEFT JOIN (SELECT DISTINCT conv_id, turn FROM users) b ON b.conv_id = u.conv_id AND b.turn = u.turn - 2
        ), replies AS (
            SELECT conv_id, turn, text FROM (
                SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS n FROM conversations WHERE role = 'assistant'
            ) WHERE n = 1
        )
        SELECT c.conv_id, c.turn, CAST(0 AS INTEGER) AS place, c.call_id, 'reply' AS name, CAST(0 AS INTEGER) AS wave,
               CASE WHEN c.again > 1 THEN 'duplicate' WHEN c.text = '' THEN 'invalid_arguments' WHEN r.turn IS NULL THEN 'no_result' ELSE 'ok' END AS status,
               r.turn AS result_turn,
               '{"arguments":{"prompt":' || CAST(to_json(c.text) AS VARCHAR) || '},"call_id":"' || c.call_id || '","depends_on":['
               || CASE WHEN c.follows THEN '"' || c.conv_id || '-' || (c.turn - 2) || '"' ELSE '' END || '],"name":"reply","result":'
               || CASE WHEN r.text IS NULL THEN 'null' ELSE CAST(to_json(r.text) AS VARCHAR) END || '}' AS json
        FROM calls c LEFT JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
    """,
    "op11_collocations": """
        WITH pieces AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (
                SELECT coalesce(lang, 'und') AS lang,
                       unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
                FROM documents
            )
        ), counts AS (
            SELECT lang, k, phrase, count(*) AS f FROM (
                SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
                FROM pieces, (VALUES (1), (2), (3), (4)) v(k)
            ) GROUP BY ALL
        ), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
        frequent AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= 30),
        cuts AS (
            SELECT lang, phrase, k, f AS a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS rest
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM frequent WHERE k > 1)
        ), scored AS (
            SELECT c.lang, c.phrase, c.k, c.a, h.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (h.f + r.f) AS BIGINT) AS score,
                   row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY CAST(2000000 AS HUGEINT) * c.a // (h.f + r.f), cut) AS best
            FROM cuts c JOIN frequent h ON h.lang = c.lang AND h.phrase = c.head JOIN frequent r ON r.lang = c.lang AND r.phrase = c.rest
        ), inner_phrases AS (
            SELECT lang, phrase, max(f) AS longer FROM (
                SELECT lang, f, unnest(list_transform(range(1, k - m + 2), lambda s: array_to_string(w[s:s + m - 1], ' '))) AS phrase
                FROM frequent, (VALUES (2), (3)) v(m) WHERE m < k
            ) GROUP BY lang, phrase
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM (
            SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
            FROM scored s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.phrase = s.phrase WHERE best = 1 AND (longer IS NULL OR 100 * longer < 80 * a)
        ) JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
