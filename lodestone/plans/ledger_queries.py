"""Queries of the write path, logs, links and further retrieval, with their SQL; they join those of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import identity, rules
from lodestone.functions import text as T
from lodestone.operators import blocks, ledger, retrieval, search, sessions, store, write
from lodestone.plans import catalog as C
from lodestone.sources import bindings as B

query, NOW, RECORDS, TOKENS, CALLS = C.query, C.NOW, C.RECORDS, C.TOKENS, C.CALLS

# --- retrieval --------------------------------------------------------------------------------------------------------

#: Documents as queries: those whose vectors ask in cosine_topk, with their titles as texts.
_ASKS_SQL = f"asks AS (SELECT doc_id AS item_id, {C.TITLE.format('text')} AS text FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 100 = 0)"
_THREE_SQL = (
    "WITH " + _ASKS_SQL + ", " + C._FUSED_SQL.split("one AS (SELECT")[0].removeprefix("WITH ").replace("FROM benchmark", "FROM asks")
    + """one AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS r FROM scored),
    two AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS r FROM overlap),
    near AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id IN (SELECT item_id FROM asks)),
    three AS (SELECT query_id, id, r FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM near) WHERE r <= 200),
    alls AS (SELECT query_id, id, 1 AS c, r FROM one UNION ALL SELECT query_id, id, 2, r FROM two UNION ALL SELECT query_id, id, 3, r FROM three),
    sized3 AS (SELECT query_id, c, count(*) AS n FROM alls GROUP BY 1, 2),
    fused3 AS (SELECT i.query_id, i.id, sum(1.0 / (60 + coalesce(a.r, s.n + 1))) AS score FROM (SELECT DISTINCT query_id, id FROM alls) i JOIN sized3 s USING (query_id) LEFT JOIN alls a ON a.query_id = i.query_id AND a.id = i.id AND a.c = s.c GROUP BY 1, 2)
    SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fused3) WHERE rank <= 20"""
)


@query("rrf_three_channels", _THREE_SQL)
def rrf_three_channels(spark, sf):
    v = B.vectors(spark, sf)
    docs = C._docs(spark, sf)
    asks = docs.join(v, "id").where("id % 100 = 0").select(F.col("id").alias("query_id"), T.title(F.col("text")).alias("query"), "vector")
    dense = search.cosine_top(asks.select("query_id", "vector"), v.select("id", "vector"), 200).select("query_id", "id", F.round("score", 9).alias("score"))
    overlap = blocks.Channel(T.tokens(F.col("text")), F.array_distinct(T.tokens(F.col("query"))), share=True)
    top = blocks.Texts(docs, asks, "id", [C._spaced(), overlap]).pooled(20, third=dense, most=200)
    return top.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("path_bonus", f"{C._BM25_SQL}, top AS ({C._TOP}) SELECT t.query_id, t.id, round(t.score * CASE WHEN d.lang = 'en' OR d.source = 'src3' THEN 1.05 ELSE 1.0 END, 6) AS score, t.rank FROM top t JOIN documents d ON d.doc_id = t.id")
def path_bonus(spark, sf):
    """A record's paths are its language's files and its source's folder."""
    d = B.table(spark, sf, "documents")
    globs = F.array(F.concat(F.lit("*."), "lang"), F.concat(F.lit("docs/"), "source", F.lit("/*")))
    hits = retrieval.path_bonus(C._bm25(spark, sf), d.select(F.col("doc_id").alias("id"), F.explode(globs).alias("glob")), ["notes/x.en", "home/docs/src3/y"])
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_WORDS = C._word_set_sql


def _gram_sql(name: str, key: str, text: str, table: str) -> str:
    return f"""{name}_t AS (SELECT {key} AS k, {TOKENS.format(text)} AS t, {_WORDS(text)} AS w FROM {table}),
        {name} AS (SELECT k, 1 AS kind, unnest(w) AS g FROM {name}_t UNION ALL SELECT DISTINCT k, 2, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM {name}_t
            UNION ALL SELECT DISTINCT k, 3, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM {name}_t),
        {name}_n AS (SELECT k, kind, count(*) AS n FROM {name} GROUP BY 1, 2)"""


@query("related_records", f"""WITH {RECORDS}, r AS (SELECT *, essence || ' ' || title AS body FROM records), {_gram_sql("q", "item_id", "text", "benchmark")}, {_gram_sql("d", "id", "body", "r")},
    x AS (SELECT q.k AS query_id, d.k AS id, q.kind, count(*) AS n FROM q JOIN d ON d.kind = q.kind AND d.g = q.g GROUP BY 1, 2, 3),
    s AS (SELECT x.query_id, x.id, sum(CASE x.kind WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END * x.n / least(a.n, b.n)) AS score FROM x JOIN q_n a ON a.k = x.query_id AND a.kind = x.kind JOIN d_n b ON b.k = x.id AND b.kind = x.kind GROUP BY 1, 2),
    t AS (SELECT s.query_id, s.id, s.score + CASE WHEN r.project = 'src1' THEN 0.05 ELSE 0 END AS score FROM s JOIN r USING (id) WHERE round(s.score, 9) > 0.15)
    SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM t) WHERE rank <= 3""")  # fmt: skip
def related_records(spark, sf):
    asked = B.query_set(spark, sf).withColumn("project", F.lit("src1")).withColumn("own", F.lit(None).cast("string"))
    return retrieval.related(asked, B.records(spark, sf)).withColumn("score", F.round("score", 6))


@query("cross_vault_search", f"""WITH {RECORDS}, q AS (SELECT item_id AS query_id, {_WORDS("text")} AS q FROM benchmark), v AS (SELECT project AS vault, id, {_WORDS("title")} AS tw, {_WORDS("trim(title || ' ' || substr(essence, 1, 100))")} AS bw FROM records),
    s AS (SELECT query_id, vault, id, least(1.0, (2.0 * len(list_intersect(q, tw)) + len(list_filter(list_intersect(q, bw), lambda x: NOT list_contains(tw, x)))) / len(q)) AS sim FROM q, v WHERE len(q) > 0)
    SELECT query_id, vault, id, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vault, id) AS rank FROM s WHERE sim > 0) WHERE rank <= 3""")  # fmt: skip
def cross_vault_search(spark, sf):
    """Each source is a vault."""
    vaults = B.records(spark, sf).select(F.col("project").alias("vault"), "id", "title", "essence")
    return retrieval.across_vaults(B.query_set(spark, sf), vaults).select("query_id", "vault", "id", F.round("similarity", 6).alias("similarity"), "rank")


_CLASS = "array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:3], ' ')"
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in rules.LESSON_STOP) + "]"


def _lesson_words(text: str) -> str:
    return "list_filter(list_distinct(regexp_extract_all(lower(" + text + r"), '[\p{L}\p{N}_]+')), lambda x: NOT list_contains(" + _STOP_SQL + ", x))"


@query("lesson_exclusions", f"""{C._BM25_SQL}, top AS ({C._TOP}), l AS (SELECT DISTINCT {_CLASS} AS c, item_id % 100 AS id FROM benchmark),
    gone AS (SELECT DISTINCT b.item_id AS query_id, l.id FROM benchmark b, l WHERE b.text <> '' AND l.c <> '' AND (contains(lower(b.text), l.c) OR len(list_intersect({_lesson_words("b.text")}, {_lesson_words("l.c")})) >= 2))
    SELECT t.query_id, t.id, t.rank FROM top t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.query_id = t.query_id AND g.id = t.id)""")  # fmt: skip
def lesson_exclusions(spark, sf):
    """Each benchmark text's first words are the class of a lesson against one record."""
    b = B.table(spark, sf, "benchmark")
    first = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 1, 3), " ")
    lessons = b.select(first.alias("query_class"), (F.col("item_id") % 100).alias("id")).distinct()
    return retrieval.without_excluded(C._bm25(spark, sf), B.query_set(spark, sf), lessons).select("query_id", "id", "rank")


@query("temporal_supplement", f"""WITH {RECORDS} SELECT b.item_id AS query_id, r.id, 1.0 AS score, CAST(r.rank AS INTEGER) AS rank FROM benchmark b,
    (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM records WHERE created_at BETWEEN {NOW} - INTERVAL 14 DAY AND {NOW} - INTERVAL 7 DAY) r WHERE r.rank <= 3""")  # fmt: skip
def temporal_supplement(spark, sf):
    asked = B.query_set(spark, sf).withColumn("query", F.lit("what changed last week"))
    return retrieval.temporal_supplement(asked, B.records(spark, sf), B.now())


@query("layer_candidates", f"WITH {RECORDS} SELECT id, layer FROM records WHERE layer IN (0, 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def layer_candidates(spark, sf):
    gone = B.table(spark, sf, "labels").where("toxic = 1").select(B.id8(F.col("doc_id")).alias("id"))
    return retrieval.layer_candidates(B.records(spark, sf), gone).select("id", F.col("layer").cast("long").alias("layer"))


_POSTED = TOKENS.format(C.TITLE.format("text") + " || ' ' || text || ' ' || lang")


@query("postings_upsert", f"SELECT term, count(*) AS records, CAST(sum(tf) AS BIGINT) AS times FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_POSTED}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def postings_upsert(spark, sf):
    """Postings in which the labelled records were stale and are replaced equal those of a full build."""
    r = B.records(spark, sf)
    changed = r.join(B.table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    stale = write.postings(r.join(changed.select("id", F.lit(True).alias("old")), "id", "left").withColumn("essence", F.when(F.col("old"), F.reverse("essence")).otherwise(F.col("essence"))))
    fresh = write.replaced(stale, changed, write.postings(changed))
    return fresh.groupBy("term").agg(F.count("*").alias("records"), F.sum("tf").alias("times"))


# --- logs and counts --------------------------------------------------------------------------------------------------


def _log(spark, sf) -> DataFrame:
    """events as a recall log with a list of returned ids; errors are tests, views a tagged source."""
    tag = F.when(F.col("call_type") == "error", "test").when(F.col("call_type") == "view", "eval").otherwise("")
    ids = F.transform(F.sequence(F.lit(1).cast("long"), 1 + F.col("returned") % 30), lambda x: B.id8(x))
    return B.calls(spark, sf).select("event_id", "ts", "call_type", F.col("session"), F.concat(F.when(F.col("returned") == 7, "cache test memory ").otherwise("q "), F.col("cited").cast("string")).alias("query"), ids.alias("ids"), "latency_ms", F.lit("slice").alias("source"), tag.alias("source_tag"))


_LOG_SQL = f"{CALLS}, entries AS (SELECT *, CASE call_type WHEN 'view' THEN 'eval' END AS source_tag, least(20, 1 + returned % 30) AS n, CASE WHEN returned = 7 THEN 'cache test memory ' ELSE 'q ' END || cited AS query FROM calls WHERE call_type <> 'error')"


@query("recall_entries", f"WITH {_LOG_SQL} SELECT CAST(ts AS DATE) AS day, call_type, source_tag, count(*) AS rows, CAST(sum(n) AS BIGINT) AS ids FROM entries GROUP BY 1, 2, 3")
def recall_entries(spark, sf):
    rows = ledger.recall_entries(_log(spark, sf))
    return rows.groupBy("day", "call_type", "source_tag").agg(F.count("*").alias("rows"), F.sum(F.size("returned_ids")).cast("long").alias("ids"))


@query("returned_totals", f"WITH {_LOG_SQL} SELECT call_type, CAST(sum(n) AS BIGINT) AS returned, count(*) AS calls FROM entries GROUP BY 1")
def returned_totals(spark, sf):
    return ledger.returned(ledger.recall_entries(_log(spark, sf)), "call_type").withColumn("returned", F.col("returned").cast("long"))


@query("test_rows", f"WITH {_LOG_SQL} SELECT count(*) FILTER (WHERE source_tag IS NOT NULL OR contains(query, 'cache test memory')) AS test_rows, count(*) AS rows FROM entries")
def test_rows(spark, sf):
    return ledger.advisory(ledger.recall_entries(_log(spark, sf)))


@query("log_tail", "SELECT event_type, count(*) AS rows FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) GROUP BY 1")
def log_tail(spark, sf):
    return ledger.newest(B.table(spark, sf, "events"), 500, "ts", "event_id").groupBy("event_type").agg(F.count("*").alias("rows"))


@query("session_recalls", f"SELECT CAST(user_id AS VARCHAR) AS session, max(ts) AS ts, array_to_string(list_sort(list(DISTINCT lpad(lower(to_hex(event_id % 100)), 8, '0'))), ',') AS recalls FROM events GROUP BY 1 HAVING max(ts) >= {NOW} - INTERVAL 2 DAY")
def session_recalls(spark, sf):
    r = ledger.session_recalls(B.calls(spark, sf).select("session", "ts", B.id8(F.col("returned")).alias("id")), B.now(), 2)
    return r.withColumn("recalls", F.array_join("recalls", ","))


@query("citations_30_days", f"WITH {CALLS} SELECT lpad(lower(to_hex(cited)), 8, '0') AS id, count(*) AS n FROM calls WHERE call_type = 'click' AND cited IS NOT NULL AND ts BETWEEN {NOW} - INTERVAL 30 DAY AND {NOW} GROUP BY 1")
def citations_30_days(spark, sf):
    return ledger.citations_since(B.calls(spark, sf).where("call_type = 'click' AND cited IS NOT NULL").select(B.id8(F.col("cited")).alias("id"), "ts"), B.now())


@query("store_status", f"WITH {RECORDS} SELECT count(*) AS records, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'deprecated') AS deprecated, count(DISTINCT project) AS projects, count(*) FILTER (WHERE doc_id % 2 = 0) AS linked, CAST(floor(count(*) FILTER (WHERE doc_id % 2 = 0) * 100 / count(*)) AS BIGINT) AS linked_percent, count(*) FILTER (WHERE layer = 0) AS layer_0, count(*) FILTER (WHERE importance = 5) AS immune FROM records")
def store_status(spark, sf):
    r = B.records(spark, sf).withColumn("related", F.when(F.col("doc_id") % 2 == 0, F.array("id"))).withColumn("decay_immune", F.col("importance") == 5)
    return ledger.status(r)


_RULE_SQL = """rule AS (SELECT *, list_filter(list_transform(string_split(essence, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM records),
    ruled AS (SELECT *, substr(CASE WHEN lines[1][1] = '#' THEN coalesce(list_filter(lines, lambda x: x[1] <> '#')[1], lines[1]) ELSE lines[1] END, 1, 100) AS line FROM rule)"""


@query("working_rules", f"""WITH {RECORDS}, {C._CITED_SQL}, {_RULE_SQL}, ranked AS (SELECT project, r.id, '- ' || line AS line, row_number() OVER w AS place, sum(length(line) + 3) OVER w + 17 AS used
    FROM ruled r LEFT JOIN (SELECT id, count(*) AS n FROM cites WHERE ts >= {NOW} - INTERVAL 30 DAY AND ts <= {NOW} GROUP BY 1) c USING (id) WHERE invalid_at IS NULL AND line <> ''
    WINDOW w AS (PARTITION BY project ORDER BY coalesce(c.n, 0) DESC, created_at DESC, r.id ROWS UNBOUNDED PRECEDING))
    SELECT project, id, line, CAST(place AS INTEGER) AS place FROM ranked WHERE used <= 1200""")  # fmt: skip
def working_rules(spark, sf):
    cited = citations_30_days(spark, sf)
    return ledger.working_rules(B.records(spark, sf), cited, "project")


@query("episode_index", f"""WITH {RECORDS}, newest AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id) AS n FROM records),
    lined AS (SELECT project, id, n, '- ' || substr(id, 1, 8) || ' [' || strftime(created_at, '%Y-%m-%d') || ']: ' || substr(title, 1, 80) AS line FROM newest WHERE n <= 25)
    SELECT project, id, line, CAST(n AS INTEGER) AS place FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY project ORDER BY n ROWS UNBOUNDED PRECEDING) + 17 AS used FROM lined) WHERE used <= 1600""")  # fmt: skip
def episode_index(spark, sf):
    return ledger.episode_index(B.records(spark, sf), "project")


@query("group_mode", "SELECT c_nationkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE r = 1")
def group_mode(spark, sf):
    return ledger.mode(B.table(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


@query("proposal_counts", "SELECT p_brand AS profile, p_type AS section, count(*) AS proposals FROM part GROUP BY 1, 2")
def proposal_counts(spark, sf):
    return ledger.proposals(B.table(spark, sf, "part").select(F.col("p_brand").alias("profile"), F.col("p_type").alias("section")), "profile", "section")


_STATE_SQL = "state AS (SELECT user_id AS session, CASE WHEN count(*) FILTER (WHERE event_type = 'error') % 3 = 0 THEN 'complete' ELSE 'failed' END AS status, count(*) FILTER (WHERE event_type = 'error') AS attempts, max(ts) AS updated_at FROM events GROUP BY 1)"


def _state(spark, sf) -> DataFrame:
    tries = F.count_if(F.col("event_type") == "error")
    e = B.table(spark, sf, "events").groupBy(F.col("user_id").alias("session")).agg(tries.alias("attempts"), F.max("ts").alias("updated_at"))
    return e.withColumn("status", F.when(F.col("attempts") % 3 == 0, "complete").otherwise("failed"))


@query("attempts_top", f"WITH {_STATE_SQL} SELECT session, attempts FROM state WHERE status = 'failed' AND attempts > 0 ORDER BY attempts DESC, session LIMIT 5")
def attempts_top(spark, sf):
    return ledger.attempts(_state(spark, sf)).select("session", "attempts")


@query("recent_sessions", f"WITH {_STATE_SQL} SELECT session, status, updated_at FROM state ORDER BY updated_at DESC, session LIMIT 5")
def recent_sessions(spark, sf):
    return ledger.recent(_state(spark, sf)).select("session", "status", "updated_at")


@query("scorecard", "SELECT source, count(*) AS cases, round(avg(CASE WHEN (n_chars >= 500) = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def scorecard(spark, sf):
    j = B.table(spark, sf, "documents").join(B.table(spark, sf, "labels"), "doc_id")
    return ledger.scorecard(j, (F.col("n_chars") >= 500) == (F.col("quality") == 1), "source")


@query("consolidation_starts", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'purchase') WHERE n % 5 = 0")
def consolidation_starts(spark, sf):
    d = B.table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("found"))
    return ledger.starts(d, "user_id", "event_id", 5).select("user_id", "event_id")


# --- identity and text ------------------------------------------------------------------------------------------------

_UUID_SQL = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || chr(10) || trim(source) || chr(10) || trim(lang)))"


@query("stable_ids", f"""WITH h AS (SELECT doc_id, {_UUID_SQL} AS h, substr(md5('doc:' || doc_id), 1, 12) AS short, sha256(text) AS essence FROM documents)
    SELECT doc_id, short, essence, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")  # fmt: skip
def stable_ids(spark, sf):
    number = F.col("doc_id").cast("string")
    return B.table(spark, sf, "documents").select("doc_id", identity.stable_id(F.lit("doc"), number).alias("short"), identity.essence_hash(F.col("text")).alias("essence"), identity.mined_id(number, F.col("source"), F.col("lang")).alias("uuid"))


@query("project_names", "SELECT page_id, CASE WHEN folder IN ('', '-home-u') THEN 'general' WHEN starts_with(folder, '-home-u-') THEN substr(folder, 9) ELSE folder END AS project FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '-home-u' WHEN 1 THEN '-home-u-p' || page_id ELSE 'other' END AS folder FROM pages)")
def project_names(spark, sf):
    p = B.table(spark, sf, "pages")
    folder = F.when(F.col("page_id") % 3 == 0, "-home-u").when(F.col("page_id") % 3 == 1, F.concat(F.lit("-home-u-p"), F.col("page_id").cast("string"))).otherwise("other")
    return p.select("page_id", identity.project_of_path(F.concat(F.lit("/data/"), folder, F.lit("/s.jsonl")), "/home/u").alias("project"))


@query("conversation_lines", "SELECT conv_id AS session, string_agg(CASE role WHEN 'user' THEN 'User: ' || trim(text) ELSE 'Assistant: ' || text END, chr(10) ORDER BY turn) AS lines FROM conversations WHERE (role = 'user' AND trim(text) <> '') OR (role = 'assistant' AND text <> '') GROUP BY 1")
def conversation_lines(spark, sf):
    t = B.turns(spark, sf).withColumn("line", identity.conversation_line(F.col("role"), F.col("text"))).where("line IS NOT NULL")
    lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return t.groupBy("session").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("lines"))


@query("newest_paths", """WITH p AS (SELECT page_id, unnest(regexp_extract_all(url, '/[a-z0-9]+')) AS path FROM pages), f AS (SELECT path, max(page_id) AS page_id FROM p GROUP BY 1)
    SELECT path, page_id FROM f ORDER BY page_id DESC, path LIMIT 5""")  # fmt: skip
def newest_paths(spark, sf):
    p = B.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("url", F.lit("/[a-z0-9]+"), F.lit(0))).alias("path"))
    return sessions.newest_first(p, "path", "page_id", 5)


@query("deletions", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def deletions(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    gone = B.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return store.delete(o, gone).withColumnRenamed("id", "o_orderkey")
