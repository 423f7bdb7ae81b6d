"""The engine's calls: search, get, timeline, slice, save, transcripts, assemble. All take and return DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import scoring as S
from lodestone.functions import text as T
from lodestone.operators import graph, search, sessions, store


class Engine:
    """Queries over one snapshot of records, with the tables beside it that a caller has.

    records: id, title, essence, project, tags, keys, importance, layer, related, contradicts, session, status,
    created_at, invalid_at. Any of vectors (id, vector), telemetry (id, access_count, last_accessed) and edges may be
    missing: the channel or signal it feeds is left out. `now` is a parameter, so results can be repeated.
    """

    def __init__(self, records: DataFrame, now: Column, vectors: DataFrame | None = None, telemetry: DataFrame | None = None, edges: DataFrame | None = None):
        self.records, self.now, self.vectors, self.edges = records, now, vectors, edges
        self.valid = store.valid_now(records)
        empty = records.limit(0).select("id", F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("timestamp").alias("last_accessed"))
        self.telemetry = telemetry if telemetry is not None else empty

    def _blob(self) -> DataFrame:
        return self.valid.select("id", F.concat_ws(" ", "title", F.substring("essence", 1, 2000), "keys").alias("text"))

    def search(self, queries: DataFrame, limit: int = 10, scope: str = "general", pool: int = 20) -> DataFrame:
        """(query_id, id, score, source, place) for queries (query_id, query and, for the dense channel, vector).

        Literal hits come first, then up to `limit` of the fused, boosted and diversified pool.
        """
        words, docs = T.spaced(F.col("query")), self._blob()
        channels = [search.bm25(docs, queries, "id", T.spaced(F.col("text")), words).select("query_id", "id", "score")]
        terms = F.transform(T.search_terms(F.col("query")), lambda w: F.lower(w))
        full = search.all_terms(search.bm25(docs, queries, "id", T.tokens(F.col("text")), terms, k1=1.2, floor=1e-6), queries, terms)
        channels.append(search.best(full, pool, F.desc("score"), F.col("id")).select("query_id", "id", "score"))
        if self.vectors is not None and "vector" in queries.columns:
            held = self.vectors.join(self.valid.select("id"), "id", "left_semi")
            channels.append(search.cosine_top(queries, held, 200).select("query_id", "id", "score"))
        literal = search.literal_hits(queries, self.valid, rules.literals(F.col("query")))
        fused = search.fuse(channels).join(literal.select("query_id", "id"), ["query_id", "id"], "left_anti")
        top = search.normalised(search.best(fused, pool, F.desc(F.round("score", 12)), F.col("id")))
        boosted = search.signals(top, self.valid, self.telemetry, F.lit(scope), self.now)
        boosted = boosted.join(queries.select("query_id", rules.time_window(F.col("query"), self.now).alias("w")), "query_id").join(self.valid.select("id", "created_at"), "id")
        inside = (F.col("created_at") >= F.col("w.start")) & (F.col("created_at") <= F.col("w.end"))
        boosted = boosted.withColumn("score", F.col("boosted") * F.when(F.coalesce(inside, F.lit(False)), 1.2).otherwise(1.0))
        vectors = self.vectors if self.vectors is not None else self.valid.limit(0).select("id", F.array().cast("array<float>").alias("vector"))
        picked = search.diversify(boosted.select("query_id", "id", "score").join(vectors.select("id", "vector"), "id", "left"), limit)
        first = literal.select("query_id", "id", F.lit(1.0).alias("score"), F.lit("literal").alias("source"), F.col("rank").alias("place"))
        return first.unionByName(picked.select("query_id", "id", "score", F.lit("fused").alias("source"), (F.col("place") + 2).alias("place")))

    def get(self, ids: DataFrame) -> DataFrame:
        """Records for keys (key, pos), in the order asked for; what is not found is left out."""
        return store.lookup(self.records, ids.select("key").distinct()).join(ids, "key").orderBy("pos")

    def timeline(self, anchors: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
        """What surrounds records (key) in time: linked either way, or of the same project."""
        at = store.lookup(self.records, anchors).select(F.col("id").alias("anchor"), F.col("created_at").alias("at"), "project", "related")
        r = self.valid.select("id", F.col("created_at").alias("ts"), F.col("project").alias("p"), F.col("related").alias("links"))
        same = at.join(r, at.project == r.p).select("anchor", "id", "ts")
        out = at.select("anchor", F.explode("related").alias("id")).join(r, "id").select("anchor", "id", "ts")
        back = r.select("id", "ts", F.explode("links").alias("anchor")).join(at.select("anchor"), "anchor", "left_semi").select("anchor", "id", "ts")
        near = same.unionByName(out).unionByName(back).where("anchor <> id").distinct()
        return sessions.timeline(at.select("anchor", "at"), near, before, after)

    def slice(self, queries: DataFrame, limit: int = 8, scope: str = "general") -> DataFrame:
        """Search results with their records and, where there are edges, what two hops of the graph add (hop > 0)."""
        hits = self.search(queries, limit, scope)
        found = hits.select("query_id", "id", F.lit(0).alias("hop"), "place")
        if self.edges is not None:
            more = graph.expand(hits.select("query_id", "id"), self.edges, most=limit + 12).where("hop > 0")
            found = found.unionByName(more.select("query_id", "id", "hop", "place"))
        return found.join(self.valid, "id").select("query_id", "hop", "place", "id", "title", F.substring("essence", 1, 80).alias("snippet"), "project", "importance")

    def save(self, new: DataFrame, reject: float = 0.92, merge: float = 0.70) -> DataFrame:
        """What would become of new records (query_id, query): band, the nearest old record, a threat if there is one."""
        near = search.overlap_search(new, self._blob(), 1).select("query_id", "id", "score")
        told = new.join(near, "query_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        threat = rules.threat(F.col("query"))
        short = F.length(F.trim("query")) < 10
        band = F.when(threat.isNotNull(), "blocked").when(short, "junk").otherwise(S.band(F.col("score"), reject, merge))
        return told.select("query_id", "id", "score", band.alias("band"), threat.alias("threat"))

    def transcripts(self, pairs: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
        """Turn pairs (id, text) for queries: full text with all terms, and word overlap where that finds nothing."""
        terms = F.transform(T.search_terms(F.col("query")), lambda w: F.lower(w))
        full = search.all_terms(search.bm25(pairs, queries, "id", T.tokens(F.col("text")), terms, k1=1.2, floor=1e-6), queries, terms)
        full = search.best(full, limit, F.desc("score"), F.col("id")).select("query_id", "id", "score", "rank")
        rest = queries.join(full.select("query_id").distinct(), "query_id", "left_anti")
        return full.unionByName(search.overlap_search(rest, pairs, limit).select("query_id", "id", "score", "rank"))

    def assemble(self, queries: DataFrame, scope: str, limit: int = 8, sparse: int = 5) -> DataFrame:
        """Search in a scope, filled up from everywhere where it finds fewer than `sparse`; first finds win."""
        inner = Engine(store.scoped(self.records, scope), self.now, self.vectors, self.telemetry, self.edges).search(queries, limit, scope)
        few = queries.join(inner.groupBy("query_id").count().where(F.col("count") >= sparse).select("query_id"), "query_id", "left_anti")
        outer = self.search(few, limit, scope)
        both = inner.withColumn("origin", F.lit(0)).unionByName(outer.withColumn("origin", F.lit(1)))
        w = Window.partitionBy("query_id", "id").orderBy("origin", "place")
        return both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
