"""Exact top-k inner products by aggregation of sorted lists without random access.

Every dimension of a block of candidates is one list, sorted by component. A query reads each list from the end that
its own component favours, all lists equally deep. What it has read of a candidate, with the rest counted at the place
just read, is the candidate's upper bound. At each stop the scores of the k candidates with the most read so far are
resolved, which gives a lower bound of the k-th best score; a candidate whose upper bound is under it can no longer
qualify. Reading stops when no more candidates than needed are left, and the scores of those are resolved in full, in
integers. Ties at the bound are never given up, so results equal those of a full scan.

Components of embeddings are nearly independent, which is hard on such bounds: of 2,000 vectors of 64 components, half of
every list rules out 65 per cent where a query brings its final bound along (41 where it brings none), 70 per cent of it
98 per cent.

Queries and candidates meet in tiles: a tile of candidates with a tile of queries is a task of its own with bounded
memory. Tiles are large (up to `CANDIDATES` and `QUERIES` rows), so with up to `QUERIES` queries each candidate moves
once; within a tile the work goes by blocks, and the k-th best score that earlier blocks gave a query is the bound it brings
to later ones. A first pass over one tile of candidates gives every query such a bound for all others. Tiles return k rows
for each query; the final k come from a window over those.

Components become floor(scale * x). Vectors that are null or hold a null or a non-finite component take no part, nor do
rows without an id. Every row but the query's own is a candidate, so rows that share an id count one by one. Vectors of
other lengths than the query's are no candidates of it; very long ones are handled like others, a tile at a time. Ties go
to smaller ids. With fewer candidates than k a query gets all; an empty table gives an empty result. Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.neardup import _grouped
from lodestone.llm.tables import Workspace

SCALE, K = 256, 5
#: Rows of a tile at most, and of the blocks that bounds are computed for at once.
CANDIDATES, QUERIES = 65_536, 16_384
BLOCK, ASKED = 2048, 512
#: Shares of the lists after which bounds are compared.
STOPS = (0.4, 0.5, 0.6, 0.7)
#: The share of all pairs that is resolved rather than read on.
RESOLVED = 0.02
NONE = np.iinfo(np.int64).min


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def _scores(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact scores of pairs, a bounded number at a time."""
    out = np.empty(len(rows), np.int64)
    for i in range(0, len(rows), 1 << 16):
        part = slice(i, i + (1 << 16))
        out[part] = np.einsum("ij,ij->i", q[rows[part]], x[columns[part]])
    return out


def block_top(x: np.ndarray, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, candidate row, score) of all pairs that can be among a query's best k, and the list entries read.

    own: the candidate row that is the query itself, -1 for none. floor: a score that k candidates are known to reach.
    """
    n, d = x.shape
    floor = floor.astype(float)
    alive = np.ones((len(q), n), bool)
    alive[np.flatnonzero(own >= 0), own[own >= 0]] = False
    values, asks = x.astype(float), q.astype(float)
    order = np.argsort(values, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    ordered = np.take_along_axis(values, order, axis=0)
    parts = np.concatenate([np.maximum(asks, 0), np.minimum(asks, 0)], 1)  # what favours the high end of a list, and the low end
    slack = 1e-9 * (1 + np.abs(asks) @ np.abs(values).max(axis=0, initial=0))
    read = 0
    for stop in STOPS:
        depth = min(n, max(1, int(n * stop)))
        unread = np.concatenate([place < n - depth, place >= depth], 1)
        last = np.concatenate([ordered[n - depth], ordered[depth - 1]])  # just read
        # Known components count as they are, the others as the one just read: one product gives the upper bounds.
        upper = parts @ np.where(unread, last, np.concatenate([values, values], 1)).T
        read = depth * d * len(q)
        if n > k:
            best = np.argpartition(np.where(alive, upper, -np.inf), n - k, axis=1)[:, n - k :]
            rows = np.repeat(np.arange(len(q)), k)
            found = np.where(alive[rows, best.ravel()], _scores(q, x, rows, best.ravel()), -np.inf).reshape(len(q), k)
            floor = np.maximum(floor, found.min(1))
        alive &= upper >= (floor - slack)[:, None]
        # To resolve what is left takes fewer steps than to read on.
        if alive.sum() <= 2 * k * len(q) + RESOLVED * alive.size:
            break
    rows, columns = np.nonzero(alive)
    return rows, columns, _scores(q, x, rows, columns), read


class Best:
    """The best k of each query of a tile so far."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.rows, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, ids, scores = (np.concatenate(x) for x in ((self.rows, rows), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = rank == self.k - 1
        self.floor[rows[last]] = np.maximum(self.floor[rows[last]], scores[last])
        self.rows, self.ids, self.scores = (x[rank < self.k] for x in (rows, ids, scores))


def tile_top(row: np.ndarray, ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """The best k candidates (row, id, vector) of a tile for its queries (row, vector, bound)."""
    best = Best(len(q), k, floor)
    for a in range(0, len(x), BLOCK):
        block = slice(a, a + BLOCK)
        by_row = np.argsort(row[block], kind="stable")
        for b in range(0, len(q), ASKED):
            some = slice(b, b + ASKED)
            at = np.minimum(np.searchsorted(row[block], asked[some], sorter=by_row), len(by_row) - 1)
            own = np.where(row[block][by_row[at]] == asked[some], by_row[at], -1)
            r, c, scores, _ = block_top(x[block], q[some], own, best.floor[some], k)
            best.add(r + b, ids[block][c], scores)
    return best


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int | None = None, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row that `is_query` (of vec_id) selects.

    candidates: rows of a tile of them; unset, as few as give every core of the cluster a tile, `CANDIDATES` at most.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "topk")
    vec = F.col(vector_col)
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable(vec), integers(vec, scale)).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    clean = space.write(clean.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("width"), F.coalesce(is_query, F.lit(False)).alias("asked")), "vectors")
    n = clean.agg(F.count("*").alias("rows"), F.count_if("asked").alias("asked")).first()
    if candidates is None:
        candidates = min(CANDIDATES, max(BLOCK, -(-n.rows // (2 * spark.sparkContext.defaultParallelism))))
    tiles, rounds = max(1, -(-n.rows // candidates)), max(1, -(-n.asked // queries))
    own = clean.select("width", F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int").alias("tile"), "row", "vec_id", "v")
    asks = clean.where("asked").select("width", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(rounds)).cast("int").alias("turn"), "row", "vec_id", "v", F.lit(NONE).alias("floor"))

    def meet(first: int, last: int, asks: DataFrame) -> DataFrame:
        """The best k of each query in each of the tiles first to last; its last one's score is its bound elsewhere."""
        held = own.where(F.col("tile").between(first, last)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("query", F.lit(False)).withColumn("floor", F.lit(NONE))
        asked = asks.withColumn("tile", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("query", F.lit(True))
        columns = ["width", "tile", "turn", "query", "row", "vec_id", "floor", "v"]
        both = held.select(columns).unionByName(asked.select(columns)).repartition("width", "tile", "turn").sortWithinPartitions("width", "tile", "turn")
        return both.mapInArrow(run, "query_row long, query_id long, vec_id long, score long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (query, row, ids, floor, v) in _grouped(batches, 3):
            query = query.astype(bool)
            if query.any() and not query.all():
                best = tile_top(row[~query], ids[~query], v[~query], row[query], v[query], floor[query], k)
                yield pa.RecordBatch.from_arrays([pa.array(row[query][best.rows]), pa.array(ids[query][best.rows]), pa.array(best.ids), pa.array(best.scores)], ["query_row", "query_id", "vec_id", "score"])

    found = meet(0, 0, asks)
    if tiles > 1:
        found = space.write(found, "first")
        bounds = found.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
        asks = asks.join(bounds, "row", "left").withColumn("floor", F.coalesce("bound", "floor")).drop("bound")
        found = found.unionByName(meet(1, tiles - 1, asks))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
