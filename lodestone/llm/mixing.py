"""Mixing overlapping sources to target weights by a minimum-cost flow.

A document may belong to several sources. Documents are counted by membership pattern (their set of sources); only these
counts, one row per pattern, reach the driver. There words flow from patterns to source quotas: the first pass over a
pattern costs nothing, each further pass costs more than the one before (convex costs), so a text is repeated only where
no fresh one is left. The flow says how many words each pattern gives to each source, and seeded documents fill it: every
document of the pattern as often as the flow has whole passes, and for the rest of the flow those with the smallest
seeded hashes, to within one short document.

Quotas: source weights share the total size; a quota is at most `most_passes` times its source's size, and what is over
is shared again by weight among the others until none is above.

The driver holds one row per pattern, that is per distinct set of sources, never per document: about 1 KB each while it
routes, so a million patterns take 1 GB of its memory.

A null text has size 0; a very long text is measured whole by column functions. A null source is a source of its own, after
all others. Repeated rows are numbered and count as documents of their own; ties go by id. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tables import Workspace

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES, SEED = 3, 17
#: Documents in the bucket of a pattern in which its selection ends, about; only that bucket is put in order.
BUCKET_DOCS = 2000
#: Buckets that are summed together first; equal rows that are told again together.
SHELF = 4096


def size_of(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", 0).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def quotas(total: float, sizes: list[int], weights: list[float], most_passes: int = MOST_PASSES) -> list[float]:
    """The words each source should give: shares by weight, held to most_passes times its size, the excess shared again."""
    out = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free}
        over = {i for i in free if share[i] > most_passes * sizes[i]}
        if not over:
            for i in free:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(most_passes * sizes[i])
            left -= out[i]
        free -= over
    return out


def route(patterns: list[tuple[tuple[int, ...], int]], wanted: list[int], most_passes: int = MOST_PASSES) -> list[dict[int, int]]:
    """Words that each pattern (its sources, its size) gives to each source, at the least cost that meets most of `wanted`.

    Sources that no chain of patterns connects do not compete, so each connected part is a flow of its own.
    """
    parent = list(range(len(wanted)))

    def root(s: int) -> int:
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for sources, _ in patterns:
        for s in sources[1:]:
            parent[root(s)] = root(sources[0])
    parts: dict[int, list[int]] = {}
    for i, (sources, _) in enumerate(patterns):
        parts.setdefault(root(sources[0]), []).append(i)
    out: list[dict[int, int]] = [{} for _ in patterns]
    for numbers in parts.values():
        names = sorted({s for i in numbers for s in patterns[i][0]})
        at = {s: k for k, s in enumerate(names)}
        told = flow([(tuple(at[s] for s in patterns[i][0]), patterns[i][1]) for i in numbers], [wanted[s] for s in names], most_passes)
        for i, given in zip(numbers, told, strict=True):
            out[i] = {names[k]: v for k, v in given.items()}
    return out


def flow(patterns: list[tuple[tuple[int, ...], int]], wanted: list[int], most_passes: int = MOST_PASSES) -> list[dict[int, int]]:
    """The minimum-cost flow of one part.

    Successive shortest paths: node 0 is the start, then patterns, then sources, then the end. Pass k of a pattern is an
    arc of its size that costs k * k.
    """
    n, m = len(patterns), len(wanted)
    end = 1 + n + m
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    carried: dict[tuple[int, int], int] = {}
    for i, (sources, size) in enumerate(patterns):
        for k in range(most_passes):
            arc(0, 1 + i, size, k * k)
        for s in sources:
            carried[i, s] = len(to)
            arc(1 + i, 1 + n + s, most_passes * size, 0)
    for s, words in enumerate(wanted):
        arc(1 + n + s, end, words, 0)

    potential = [0] * (end + 1)
    while True:
        far = [None] * (end + 1)
        via = [-1] * (end + 1)
        far[0], queue = 0, [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in graph[a]:
                if room[e] > 0:
                    x = d + cost[e] + potential[a] - potential[to[e]]
                    if far[to[e]] is None or x < far[to[e]]:
                        far[to[e]], via[to[e]] = x, e
                        heapq.heappush(queue, (x, to[e]))
        if far[end] is None:
            break
        potential = [p + (f if f is not None else far[end]) for p, f in zip(potential, far, strict=True)]
        path, a = [], end
        while a:
            path.append(via[a])
            a = to[via[a] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step
    return [{s: room[carried[i, s] ^ 1] for s in sources} for i, (sources, _) in enumerate(patterns)]


def _fill(bucket: pd.DataFrame) -> pd.DataFrame:
    """Takes the documents of one bucket in the order of their tickets while they fit into what is short."""
    bucket = bucket.sort_values(["ticket", "doc_id", "size"], kind="stable").reset_index(drop=True)
    left = int(bucket["short"].iloc[0])
    extra = np.zeros(len(bucket), np.int32)
    for i, size in enumerate(bucket["size"]):
        if size <= left:
            extra[i], left = 1, left - size
    spare = bucket["size"].where(extra == 0).dropna()
    if len(spare) and abs(left - spare.min()) < left:
        extra[spare.idxmin()] = 1
    return bucket.assign(extra=extra)[["doc_id", "size", "number", "passes", "extra"]]


def _numbered(sized: DataFrame) -> DataFrame:
    """The rows with a number `copy` among those that are equal to them, so that equal rows get different tickets.

    Equal rows are counted, and told again in blocks that are dealt out, however many they are.
    """
    counted = sized.groupBy(*sized.columns).agg(F.count("*").alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SHELF))))
    once, often = blocks.where("n = 1"), blocks.where("n > 1").repartition("doc_id", "block")
    first = F.col("block") * SHELF
    often = often.withColumn("copy", F.explode(F.sequence(first, F.least(first + SHELF, F.col("n")) - 1)))
    return once.withColumn("copy", F.lit(0).cast("long")).unionByName(often).drop("n", "block")


def _edges(sums: DataFrame) -> DataFrame:
    """(number, edge, short): the bucket in which each pattern's rest is used up, and what is left of it there.

    Sums run over shelves of SHELF buckets first, then over the buckets of one shelf.
    """
    shelves = sums.groupBy("number", "shelf").agg(F.sum("words").alias("words"), F.max("rest").alias("rest"))
    shelves = shelves.withColumn("through", F.sum("words").over(Window.partitionBy("number").orderBy("shelf"))).where("through >= rest")
    shelf = shelves.groupBy("number").agg(F.min(F.struct("shelf", (F.col("through") - F.col("words")).alias("before"))).alias("at"))
    inside = sums.join(shelf.select("number", "at.shelf", "at.before"), ["number", "shelf"])
    inside = inside.withColumn("through", F.col("before") + F.sum("words").over(Window.partitionBy("number").orderBy("bucket"))).where("through >= rest")
    last = inside.groupBy("number").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("through") + F.col("words")).alias("short"))).alias("last"))
    return last.select("number", F.col("last.bucket").alias("edge"), "last.short")


def mix(docs: DataFrame, membership: Column, weights: tuple[float, ...] = WEIGHTS, most_passes: int = MOST_PASSES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, pattern (its sources), pattern_size, target (sum of its sources' quotas), copies, taken.

    membership: an array of source names for each document, which may hold a null; a null array is the null source.
    Weights repeat along the sources in the order of their code points, null last.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "mixing")
    pattern = F.array_sort(F.array_distinct(F.coalesce(membership, F.array(F.lit(None).cast("string")))))
    sized = docs.select(F.col(id_col).alias("doc_id"), pattern.alias("pattern"), size_of(F.col(text_col)).alias("size"))
    sized = space.write(sized.withColumn("pattern_key", F.to_json("pattern")), "sized")
    counted = sized.groupBy("pattern_key").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("size"), F.count("*").alias("docs"))
    counted = counted.collect()
    counted.sort(key=lambda r: [(x is None, x or "") for x in r.pattern])
    names = sorted({x for r in counted for x in r.pattern}, key=lambda x: (x is None, x or ""))
    at = {x: i for i, x in enumerate(names)}
    sizes = [sum(r.size for r in counted if x in r.pattern) for x in names]
    targets = quotas(sum(r.size for r in counted), sizes, [weights[i % len(weights)] for i in range(len(names))], most_passes)
    flows = route([(tuple(at[x] for x in r.pattern), r.size) for r in counted], [round(t) for t in targets], most_passes)

    plan = []
    for i, (r, flow) in enumerate(zip(counted, flows, strict=True)):
        passes, rest = divmod(sum(flow.values()), r.size) if r.size else (0, 0)
        plan.append((r.pattern_key, i, list(r.pattern), int(r.size), float(sum(targets[at[x]] for x in r.pattern)), int(passes), int(rest), max(1, r.docs // BUCKET_DOCS)))
    kind = sized.schema["pattern"].dataType.simpleString()
    plan = spark.createDataFrame(plan, f"pattern_key string, number int, pattern {kind}, pattern_size long, target double, passes long, rest long, buckets long")
    ready = _numbered(sized.drop("pattern")).join(plan.select("pattern_key", "number", "passes", "rest", "buckets"), "pattern_key").drop("pattern_key")
    ready = ready.withColumn("ticket", F.xxhash64(F.lit(seed), "doc_id", "size", "copy")).withColumn("bucket", F.pmod("ticket", "buckets")).drop("copy")

    sums = ready.where("rest > 0").groupBy("number", "bucket").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    last = space.write(_edges(sums.withColumn("shelf", F.floor(F.col("bucket") / SHELF))), "edges")
    ready = ready.join(last, "number", "left")
    on_edge = F.coalesce((F.col("bucket") == F.col("edge")) & (F.col("size") > 0), F.lit(False))
    filled = ready.where(on_edge).select("number", "doc_id", "size", "passes", "ticket", "short")
    filled = filled.groupBy("number").applyInPandas(_fill, f"doc_id {sized.schema['doc_id'].dataType.simpleString()}, size long, number int, passes long, extra int")
    others = ready.where(~on_edge).select("doc_id", "size", "number", "passes", F.coalesce((F.col("bucket") < F.col("edge")).cast("int"), F.lit(0)).alias("extra"))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(0)
    out = filled.unionByName(others).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    out = space.write(out.join(plan.select("number", "pattern", "pattern_size", "target"), "number").drop("number", "passes", "extra"), "mixed")
    space.drop(sized)
    return out.select("doc_id", "size", "pattern", "pattern_size", "target", "copies", "taken")


def repeat(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs."""
    copies = mixed.groupBy(F.col("doc_id").alias("mixed_id")).agg(F.max("copies").alias("mixed_copies")).where("mixed_copies > 0")
    joined = docs.join(copies, F.col(id_col).eqNullSafe(F.col("mixed_id")))
    return joined.withColumn("mixed_copies", F.explode(F.sequence(F.lit(1), F.col("mixed_copies").cast("int")))).select(*docs.columns)
