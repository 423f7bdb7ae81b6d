"""Toxicity by a classifier chain: linear models in a fixed order, each of which also reads what the earlier ones say.

A model of the chain reads which of its chosen words and word beginnings a text holds, the text's structure statistics,
and the log-odds that earlier categories were given. While it is trained it reads out-of-fold log-odds, made by models
that had not seen the document, so that it learns to trust them as far as they deserve on unseen texts.

Training uses at most `most_labelled` labelled documents (a documented bound; they are chosen among the labels of documents
at hand by a hash of their ids). Each kind of the last category has its share of them, and a rare kind all it has up to a
tenth of the bound, so where it is rarer than that, probabilities are those of a corpus with the sample's share.
Candidate features are counted over all texts of that sample in the cluster, and those with the strongest chi-squared
association come to the driver: at most `FEATURES` for each category, none below `SIGNIFICANT`. Every document is then scored on its whole text.

The last category flags from a threshold on: the one that is best on out-of-fold probabilities, drawn towards the middle
between the category's share of the labels and 1 as by `PRIOR_LABELS` further labels, so that few labels do not set it
alone. Folds go by the smallest shingle of a text, so near copies stand in the same fold.

A null or empty text has no words and is never flagged; a very long text is read whole, in a part of its own. Documents
without labels are scored like all others. Without both kinds of labels for a category its model gives their share.
Repeated rows get equal scores; of rows that share an id and differ in text the smallest text is learnt from. Ties at the
bound of the sample go to smaller ids. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import features, words
from lodestone.llm.neardup import shingle_sets
from lodestone.llm.tables import Workspace
from lodestone.llm.words import U64

MOST_LABELLED, FEATURES, FOLDS, LEAST_DOCS, PENALTY = 10_000, 2048, 5, 2, 1.0
#: The least chi-squared value of a feature: below it some of the many candidates are associated by chance.
SIGNIFICANT = 24.0
#: How many labels of the rarer kind the prior of the threshold counts for.
PRIOR_LABELS = 25
#: Structure columns weigh less than words, for they tell languages and kinds of text apart rather than toxicity.
STRUCTURE_SCALE = 0.3
#: Lengths in bytes of the word beginnings that are features besides whole words.
BEGINNINGS = (5, 6)
#: The labels table marks low quality and toxicity; the chain reads them in this order.
CATEGORIES = {"junk": lambda: 1 - F.col("quality"), "toxic": lambda: F.col("toxic")}


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature keys of all words and word beginnings, and the number of the text that each stands in."""
    data, offsets = words.utf8(texts)
    starts, ends, first = words.word_spans(data, offsets, punctuation=False)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys, owners = [words.hash_spans(data, starts, ends)], [owner]
    for n in BEGINNINGS:
        longer = ends - starts > n
        keys.append(words.mix(words.hash_spans(data, starts[longer], starts[longer] + n), n))
        owners.append(owner[longer])
    return np.concatenate(keys), np.concatenate(owners)


class Lookup:
    """Columns of chosen keys. A bitmap of the low bits settles nearly all other keys without a search."""

    def __init__(self, chosen: np.ndarray):
        self.keys = np.sort(chosen.astype(U64))
        self.bitmap = np.zeros(1 << 18, bool)
        self.bitmap[(self.keys & U64((1 << 18) - 1)).astype(np.int64)] = True

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, column) pairs."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, owner = tokens(texts)
        maybe = np.flatnonzero(self.bitmap[(keys & U64((1 << 18) - 1)).astype(np.int64)])
        keys, owner = keys[maybe], owner[maybe]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        right = self.keys[at] == keys
        pairs = np.unique(owner[right] * len(self.keys) + at[right])
        return pairs // len(self.keys), pairs % len(self.keys)


class Linear:
    """Logistic regression on sparse 0/1 columns and a few dense ones, by Newton steps with conjugate gradients."""

    def __init__(self, sparse: int, dense: int, penalty: float = PENALTY):
        self.w, self.v, self.b, self.penalty = np.zeros(sparse), np.zeros(dense), 0.0, penalty

    def decide(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.w[columns], len(dense)) + dense @ self.v + self.b

    def fit(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, y: np.ndarray, start: Linear | None = None, steps: int = 12) -> Linear:
        """The optimum for y. The loss is convex, so where the steps start from changes their number and not the result."""
        n, p = len(y), len(self.w)
        if n == 0 or y.min() == y.max():
            share = np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4)
            self.b = float(np.log(share / (1 - share)))
            return self
        dense = np.column_stack([dense, np.ones(n)])
        ridge = np.r_[np.full(p, self.penalty), np.full(dense.shape[1] - 1, self.penalty), 1e-6]
        times = lambda x: np.bincount(rows, x[:p][columns], n) + dense @ x[p:]
        back = lambda e: np.r_[np.bincount(columns, e[rows], p), e @ dense]

        def loss(x: np.ndarray, z: np.ndarray) -> float:
            return float(np.logaddexp(0, np.where(y > 0, -z, z)).sum() + 0.5 * (ridge * x * x).sum())

        x = np.zeros(p + dense.shape[1]) if start is None else np.r_[start.w, start.v, start.b]
        z = times(x)
        for _ in range(steps):
            share = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            gradient = back(share - y) + ridge * x
            curve = np.maximum(share * (1 - share), 1e-6)
            scale = 1 / (np.r_[np.bincount(columns, curve[rows], p), curve @ dense**2] + ridge)
            step, rest = np.zeros_like(x), -gradient
            way = scale * rest
            power = rest @ way
            first = power
            for _ in range(30):
                bent = back(curve * times(way)) + ridge * way
                size = power / max(way @ bent, 1e-300)
                step += size * way
                rest -= size * bent
                turned = scale * rest
                power, old = rest @ turned, power
                if power < 1e-6 * first:
                    break
                way = turned + power / old * way
            now, length, move = loss(x, z), 1.0, times(step)
            while length > 1e-3 and loss(x + length * step, z + length * move) > now:
                length /= 2
            x, z = x + length * step, z + length * move
            if now - loss(x, z) < 1e-6 * abs(now):
                break
        self.w, self.v, self.b = x[:p], x[p:-1], float(x[-1])
        return self


class Chain:
    """Models in order. The dense columns of model k are the structure columns and the log-odds of models 0 to k-1."""

    def __init__(self, lookup: Lookup, centre: np.ndarray, spread: np.ndarray):
        self.lookup, self.centre, self.spread = lookup, centre, spread
        self.models: list[Linear] = []
        self.threshold = 0.5

    def dense(self, texts: pa.Array) -> np.ndarray:
        return self.scaled(features.structure(texts))

    def scaled(self, structure: np.ndarray) -> np.ndarray:
        return STRUCTURE_SCALE * np.clip((structure - self.centre) / self.spread, -4, 4)

    def train(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, targets: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Fits all models; returns the out-of-fold probabilities."""
        known, outside = dense, np.zeros(targets.shape)
        for k in range(targets.shape[1]):
            y = targets[:, k].astype(float)
            odds = np.zeros(len(y))
            whole = Linear(len(self.lookup.keys), known.shape[1]).fit(rows, columns, known, y)
            for f in range(FOLDS):
                out = fold == f
                inside = ~out[rows]
                index = np.cumsum(~out) - 1
                model = Linear(len(self.lookup.keys), known.shape[1]).fit(index[rows[inside]], columns[inside], known[~out], y[~out], whole)
                odds[out] = model.decide(rows, columns, known)[out]
            self.models.append(whole)
            outside[:, k] = 1 / (1 + np.exp(-odds))
            known = np.column_stack([known, np.clip(odds, -8, 8)])
        return outside

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probabilities of all categories for each text."""
        rows, columns = self.lookup.hits(texts)
        known, out = self.dense(texts), []
        for model in self.models:
            odds = model.decide(rows, columns, known)
            out.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            known = np.column_stack([known, np.clip(odds, -8, 8)])
        return np.stack(out, 1)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the thresholds with the best F1; 0.5 where one class is missing."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    high = p[order]
    low = np.append(high[1:], 0.0)
    good = np.flatnonzero((f1 >= f1.max() - 1e-9) & (high > low))
    k = good[np.argmax(high[good] - low[good])] if len(good) else int(f1.argmax())
    return float((high[k] + low[k]) / 2)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in words.slices(whole, "text"):
            keys, owner = tokens(words.texts_of(b, "text"))
            pairs = np.unique(np.stack([keys.view(np.int64), owner]), axis=1) if len(keys) else np.zeros((2, 0), np.int64)
            flags = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(2, b.num_columns)])
            key, at, n = np.unique(pairs[0], return_index=True, return_counts=True)
            sums = [np.add.reduceat(f[pairs[1]], at).astype(np.int64) if len(key) else key for f in flags]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), *map(pa.array, sums)], ["key", "n", *b.schema.names[2:]])


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most_labelled: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """The chain for the given categories (name to 0/1 column of labels), in their order."""
    space = Workspace(docs.sparkSession, "toxicity")
    names = list(categories)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = F.broadcast(features.labelled(labels, categories, most_labelled, docs=docs, by=names[-1]))  # most_labelled rows of a few numbers
    sample = docs.join(chosen, "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text"))
    sample = space.write(sample.select("doc_id", "text", *names), "sample")
    schema = "key long, n long, " + ", ".join(f"{name} long" for name in names)
    totals = sample.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names)).first()
    counts = sample.mapInArrow(_counted, schema).groupBy("key").agg(*(F.sum(c).cast("double").alias(c) for c in ("n", *names))).where(F.col("n") >= LEAST_DOCS)
    counts = space.write(counts, "counts")
    keys: set[int] = set()
    for name in names:
        n, y, all_n, all_y = F.col("n"), F.col(name), float(totals.n), float(totals[name])
        if 0 < all_y < all_n:
            expected = n * all_y / all_n
            chi = F.pow(y - expected, 2) / (expected * (1 - all_y / all_n) * (1 - n / (all_n + 1)))
            keys |= {r.key for r in counts.where(chi >= SIGNIFICANT).orderBy(chi.desc(), "key").select("key").limit(FEATURES).collect()}
    lookup = Lookup(np.array(sorted(keys), np.int64))

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.slices(whole, "text"):
                texts = words.texts_of(b, "text")
                rows, columns = lookup.hits(texts)
                edges = np.searchsorted(rows, np.arange(len(texts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(columns, pa.int32()))
                dense = pa.array(list(features.structure(texts)), pa.list_(pa.float64()))
                least = np.array([s[0] if len(s) else 0 for s in shingle_sets(texts)], U64)
                fold = pa.array((words.mix(least, 31) % U64(FOLDS)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, dense, fold, *b.columns[2:]], ["doc_id", "columns", "dense", "fold", *names])

    flags = ", ".join(f"{name} int" for name in names)
    kind = sample.schema["doc_id"].dataType.simpleString()
    data = sample.mapInArrow(matrix, f"doc_id {kind}, columns array<int>, dense array<double>, fold long, {flags}")
    data = data.orderBy("doc_id").toArrow()  # most_labelled rows
    dense = np.array(data["dense"].to_pylist(), float).reshape(-1, len(features.STRUCTURE))
    columns = data["columns"].combine_chunks()
    rows = np.repeat(np.arange(len(data)), np.asarray(columns.value_lengths(), np.int64)) if len(data) else np.zeros(0, np.int64)
    columns = np.asarray(columns.flatten(), np.int64)
    centre = dense.mean(0) if len(dense) else np.zeros(len(features.STRUCTURE))
    spread = np.maximum(dense.std(0), 1e-6) if len(dense) else np.ones(len(features.STRUCTURE))
    chain = Chain(lookup, centre, spread)
    targets = np.stack([np.asarray(data[name], np.int64) for name in names], 1)
    outside = chain.train(rows, columns, chain.scaled(dense), targets, np.asarray(data["fold"], np.int64))
    last = targets[:, -1]
    fewer = min(last.sum(), len(last) - last.sum())
    middle = (1 + last.mean()) / 2 if len(last) else 0.5
    chain.threshold = float((fewer * best_threshold(outside[:, -1], last) + PRIOR_LABELS * middle) / (fewer + PRIOR_LABELS))
    space.close()
    return chain


def score(docs: DataFrame, chain: Chain, names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a probability for each category, and `flagged`: the last category reaches the chain's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.slices(whole, "text"):
                texts = words.texts_of(b, "text")
                p = chain.score(texts)
                some = np.asarray(pa.compute.binary_length(texts), np.int64) > 0
                flagged = (p[:, -1] >= chain.threshold) & some
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.round(p[:, k], 9)) for k in range(len(names))), pa.array(flagged)], ["doc_id", *names, "flagged"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in names) + ", flagged boolean")


def categories() -> dict[str, Column]:
    return {name: make() for name, make in CATEGORIES.items()}


def toxic_documents(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, p_junk, p_toxic, toxic."""
    chain = fit(docs, labels, categories(), most_labelled)
    out = score(docs, chain, [f"p_{name}" for name in CATEGORIES])
    return out.withColumnRenamed("flagged", "toxic")


def without_toxic(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the chain does not reject."""
    chain = fit(docs, labels, categories(), most_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.slices(whole, text_col):
                texts = words.texts_of(b, text_col)
                some = np.asarray(pa.compute.binary_length(texts), np.int64) > 0
                yield b.filter(pa.array(~((chain.score(texts)[:, -1] >= chain.threshold) & some)))

    return docs.mapInArrow(run, docs.schema)
