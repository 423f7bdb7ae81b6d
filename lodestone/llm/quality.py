"""Quality by a factorisation machine over hashed words, structure statistics and metadata computed from the text.

The score of a document with features x is

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

so all pairwise interactions of rank `RANK` cost time linear in the number of features (the sum-of-squares identity).
Word features are log(1 + count) of words hashed into `BUCKETS` places, scaled to unit length for each document;
structure features are standardised shares and lengths. Labels, lang, source and doc_id are never inputs of a score.

The model is fitted on at most `most_labelled` labelled documents (a documented bound), none of which is held out: ids
whose crc32 leaves 0 modulo 5 never reach the fit. Scores are calibrated by the fit's own logistic link, and all
documents are scored on their whole text.

A null text counts as empty and is scored like an empty one, from its structure alone; a very long text is read whole, in
a part of its own. Repeated rows get equal scores; of rows that share an id and differ in text the smallest text is learnt
from; ties at the bound of the sample go to smaller ids; repeated labels are averaged; without both labels in the sample, scores give their share. An empty table gives an empty
result; further columns are ignored. A row without an id is scored and is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import features, words
from lodestone.llm.tables import Workspace
from lodestone.llm.words import U64

BUCKETS, RANK, MOST_LABELLED, THRESHOLD = 1 << 16, 8, 8_000, 0.3


class Rows:
    """Sparse rows: indices and values, and where each row begins."""

    def __init__(self, index: np.ndarray, value: np.ndarray, begin: np.ndarray):
        self.index, self.value, self.begin = index, value, begin

    def __len__(self) -> int:
        return len(self.begin) - 1

    def take(self, rows: np.ndarray) -> Rows:
        counts = np.diff(self.begin)[rows]
        begin = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(begin[-1]) - np.repeat(begin[:-1], counts) + np.repeat(self.begin[rows], counts)
        return Rows(self.index[at], self.value[at], begin)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.begin))


def word_rows(texts: pa.Array) -> Rows:
    """Hashed words of each text with log counts of unit length."""
    hashes, first, _, _ = words.hashed_words(texts)
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    keys, counts = np.unique(owner * BUCKETS + (hashes >> U64(48)).astype(np.int64) % BUCKETS, return_counts=True)
    owner, value = keys // BUCKETS, np.log1p(counts)
    length = np.sqrt(np.bincount(owner, value**2, n))
    return Rows(keys % BUCKETS, value / np.maximum(length[owner], 1e-12), np.searchsorted(owner, np.arange(n + 1)))


class Machine:
    """A factorisation machine on BUCKETS sparse columns and the dense structure columns."""

    def __init__(self, dense: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(BUCKETS)
        self.v = rng.normal(0, 0.02, (BUCKETS, RANK))
        self.wd, self.vd = np.zeros(dense), rng.normal(0, 0.02, (dense, RANK))

    def parts(self, x: Rows, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and sum_i v_if x_i of each row."""
        n, owner = len(x), x.owner()
        vx = self.v[x.index] * x.value[:, None]
        total = np.stack([np.bincount(owner, vx[:, f], n) for f in range(RANK)], 1) + dense @ self.vd
        squares = np.bincount(owner, (vx**2).sum(1), n) + (dense**2) @ (self.vd**2).sum(1)
        linear = self.w0 + np.bincount(owner, self.w[x.index] * x.value, n) + dense @ self.wd
        return linear + 0.5 * ((total**2).sum(1) - squares), total

    def fit(self, x: Rows, dense: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 200, rate: float = 0.1, penalty: float = 2e-4, seed: int = 9) -> Machine:
        """AdaGrad on the logistic loss. With one class only, the score is its smoothed share."""
        if not len(y) or y.min() == y.max():
            p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
            self.w0 = float(np.log(p / (1 - p)))
            self.v[:], self.vd[:] = 0, 0
            return self
        rng = np.random.default_rng(seed)
        self.w0 = float(np.log(y.mean() / (1 - y.mean())))
        seen = {k: np.full(np.shape(getattr(self, k)), 1e-2) for k in ("w", "v", "wd", "vd")}
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                part, d = x.take(rows), dense[rows]
                z, total = self.parts(part, d)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                owner = part.owner()
                ev = error[owner] * part.value
                columns, back = np.unique(part.index, return_inverse=True)
                gv = ev[:, None] * (total[owner] - self.v[part.index] * part.value[:, None])
                grads = {
                    "w": np.bincount(back, ev, len(columns)) + penalty * self.w[columns] / epochs,
                    "v": np.stack([np.bincount(back, gv[:, f], len(columns)) for f in range(RANK)], 1) + penalty * self.v[columns],
                    "wd": error @ d + penalty * self.wd,
                    "vd": d.T @ (error[:, None] * total) - self.vd * (error @ d**2)[:, None] + penalty * self.vd,
                }
                for k, g in grads.items():
                    at = columns if k in ("w", "v") else slice(None)
                    seen[k][at] += g**2 * len(rows)
                    getattr(self, k)[at] -= rate * g / np.sqrt(seen[k][at] / len(rows) + 1e-8) / (1 + epoch / 4)
                self.w0 -= 0.05 * error.sum()
        return self


class Scorer:
    def __init__(self, machine: Machine, centre: np.ndarray, spread: np.ndarray):
        # Single precision halves what is sent to each task; the score is rounded well above its error.
        self.machine, self.centre, self.spread = machine, centre, spread
        machine.v, machine.w = machine.v.astype(np.float32), machine.w.astype(np.float32)

    def dense(self, texts: pa.Array) -> np.ndarray:
        return np.clip((features.structure(texts) - self.centre) / self.spread, -4, 4)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        z, _ = self.machine.parts(word_rows(texts), self.dense(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """A scorer fitted on labelled documents outside the held-out fifth; labels of documents that are not at hand do not count."""
    space = Workspace(docs.sparkSession, "quality")
    own = docs.select(F.col(id_col).alias("doc_id"))
    chosen = F.broadcast(features.labelled(labels, {"quality": F.col("quality")}, most_labelled, train_only=True, docs=own))  # most_labelled rows of two numbers
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.slices(whole, "text"):
                texts = words.texts_of(b, "text")
                x = word_rows(texts)
                begin = pa.array(x.begin, pa.int32())
                dense = pa.array(list(features.structure(texts)), pa.list_(pa.float64()))
                index = pa.ListArray.from_arrays(begin, pa.array(x.index, pa.int32()))
                value = pa.ListArray.from_arrays(begin, pa.array(x.value, pa.float32()))
                yield pa.RecordBatch.from_arrays([b.column(0), index, value, dense, b.column(2)], ["doc_id", "index", "value", "dense", "quality"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    data = space.write(sample.select("doc_id", "text", "quality").mapInArrow(rows, f"doc_id {kind}, index array<int>, value array<float>, dense array<double>, quality int"), "sample")
    data = data.orderBy("doc_id").toArrow()  # most_labelled rows
    space.close()
    dense = np.array(data["dense"].to_pylist(), float).reshape(-1, len(features.STRUCTURE))
    lists = data["index"].combine_chunks()
    begin = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))]).astype(np.int64)
    x = Rows(np.asarray(lists.flatten(), np.int64), np.asarray(data["value"].combine_chunks().flatten(), float), begin)
    centre = dense.mean(0) if len(dense) else np.zeros(len(features.STRUCTURE))
    spread = np.maximum(dense.std(0), 1e-6) if len(dense) else np.ones(len(features.STRUCTURE))
    scaled = np.clip((dense - centre) / spread, -4, 4)
    return Scorer(Machine(len(features.STRUCTURE)).fit(x, scaled, np.asarray(data["quality"], float)), centre, spread)


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in words.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(scorer(words.texts_of(b, "text")), 9))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", features.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
