"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashes of its words, word pairs and pairs with one word
between. Every coordinate has its own learning rate, and L1 keeps only the weights
that the labels bear out, so the model is a short list that every task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, bounded_batches, mix, word_hashes
from .language_id import folded

#: Training rows of each label at most; a documented bound of the fitted sample.
TRAIN_ROWS = 4000
#: FTRL-proximal: learning rate, its smoothing, L1 and L2, passes, and documents a feature must occur in.
ALPHA, BETA, L1, L2, PASSES, LEAST_DOCS = 2.0, 1.0, 12.0, 0.1, 8, 2
#: The most that one row of the rarer label weighs.
MOST_SHARE = 10.0
#: Odd multipliers that tell the kinds of features apart.
KINDS = [U64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def features(text: str | None) -> np.ndarray:
    """Hashes of the text's words, word pairs and skip pairs, with repeats."""
    h = word_hashes(folded(text).split())
    return np.concatenate([mix(h * KINDS[0]), mix(h[:-1] * KINDS[1] + h[1:] * KINDS[2]), mix(h[:-2] * KINDS[3] + h[2:] * KINDS[4])])


class Ftrl:
    """FTRL-proximal over dense coordinates; coordinate 0 is the intercept, free of L1."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == 0, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int, share: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * share
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes in order, their weights, and the intercept."""
    docs = [np.unique(features(t)) for t in texts]
    kinds, counts = np.unique(np.concatenate(docs) if docs else np.zeros(0, np.uint64), return_counts=True)
    kinds = kinds[counts >= LEAST_DOCS]
    places = []
    for d in docs:
        at = np.searchsorted(kinds, d)
        hit = at < len(kinds)
        hit[hit] = kinds[at[hit]] == d[hit]
        places.append(np.concatenate(([0], at[hit] + 1)))
    # both labels weigh the same in all, whichever is rarer
    n = np.bincount(labels, minlength=2) if labels else np.ones(2)
    share = np.clip(n.max() / np.maximum(n, 1), 1, MOST_SHARE)
    model, order = Ftrl(len(kinds) + 1), np.random.default_rng(0)
    for _ in range(PASSES):
        for i in order.permutation(len(docs)):
            model.learn(places[i], labels[i], share[labels[i]])
    w = model.weights(np.arange(len(kinds) + 1))
    return kinds[w[1:] != 0], w[1:][w[1:] != 0], float(w[0])


class Scorer:
    """Scores texts under trained weights."""

    def __init__(self, kinds: np.ndarray, weights: np.ndarray, intercept: float):
        self.kinds, self.weights, self.intercept = kinds, weights, intercept
        self.marked = np.zeros(1 << 20, bool)   # most features are ruled out by their first 20 bits
        self.marked[(kinds >> U64(44)).astype(np.int64)] = True

    def score(self, text: str | None) -> float:
        f = features(text)
        f = np.unique(f[self.marked[(f >> U64(44)).astype(np.int64)]])
        at = np.searchsorted(self.kinds, f)
        hit = at < len(self.kinds)
        hit[hit] = self.kinds[at[hit]] == f[hit]
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[at[hit]].sum(), -35, 35))))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learned from labelled documents, up to ``train_rows`` of each label in order of a hash of their ids.

    One task learns from that bounded sample; its non-zero weights come to the driver.
    Null labels and labels of unknown documents do not train; without any label the
    weights are empty and every score is one half.
    """
    bounded_batches(docs.sparkSession)
    ranked = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()
              .withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= train_rows).select("doc_id", "toxic"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")   # at most 2 * train_rows rows

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((int(d), int(y), t or "") for b in batches for d, y, t in zip(b["doc_id"], b["toxic"], b["text"]))
        kinds, weights, intercept = train([r[2] for r in rows], [r[1] for r in rows])
        yield pd.DataFrame({"kind": kinds.astype(np.int64), "weight": weights, "intercept": False})
        yield pd.DataFrame({"kind": [0], "weight": [intercept], "intercept": [True]})

    got = sample.repartition(1).mapInPandas(learn, "kind long, weight double, intercept boolean").collect()
    rows = sorted((np.uint64(r["kind"] & 0xFFFFFFFFFFFFFFFF), r["weight"]) for r in got if not r["intercept"])
    return (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.float64),
            sum(r["weight"] for r in got if r["intercept"]))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; null and empty texts have the intercept's score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*sent.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": [scorer.score(t) for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double")


def held_out():
    """Whether crc32(doc_id as text) mod 5 is 0; such labels never train."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, learned from the labels that are not held out.

    A null doc_id is not held out and cannot train; repeated rows are scored each; other columns are ignored.
    """
    model = fit(docs, labels.where(~held_out()), train_rows)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
