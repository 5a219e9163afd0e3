"""Language identification by prediction by partial matching (PPM).

Per language a tree of byte contexts up to ``ORDER`` bytes is counted. The statistics
are frozen: the probability of every byte after every context, escapes included, is
written into one table, so a text's exact code length is a walk down the tree and one
look-up a byte, for all bytes of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, lean

#: Longest context in bytes.
ORDER = 3
#: Training documents of each language at most; a documented bound of the fitted sample.
TRAIN_DOCS = 500
#: A-Z become a-z; control characters, digits and ASCII punctuation become spaces.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32) for c in range(256))


def folded(text: str | None) -> bytes:
    """The text's bytes with letters lower-cased and runs of anything that is no letter as one space."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()) if text else b""


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def gram_counts(docs: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(lang, gram, n) over the training sample; a gram holds the last byte and up to ``order`` bytes before it.

    The sample takes up to ``train_docs`` documents a language in order of a hash of
    their ids, then of their texts; a row that is repeated whole trains once. Rows
    without lang or text do not train. Hashes alone are ranked: a language's last place
    in the sample is one row, fewer than the model that follows from them, and texts are
    read again up to it.
    """
    place = [F.xxhash64("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_text")]
    able = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND length(text) > 0").select("lang", *place, "text")
    ranked = Window.partitionBy("lang").orderBy("_id", "_text")
    last = (able.select("lang", "_id", "_text").distinct().withColumn("_nth", F.row_number().over(ranked)).where(F.col("_nth") <= train_docs)
            .groupBy("lang").agg(F.max(F.struct("_id", "_text")).alias("_last")))
    sample = (able.join(F.broadcast(last), "lang").where(F.struct("_id", "_text") <= F.col("_last"))
              .dropDuplicates(["lang", "_id", "_text"]).select("lang", "text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, group in b.groupby("lang"):
                grams = []
                for t in group["text"]:
                    x = np.frombuffer(b" " * order + folded(t) + b" ", np.uint8).astype(np.uint64)
                    g = np.zeros(len(x) - order, np.uint64)
                    for k in range(order + 1):
                        g = g << np.uint64(8) | x[k:len(x) - order + k]
                    grams.append(g)
                u, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": u.astype(np.int64), "n": n})

    return sample.mapInPandas(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTree:
    """One language's frozen PPM statistics as arrays: ``child`` steps to a longer context, ``bits`` holds code lengths."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, code: np.ndarray, symbols: int, order: int):
        # level k: contexts of k bytes, the byte next to the coded one first
        last = code[(grams & np.uint64(255)).astype(np.int64)]
        before = [code[(grams >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)] for k in range(1, order + 1)]
        node = np.zeros(len(grams), np.int64)
        parents, steps, tables = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        size, bases = 1, [0]

        def frozen(ids: np.ndarray, n_nodes: int, shorter: np.ndarray) -> np.ndarray:
            """Method C: seen bytes share n of n + d parts, the escape to the shorter context has d."""
            c = np.bincount(ids * symbols + last, counts, n_nodes * symbols).reshape(n_nodes, symbols)
            n, d = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            return np.where(c > 0, c / (n + d), d / (n + d) * shorter)

        tables.append(frozen(node, 1, np.full((1, symbols), 1 / 256)))
        edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(order):
            keys, inner = np.unique(node * symbols + before[k], return_inverse=True)
            up, step = keys // symbols, keys % symbols
            edges.append((up + bases[-1], step, np.arange(len(keys)) + size))
            tables.append(frozen(inner, len(keys), tables[-1][up]))
            bases.append(size)
            size += len(keys)
            node = inner
        del parents, steps
        table = np.concatenate(tables)
        self.symbols, self.order = symbols, order
        # a context that the tree lacks ends the walk: it steps to a twin that stays where it is; the longest
        # contexts, most of the tree, are reached by the last step only and have neither a twin nor children
        inner = bases[order]
        child = np.repeat(np.concatenate([np.arange(inner, dtype=np.int32) + inner] * 2), symbols).reshape(2 * inner, symbols)
        for up, step, to in edges:
            child[up, step] = np.where(to < inner, to, to + inner)
        self.child = (child * symbols).astype(np.int32).ravel()
        bits = -np.log2(table).astype(np.float32)
        self.bits = np.concatenate([bits[:inner], bits]).ravel()

    def lengths(self, x: np.ndarray) -> np.ndarray:
        """Bits of each byte from the ``order``-th on."""
        n = len(x) - self.order
        node = np.zeros(n, np.int32)
        for k in range(1, self.order + 1):
            node = self.child[node + x[self.order - k:self.order - k + n]]
        return self.bits[node + x[self.order:]]


class Languages:
    """The context trees of all languages."""

    def __init__(self, rows: list[tuple[str, int, int]], order: int = ORDER):
        self.order, self.names, self.trees = order, sorted({r[0] for r in rows}), []
        grams = np.array([r[1] for r in rows], np.int64).astype(np.uint64)
        counts, langs = np.array([r[2] for r in rows], np.int64), np.array([self.names.index(r[0]) for r in rows], np.int64)
        seen = np.unique((grams & np.uint64(255)).astype(np.int64)) if len(rows) else np.zeros(0, np.int64)
        self.code = np.full(256, len(seen), np.int32)   # bytes never seen share one symbol
        self.code[seen] = np.arange(len(seen))
        for k in range(len(self.names)):
            own = langs == k
            self.trees.append(ContextTree(grams[own], counts[own], self.code, len(seen) + 1, order))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language of least code length and its share of the posterior; ``und`` and 0 without a letter or a model."""
        pad = b" " * self.order
        folds = [folded(t) if has_letter(t) else b"" for t in texts]
        pred, score, group, size = ["und"] * len(texts), [0.0] * len(texts), [], 0
        for i, f in enumerate(folds):
            if f and self.names:
                group.append(i)
                size += len(f)
            if group and (size > 1 << 19 or i + 1 == len(folds)):
                x = self.code[np.frombuffer(b"".join(pad + folds[j] + b" " for j in group), np.uint8)]
                lens = np.array([len(folds[j]) + 1 for j in group])
                begins = np.concatenate(([0], np.cumsum(lens + self.order)[:-1]))
                cuts = np.stack([begins, begins + lens], 1).ravel()   # the bits of the next text's pad are left out
                total = np.stack([np.add.reduceat(np.append(t.lengths(x), np.zeros(self.order + 1, np.float32)).astype(np.float64), cuts)[::2] for t in self.trees])
                best = total.argmin(0)
                share = 1 / np.exp2(-np.minimum(total - total.min(0), 1000)).sum(0)
                for j, k, s in zip(group, best, share):
                    pred[j], score[j] = self.names[k], float(s)
                group, size = [], 0
        return pred, score


def fit(docs: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS) -> Languages:
    """Languages learned from labelled documents; what comes to the driver is bounded by the sample."""
    bounded_batches(docs.sparkSession)
    return Languages([(r["lang"], r["gram"], r["n"]) for r in gram_counts(docs, order, train_docs).collect()], order)


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """``docs`` with lang_pred and score; null texts and texts without a letter are ``und`` with score 0.

    All columns and rows are kept; columns named lang_pred or score are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    found = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    @F.pandas_udf(found)
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            pred, score = sent.value.predict(t.tolist())
            yield pd.DataFrame({"lang_pred": pred, "score": score})
        give_back()

    return kept.withColumn("_guess", guess("text")).select(*kept.columns, "_guess.lang_pred", "_guess.score")


def held_out():
    """Whether crc32(doc_id as text) mod 4 is 2; such documents never train."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify_all(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, learned from the documents that are not held out.

    A null doc_id is not held out; repeated rows are predicted each; other columns are ignored.
    """
    model = fit(docs.where(~held_out()), train_docs=train_docs)
    return identify(docs.select("doc_id", "text"), model).select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "lang_pred", "score")
