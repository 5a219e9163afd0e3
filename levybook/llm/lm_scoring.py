"""Language-model scores by deleted interpolation of word pairs.

Maximum-likelihood estimates of a word alone and after its predecessor are mixed with
a uniform share. How much the pair counts depends on how often the predecessor occurs
(buckets by powers of two); the weights are learned by expectation-maximisation on
counts from which each training document's own counts are taken out in turn.

Documents are dealt to buckets. A bucket asks for the counts of its distinct words and
pairs as sorted arrays of 64-bit hashes, one for each share of the hash range; a share
adds up what all buckets hold and answers each in the order it asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, mix, stored, word_hashes, words

#: Bytes of text in a bucket on average, and buckets to each share of the hash range.
BUCKET_BYTES, BUCKETS_A_SHARE = 6 << 20, 2
#: Hashes of the end of a text and of the place before its first word.
END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
#: Bins of an estimate in the learning table: eighths of a power of two; 0 stands for an estimate of zero.
BINS, FINENESS, ROUNDS = 256, 8, 100


class Grams:
    """Tokens of some texts: words and ends, their pairs, and the distinct ones of both."""

    def __init__(self, texts: list[str | None]):
        of = [words(t) for t in texts]
        self.sizes = np.array([len(ws) + 1 for ws in of], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        token = np.full(self.sizes.sum(), END)
        inner = np.ones(len(token), bool)
        inner[self.starts + self.sizes - 1] = False
        token[inner] = word_hashes([w for ws in of for w in ws])
        before = np.concatenate((np.array([BEGIN]), token[:-1]))
        before[self.starts] = BEGIN
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.distinct, self.at = [], []
        for keys in (token, mix(before * U64(0x9E3779B97F4A7C15) + token)):
            u, at = np.unique(keys, return_inverse=True)
            self.distinct.append(u)
            self.at.append(at)

    def own(self, n: int, total: np.ndarray, use: np.ndarray) -> np.ndarray:
        """How often each used token's word (n = 0) or pair (n = 1) occurs in its own text; once where it occurs once in all."""
        out = np.ones(len(total))
        many = np.flatnonzero(use & (total > 1))
        _, at, count = np.unique(self.doc[many] * (len(self.distinct[n]) + 1) + self.at[n][many], return_inverse=True, return_counts=True)
        out[many] = count[at]
        return out

    def after(self, values: np.ndarray, first: float) -> np.ndarray:
        """Each token's predecessor's value; ``first`` at the start of a text."""
        out = np.concatenate((np.zeros(1, values.dtype), values[:-1]))
        out[self.starts] = first
        return out


def asked(bucket: int, g: Grams, train: np.ndarray, shares: int) -> pd.DataFrame:
    """One row a share and kind: the bucket's distinct hashes in that range, and their counts in its training texts."""
    rows = []
    weight = np.repeat(train, g.sizes)
    for n in (0, 1):
        counts = np.bincount(g.at[n], weight, len(g.distinct[n])).astype("<u8")
        share = ((g.distinct[n] >> U64(32)) * U64(shares) >> U64(32)).astype(np.int64)
        cuts = np.searchsorted(share, np.arange(shares + 1))
        rows += [(n, s, bucket, g.distinct[n][a:b].astype("<u8").tobytes(), packed(counts[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    return pd.DataFrame(rows, columns=["kind", "share", "bucket", "keys", "counts"])


def answered(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of one share of one kind, for each bucket in the order of its hashes; the first row also counts the kinds seen."""
    keys = [np.frombuffer(k, "<u8") for k in rows["keys"]]
    counts = np.concatenate([unpacked(c) for c in rows["counts"]])
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, counts)
    cuts = np.cumsum([0, *map(len, keys)])
    mine = total[at].astype("<u8")
    first = [True] + [False] * (len(keys) - 1)
    return pd.DataFrame({"bucket": rows["bucket"], "kind": rows["kind"], "share": rows["share"], "totals": [packed(mine[a:b]) for a, b in zip(cuts, cuts[1:])],
                         "kinds": [int((total > 0).sum()) if f else 0 for f in first], "seen": [int(total.sum()) if f else 0 for f in first]})


def packed(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold the largest; the first byte tells how many."""
    for size in (1, 2, 4, 8):
        if size == 8 or not len(counts) or counts.max() < 1 << 8 * size:
            return bytes([size]) + counts.astype(f"<u{size}").tobytes()
    raise AssertionError


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", -1, 1).astype(np.float64)


def totals(answers: pd.DataFrame) -> list[np.ndarray]:
    """Counts of a bucket's distinct words and pairs, in the order of their hashes."""
    out = []
    for n in (0, 1):
        own = answers[answers["kind"] == n].sort_values("share")
        out.append(np.concatenate([unpacked(d) for d in own["totals"]]) if len(own) else np.zeros(0))
    return out


def level(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 for none, then by powers of two."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(1 + np.round(-np.log2(np.where(p > 0, p, 1)) * FINENESS), BINS - 1), 0).astype(np.int64)


def estimates(bins: np.ndarray) -> np.ndarray:
    return np.where(bins > 0, np.exp2(-(bins - 1) / FINENESS), 0.0)


def weights(table: list[tuple[int, int, int, int]], kinds: int) -> tuple[float, dict[int, float]]:
    """Weight of the word's own estimate against the uniform share, and by bucket that of the pair's, learned by EM."""
    if not table:
        return 0.0, {}
    lev, pair, word, n = (np.array(c, np.int64) for c in zip(*table))
    p2, p1, p0 = estimates(pair), estimates(word), 1 / (kinds + 1)

    def em(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> float:
        w = 0.5
        for _ in range(ROUNDS):
            w = min(max(float((n * (w * high / (w * high + (1 - w) * low))).sum() / n.sum()), 0.0), 1 - 1e-6)
        return w

    one = em(p1, np.full(len(p1), p0), n)
    low = one * p1 + (1 - one) * p0
    return one, {int(k): em(p2[lev == k], low[lev == k], n[lev == k]) for k in np.unique(lev) if k}


def lm_scores(docs: DataFrame, train=None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is the column that tells which rows are learned from; by default those
    whose crc32(doc_id as text) mod 7 is not 2. Null and empty texts are their end
    alone. A null doc_id trains by default; repeated rows count and are scored each;
    other columns are ignored. Nothing to learn from leaves every score at the uniform
    share of a single kind.
    """
    bounded_batches(docs.sparkSession)
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True)) if train is None else train
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), train.alias("train"))
    facts = rows.agg(F.sum(F.octet_length("text") + F.lit(1)).cast("long").alias("bytes"), F.sum(F.col("train").cast("long")).alias("docs")).first()
    buckets = int((facts["bytes"] or 0) // BUCKET_BYTES) + 1
    shares, train_docs = buckets // BUCKETS_A_SHARE + 1, facts["docs"] or 0
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))

    def ask(b: pd.DataFrame) -> pd.DataFrame:
        return asked(int(b["bucket"].iloc[0]), Grams(b["text"].tolist()), b["train"].to_numpy(bool), shares)

    requests = dealt.groupBy("bucket").applyInPandas(ask, "kind long, share long, bucket long, keys binary, counts binary")
    answers = stored(requests.groupBy("kind", "share").applyInPandas(answered, "bucket long, kind long, share long, totals binary, kinds long, seen long"), "gram-counts")
    known = answers.where("kind = 0").agg(F.sum("seen").alias("seen"), F.sum("kinds").alias("kinds")).first()
    tokens, kinds = known["seen"] or 0, known["kinds"] or 0
    together = dealt.groupBy("bucket").cogroup(answers.drop("kinds", "seen").groupBy("bucket"))

    def learn(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        g, (c1, c2) = Grams(b["text"].tolist()), totals(a)
        use = np.repeat(b["train"].to_numpy(bool), g.sizes)
        word, pair = c1[g.at[0]], c2[g.at[1]]
        word_left = word - g.own(0, word, use)
        context = g.after(word_left, max(train_docs - 1, 0))
        p2 = (pair - g.own(1, pair, use)) / np.maximum(context, 1)
        p1 = word_left / np.maximum(tokens - np.repeat(g.sizes, g.sizes), 1)
        code, n = np.unique(((level(context) * BINS + quantised(p2)) * BINS + quantised(p1))[use], return_counts=True)
        return pd.DataFrame({"level": code // (BINS * BINS), "pair": code // BINS % BINS, "word": code % BINS, "n": n})

    # at most 64 * BINS * BINS rows, whatever the input
    table = together.applyInPandas(learn, "level long, pair long, word long, n long").groupBy("level", "pair", "word").agg(F.sum("n").alias("n")).collect()
    one, by_level = weights([tuple(r) for r in table], kinds)
    pair_weight = np.array([0.0] + [by_level.get(k, by_level.get(max((j for j in by_level if j < k), default=0), 0.0)) for k in range(1, 66)])

    def score(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        g, (c1, c2) = Grams(b["text"].tolist()), totals(a)
        word = c1[g.at[0]]
        context = g.after(word, train_docs)
        w = pair_weight[np.minimum(level(context), 65)]
        p = w * c2[g.at[1]] / np.maximum(context, 1) + (1 - w) * (one * word / max(tokens, 1) + (1 - one) / (kinds + 1))
        base = np.log10((word + 1) / (tokens + kinds + 1))

        def by_text(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, g.starts) if len(x) else x
        return pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": ~b["train"].to_numpy(bool), "n_tokens": g.sizes, "n_known": by_text((word > 0).astype(np.int64)),
                             "train_tokens": tokens, "base_score": by_text(base), "score": by_text(np.log10(p))})

    return together.applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
