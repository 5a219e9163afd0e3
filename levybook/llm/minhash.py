"""Near-duplicate documents by fast similarity sketching.

Every set of word shingles gets a sketch of ``BINS`` bins. In each round all elements
are hashed to a bin and a value; a bin keeps the least value of the first round that
reaches it, and a second phase gives every bin a round of its own, so that no bin
stays empty and agreement is concentrated around the similarity. Bands of the sketch
propose pairs, whose full shingle sets are then compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Marks, bounded_batches, dropped, lean, mix, stored, word_hashes, words
from .components import components

#: Bins of a sketch and bins of a band: a pair at similarity 0.85 shares no band with probability 7e-9.
BINS, ROWS = 160, 5
#: Standard errors below the threshold at which a pair's sketches still count as similar.
SLACK = 6.0
#: Members of one block of a bucket.
BLOCK = 200
SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
FRACTION = U64((1 << 40) - 1)


def shingle_hashes(ws: list[bytes], size: int) -> np.ndarray:
    """Distinct hashes of runs of ``size`` words; the whole sequence where there are fewer, none without words."""
    h = word_hashes(ws)
    if not len(h):
        return h
    if len(h) < size:
        return mix(np.array([h @ (SEEDS[:len(h)] | U64(1)) + U64(len(h))], np.uint64))
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += h[k:k + n] * (SEEDS[k] | U64(1))
    return np.unique(mix(total))


def sketch(s: np.ndarray) -> np.ndarray:
    """One value a bin; two sets agree in a bin with the probability of their Jaccard similarity."""
    out = np.zeros(BINS, np.uint64)
    empty = np.ones(BINS, bool)
    step = max(1, 2048 // len(s))
    for low in range(0, BINS, step):
        rounds = np.arange(low, min(BINS, low + step))
        h = mix(s[None, :] ^ SEEDS[rounds][:, None])
        bins = ((h >> U64(40)) * U64(BINS) >> U64(24)).astype(np.int64).ravel()
        value = ((rounds.astype(np.uint64) + U64(1))[:, None] << U64(40) | h & FRACTION).ravel()
        free = empty[bins]
        bins, value = bins[free], value[free]
        falling = np.argsort(value)[::-1]   # the least value is written last
        out[bins[falling]] = value[falling]
        empty[bins] = False
        if not empty.any():
            return out
    for b in np.flatnonzero(empty):
        out[b] = U64(BINS + int(b) + 1) << U64(40) | np.min(mix(s ^ SEEDS[BINS + b]) & FRACTION)
    return out


def band_keys(sk: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    rows = sk[:BINS // ROWS * ROWS].reshape(-1, ROWS)
    key = SEEDS[:len(rows)].copy()
    for k in range(ROWS):
        key = mix(key + rows[:, k])
    return key


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, same, bins, bands): ``same`` is equal for equal sets, ``bins`` the sketch in two bytes a bin."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                s = shingle_hashes(words(t), size)
                if len(s):
                    sk = sketch(s)
                    same = np.array([np.bitwise_xor.reduce(mix(s + SEEDS[0])), mix(s ^ SEEDS[1]).sum(dtype=np.uint64)], np.uint64).tobytes()
                    rows.append((len(s), same, (mix(sk) >> U64(48)).astype("<u2").tobytes(), band_keys(sk).astype(np.int64)))
                else:
                    rows.append((0, None, None, None))
            yield pd.DataFrame(rows, columns=["n_shingles", "same", "bins", "bands"]).assign(doc_id=b["doc_id"].astype("Int64").array)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(lean(run), "n_shingles long, same binary, bins binary, bands array<long>, doc_id long")


def likely(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the threshold."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("bins").alias("sa"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("bins").alias("sb"))
    least = agreement(threshold)

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p, q = (np.frombuffer(b"".join(b[c]), "<u2").reshape(len(b), BINS) for c in ("sa", "sb"))
                yield b.loc[(p == q).sum(1) >= least, ["a", "b"]]

    fits = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold) - F.lit(1e-6)
    return pairs.join(x, "a").join(y, "b").where(fits).select("a", "b", "sa", "sb").mapInPandas(lean(agree), "a long, b long")


def agreement(threshold: float) -> int:
    """Bins in which a pair at the threshold agrees, less the slack."""
    return int(BINS * threshold - SLACK * (BINS * threshold * (1 - threshold)) ** 0.5)


def shingle_set(text: str, size: int) -> frozenset:
    ws = words(text)
    return frozenset(zip(*(ws[k:] for k in range(size)))) if len(ws) >= size else frozenset([tuple(ws)])


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ``ids``; other texts do not travel."""
    return Marks(ids, ["doc_id"]).semi(docs.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL"), ids)


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents whose full shingle sets meet the threshold, compared word by word."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = stored(texts_of(docs, ids), "pair-texts")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent = lru_cache(maxsize=16)(shingle_set)   # a head meets many; it ends with the task
        for b in batches:
            def linked(p: str, q: str) -> bool:
                s, t = recent(p, size), recent(q, size)
                both = len(s & t)
                return 100 * both >= percent * (len(s) + len(t) - both)
            yield b.loc[[linked(p, q) for p, q in zip(b["ta"], b["tb"])], ["a", "b"]]

    with_texts = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
                  .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"))
    out = stored(with_texts.mapInPandas(lean(compare), "a long, b long").distinct(), "confirmed")
    dropped(texts)
    return out


def set_rows(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles): the sorted shingle hashes of the documents in ``ids``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "shingles": [shingle_hashes(words(t), size).tobytes() for t in b["text"]]})
    return texts_of(docs, ids).mapInPandas(lean(run), "doc_id long, shingles binary")


def bridges(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components in buckets whose members are in several, found block against block.

    ``members`` has key, doc_id, component, n_shingles, bins, bands and shingles. A bucket's
    largest component is not compared within itself: its other members meet one another
    and that component. Both sides are cut into blocks of about ``BLOCK`` members, and two
    blocks meet in one task. A pair is looked at in the first band it shares, and only
    while its components are apart in that task.
    """
    of = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"))
    j = members.join(of, "key")
    own, other = F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK), F.ceil(F.col("n_main") / BLOCK)
    j = j.withColumn("own", own).withColumn("all", own + other).withColumn("block", F.when(
        F.col("component") == F.col("main"), own + F.pmod(F.xxhash64("doc_id"), other)).otherwise(F.pmod(F.xxhash64("doc_id"), own)))
    partner = F.when(F.col("block") < F.col("own"), F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("own") - 1))
    placed = (j.withColumn("partner", F.explode(partner)).withColumn("low", F.least("block", "partner")).withColumn("high", F.greatest("block", "partner"))
              .select("key", "low", "high", "block", "doc_id", "component", "n_shingles", "bins", "bands", "shingles"))
    threshold = percent / 100
    least = agreement(threshold)

    def links_of(g: pd.DataFrame) -> pd.DataFrame:
        bands = np.stack(g["bands"].to_numpy())
        here = bands == g["key"].iloc[0]
        band = int(here.any(0).argmax())
        g, bands = g[here[:, band]], bands[here[:, band]]   # a repeated doc_id also brings its other texts
        sk = np.frombuffer(b"".join(g["bins"]), "<u2").reshape(len(g), BINS)
        sets = [np.frombuffer(x, "<u8") for x in g["shingles"]]
        ids, size, block = (g[c].to_numpy() for c in ("doc_id", "n_shingles", "block"))
        comp, alone, out = g["component"].to_numpy().copy(), bool((block == block[0]).all()), []
        for i in np.flatnonzero(block == block.min()):
            j = np.arange(i + 1, len(g)) if alone else np.flatnonzero(block != block[i])
            j = j[(comp[j] != comp[i]) & (np.minimum(size[j], size[i]) >= np.maximum(size[j], size[i]) * threshold - 1e-6)]
            j = j[(bands[j] == bands[i]).argmax(1) == band]
            agree = (sk[j] == sk[i]).sum(1)
            for k in j[np.argsort(-agree)][:int((agree >= least).sum())]:
                if comp[k] != comp[i]:
                    both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[k]) - both):
                        out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                        comp[comp == comp[k]] = comp[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None   # rows come sorted, so only the last group may go on in the next batch
        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if len(rest):
                mark = rest[["key", "low", "high"]].ne(rest[["key", "low", "high"]].shift()).any(axis=1).cumsum()
                for g, part in rest.groupby(mark, sort=False):
                    if g != mark.iloc[-1]:
                        yield links_of(part)
                rest = rest[mark == mark.iloc[-1]]
        if rest is not None and len(rest):
            yield links_of(rest)

    return (placed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
            .mapInPandas(lean(run), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of
    ``size``-word shingles; component_id is the smallest doc_id that is reachable. Null
    texts and texts without words have no shingles and no links. A null doc_id has a
    null component and is kept. Rows that repeat a doc_id are one document with several
    texts: linked with whatever one of them is linked with, and returned each. Other
    columns are ignored.

    Equal sets are one representative. In every bucket all members are compared with the
    one that shares most buckets in all, which in a group of edited copies is the text
    they were made from. Where the links leave a bucket in several components, these are
    compared block against block until joined, so no link between components is lost.
    """
    spark, threshold = docs.sparkSession, percent / 100
    bounded_batches(spark)
    all_sets = stored(sketches(docs, size), "sketches")
    known = all_sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = stored(known.groupBy("same").agg(F.min("doc_id").alias("rep")), "same-sets")
    sets = stored(known.join(same.withColumnRenamed("rep", "doc_id"), ["same", "doc_id"], "left_semi").dropDuplicates(["same", "doc_id"]), "distinct-sets")
    keyed = sets.select("doc_id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    members = stored(keyed.join(shared, "key"), "buckets")
    degree = members.groupBy("doc_id").agg(F.sum("count").alias("degree"))
    heads = members.join(degree, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("degree", -F.col("doc_id"))).alias("head"))
    pair = [F.least("head", "doc_id").alias("a"), F.greatest("head", "doc_id").alias("b")]
    near = likely(members.join(heads, "key").where("doc_id <> head").select(*pair).distinct(), sets, threshold)
    near = stored(near, "near-pairs")
    links = verified(near, docs, size, percent)

    def labelled(df: DataFrame, labels: DataFrame, at: str) -> DataFrame:
        return df.join(labels.withColumnRenamed("node", at), at, "left").withColumn("component", F.coalesce("component", at))

    parts = labelled(members.where("count > 2"), components(links), "doc_id")
    apart = parts.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rest = stored(parts.join(apart, "key", "left_semi").select("key", "doc_id", "component"), "open-buckets")
    dropped(members, near)
    open_ids = stored(rest.select("doc_id").distinct(), "open-ids")
    whole = Marks(open_ids, ["doc_id"]).semi(sets.select("doc_id", "n_shingles", "bins", "bands"), open_ids).join(set_rows(docs, open_ids, size), "doc_id")
    whole = stored(whole, "open-sets")
    joined = stored(bridges(rest.join(whole, "doc_id"), percent), "bridges")
    dropped(rest, whole, open_ids, sets)
    further = verified(joined, docs, size, percent)
    # rows that repeat a doc_id tie their sets together
    repeated = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    ties = known.join(repeated, "doc_id", "left_semi").join(same, "same").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(links.unionAll(further).unionAll(ties))
    rows = labelled(all_sets.select("doc_id", "n_shingles", "same").join(same, "same", "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))), final, "rep")
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


#: The same rows in DuckDB, for small tables: every two documents that share a shingle are compared.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM g),
e AS (SELECT doc_id, unnest(s) AS sh FROM g),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n_shingles + nb.n_shingles - i)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT sym.b, reach.root FROM reach JOIN sym ON sym.a = reach.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1)
SELECT n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)"""
