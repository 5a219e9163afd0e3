"""Phrases whose words belong together, mined with mergeable Misra-Gries summaries.

Every n-gram has a 64-bit hash, and every range of hashes a summary whose capacity
exceeds its mass divided by the threshold, so no frequent n-gram can leave it. A first
scan summarises words and pairs, a second one longer n-grams made of surviving pairs;
survivors are marked in a bitmap of fixed size. The last scan counts what is marked,
by text, and only true counts decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, bits_for, bounded_batches, lean, mix, stored

#: Bytes of text that are hashed at once; a longer piece is hashed whole.
WINDOW = 1 << 20
#: Hashes that a task gathers before it deals them out, and strings that it counts before it sends them.
GATHERED, STRINGS = 1_000_000, 100_000
#: Bytes of text for every range of hashes.
RANGE_BYTES = 32 << 20
#: Bits of the bitmap of survivors at most; more survivors than it can tell apart only let more n-grams through to the exact count.
MOST_BITS = 1 << 26
BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
ODD = mix(np.arange(1, 17, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)

# Bytes of a text: A-Z lower-cased, what ends a piece as a line feed, what parts words as a space.
_TABLE = bytearray(range(256))
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 10
_TABLE[9] = 32
TABLE = bytes(_TABLE)


class Powers:
    """Powers of both bases and of their inverses, as far as the longest window of this task needs them."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def of(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.held or len(self.held[0][0]) < n:
            self.held = []
            for base in BASES:
                pair = []
                for b in (base, U64(pow(int(base), -1, 1 << 64))):
                    full = np.full(max(n, WINDOW + 1), b, np.uint64)
                    full[0] = U64(1)
                    pair.append(np.multiply.accumulate(full))
                self.held.append(tuple(pair))
        return self.held


class Words:
    """The words of one window: where each starts and ends, the piece it is in, two hashes, and the seed of its language."""

    def __init__(self, data: bytes, at: np.ndarray, seeds: np.ndarray, powers: Powers, checked: bool):
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        letter = (raw != 10) & (raw != 32)
        edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        self.piece = np.cumsum(raw == 10, dtype=np.int32)[self.start] if len(edge) else np.zeros(0, np.int32)
        self.text = np.searchsorted(at, self.start, "right") - 1
        self.seed = seeds[self.text]
        value = raw.astype(np.uint64) + U64(1)
        self.hashes = []
        for up, down in powers.of(len(raw))[:2 if checked else 1]:
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(value * up[:len(raw)], out=sums[1:])
            self.hashes.append(mix((sums[self.end] - sums[self.start]) * down[self.start]))

    def grams(self, size: int, which: int = 0) -> np.ndarray:
        """A hash of the ``size`` words from each word on, whether they are of one piece or not."""
        h = self.hashes[which]
        n = max(0, len(h) - size + 1)
        total = self.seed[:n] * ODD[8] + U64(size)
        for k in range(size):
            total = total + h[k:k + n] * ODD[k]
        return mix(total)

    def whole(self, size: int) -> np.ndarray:
        n = max(0, len(self.piece) - size + 1)
        return self.piece[:n] == self.piece[size - 1:size - 1 + n]


def seed_of(lang: str) -> np.uint64:
    from xxhash import xxh3_64_intdigest
    return U64(xxh3_64_intdigest(lang))


def windows(texts, langs, powers: Powers, checked: bool = False) -> Iterator[tuple[Words, np.ndarray]]:
    """The words of some texts, window by window, with the number of each word's text. Windows end between pieces, as no phrase crosses one."""
    whole = [(t.encode("utf-8", "surrogatepass") if t else b"").translate(TABLE) + b"\n" for t in texts]
    at = np.concatenate(([0], np.cumsum([len(x) for x in whole]))).astype(np.int64)
    data = b"".join(whole)
    seeds = np.array([seed_of(x) for x in langs], np.uint64)
    low = 0
    while low < len(data):
        high = min(len(data), low + WINDOW)
        cut = data.rfind(b"\n", low, high) + 1 or data.find(b"\n", high) + 1
        yield Words(data[low:cut], at[:-1] - low, seeds, powers, checked)
        low = cut


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = (hashes & U64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def candidates(words: Words, sizes: tuple[int, ...], bits: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, hashes) of the n-grams in one piece; with ``bits``, longer ones only where all their pairs are marked."""
    pairs = None
    if bits is not None and max(sizes) > 2:
        pairs = marked(bits, words.grams(2)) & words.whole(2)
    for size in sizes:
        ok = words.whole(size)
        if pairs is not None and size > 2:
            for k in range(size - 1):
                ok = ok & pairs[k:k + len(ok)]
        place = np.flatnonzero(ok)
        if len(place):
            yield size, place, words.grams(size)[place]


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with their counts added up."""
    if not len(hashes):
        return hashes, counts
    by = np.argsort(hashes)
    h, c = hashes[by], counts[by]
    head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[head], np.add.reduceat(c, head)


def packed(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Hashes that occur once, then the others with their counts."""
    once = counts == 1
    many = counts[~once].astype("<i8")
    return b"".join([np.array([once.sum()], "<i8").tobytes(), hashes[once].tobytes(), hashes[~once].tobytes(), many.tobytes()])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    once = int(np.frombuffer(data, "<i8", 1)[0])
    rest = (len(data) - 8 - 8 * once) // 16
    hashes = np.frombuffer(data, "<u8", once + rest, 8)
    return hashes, np.concatenate((np.ones(once, np.int64), np.frombuffer(data, "<i8", rest, 8 + 8 * (once + rest))))


class Summary:
    """A Misra-Gries summary of ``capacity`` counters.

    A counter is at most ``taken`` below the true count, and taken stays under mass / capacity.
    """

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Merges exact counts, or another summary's counters; of too many, all lose what the first one too many has."""
        self.hashes, self.counts = summed(np.concatenate((self.hashes, hashes)), np.concatenate((self.counts, counts)))
        if len(self.counts) > self.capacity:
            extra = len(self.counts) - self.capacity
            loss = int(np.partition(self.counts, extra - 1)[extra - 1])   # the largest of those beyond the capacity
            self.counts = self.counts - loss
            stay = self.counts > 0
            self.hashes, self.counts, self.taken = self.hashes[stay], self.counts[stay], self.taken + loss


def dealt(docs: DataFrame, sizes: tuple[int, ...], parts: int, bits) -> DataFrame:
    """(part, nth, mass, data): counted n-gram hashes by range; rows with nth 0 hold the mass alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, powers, allowed = 0, Powers(), bits.value if bits is not None else None
        edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)

        def out(h: np.ndarray, c: np.ndarray) -> pd.DataFrame:
            at = np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))
            used = np.flatnonzero(np.diff(at))
            data = [packed(h[at[p]:at[p + 1]], c[at[p]:at[p + 1]]) for p in used]
            mass = [int(c[at[p]:at[p + 1]].sum()) for p in used]
            return pd.DataFrame({"part": np.repeat(used, 2), "nth": [0, 1] * len(used), "mass": np.repeat(mass, 2), "data": [x for d in data for x in (None, d)]})

        for b in batches:
            for words in windows(b["text"], b["lang"], powers):
                for _, _, h in candidates(words, sizes, allowed):
                    held.append(summed(h, np.ones(len(h), np.int64)))
                    size += len(held[-1][0])
                if size > GATHERED:
                    held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
                    if size > GATHERED // 2:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*summed(*(np.concatenate(x) for x in zip(*held))))

    return docs.mapInPandas(lean(run), "part long, nth int, mass long, data binary")


def survivors(counted: DataFrame, parts: int, threshold: int) -> DataFrame:
    """(hash): n-grams that may occur ``threshold`` times; all that do are among them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, mass, summary = None, 0, None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merge() -> None:
            nonlocal size
            if held:
                summary.add(*summed(*(np.concatenate(x) for x in zip(*held))))
                held.clear()
                size = 0

        def out() -> Iterator[pd.DataFrame]:
            merge()
            likely = summary.counts + summary.taken >= threshold
            if likely.any():
                yield pd.DataFrame({"hash": summary.hashes[likely].view(np.int64)})

        for b in batches:
            for part, nth, m, data in zip(b["part"].tolist(), b["nth"].tolist(), b["mass"].tolist(), b["data"]):
                if part != now:
                    if summary is not None:
                        yield from out()
                    now, mass, summary = part, 0, None
                if nth == 0:
                    mass += m
                    continue
                if summary is None:   # all masses of a range come before its counts
                    summary = Summary(mass // threshold + 1)
                held.append(unpacked(data))
                size += len(held[-1][0])
                if size > max(summary.capacity, GATHERED // 2):   # so merging costs in proportion to what comes in
                    merge()
        if summary is not None:
            yield from out()

    return counted.repartition(parts, "part").sortWithinPartitions("part", "nth").mapInPandas(lean(run), "hash long")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """64 bits a hash, but ``MOST_BITS`` at most, set where a hash falls; put together by Spark, so what comes back is bounded."""
    bits = bits_for(hashes.count(), 64, MOST_BITS)
    bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
    cells = (hashes.select(F.shiftright(bit, 6).alias("cell"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
             .groupBy("cell").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow())
    out = np.zeros(bits // 64, "<i8")
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return out.view(np.uint8)


def sealed(langs: list[str], phrases: list[bytes | None], counts: list[int]) -> bytes:
    """Counted phrases as one packed value."""
    out = pa.BufferOutputStream()
    batch = pa.record_batch([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], ["lang", "phrase", "f"])
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def counted_by_text(docs: DataFrame, longest: int, parts: int, bits) -> DataFrame:
    """(part, data): marked n-grams counted by their texts, packed by range of a text's hash; phrase null counts all words of a language."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, allowed = Powers(), bits.value
        counts: dict[tuple[str, bytes | None], int] = {}

        def out() -> pd.DataFrame:
            keys = list(counts)
            names = np.empty(len(keys), object)
            names[:] = [(phrase or b"") + b"\x00" + lang.encode("utf-8", "surrogatepass") for lang, phrase in keys]
            part = (pd.util.hash_array(names, categorize=False) % np.uint64(parts)).astype(np.int64)
            rows = []
            for p in np.unique(part).tolist():
                own = [keys[k] for k in np.flatnonzero(part == p)]
                rows.append((p, sealed([k[0] for k in own], [k[1] for k in own], [counts[k] for k in own])))
            counts.clear()
            return pd.DataFrame(rows, columns=["part", "data"])

        def put(lang: str, phrase: bytes | None, n: int) -> None:
            counts[lang, phrase] = counts.get((lang, phrase), 0) + n

        for b in batches:
            langs = b["lang"].tolist()
            for words in windows(b["text"], langs, powers, checked=True):
                for text, n in zip(*(x.tolist() for x in np.unique(words.text, return_counts=True))):
                    put(langs[text], None, n)
                for size, place, h in candidates(words, tuple(range(1, longest + 1)), allowed):
                    keep = marked(allowed, h)
                    place, h = place[keep], h[keep]
                    _, first, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                    other = words.grams(size, 1)[place]
                    odd = np.flatnonzero(other != other[first][which])   # equal in one hash only: counted each by itself
                    if len(odd):
                        np.subtract.at(n, which[odd], 1)
                    for p, c in chain(zip(place[first].tolist(), n.tolist()), ((p, 1) for p in place[odd].tolist())):
                        phrase = words.data[words.start[p]:words.end[p + size - 1]]
                        put(langs[words.text[p]], b" ".join(phrase.split()) if size > 1 else phrase, c)
                if len(counts) > STRINGS:
                    yield out()
        if counts:
            yield out()

    return docs.mapInPandas(lean(run), "part long, data binary")


def exact_counts(packed: DataFrame, parts: int, threshold: int) -> DataFrame:
    """(lang, phrase, f) with at least ``threshold`` occurrences, and all words of each language under a null phrase."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, size = None, [], 0

        def merge() -> None:
            nonlocal size
            one = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "f"])
            held[:], size = [one], 0

        def out() -> Iterator[pd.DataFrame]:
            merge()
            one = held.pop()
            one = one.filter(pc.or_(pc.is_null(one["phrase"]), pc.greater_equal(one["f"], threshold)))
            if len(one):
                yield one.set_column(1, "phrase", one["phrase"].cast(pa.string())).to_pandas()

        for b in batches:
            for part, data in zip(b["part"].tolist(), b["data"]):
                if part != now and held:
                    yield from out()
                now = part
                held.append(pa.ipc.open_stream(data).read_all())
                size += len(held[-1])
                if size > max(STRINGS, len(held[0])):   # so merging costs in proportion to what comes in
                    merge()
        if held:
            yield from out()

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(lean(run), "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, longest: int = 5, threshold: int = 100) -> DataFrame:
    """(lang, phrase, f): phrases of up to ``longest`` words with at least ``threshold`` occurrences, and per language all words under a null phrase."""
    spark = docs.sparkSession
    bounded_batches(spark, megabytes=2)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text <> ''")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // RANGE_BYTES + 1
    found = stored(survivors(dealt(rows, (1, 2), parts, None), parts, threshold), "frequent-grams")
    bits = spark.sparkContext.broadcast(bitmap(found))
    if longest > 2:
        more = stored(survivors(dealt(rows, tuple(range(3, longest + 1)), parts, bits), parts, threshold), "frequent-long-grams")
        bits = spark.sparkContext.broadcast(bitmap(found.unionAll(more)))
    return stored(exact_counts(counted_by_text(rows, longest, parts, bits), parts, threshold), "phrases")


def collocations(docs: DataFrame, longest: int = 5, threshold: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into
    words; null languages are ``und``, null and empty texts hold no words. Candidates
    are phrases of 2 to ``longest`` words that occur ``threshold`` times (a) in the n
    words of their language. A cut into a first part (l) and a rest (r) has the score
    floor(1000 a n / (l r)), the lowest of all cuts counts. Candidates inside a longer
    one that occurs as often go. Repeated rows and doc_ids count each; other columns are
    ignored; an empty table has no phrases.
    """
    known = frequent_phrases(docs, longest, threshold)
    total = known.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    counts = known.where("phrase IS NOT NULL").select("lang", "phrase", "f")
    several = counts.withColumn("ws", F.split("phrase", " ")).where(F.size("ws") > 1)

    def run_of(first, n):
        return F.array_join(F.slice("ws", first, n), " ")

    inside = (several.where(F.size("ws") > 2).select("lang", F.explode(F.array(run_of(F.lit(1), F.size("ws") - 1), run_of(F.lit(2), F.size("ws") - 1))).alias("phrase"), F.col("f").alias("longer"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    # what holds a phrase two or more words longer holds one that is one word longer and at least as frequent
    kept = several.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("f")))
    cut = F.explode(F.sequence(F.lit(1), F.size("ws") - 1))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "ws", cut.alias("k")).select(
        "lang", "phrase", "a", "k", run_of(F.lit(1), F.col("k")).alias("first"), run_of(F.col("k") + 1, F.size("ws")).alias("rest"))
    scored = (cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
              .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(total, "lang")
              .withColumn("score", F.expr("cast(1000 AS decimal(4)) * cast(a AS decimal(38)) * n div (cast(l AS decimal(38)) * r)")))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    ranked = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB.
ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
cand AS (SELECT lang, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND c >= 100),
parts AS (SELECT lang, a, unnest(flatten(list_transform(range(2, len(ws)), lambda m: list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase FROM cand),
kept AS (SELECT * FROM cand WHERE NOT EXISTS (SELECT 1 FROM parts WHERE parts.lang = cand.lang AND parts.phrase = cand.phrase AND 100 * parts.a >= 100 * cand.a)),
cuts AS (SELECT kept.lang, kept.phrase, a, j, array_to_string(ws[1:j], ' ') AS first, array_to_string(ws[j + 1:], ' ') AS rest FROM kept, range(1, 5) t(j) WHERE j < len(ws)),
s AS (SELECT cuts.lang, cuts.phrase, a, j, x.c AS l, y.c AS r, n, (1000::HUGEINT * a * n) // (x.c::HUGEINT * y.c) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first
    JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= 2000"""
