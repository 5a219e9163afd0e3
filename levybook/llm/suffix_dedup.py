"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A string of ``LENGTH`` bytes that repeats holds, in both places, the same anchor: the
``PIECE``-byte piece of least hash. So the suffixes worth sorting start at pieces that
occur more than once, which one grouped count of piece hashes finds. Every task sorts
the suffixes of its texts into runs and front-codes them; the runs' chunks go to key
ranges, where a loser tree merges them. Each suffix carries the length of the prefix it
shares with the last one out, so known prefixes are never compared again. Strings
around a piece at very many places are grouped by their hash instead.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Marks, bounded_batches, dropped, lean, mix, stored

#: Bytes of a repeated string, of an anchor, and of what may precede the anchor in the string.
LENGTH, PIECE = 100, 36
LEFT = LENGTH - PIECE
#: Suffixes of one run and of one front-coded chunk at most, and bytes of chunks that one merge task takes on average.
RUN, CHUNK, MERGE_BYTES = 100_000, 2048, 12 << 20
#: Suffixes of one judged batch, about.
BATCH = 20_000
#: Places of a piece above which its strings are grouped by hash instead of sorted in one task, and strings that one task sorts at a time there.
HOT, HASHED = 100_000, 500_000
#: Suffixes whose pieces choose the cuts of the key ranges, at most, and stretches that a merge task sends at a time.
CUT_SAMPLE, SENT = 40_000, 50_000
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Powers:
    """Powers of the base and of its inverse, modulo 2^64, as far as the longest text of a task needs them."""

    def __init__(self):
        self.held: list[np.ndarray] = []

    def of(self, n: int) -> list[np.ndarray]:
        if not self.held or len(self.held[0]) < n:
            self.held = []
            for base in (BASE, BASE_INVERSE):
                full = np.full(max(n, 1 << 16), base, np.uint64)
                full[0] = U64(1)
                self.held.append(np.multiply.accumulate(full))
        return self.held


def piece_hashes(data: np.ndarray, powers: Powers, width: int = PIECE) -> np.ndarray:
    """A hash of the ``width`` bytes at every place where as many follow."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers.of(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U64(1)) * up[:len(data)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[:-(width - step)], x[width - step:]) if width > step else x


def least(hashes: np.ndarray) -> np.ndarray:
    """The least piece hash of every string of ``LENGTH`` bytes, by the string's start."""
    width = LENGTH - PIECE + 1
    return sliding(hashes, width, np.minimum) if len(hashes) >= width else np.zeros(0, np.uint64)


def anchor_places(hashes: np.ndarray) -> np.ndarray:
    """Places whose piece is the least of a string of ``LENGTH`` bytes around it."""
    low = least(hashes)
    if not len(low):
        return np.zeros(0, np.int64)
    width = LENGTH - PIECE + 1
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(hashes == sliding(np.concatenate((edge, low, edge)), width, np.maximum))


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct least hashes of all strings of ``LENGTH`` bytes, and at how many places each is one."""
    return np.unique(hashes[anchor_places(hashes)], return_counts=True)


def places_of(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places whose hash is wanted; the first 16 bits rule most of them out."""
    marked = np.zeros(1 << 16, bool)
    marked[(wanted >> U64(48)).astype(np.int64)] = True
    near = np.flatnonzero(marked[(hashes >> U64(48)).astype(np.int64)])
    return near[np.isin(hashes[near], wanted)]


def text_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def anchor_rows(texts: DataFrame) -> DataFrame:
    """(piece, at, variant, n) of each text's anchors; ``n`` counts the anchor's places in the text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for b in batches:
            found = [anchors(piece_hashes(np.frombuffer(text_bytes(t), np.uint8), powers)) for t in b["text"]]
            sizes = [len(f[0]) for f in found]
            if sum(sizes):
                yield pd.DataFrame({"piece": np.concatenate([f[0] for f in found]).astype(np.int64), "at": np.repeat(b["at"].to_numpy(), sizes),
                                    "variant": np.repeat(b["variant"].to_numpy(), sizes), "n": np.concatenate([f[1] for f in found])})
    return texts.select("at", "variant", "text").mapInPandas(lean(run), "piece long, at long, variant long, n long")


def shared_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of ``a`` and ``b``, of which ``at`` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    while at < n:   # narrow by halves: slices compare in C
        step = max(1, (n - at) // 2)
        if a[at:at + step] == b[at:at + step]:
            at += step
        elif step == 1:
            return at
        else:
            n = at + step
    return at


Suffix = tuple[bytes, bytes, int, int, int]   # the suffix, bytes before it, doc_id, variant, place


def front_code(rows: list[Suffix]) -> bytes:
    """A sorted chunk with each suffix's shared prefix left out, and variants only where there are any."""
    prefix = [0]
    for k in range(1, len(rows)):
        prefix.append(shared_prefix(rows[k - 1][0], rows[k][0]))
    tails = b"".join(r[0][p:] for r, p in zip(rows, prefix))
    before = b"".join(r[1] for r in rows)
    variants = np.array([r[3] for r in rows], "<i8")
    head = np.array([len(rows), len(tails), bool(variants.any())], "<i8").tobytes()
    return b"".join([head, np.array(prefix, "u1").tobytes(), bytes(len(r[0]) for r in rows), bytes(len(r[1]) for r in rows),
                     np.array([r[2] for r in rows], "<i8").tobytes(), np.array([r[4] for r in rows], "<i8").tobytes(), variants.tobytes() if variants.any() else b"", tails, before])


def decoded(blob: bytes) -> Iterator[tuple[bytes, int, bytes, int, int, int]]:
    """(suffix, prefix shared with the one before, bytes before it, doc_id, variant, place) of a chunk, in order."""
    n, n_tails, varied = np.frombuffer(blob, "<i8", 3).tolist()
    at = 24
    prefix, sizes, lefts = (blob[at + k * n:at + (k + 1) * n] for k in range(3))
    at += 3 * n
    docs, places = (np.frombuffer(blob, "<i8", n, at + 8 * n * k).tolist() for k in range(2))
    at += 16 * n
    variants = np.frombuffer(blob, "<i8", n, at).tolist() if varied else [0] * n
    at += 8 * n * varied
    left_at, suffix = at + n_tails, b""
    for k in range(n):
        own = sizes[k] - prefix[k]
        suffix = suffix[:prefix[k]] + blob[at:at + own]
        at += own
        yield suffix, prefix[k], blob[left_at:left_at + lefts[k]], docs[k], variants[k], places[k]
        left_at += lefts[k]


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Loser tree over sorted runs; yields (suffix, prefix shared with the last one out, left, doc_id, variant, place).

    Every waiting suffix holds the length it shares with the last winner of its match.
    Of two, the one that shares more is the smaller; only equal lengths are compared,
    from that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[list | None] = []
    for r in runs:
        first = next(r, None)
        heads.append([*first] if first else None)
        if first:
            heads[-1][1] = 0
    heads += [None] * (k - len(runs))
    losers = [-1] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; both hold what they share with the same last winner, the loser then what it shares with the winner."""
        a, b = heads[x], heads[y]
        if b is None:
            return x, y
        if a is None:
            return y, x
        if a[1] != b[1]:
            return (x, y) if a[1] > b[1] else (y, x)
        sa, sb = a[0], b[0]
        p = shared_prefix(sa, sb, a[1])
        if p == len(sa) and (p < len(sb) or x < y) or p < len(sa) and p < len(sb) and sa[p] < sb[p]:
            b[1] = p
            return x, y
        a[1] = p
        return y, x

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, losers[node] = play(build(2 * node), build(2 * node + 1))
        return w

    best = build(1) if k > 1 else 0
    while heads and heads[best] is not None:
        yield tuple(heads[best])
        nxt = next(runs[best], None)
        heads[best] = [*nxt] if nxt else None
        node = (best + k) // 2
        while node >= 1 and k > 1:
            best, losers[node] = play(best, losers[node])
            node //= 2


def pair_repeats(one: tuple, two: tuple) -> Iterator[tuple[int, int, int, int]]:
    """What ``repeats`` gives for two suffixes that nothing else shares a piece with."""
    (_, _, a, *ia), (_, p, b, *ib) = one, two
    left = shared_prefix(a[::-1], b[::-1])
    if left + p >= LENGTH and ia != ib:
        d, variant, at = max(ia, ib)
        yield d, variant, at - left, at + p


def repeats(group: list[tuple[bytes, int, bytes, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, variant, start, end) to remove, for whole groups of suffixes that share a piece, in suffix order.

    A string of LENGTH bytes holds ``o`` bytes before the piece. All removable strings
    around one piece overlap in it, so the least and the largest ``o`` give one stretch.
    """
    n = len(group)
    known = {key: k for k, key in enumerate(sorted({g[3:6] for g in group}))}
    rank = np.array([known[g[3:6]] for g in group])
    low, high = np.full(n, LENGTH + 1), np.full(n, -1)
    rights = np.array([len(g[0]) for g in group])
    prefix = np.array([g[1] for g in group])
    lefts = np.zeros((n, LEFT), np.uint8)
    sizes = np.array([len(g[2]) for g in group])
    for i, g in enumerate(group):
        if g[2]:
            lefts[i, :len(g[2])] = np.frombuffer(g[2][::-1], np.uint8)
    key = np.zeros(n, np.uint64)
    for o in range(LEFT + 1):
        if o:
            key = mix(key + lefts[:, o - 1].astype(np.uint64) + U64(1))
        fit = np.flatnonzero((sizes >= o) & (rights >= LENGTH - o))
        if len(fit) > 1:
            right = np.cumsum(prefix < LENGTH - o)   # suffixes that share the string's right part are neighbours
            pair = mix(key[fit]) + right[fit].astype(np.uint64)
            by = np.lexsort((rank[fit], pair))
            head = np.concatenate(([True], pair[by[1:]] != pair[by[:-1]]))
            earliest = rank[fit][by][np.flatnonzero(head)[np.cumsum(head) - 1]]
            later = fit[by[rank[fit][by] > earliest]]   # all but the earliest of equal strings
            low[later], high[later] = np.minimum(low[later], o), np.maximum(high[later], o)
    for i in np.flatnonzero(high >= 0):
        d, variant, at = group[i][3:6]
        yield d, variant, at - int(high[i]), at - int(low[i]) + LENGTH


def sorted_runs(candidates: DataFrame) -> DataFrame:
    """Front-coded chunks of sorted runs (run, nth, first, last, data), and stretches (at, variant, start, end) that a run itself shows to repeat."""
    def stretches(gone: list[tuple[int, int, int, int]]) -> pd.DataFrame:
        return pd.DataFrame(gone, columns=["at", "variant", "start", "end"], dtype="Int64").assign(run=None, nth=pd.array([None] * len(gone), "Int64"), first=None, last=None, data=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[Suffix] = []
        powers = Powers()

        def flush() -> Iterator[pd.DataFrame]:
            rows.sort()
            kept, gone = [], []
            for r in rows:   # of equal suffixes with equal bytes before, the earliest goes on
                if kept and kept[-1][:2] == r[:2]:
                    if len(r[0]) + len(r[1]) >= LENGTH and kept[-1][2:] != r[2:]:
                        gone.append((r[2], r[3], r[4] - len(r[1]), r[4] + len(r[0])))
                else:
                    kept.append(r)
            name = hashlib.sha256(repr((len(rows), rows[0], rows[-1])).encode()).hexdigest()
            chunks = [kept[k:k + CHUNK] for k in range(0, len(kept), CHUNK)]
            rows.clear()
            for nth, c in enumerate(chunks):
                yield pd.DataFrame({"run": [name], "nth": [nth], "first": [c[0][0][:PIECE]], "last": [c[-1][0][:PIECE]], "data": [front_code(c)],
                                    **{x: pd.array([None], "Int64") for x in ("at", "variant", "start", "end")}})
            if gone:
                yield stretches(gone)

        for b in batches:
            for d, variant, t, wanted in zip(b["at"].tolist(), b["variant"].tolist(), b["text"], b["pieces"]):
                data = text_bytes(t)
                h = piece_hashes(np.frombuffer(data, np.uint8), powers)
                at_anchors = anchor_places(h)   # a repeated string's anchor is one in both places; its other places do not matter
                for p in at_anchors[places_of(h[at_anchors], wanted.astype(np.uint64))].tolist():
                    rows.append((data[p:p + LENGTH], data[max(0, p - LEFT):p], d, variant, p))
                    if len(rows) >= RUN:
                        yield from flush()
        if rows:
            yield from flush()
    return candidates.select("at", "variant", "text", "pieces").mapInPandas(lean(run), "run string, nth long, first binary, last binary, data binary, at long, variant long, start long, end long")


def hot_repeats(candidates: DataFrame) -> DataFrame:
    """Stretches (at, variant, start, end) that repeat around the pieces ``hot`` of each text.

    A string goes to the hash of its bytes and its anchor, so a piece's strings spread
    over tasks; of a task's equal strings only the earliest is sent.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        size, powers = 0, Powers()

        def flush() -> pd.DataFrame:
            piece, string, at, variant, place = (np.concatenate(x) for x in zip(*held))
            held.clear()
            by = np.lexsort((place, variant, at, string, piece))
            piece, string, at, variant, place = piece[by], string[by], at[by], variant[by], place[by]
            head = np.concatenate(([True], (piece[1:] != piece[:-1]) | (string[1:] != string[:-1])))
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            keep = head | (at != at[first]) | (variant != variant[first]) | (place != place[first])   # a row that is repeated is no second place
            return pd.DataFrame({"piece": piece.view(np.int64), "string": string.view(np.int64), "at": at, "variant": variant, "place": place, "later": ~head})[keep]

        for b in batches:
            for d, variant, t, wanted in zip(b["at"].tolist(), b["variant"].tolist(), b["text"], b["hot"]):
                data = np.frombuffer(text_bytes(t), np.uint8)
                low = least(piece_hashes(data, powers))
                found = places_of(low, wanted.astype(np.uint64))
                held.append((low[found], piece_hashes(data, powers, LENGTH)[found], np.full(len(found), d, np.int64), np.full(len(found), variant, np.int64), found.astype(np.int64)))
                size += len(found)
                if size >= HASHED:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    strings = stored(candidates.select("at", "variant", "text", "hot").mapInPandas(lean(run), "piece long, string long, at long, variant long, place long, later boolean"), "hot-strings")
    sent = strings.where("NOT later")
    firsts = sent.groupBy("piece", "string").agg(F.min(F.struct("at", "variant", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = sent.join(firsts, ["piece", "string"]).where(F.struct("at", "variant", "place") > F.col("first")).select("at", "variant", "place")
    return later.unionAll(strings.where("later").select("at", "variant", "place")).select("at", "variant", F.col("place").alias("start"), (F.col("place") + LENGTH).alias("end"))


def merge_runs(chunks: DataFrame) -> DataFrame:
    """Stretches (at, variant, start, end) that repeat, from the merged runs of each key range.

    Ranges are cut at whole pieces, so suffixes that begin alike part as soon as their
    pieces differ; what shares a piece stays together.
    """
    size = chunks.agg(F.sum(F.octet_length("data")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, min(int((size["size"] or 0) // MERGE_BYTES) + 1, size["n"] or 1))
    firsts = sorted(bytes(r["first"]) for r in chunks.select("first", F.xxhash64("run", "nth").alias("h")).orderBy("h").limit(CUT_SAMPLE).collect()) if parts > 1 else []
    cuts = sorted({firsts[k * len(firsts) // parts] for k in range(1, parts)}) if firsts else []

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a chunk that reaches into several ranges is taken apart, so that nothing is sent twice
        for b in batches:
            out = []
            for name, nth, first, last, data in zip(b["run"], b["nth"].tolist(), b["first"], b["last"], b["data"]):
                low, high = bisect_right(cuts, bytes(first)), bisect_right(cuts, bytes(last))
                if low == high:
                    out.append((low, name, nth, data))
                    continue
                own: dict[int, list[Suffix]] = {}
                for suffix, _, left, *place in decoded(data):
                    while low < high and suffix[:PIECE] >= cuts[low]:
                        low += 1
                    own.setdefault(low, []).append((suffix, left, *place))
                out += [(part, name, nth, front_code(rows)) for part, rows in own.items()]
            yield pd.DataFrame(out, columns=["part", "run", "nth", "data"])

    dealt = chunks.mapInPandas(lean(deal), "part long, run string, nth long, data binary")

    def merge(rows: list[tuple[str, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
        runs: dict[str, list[bytes]] = {}
        for name, _, data in rows:
            runs.setdefault(name, []).append(data)

        def stream(blobs: list[bytes]) -> Iterator[tuple]:
            last = None
            for blob in blobs:
                whole = True   # a chunk's first suffix does not say what it shares with the chunk before
                for suffix, prefix, left, *place in decoded(blob):
                    if last is None:
                        prefix = 0
                    elif whole:
                        prefix = shared_prefix(last, suffix)
                    yield suffix, prefix, left, *place
                    last, whole = suffix, False

        group: list[tuple] = []
        batch: list[tuple] = []   # groups of more than two are judged many at a time
        for entry in chain(merged([stream(b) for b in runs.values()]), [None]):
            if entry is None or group and entry[1] < PIECE:
                if len(group) == 2:
                    yield from pair_repeats(*group)
                elif len(group) > 2:
                    batch += group
                if batch and (entry is None or len(batch) >= BATCH):
                    yield from repeats(batch)
                    batch = []
                group = []
            group.append(entry)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []

        def out() -> Iterator[pd.DataFrame]:
            found = merge(rows)
            while got := list(islice(found, SENT)):
                yield pd.DataFrame(got, columns=["at", "variant", "start", "end"])

        for b in batches:
            for part, name, nth, data in zip(b["part"], b["run"], b["nth"], b["data"]):
                if part != now:
                    if rows:
                        yield from out()
                    now, rows = part, []
                rows.append((name, nth, data))
        if rows:
            yield from out()
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "run", "nth").mapInPandas(lean(run), "at long, variant long, start long, end long")


def joined_up(stretches) -> list[list[int]]:
    """Maximal runs of sorted [start, end) ranges."""
    out: list[list[int]] = []
    for s, e in stretches:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with at (doc_id, the least number for null), digest of the text, and variant.

    Variant is 0, but among different texts of one ``at`` it is a number of their own
    each, in order of their digests.
    """
    rows = docs.withColumn("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("digest", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    several = rows.groupBy("at").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("at")
    texts = stored(rows.select("at", "digest").join(several, "at", "left_semi").distinct(), "texts-of-one-id")
    if texts.isEmpty():
        return rows.withColumn("variant", F.lit(0).cast("long"))
    # numbers rise with (at, digest): ranges are sorted, and a number has its range's in front
    ranges = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = stored(texts.repartitionByRange(ranges, "at", "digest").sortWithinPartitions("at", "digest")
                      .withColumn("variant", F.monotonically_increasing_id() + 1), "numbered-texts")
    return Marks(numbered, ["at", "digest"]).left(rows, numbered).withColumn("variant", F.coalesce("variant", F.lit(0).cast("long")))


def removals(docs: DataFrame) -> DataFrame:
    """(at, variant, stretches) of the documents of ``identified`` rows that lose bytes; stretches are [start, end) and may overlap."""
    key = ["at", "variant"]
    bounded_batches(docs.sparkSession)
    able = docs.where(F.octet_length("text") >= LENGTH)
    ids = able.select(*key, "digest", F.octet_length("text").cast("long").alias("end"))
    first = ids.groupBy("digest").agg(F.min("at").alias("first"))
    # a later copy of a whole text goes entirely, so only first copies are searched
    copies = stored(ids.join(first, "digest").where("at > first").select(*key, F.lit(0).cast("long").alias("start"), "end").distinct(), "copies")
    firsts = Marks(copies, key).anti(able, copies.select(*key))
    pieces = stored(anchor_rows(firsts), "anchors")
    often = stored(pieces.groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1").select("piece", (F.col("n") > HOT).alias("is_hot")), "repeated-pieces")
    repeated = Marks(often, ["piece"]).near(pieces).select("piece", *key).join(often, "piece")
    wanted = stored(repeated.groupBy(*key).agg(F.collect_set(F.when(~F.col("is_hot"), F.col("piece"))).alias("pieces"),
                                               F.collect_set(F.when(F.col("is_hot"), F.col("piece"))).alias("hot")), "wanted-pieces")
    dropped(pieces, often)
    able_to_repeat = Marks(wanted, key).near(able).select(*key, "text")
    found = stored(sorted_runs(able_to_repeat.join(wanted.where(F.size("pieces") > 0), key)), "runs")
    coded = merge_runs(found.where("run IS NOT NULL").select("run", "nth", "first", "last", "data")).unionAll(found.where("run IS NULL").select(*key, "start", "end"))
    hot = wanted.where(F.size("hot") > 0).drop("pieces")
    if not hot.isEmpty():
        coded = coded.unionAll(hot_repeats(able_to_repeat.join(hot, key)))
    out = stored(coded.unionAll(copies).groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("stretches")), "removals")
    dropped(found, wanted, copies)
    return out


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes when a string of ``LENGTH`` bytes over it also starts earlier, judged on
    the input. Null counts as the empty text; texts under ``LENGTH`` bytes lose nothing.
    A null doc_id precedes all others. Rows that repeat doc_id and text are one document
    and returned each; further texts of a doc_id are documents after it, in order of
    their digests. Other columns are ignored.
    """
    rows = identified(docs.select("doc_id", "text"))
    lost = removals(rows)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, stretches in zip(b["text"], b["stretches"]):
                data, spans = text_bytes(t), joined_up((x["start"], x["end"]) for x in stretches) if stretches is not None else []
                out.append((len(data), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept_bytes(data, spans)).hexdigest()))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"]).assign(doc_id=b["doc_id"].astype("Int64").array)

    return (Marks(lost, ["at", "variant"]).left(rows, lost).select(F.col("doc_id").cast("long"), "text", "stretches")
            .mapInPandas(cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, doc_id long")
            .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def kept_bytes(data: bytes, spans: list[list[int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(data[at:s])
        at = e
    return b"".join(out) + data[at:]


def kept_text(text: str, stretches) -> str:
    """The text without its repeated stretches; a character goes when all its bytes do."""
    data = text_bytes(text)
    spans = []
    for s, e in joined_up(stretches):
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        spans.append([s, e])
    return kept_bytes(data, spans).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated strings taken out of ``text`` and n_chars, where it is a column, counted anew.

    A document of which nothing is left is dropped; one that was empty before stays.
    """
    rows = identified(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))   # no column's name matters in between
    lost = removals(rows)

    @F.pandas_udf("string")
    def kept(texts: pd.Series, stretches: pd.Series) -> pd.Series:
        return pd.Series([t if x is None else kept_text(t, [(y["start"], y["end"]) for y in x]) for t, x in zip(texts, stretches)])

    cut, key = F.col("stretches").isNotNull(), ["at", "variant"]
    # Spark would cut once more for the filter, in a second Python worker of the same task; what it may not repeat it does once
    once, marks = kept.asNondeterministic(), Marks(lost, key)
    near = marks.near(rows).join(lost, key, "left").withColumn("text", F.when(cut, once("text", "stretches")).otherwise(F.col("text"))).where(~cut | (F.length("text") > 0))
    joined = marks.near(rows, False).unionByName(near, allowMissingColumns=True)
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("row")["n_chars"])
    return joined.select(*(column.alias(c) for c, column in columns.items()))
