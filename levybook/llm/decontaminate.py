"""Benchmark decontamination by pigeonhole edit matching.

Each benchmark item may occur in a document with at most ``e`` edits. It is halved
until its parts have no edits left to spend, which gives e + 1 pieces, one of which an
occurrence holds unchanged. An Aho-Corasick pass finds the pieces; a hit is verified
part by part up to the whole item with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, lean

#: Characters of benchmark items that one pass over the documents looks for.
BLOCK_CHARS = 1 << 20


def normal(text: str | None) -> str:
    """Lower case, words parted by single spaces."""
    return " ".join(text.lower().split()) if text else ""


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text``, and where the first such substring ends."""
    m, peq = len(pattern), {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Part:
    """A stretch of an item with the edits it may hold; ``up`` is the longer stretch it was halved from."""
    __slots__ = ("start", "end", "edits", "up", "item")

    def __init__(self, start, end, edits, up, item):
        self.start, self.end, self.edits, self.up, self.item = start, end, edits, up, item


def pieces(item: str, edits: int, number: int) -> list[Part]:
    """The ``edits + 1`` parts of an item that have no edits to spend."""
    done, todo = [], [Part(0, len(item), edits, None, number)]
    while todo:
        p = todo.pop()
        if p.edits == 0:
            done.append(p)
            continue
        left = (p.edits - 1) // 2
        right = p.edits - 1 - left
        middle = p.start + (p.end - p.start) * (left + 1) // (p.edits + 1)
        todo += [Part(p.start, middle, left, p, number), Part(middle, p.end, right, p, number)]
    return done


class Matcher:
    """Finds benchmark items in texts."""

    def __init__(self, items: list[str], rate: float):
        import ahocorasick
        self.items = items
        by_piece: dict[str, list[Part]] = {}
        for number, item in enumerate(items):
            for p in pieces(item, min(int(rate * len(item)), len(item) - 1), number):
                by_piece.setdefault(item[p.start:p.end], []).append(p)
        self.automaton = ahocorasick.Automaton()
        for text, parts in by_piece.items():
            self.automaton.add_word(text, (len(text), parts))
        if by_piece:
            self.automaton.make_automaton()
        self.any = bool(by_piece)

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """item number -> (least distance found, end of that occurrence in the normalised text)."""
        found: dict[int, tuple[int, int]] = {}
        if not self.any or not text:
            return found
        tried: set[tuple[int, int, int, int]] = set()
        for last, (size, parts) in self.automaton.iter(text):
            at = last + 1 - size
            for leaf in parts:
                best = found.get(leaf.item)
                if best and (best[0] == 0 or abs(best[1] - (at - leaf.start + len(self.items[leaf.item]))) <= len(self.items[leaf.item]) // 10 + 1):
                    continue   # this occurrence is known already
                base, part, result = at - leaf.start, leaf, (0, last + 1)
                while part.up is not None and result:
                    part = part.up
                    key = (part.item, part.start, part.end, base)
                    if key in tried:
                        result = None
                        break
                    low = max(0, base + part.start - part.edits)
                    window = text[low:base + part.end + part.edits]
                    distance, end = myers(self.items[part.item][part.start:part.end], window)
                    result = (distance, low + end) if distance <= part.edits else None
                    if result is None:
                        tried.add(key)
                if result and (best is None or result < best):
                    found[leaf.item] = result
        return found


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, list[int | None]]]]:
    """The items, equal ones together, in blocks of about ``BLOCK_CHARS`` characters; they are the stated query set, which the driver hands to the tasks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("length(trim(text)) > 0")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(chars // BLOCK_CHARS) + 1
    for k in range(n):
        ids: dict[str, list] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect():
            if r["text"] and normal(r["text"]):
                ids.setdefault(normal(r["text"]), []).append(r["item_id"])
        yield list(ids.items())


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """Pairs (doc_id, item_id, distance, end): documents that hold a benchmark item with at most ``rate`` edits a character.

    Both sides are compared in lower case with single spaces; ``end`` is where the
    closest occurrence ends in that form. Documents with a null doc_id are matched and
    keep it; null or empty texts and items match nothing; repeated rows give one pair;
    other columns are ignored. Items are the stated query set: they are brought to the
    tasks in blocks of about ``BLOCK_CHARS`` characters, one pass over the documents each.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            known = sent.value
            matcher = Matcher([t for t, _ in known], rate)
            for b in batches:
                got = [(d, i, *hit) for d, t in zip(b["doc_id"].astype("Int64"), b["text"]) for n, hit in matcher.find(normal(t)).items() for i in known[n][1]]
                yield pd.DataFrame({"doc_id": pd.array([None if g[0] is pd.NA else g[0] for g in got], "Int64"), "item_id": pd.array([g[1] for g in got], "Int64"),
                                    "distance": [g[2] for g in got], "end": [g[3] for g in got]})

        block = texts.mapInPandas(lean(search), "doc_id long, item_id long, distance long, end long")
        out = block if out is None else out.unionAll(block)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end")).alias("best")).select("doc_id", "item_id", "best.distance", "best.end")


def holds_any(spark: SparkSession, items: list[str], rate: float):
    """A column function: whether a text holds one of the items."""
    sent = spark.sparkContext.broadcast(items)

    @F.pandas_udf("boolean")
    def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, rate)
        for some in texts:
            yield pd.Series([bool(matcher.find(normal(t))) for t in some], dtype=bool)
        give_back()

    return leaks


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns kept, and rows judged each, whatever their doc_id."""
    bounded_batches(docs.sparkSession)
    for block in blocks(benchmark):
        docs = docs.where(~holds_any(docs.sparkSession, [t for t, _ in block], rate)("text"))
    return docs
