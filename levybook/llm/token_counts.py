"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch become one ragged numpy array of byte symbols. In every round
each pre-token's pair of lowest rank is merged, in all pre-tokens at once, until no
pre-token holds a known pair; the symbols that survive are its tokens. Pre-tokens
already counted are remembered, so only new ones enter the arrays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Pre-tokenizer pattern of the byte-level tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a worker remembers; the memory is emptied beyond it.
REMEMBERED = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level tokenizer files, by the usual rule:
    printable Latin-1 bytes stand for themselves, the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankMerger:
    """Counts tokens of pre-tokens under the merges of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.base = np.zeros(256, np.int64)
        for ch, b in alphabet.items():
            self.base[b] = vocab[ch]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.rank, self.made = size, keys[order], order.astype(np.int64), made[order]
        self.pattern = regex.compile(PATTERN)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.known: dict[str, int] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; the largest integer where the pair is unknown."""
        k = a * self.size + b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        hit = self.keys[i] == k
        return np.where(hit, self.rank[i], np.iinfo(np.int64).max), self.made[i]

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece."""
        lens = np.array([len(p) for p in pieces], np.int64)
        sym = self.base[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lens)
        total, none = np.zeros(len(pieces), np.int64), np.iinfo(np.int64).max
        while len(sym) > 1:
            rank, made = self.ranks(sym[:-1], sym[1:])
            rank[owner[:-1] != owner[1:]] = none
            best = np.full(len(pieces), none)
            np.minimum.at(best, owner[:-1], rank)
            live = best[owner] != none
            if not live.all():   # finished pieces leave the arrays
                total += np.bincount(owner[~live], minlength=len(pieces))
                keep = live[:-1] & live[1:]
                # neighbours stay neighbours: a piece leaves whole
                rank, made = rank[keep], made[keep]
                sym, owner = sym[live], owner[live]
                if not len(sym):
                    return total
                if len(rank) != len(sym) - 1:
                    rank, made = self.ranks(sym[:-1], sym[1:])
                    rank[owner[:-1] != owner[1:]] = none
            at = np.flatnonzero((rank == best[owner[:-1]]) & (rank != none))
            if len(at) > 1:   # of overlapping equal pairs every second one merges, from the left
                start = np.empty(len(at), bool)
                start[0], start[1:] = True, np.diff(at) != 1
                first = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, owner = sym[keep], owner[keep]
        return total + np.bincount(owner, minlength=len(pieces))

    def learn(self, new: list[str]) -> None:
        """Counts pre-tokens, in groups of at most about 2^21 bytes; one longer pre-token is a group of its own."""
        group, size = [], 0
        for w in [*new, None]:
            if group and (w is None or size + 4 * len(w) > 1 << 21):
                self.known.update(zip(group, self.count([g.encode("utf-8", "surrogatepass") for g in group]).tolist()))
                group, size = [], 0
            if w is not None:
                group.append(w)
                size += 4 * len(w)

    def texts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        split, extra = [], []
        for t in texts:
            parts = self.special.split(t) if t and self.special else [t or ""]
            extra.append(len(parts) - 1)
            split.append([w for p in parts for w in self.pattern.findall(p)])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(list({w for ws in split for w in ws} - self.known.keys()))
        get = self.known.__getitem__
        return [sum(map(get, ws)) + e for ws, e in zip(split, extra)]


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens; a null doc_id stays null;
    repeated rows are counted each; other columns are ignored. ``tokenizer`` is the
    path of a byte-level BPE file that every executor has.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = merger(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": m.texts(b["text"].tolist())})

    out = (docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
           .mapInPandas(count, "doc_id long, n_bytes long, n_tokens long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
