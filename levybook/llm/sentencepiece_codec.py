"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (protobuf wire format), and its normaliser, metaspace
marker, scores and byte fallback are rebuilt as a tokenizers pipeline. Where no piece
spans two words, as in most BPE models, texts are encoded in stretches of whole words.
``parity_errors`` compares with sentencepiece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean

# Fixed values of the model format: piece types, model types, and field numbers.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MARK = "▁"
#: Characters of a stretch, and where one may end: before a mark that follows another character.
STRETCH, WORD_END = 1 << 10, re.compile(f"[^{MARK}](?={MARK})")


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    unk_surface: str = " ⁇ "


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message; values are integers, floats or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            n = varint()
            yield number, data[at:at + n]
            at += n
        elif wire == 5:
            yield number, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif wire == 1:
            yield number, struct.unpack_from("<d", data, at)[0]
            at += 8
        else:
            raise ValueError(f"no SentencePiece model: wire type {wire}")


def read_model(path: str) -> Model:
    with open(path, "rb") as f:
        data = f.read()
    m = Model()
    for number, value in fields(data):
        if number == PIECES:
            piece = dict(fields(value))
            m.pieces.append(piece.get(1, b"").decode())
            m.scores.append(piece.get(2, 0.0))
            m.types.append(piece.get(3, NORMAL))
        elif number == TRAINER:
            spec = dict(fields(value))
            m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            m.unk_surface = spec.get(44, m.unk_surface.encode()).decode()
        elif number == NORMALIZER:
            spec = dict(fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.squeeze, m.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are rebuilt")
    return m


class Codec:
    """A model rebuilt on the tokenizers library, and the piece table that decoding reads."""

    def __init__(self, path: str):
        from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers, pre_tokenizers
        m = self.model = read_model(path)
        index = {p: i for i, p in enumerate(m.pieces)}
        unk = next((i for i, t in enumerate(m.types) if t == UNKNOWN), None)
        usable = {p for p, t in zip(m.pieces, m.types) if t in (NORMAL, USER_DEFINED)}
        if m.kind == UNIGRAM:
            low = min(m.scores) - 100.0   # pieces that never come from text lose every comparison
            kept = [(p, s if t in (NORMAL, USER_DEFINED) else low) for p, s, t in zip(m.pieces, m.scores, m.types)]
            tok = Tokenizer(models.Unigram(kept, unk_id=unk, byte_fallback=m.byte_fallback))
        else:
            merges = []
            for p, s, t in zip(m.pieces, m.scores, m.types):
                if t == NORMAL and len(p) > 1:
                    merges += [(-s, index[p], index[p[:k]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            merges.sort(key=lambda x: x[:3])
            tok = Tokenizer(models.BPE(index, [(a, b) for *_, a, b in merges], unk_token=m.pieces[unk] if unk is not None else None,
                                       fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0))   # stretches hardly recur
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if m.escape:
            steps.append(normalizers.Replace(" ", MARK))
        tok.normalizer = normalizers.Sequence(steps)
        inner = [p for p in usable if MARK in p.lstrip(MARK)]
        own = [AddedToken(p, normalized=False) for p, t in zip(m.pieces, m.types) if t == USER_DEFINED]
        self.plain = not m.charsmap and not m.squeeze
        self.words = None
        if m.kind == BPE and not inner:   # no piece holds a mark after a letter, so nothing merges over a word's end
            if own or MARK not in usable:
                tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
            else:
                self.words = Tokenizer(tok.model)   # the same merges, for normalised text
        if own:
            tok.add_tokens(own)
        self.tokenizer = tok
        self.surface = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else m.unk_surface.encode() if t == UNKNOWN
                        else p.replace(MARK, " ").encode() for p, t in zip(m.pieces, m.types)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, without begin or end symbols.

        Where words stand apart, stretches are encoded one at a time: the library then needs neither its
        slow splitting nor its threads, which compete with the other tasks, and its heap of merges stays small.
        Else it spreads each batch over its threads; its results are much larger than the texts, so batches
        end at about 2^17 characters."""
        if self.words is not None:
            one = self.words.encode_batch_fast
            return [[i for s in stretches(self.marked(t)) for i in one([s], add_special_tokens=False)[0].ids] for t in texts]
        out, batch, size = [], [], 0
        for i, t in enumerate(texts):
            batch.append(t)
            size += len(t)
            if size > 1 << 17 or i + 1 == len(texts):
                out += [e.ids if x else [] for e, x in zip(self.tokenizer.encode_batch_fast(batch, add_special_tokens=False), batch)]
                batch, size = [], 0
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: pieces joined, byte pieces read as UTF-8, the dummy prefix taken off."""
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.model.dummy_prefix and ids and data[:1] == b" " and self.model.types[ids[0]] != BYTE:
            data = data[1:]
        return data.decode("utf-8", "replace")

    def marked(self, text: str) -> str:
        """The text as the model normalises it, with its marks."""
        if not self.plain:
            return self.tokenizer.normalizer.normalize_str(text) if text else ""
        s = " " + text if self.model.dummy_prefix and text else text
        return s.replace(" ", MARK) if self.model.escape else s

    def normalised(self, text: str) -> str:
        """What decoding gives back when nothing is lost."""
        s = self.marked(text).replace(MARK, " ")
        return s[1:] if self.model.dummy_prefix and s[:1] == " " else s


def stretches(marked: str, chars: int = STRETCH) -> Iterator[str]:
    """The text in runs of whole words of about ``chars`` characters; a longer word is not cut."""
    low = 0
    while len(marked) - low > chars and (end := WORD_END.search(marked, low + chars - 1)):
        yield marked[low:end.end()]
        low = end.end()
    if low < len(marked):
        yield marked[low:]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=1)
def reference(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def parity_errors(texts: list[str], path: str, own: Codec | None = None, found: tuple[list[list[int]], list[str]] | None = None) -> list[int]:
    """Places of texts that sentencepiece itself encodes or decodes otherwise; empty when the rebuilt model is the same.

    ``found`` are ids and decoded texts of the rebuilt model, where they are known."""
    if not texts:
        return []
    sp, own = reference(path), own or codec(path)
    theirs, ours = sp.encode(texts, num_threads=1), found[0] if found else own.encode(texts)
    back = found[1] if found else map(own.decode, ours)
    return [i for i, (a, b, t) in enumerate(zip(theirs, ours, back)) if a != b or sp.decode(a) != t]


def slices(texts: list[str], chars: int = 1 << 19) -> Iterator[slice]:
    """Runs of texts of about ``chars`` characters, so that ids and decoded texts of a whole batch are never held at once."""
    low = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > chars or i + 1 == len(texts):
            yield slice(low, i + 1)
            low, size = i + 1, 0


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, ids, decoded, round_trip, checked.

    ``ids`` are the model's ids of the whole text, ``decoded`` what they give back, and
    ``round_trip`` whether that is the text as the model normalises it. Every text is
    also encoded and decoded by sentencepiece (``checked``), and a difference ends the job. Null
    and empty texts have no ids and decode to the empty text; repeated rows are encoded
    each; other columns are ignored. The rebuilt model stays in the worker for its next
    task: the library's threads keep what they cache of a model when it goes, so a model
    a task would grow the worker with every task.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for b in batches:
            for part in slices(b["text"].tolist()):
                rows = b.iloc[part]
                texts = rows["text"].tolist()
                ids = c.encode(texts)
                back = [c.decode(i) for i in ids]
                if wrong := parity_errors(texts, model, c, (ids, back)):
                    raise ValueError(f"the rebuilt model differs from sentencepiece for doc_id {rows['doc_id'].iloc[wrong[0]]}")
                yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64").array, "n_bytes": rows["n_bytes"].to_numpy(), "n_tokens": [len(i) for i in ids],
                                    "ids": [np.array(i, np.int32) for i in ids], "decoded": back,
                                    "round_trip": [d == t or d == c.normalised(t) for d, t in zip(back, texts)], "checked": True})

    return (docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
            .mapInPandas(lean(run), "doc_id long, n_bytes long, n_tokens long, ids array<int>, decoded string, round_trip boolean, checked boolean"))
