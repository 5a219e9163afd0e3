"""Secrets in texts by assignment-aware lexing.

Fixed patterns find the well-known shapes. Beyond these, every place of a text where
source or configuration syntax gives a name a value is read as a pair of a name and an
expression: quoted strings, bare words, references, and what is put together from them.
Names that stand for constants are followed to the strings they hold, through other
names if need be, and a string counts as a secret when the name that receives it says
so and the value itself looks like one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Kinds of spans, in the order of spans that start together.
KINDS = ("assign", "access", "hex", "literal")
#: Least product of a name's and a value's weight for a secret.
LEAST = 0.5

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")   # a run of 20 and more has no shorter one that starts before it
HEX = re.compile(r"[0-9a-f]{24,}")

# Words of names and what they say about a value; values between 0 and 1.
WORDS = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "secretkey": 1.0, "accesskey": 1.0,
         "privatekey": 1.0, "authtoken": 1.0, "accesstoken": 1.0, "credential": 1.0, "bearer": 1.0, "pass": 0.9, "cred": 0.9, "authorization": 0.8, "auth": 0.7, "dsn": 0.6, "salt": 0.6, "cookie": 0.5}
KEYS = frozenset("api access private secret signing encryption master auth account storage shared deploy service client license session".split())
BENIGN = frozenset("id ids name names count length len max min limit size file filename path dir url uri endpoint policy expiry expires ttl timeout type field label hint prompt regex "
                   "pattern public header index column page placeholder format enabled required reset num number per total budget".split())
STEM = re.compile("pass|pwd|secret|token|key|cred|bearer|auth|dsn|salt|cookie", re.I | re.A)
EMPTY_VALUE = re.compile(r"(?:x{3,}|\*+|\.{2,}|-+|<.*>|\[.*\]|\$.*|%.*%|\{\{.*|your[ _-].*|my[ _-].*|.*(?:example|changeme|change[_-]me|placeholder|redacted|dummy|sample|todo).*|null|none|nil|true|"
                         r"false|undefined|required|optional|string|integer|password|passwd|secret|token|bearer|basic)", re.I | re.S)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

NAME = r"[A-Za-z_$][\w$]*+(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*+)*+"
SITE = re.compile(rf"""
    (?<![\w$.>:-])(?P<flag>--)?(?P<name>{NAME})
    (?: ["'`]?\]? [ \t]*+ (?: :[ \t]*+[A-Za-z_][\w.]*+(?:\[[^\]\n]*+\])?+[ \t]*+=(?![=~>]) | :=|=>|\?=|\+=|=(?![=~>])|:(?![:=/]) )
      | [ \t]++(?P<second>[A-Za-z_$][\w.$]*+)(?:\[\])?[ \t]*+:?=(?![=~>])
      | (?P<call>\([ \t]*+(?=[rbuRBU]?["'`]))
      | (?P<element>>(?=[^<>\s]))
      | (?(flag)[ \t]++(?=[^\s=:-])|(?!)) )""", re.X | re.A)
SPACE = re.compile(r"[ \t]*+")
SCHEME = re.compile(r"[ \t]*+(?:Bearer|Basic|Token)[ \t]++", re.I | re.A)
STRING = re.compile(r"""[A-Za-z@$]{0,2}+(?:(?P<q>\"\"\"|\'\'\')(?P<t>(?:\\.|(?!(?P=q))[^\\])*+)(?P=q)|"(?P<d>(?:[^"\\\n]|\\.)*+)"|'(?P<s>(?:[^'\\\n]|\\.)*+)'|`(?P<b>[^`\n]*+)`)""", re.S | re.A)
REFERENCE = re.compile(r"\$\{(?P<a>[A-Za-z_][\w.]*+)\}|\$(?P<b>[A-Za-z_]\w*+)|\{\{[ \t]*+(?P<c>[A-Za-z_][\w.]*+)[ \t]*+\}\}|%(?P<d>[A-Za-z_]\w*+)%", re.A)
WORD = re.compile(r"[^\s\"'`,;(){}\[\]<>|&=]++(?:=++(?=[\s,;)}\]&]|\Z))?+")
IDENTIFIER = re.compile(rf"{NAME}\Z", re.A)
JOIN = re.compile(r"[ \t]*+(?P<by>\+|\.\.|\.(?=[ \t]*+[\"'$])|\\\n|&(?=[ \t]*+[\"'A-Za-z]))?+[ \t]*+", re.A)
JOINED = re.compile(r"[ \t]*+(?:\+|\.\.|\.[ \t]*+[\"'$]|&[ \t]++[\"'A-Za-z]|\$|\{\{)", re.A)
ARGUMENT = re.compile(r"[ \t]*+(?P<by>,)?+[ \t]*+", re.A)
ASKS = re.compile(r"(?:getenv|environ\.get|env|get_env|getProperty|process\.env)\Z", re.A)   # their first argument is a name, not a value
OWNER = re.compile(r"\.|->|::")


@lru_cache(maxsize=1 << 14)
def name_weight(name: str) -> float:
    """How surely what the name holds is secret."""
    parts = [p.lower() for p in PART.findall(name)]
    if parts and parts[-1].endswith("s") and parts[-1] not in WORDS and parts[-1][:-1] in (*WORDS, "key"):
        parts[-1] = parts[-1][:-1]
    best = max((WORDS.get(p, 0.0) for p in parts), default=0.0)
    if any(b == "key" and a in KEYS for a, b in zip(parts, parts[1:])):
        best = 1.0
    return best * 0.3 if any(p in BENIGN for p in parts) else best


def value_features(text: str, quoted: bool) -> tuple[int, int, bool, bool]:
    """Length, set of characters as a bit mask (all beyond ASCII are one), whether it says nothing, and whether it was quoted."""
    mask = 0
    for c in set(text):
        mask |= 1 << min(ord(c), 127)
    return len(text), mask, EMPTY_VALUE.fullmatch(text) is not None, quoted


def together(features: list[tuple[int, int, bool, bool]]) -> tuple[int, int, bool, bool]:
    mask = 0
    for f in features:
        mask |= f[1]
    return sum(f[0] for f in features), mask, all(f[2] for f in features), any(f[3] for f in features)


def _mask(chars) -> int:
    return sum(1 << c for c in chars)


LOWER_MASK, UPPER_MASK, DIGIT_MASK = _mask(range(97, 123)), _mask(range(65, 91)), _mask(range(48, 58))
SPACE_MASK = _mask((9, 10, 11, 12, 13, 32))
OTHER_MASK = (1 << 128) - 1 - LOWER_MASK - UPPER_MASK - DIGIT_MASK - SPACE_MASK - (1 << ord("_"))


def value_weight(features: tuple[int, int, bool, bool]) -> float:
    """How much a value looks like a secret: long, mixed, no phrase, no stand-in."""
    n, mask, says_nothing, quoted = features
    if n < 6 or says_nothing or mask.bit_count() < 4:
        return 0.0
    classes = sum(1 for m in (LOWER_MASK, UPPER_MASK, DIGIT_MASK, OTHER_MASK) if mask & m)
    if mask & SPACE_MASK:
        return 0.3 if classes < 3 else 0.5
    if mask & DIGIT_MASK and classes > 1:
        return 1.0
    if not quoted and classes < 3:
        return 0.3
    return 0.9 if classes > 1 else 0.6


class Pair:
    """A name and the terms of its value: (start, end, whether quoted, the name it refers to or None)."""
    __slots__ = ("at", "name", "terms", "features", "told")

    def __init__(self, at: int, name: str, terms: list[tuple]):
        self.at, self.name, self.terms, self.features, self.told = at, name, terms, None, False


def read_value(text: str, at: int, bare: bool = True, arguments: bool = False) -> tuple[list[tuple], int]:
    """The terms of the expression that starts at ``at``, and where it ends."""
    terms: list[tuple] = []
    while True:
        word = False
        if (m := STRING.match(text, at)):
            start, end = next(m.span(g) for g in "tdsb" if m[g] is not None)
            inner = REFERENCE.fullmatch(text, start, end)
            terms.append((start, end, True, next(x for x in inner.groups() if x) if inner else None))
        elif (m := REFERENCE.match(text, at)):
            terms.append((*m.span(), False, next(x for x in m.groups() if x)))
        elif bare and (m := WORD.match(text, at)):
            follows = text[m.end():m.end() + 1]
            if follows == "(":   # what a function is given counts as part of what it returns
                given, end = read_value(text, SPACE.match(text, m.end() + 1).end(), bare=False, arguments=True)
                return terms + given[1 if ASKS.search(m[0]) else 0:], max(end, m.end() + 1)
            if follows == "[":
                return terms, m.end()
            word = True
            terms.append((*m.span(), False, m[0].lstrip("$") if IDENTIFIER.match(m[0]) else None))
        else:
            return terms, at
        at = m.end()
        if word and not JOINED.match(text, at):   # a bare word stands alone unless something joins it
            return terms, at
        step = (ARGUMENT if arguments else JOIN).match(text, at)
        if step["by"] is None and not text.startswith(('"', "'"), step.end()):   # strings side by side are one
            return terms, at
        at = step.end()


def read_pairs(text: str) -> list[Pair]:
    """All pairs of a text, by place."""
    pairs, at = [], 0
    while (m := SITE.search(text, at)):
        at = m.end()
        name = m["name"].lstrip("$")
        if m["second"] is not None:   # a type stands before the name, or after it
            second = m["second"].lstrip("$")
            name = name if name_weight(name) > name_weight(second) else second
        start = SPACE.match(text, at).end()
        if m["element"] is not None:
            end = text.find("<", start, start + len(text))
            if text[m.start("name") - 1:m.start("name")] == "<" and text.startswith(f"</{name}", end):
                pairs.append(Pair(m.start(), name, [(start, end, True, None)]))
            continue
        if (scheme := SCHEME.match(text, start)):
            start = scheme.end()
        terms, end = read_value(text, start, bare=m["call"] is None)
        if terms:
            pairs.append(Pair(m.start(), name, terms))
            s, e, _, refers = terms[-1]
            at = max(at, s if refers and e == end else end)   # a last bare word may itself be a name that gets a value
    return pairs


class Constants:
    """What the names of a text stand for: at a place, the last value before it, or else the first."""

    def __init__(self, pairs: list[Pair]):
        self.of: dict[str, tuple[list[int], list[Pair]]] = {}
        for p in pairs:
            for name in {p.name, OWNER.split(p.name)[-1]}:
                places, values = self.of.setdefault(name, ([], []))
                places.append(p.at)
                values.append(p)

    def value(self, term: tuple, user: Pair) -> Pair | None:
        if term[3] is None:
            return None
        known = self.of.get(term[3]) or self.of.get(OWNER.split(term[3])[-1])
        if not known:
            return None
        k = bisect_left(known[0], user.at)
        found = known[1][k - 1 if k else 0]
        return found if found is not user else None


def outside(text: str, term: tuple) -> bool:
    """Whether a term refers, by its syntax, to something that only the surroundings know."""
    return term[3] is not None and (term[2] or text.startswith(("$", "{{", "%"), term[0]))


def settle(text: str, top: Pair, constants: Constants) -> None:
    """Features of a pair and of all that it depends on; names in a circle add nothing. Without recursion, as chains may be long."""
    todo, open_pairs = [top], set()
    while todo:
        p = todo[-1]
        if p.features is not None:
            todo.pop()
            continue
        needed = [constants.value(t, p) for t in p.terms]
        if id(p) not in open_pairs:
            open_pairs.add(id(p))
            missing = [q for q in needed if q is not None and q.features is None and id(q) not in open_pairs]
            if missing:
                todo += missing
                continue
        parts = []
        for t, q in zip(p.terms, needed):
            if q is not None:
                parts.append(q.features or (0, 0, True, False))
            elif not outside(text, t):
                parts.append(value_features(text[t[0]:t[1]], t[2]))
        p.features = together(parts) if parts else (0, 0, True, False)
        todo.pop()


def literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of the strings that secret names receive; each string once, under the first name."""
    if not STEM.search(text):
        return []
    pairs = read_pairs(text)
    constants = Constants(pairs)
    found: dict[tuple[int, int], tuple[str, float]] = {}
    for p in pairs:
        weight = name_weight(p.name)
        if weight < LEAST:
            continue
        settle(text, p, constants)
        score = weight * value_weight(p.features)
        if score < LEAST:
            continue
        todo = [p]
        while todo:
            q = todo.pop()
            if q.told:
                continue
            q.told = True
            for t in q.terms:
                held = constants.value(t, q)
                if held is not None:
                    todo.append(held)
                elif t[1] > t[0] and not outside(text, t):
                    found.setdefault((t[0], t[1]), (p.name, score))
    return sorted((s, e, name, score) for (s, e), (name, score) in found.items())


def find_spans(text: str | None) -> list[dict]:
    """All secrets of a text, by start and kind: kind, start, end (code points), the name that receives it, score."""
    if not text:
        return []
    spans = [(m.start(), 0, m.end(), m[1], 1.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), 1, m.end(), None, 1.0) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), None, 1.0) for m in HEX.finditer(text)]
    spans += [(s, 3, e, name, score) for s, e, name, score in literals(text)]
    return [{"kind": KINDS[k], "start": s, "end": e, "name": name, "score": score} for s, k, e, name, score in sorted(spans, key=lambda x: x[:3])]


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and spans, an array of (kind, start, end, name, score) by start and kind.

    Kinds assign, access and hex are fixed patterns; literal is a string, without its
    quotes, that a secret name receives, directly or through constants of the same text.
    Null and empty texts have no spans; null doc_ids and repeated rows are returned
    each; other columns are ignored. One text is held whole in one task, with its pairs.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").array, "spans": [find_spans(t) for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, spans array<struct<kind string, start long, end long, name string, score double>>")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed patterns, the digest of their spans, and all spans as kind:start:end."""
    base = F.filter("spans", lambda s: s["kind"] != "literal")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_secrets(docs).select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
