"""Phrases against a plain count, and the bounds of the summaries."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from levybook.llm import collocations as col

from .cases import documents, empty, prose, texts


def word_lists(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [ws for piece in re.split(r"[.,;:!?\x0A-\x0D]", text) if (ws := [w for w in re.split(r"[\x20\x09]+", piece) if w])]


def brute(rows, threshold, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for ws in word_lists(text):
            n[lang or "und"] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang or "und", tuple(ws[i:i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= threshold}
    out = {}
    for (lang, ws), a in candidates.items():
        if any(x == lang and len(long) > len(ws) and 100 * b >= 100 * a and any(long[i:i + len(ws)] == ws for i in range(len(long) - len(ws) + 1)) for (x, long), b in candidates.items()):
            continue
        score, _, l, r = min(((1000 * a * n[lang]) // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), l, r, n[lang]))
    return sorted((lang, k + 1, p.decode(), -a, l, r, m, -s) for lang, found in out.items() for k, (s, a, p, l, r, m) in enumerate(sorted(found)[:top]))


def sample():
    r = random.Random(8)
    vocab = ["a", "b", "New", "york", "Été", "日本", "x" * 50]
    rows = [(r.choice(["en", "de", None, "und"]), " ".join(r.choice(vocab) + r.choice(["", "", "", ".", "\t", "  ", ",\n"]) for _ in range(r.randint(0, 60)))) for _ in range(150)]
    rows += [("en", "of the of the of the town hall"), ("en", "a a a a a a")] * 30 + [("de", None), ("de", ""), (None, " \t.,!"), ("fr", "\x00 odd \x1c words \x00 odd")] * 3
    return rows


@pytest.mark.parametrize("threshold,top", [(3, 2000), (20, 2000), (5, 7)])
def test_phrases_equal_a_plain_count(spark, threshold, top):
    rows = sample()
    docs = spark.createDataFrame([(lang, t, 5, "p", 1.5) for lang, t in rows], "lang string, text string, f int, phrase string, n double").repartition(5)
    assert sorted(map(tuple, col.collocations(docs, threshold=threshold, top=top).collect())) == brute(rows, threshold, top)


def test_odd_documents(spark):
    docs = documents(spark, texts() * 3)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, col.collocations(docs, threshold=6).collect())) == brute(rows, 6)
    assert col.collocations(empty(spark)).collect() == []


def test_no_frequent_key_leaves_a_summary():
    r = np.random.default_rng(1)
    for threshold in (5, 40):
        keys = np.concatenate([r.zipf(1.3, 20000) % 5000, r.integers(5000, 60000, 30000)]).astype(np.uint64)
        r.shuffle(keys)
        summary = col.Summary(len(keys) // threshold + 1)
        for k in range(0, len(keys), 777):   # parts of any size, some of them summaries themselves
            part = keys[k:k + 777]
            summary.add(*col.summed(part, np.ones(len(part), np.int64)))
        true = Counter(keys.tolist())
        held = dict(zip(summary.hashes.tolist(), summary.counts.tolist()))
        assert len(held) <= summary.capacity and summary.taken < threshold
        assert all(held.get(k, 0) <= c <= held.get(k, 0) + summary.taken for k, c in true.items())
        assert all(k in held for k, c in true.items() if c >= threshold)


def test_packing():
    h, c = np.array([9, 1 << 63, 4], np.uint64), np.array([1, 5, 1 << 40])
    got = dict(zip(*(x.tolist() for x in col.unpacked(col.packed(h, c)))))
    assert got == {9: 1, 1 << 63: 5, 4: 1 << 40}


def test_windows_hold_every_word_once(monkeypatch):
    rows = [prose(k, 300).replace("ra", "ra.") for k in range(6)] + ["", None, "word" * 100, "UPPER lower"]
    whole = [h for w, in zip(col.windows(rows, ["en"] * len(rows), col.Powers())) for h in w.hashes[0].tolist()]
    monkeypatch.setattr(col, "WINDOW", 64)
    small = [(h, t) for w in col.windows(rows, ["en"] * len(rows), col.Powers()) for h, t in zip(w.hashes[0].tolist(), w.text.tolist())]
    assert [h for h, _ in small] == whole and len(whole) == sum(len(ws) for t in rows for ws in word_lists(t))
    assert Counter(t for _, t in small) == Counter({k: n for k, t in enumerate(rows) if (n := sum(map(len, word_lists(t))))})
