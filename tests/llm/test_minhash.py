import random

from levybook.llm import minhash
from levybook.llm.common import words
from levybook.llm.components import components

from .cases import documents, empty, prose, texts


def brute(rows, size, percent):
    """Components by comparing every two documents."""
    def shingles(t):
        ws = words(t)
        return frozenset(tuple(ws[i:i + size]) for i in range(len(ws) - size + 1)) if len(ws) >= size else frozenset([tuple(ws)] if ws else [])
    ids = sorted({d for d, _ in rows if d is not None})
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1:]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = sorted((-1 if d is None else d, len(shingles(t)), -1 if d is None else find(d)) for d, t in rows)
    return out


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in rows)
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in rows)


def test_cases(spark):
    assert got(minhash.near_duplicates(documents(spark), 3, 85)) == brute(texts(), 3, 85)


def test_chains_of_edits_and_many_copies(spark):
    r, rows = random.Random(5), []
    for g in range(6):
        ws = prose(100 + g, 80).split()
        for k in range(40):   # every edit starts from the one before, so the ends of a chain are not alike
            ws = list(ws)
            ws[r.randrange(len(ws))] = f"w{r.randrange(9999)}"
            rows.append((g * 100 + k, " ".join(ws)))
    rows += [(1000 + k, prose(77, 50)) for k in range(30)]
    for percent in (85, 80):
        assert got(minhash.near_duplicates(documents(spark, rows), 3, percent)) == brute(rows, 3, percent)


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    ws = prose(9, 60).split()
    rows = []
    for k in range(120):
        v = list(ws)
        v[k % 58], v[(k * 7) % 58] = f"q{k % 5}", f"z{k}"
        rows.append((k, " ".join(v)))
    assert got(minhash.near_duplicates(documents(spark, rows), 3, 85)) == brute(rows, 3, 85)


def test_empty(spark):
    assert minhash.near_duplicates(empty(spark)).collect() == []


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 7)]
    random.Random(1).shuffle(links)
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
