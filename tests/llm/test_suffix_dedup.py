import hashlib
import random

from levybook.llm import suffix_dedup

from .cases import documents, empty, prose, texts


def brute(rows, length=100):
    return sorted(brute_in_order(rows, length))


def brute_in_order(rows, length=100):
    """Every string of every text in a set, in order of (doc_id, digest of the text, start)."""
    seen, out = {}, []
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for d, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], digest(r[1]))):
        data, key = (t or "").encode(), (d, digest(t))
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if seen.setdefault(data[i:i + length], (key, i)) != (key, i):
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((-1 if d is None else d, len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def got(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_cases(spark):
    assert got(suffix_dedup.suffix_dedup(documents(spark))) == brute(texts())


def test_passages_and_edited_copies_over_small_runs(spark, monkeypatch):
    # the functions travel to the tasks by reference, so small sizes are set through the tasks' module too
    r, rows = random.Random(3), []
    passages = [prose(k, 30) for k in range(4)]
    for d in range(150):
        parts = [prose(1000 + d % 60, r.randint(5, 60))]
        parts += r.sample(passages, r.randint(0, 3))
        t = list(" ".join(parts))
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = "#"
        rows.append((d, "".join(t)))
    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 20_000)
    assert got(suffix_dedup.suffix_dedup(documents(spark, rows))) == brute(rows)


def test_periodic_and_multibyte_texts(spark):
    rows = [(1, "ab" * 300), (2, "ab" * 80), (3, "é" * 200), (4, "xé" * 120 + "é" * 100), (5, "q" + "ab" * 60), (6, "\x00" * 150), (7, "\x00" * 149 + "\x01")]
    assert got(suffix_dedup.suffix_dedup(documents(spark, rows))) == brute(rows)
    kept = {r["doc_id"]: r for r in suffix_dedup.without_repeats(documents(spark, rows)).collect()}
    assert set(kept) >= {1, 3} and 2 not in kept and kept[1]["text"].startswith("ab")
    assert kept[1]["n_chars"] == len(kept[1]["text"])


def test_front_coding_and_loser_tree():
    r = random.Random(2)
    runs = [sorted((bytes(r.choice(b"ab") for _ in range(r.randint(36, 60))), b"l", r.randrange(9), r.randrange(3) if k else 0, r.randrange(99)) for _ in range(r.randint(0, 60))) for k in range(7)]
    for run in runs:
        if run:
            assert [(s, x, *place) for s, _, x, *place in suffix_dedup.decoded(suffix_dedup.front_code(run))] == run
    out = list(suffix_dedup.merged([suffix_dedup.decoded(suffix_dedup.front_code(run)) if run else iter(()) for run in runs]))
    assert [o[0] for o in out] == sorted(s for run in runs for s, *_ in run)
    assert all(o[1] == suffix_dedup.shared_prefix(a[0], o[0]) for a, o in zip(out, out[1:]))


def test_hot_line_in_different_contexts(spark, monkeypatch):
    """A line in every text goes by hash: no suffix at it is sorted in one task, and the result is the same."""
    r = random.Random(5)
    line = prose(7, 8)[:48]
    rows = [(d, f"{prose(100 + d % 90, r.randint(0, 40))} {line} {prose(300 + d % 70, r.randint(0, 40))}") for d in range(200)]
    rows += [rows[3], (None, rows[5][1] + " end"), (500, f"{line} {line} {prose(1, 9)} {line} {line}"), (501, line * 9)]
    most, judge = [], suffix_dedup.sorted_runs
    monkeypatch.setattr(suffix_dedup, "sorted_runs", lambda c: most.append(c.selectExpr("explode(pieces) AS p").groupBy("p").count().agg({"count": "max"}).first()[0] or 0) or judge(c))
    for bound in (20, 1):
        monkeypatch.setattr(suffix_dedup, "HOT", bound)
        assert got(suffix_dedup.suffix_dedup(documents(spark, rows))) == brute_rows(rows)
    assert max(most) <= 20


def brute_rows(rows):
    """``brute`` with a row for each repeated row."""
    distinct = list(dict.fromkeys(rows))
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    texts_of = {}
    for d, t in distinct:   # null and the empty text are one
        texts_of.setdefault((d, digest(t)), (d, t))
    order = sorted(texts_of, key=lambda k: (-1 if k[0] is None else k[0], k[1]))
    per = dict(zip(order, brute_in_order(list(texts_of.values()))))
    return sorted(per[d, digest(t)] for d, t in rows)


def test_empty(spark):
    assert suffix_dedup.suffix_dedup(empty(spark)).collect() == []
    assert suffix_dedup.without_repeats(empty(spark)).collect() == []


def test_texts_of_one_id_are_documents_of_their_own(spark):
    """Null and repeated ids hold many texts, some with digests that begin alike; a passage stays in the first of them."""
    shared, first, rows = prose(1, 40), {}, []
    for k in range(2000):   # two texts whose digests share their first 20 bits
        text = f"{shared} {k}"
        start = hashlib.sha256(text.encode()).hexdigest()[:5]
        if start in first:
            rows = [(None, first[start]), (None, text), (7, first[start]), (7, text), (7, text), (9, shared), (10, None), (10, "")]
            break
        first[start] = text
    assert rows
    rows += [(None, f"{shared} {prose(k, 9)}") for k in range(50)]
    for some in (rows[:2], rows[2:4], rows):
        assert got(suffix_dedup.suffix_dedup(documents(spark, some))) == brute_rows(some)
    left = suffix_dedup.without_repeats(documents(spark, rows[:2])).collect()
    assert sum(shared in r["text"] for r in left) == 1


def test_ranges_are_cut_at_pieces(spark, monkeypatch):
    """Suffixes that begin alike for over seven bytes are dealt to several ranges."""
    rows = [(d, f"the same seven {prose(d % 40, 30)} the same seven {prose(d % 23, 25)}") for d in range(120)]
    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 3000)
    assert got(suffix_dedup.suffix_dedup(documents(spark, rows))) == brute(rows)
