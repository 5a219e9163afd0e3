"""Fill-in-the-middle against a text-at-a-time version, and the way back."""
import hashlib
import random
import re

import numpy as np

from levybook.llm import fill_in_middle as fim

from .cases import documents, empty, prose, texts

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_rows():
    r = random.Random(3)
    pieces = ["<P>", "<S>", "<M", "<", ">", "P>", " ", "\n", "\t\x0b", "é", "日本", "word", " ", "\x1c", "𝒳", "<S", "M>"]
    return [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 30)))) for i in range(1000, 1400)]


def key(row):
    return tuple((x is None, x) for x in row)


def test_outputs_equal_text_at_a_time(spark):
    rows = texts() + odd_rows() + [(5000 + i, prose(i, 5000) + " " * (i % 3)) for i in range(8)]
    got = fim.fill_in_middle(documents(spark, rows)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert sorted(map(tuple, got), key=key) == sorted((brute(*r) for r in rows), key=key)
    assert {g["form"] for g in got} == {"plain", "psm", "spm"}


def test_outputs_give_their_texts_back(spark):
    rows = texts() + odd_rows()
    out = fim.restored(fim.fill_in_middle(documents(spark, rows)).withColumnRenamed("n", "restored"))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["restored"]) for r in out.collect() if r["doc_id"] is not None) == sorted((False, d, t or "") for d, t in rows if d is not None)
    made = spark.createDataFrame([("<P>a <S<S> c<M> b", "psm"), ("<S> c<P>a<M<M> b", "spm"), ("as <P> is", "plain"), (None, "plain"), ("kept", None)], "output string, form string")
    assert sorted(r["restored"] for r in fim.restored(made).collect()) == sorted(["a <S b c", "a<M b c", "as <P> is", "", "kept"])


def test_digests(spark):
    rows = texts()
    got = sorted((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in fim.fim_digests(documents(spark, rows)).collect() if r["doc_id"] is not None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted((d, sha(brute(d, t)[5]), sha(t or "")) for d, t in rows if d is not None)
    assert fim.fim_digests(empty(spark)).collect() == []


def test_slices_do_not_change_shifts(monkeypatch):
    rows = [t for _, t in odd_rows()]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in rows])))
    form = np.array([k % 3 for k in range(len(rows))])
    form[fim.mark_places(data, at)[1]] = fim.PLAIN
    first = at[:-1] + (at[1:] - at[:-1]) // 3
    second = at[:-1] + (at[1:] - at[:-1]) // 2
    whole, whole_at = fim.scattered(data, at, form, first, second)
    monkeypatch.setattr(fim, "SLICE", 7)
    parts, _ = fim.scattered(data, at, form, first, second)
    assert (whole == parts).all()
    back, back_at = fim.gathered(whole, whole_at, form)
    assert (back == data).all() and (back_at == at).all()
