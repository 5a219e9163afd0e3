"""The corpus pipeline against a brute-force version of its stages, and its contract."""
import pandas as pd
import sentencepiece

import __spark_entry__
import corpus_pipeline
from levybook.llm import decontaminate, sentencepiece_codec, suffix_dedup
from levybook.llm.queries import PIECE_FILE, tokenizer_file

from .cases import SCHEMA, documents, prose
from .test_learned import code_length
from .test_minhash import brute as brute_groups
from .test_pages_merkle_leaks import distance

GERMAN = ["der die das und ist nicht mit einem auf für von dem schön über straße zwischen wieder heute", "ein haus steht auf dem berg und die sonne scheint über das grüne tal"]
ENGLISH = ["the and is not with a on for from this beautiful over street between again today", "a house stands on the hill and the sun shines over the green valley"]


def rows():
    long = prose(1, 150)
    out = [(1, ENGLISH[0] + " " + prose(20, 60), "en"), (2, GERMAN[0] + " " + prose(21, 60), "de"), (3, ENGLISH[1] + " " + long, "en"), (4, ENGLISH[1] + " " + long + " tail", "en"),
           (5, "1234 !!", "en"), (6, None, "de"), (7, "", None), (8, GERMAN[1] + " " + prose(22, 80), "de"), (9, ENGLISH[0] + " " + prose(30, 40), "en"),
           (10, prose(31, 60) + " " + " ".join(prose(1, 150).split()[20:70]) + " " + prose(32, 30), "en"), (11, prose(33, 40) + " " + prose(90, 30) + " end", "en"), (12, long, "en"), (13, long, "en")]
    return out


def tables(spark, tmp_path):
    docs = spark.createDataFrame([(d, t, lang, "src", None if t is None else len(t)) for d, t, lang in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, prose(90, 30)), (2, None), (3, "")], "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs


def brute_pipeline():
    train = {lang: [t for _, t, x in rows() if x == lang and t] for lang in ("en", "de")}
    docs = []
    for d, t, _ in rows():
        if t and any(c.isalpha() for c in t):
            bits = sorted(code_length(train[lang], t, 3, set()) for lang in train)
            if 1 / (1 + 2 ** -(bits[1] - bits[0])) >= 0.5:
                docs.append((d, t))
    kept = {d for d, _, root in brute_groups(docs, 5, 80) if d == root}
    docs = [(d, t) for d, t in docs if d in kept]
    seen, left = set(), []
    for d, t in docs:
        data = t.encode()
        gone = [False] * len(data)
        for i in range(len(data) - 99):
            if data[i:i + 100] in seen:
                gone[i:i + 100] = [True] * 100
            seen.add(data[i:i + 100])
        rest = bytes(b for b, g in zip(data, gone) if not g).decode()
        if rest:
            left.append((d, rest))
    item = decontaminate.normal(prose(90, 30))
    left = [(d, t) for d, t in left if distance(item, decontaminate.normal(t)) > int(0.08 * len(item))]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE_FILE))
    return sorted((d, sp.encode(t)) for d, t in left)


def test_run_equals_brute_force(spark, tmp_path):
    tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute_pipeline()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == want
    assert {d for d, _ in want} >= {1, 2, 3, 8, 9, 10} and not {d for d, _ in want} & {4, 5, 6, 7, 11, 13}


def test_stages_keep_columns_and_take_any_table(spark, tmp_path):
    tables(spark, tmp_path)
    odd = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        if name != "sentencepiece":
            assert out.schema.names == odd.schema.names, name
            odd = out
        out.collect()
        empty = stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path))
        assert empty.collect() == [], name


def test_stages_leave_clean_documents(spark):
    """A table of different texts in a known language comes through whole."""
    docs = spark.createDataFrame([(i, f"{ENGLISH[i % 2]} {prose(500 + i, 50, 4000)}", "en", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == set(range(40)), name


def test_rows_without_a_doc_id_are_judged(spark):
    """Copies and leaked passages go whether they have a doc_id or not; what is clean stays."""
    base, own = prose(1, 60), prose(2, 60)
    docs = spark.createDataFrame([(None, base), (3, base), (None, base + " end"), (None, own), (None, own), (4, own + " more words"), (None, prose(5, 50)), (None, None), (None, "")], "doc_id long, text string")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(3, base), (4, own + " more words"), (0, prose(5, 50)), (0, ""), (0, "")])
    bench = spark.createDataFrame([(1, prose(5, 20))], "item_id long, text string")
    assert sorted(r["text"] or "" for r in decontaminate.clean(docs, bench).collect()) == sorted(t for t in [base, base, base + " end", own, own, own + " more words", "", ""])


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None and "pipeline" not in __spark_entry__.oracle_sql()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))


def test_cuts_keep_whole_characters(spark):
    """é and è share their first byte, so the repeated bytes end inside a character."""
    shared = prose(8, 40)
    docs = spark.createDataFrame([(1, f"ê{shared}é"), (2, f"ô{shared}è")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs).collect()}
    assert got == {1: f"ê{shared}é", 2: "ôè"}


def test_texts_are_cut_in_one_python_step(spark):
    """A second one would hold a second worker beside the first in every task."""
    shared = prose(8, 40)
    docs = spark.createDataFrame([(1, f"a {shared} b", 9), (2, f"c {shared} d", 9), (3, "x", 1), (4, shared, 1), (5, None, None), (6, "", 0)], "doc_id long, text string, n_chars long")
    got = suffix_dedup.without_repeats(docs)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, got.collect())) == [(1, f"a {shared} b", 9), (2, "cd", 2), (3, "x", 1), (5, None, None), (6, "", 0)]


def test_one_rebuilt_model_a_worker(spark, monkeypatch):
    """Threads of the tokenizers library keep their caches of every model that was built, so tasks share one."""
    docs = spark.createDataFrame([(1, ENGLISH[0])], "doc_id long, text string")
    steps, built = [], []
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, f, schema: steps.append(f))
    monkeypatch.setattr(sentencepiece_codec, "Codec", lambda path, whole=sentencepiece_codec.Codec: built.append(path) or whole(path))
    sentencepiece_codec.codec.cache_clear()
    corpus_pipeline.token_ids(spark, docs, "")
    batch = pd.DataFrame({"doc_id": [1], "text": [ENGLISH[0]], "n_bytes": [len(ENGLISH[0])]})
    one, two = (pd.concat(steps[0](iter([batch]))) for _ in range(2))
    assert len(built) == 1 and one["ids"].iloc[0].tolist() == two["ids"].iloc[0].tolist()
    assert one["decoded"].tolist() == [ENGLISH[0]]


def test_every_text_of_the_last_stage_is_compared(spark):
    """Whatever the stages before leave, sentencepiece encodes all of it too."""
    docs = spark.createDataFrame([(k, prose(k, 30)) for k in range(300)] + [(300, None), (301, ""), (None, "naïve 日本")], "doc_id long, text string")
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(got) == 303 and all(r["checked"] for r in got)
