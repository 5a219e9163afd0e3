import os
from pathlib import Path

import pandas as pd
import pytest

from levybook.llm import sentencepiece_codec, token_counts
from levybook.llm.queries import BPE_FILE, PIECE_FILE, tokenizer_file

from .cases import documents, empty, texts

EXTRA = ["don't we'll they've", "aaab" * 500, "!" * 700, "<|endoftext|>a<|endoftext|>", "\n\n \t x  y", "​zero 　wide", "<0x41> <s></s><unk>", "▁a▁▁ ▁b", "é", "🎉🎉 ok"]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_file(BPE_FILE))
    rows = texts() + [(100 + i, t) for i, t in enumerate(EXTRA)]
    want = sorted((-1 if d is None else d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 40) for d, t in rows)
    got = token_counts.token_counts(documents(spark, rows), tokenizer_file(BPE_FILE), limit=40).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want


def test_codec_equals_sentencepiece(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE_FILE))
    rows = texts() + [(100 + i, t) for i, t in enumerate(EXTRA)]
    want = sorted((-1 if d is None else d, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for d, t in rows)
    got = sentencepiece_codec.encode_decode(documents(spark, rows), tokenizer_file(PIECE_FILE)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"], r["decoded"]) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert all(r["round_trip"] for r in got if r["doc_id"] not in (20, 107))   # texts with the marker itself decode to spaces


def test_unigram_model(tmp_path):
    """A hand-written unigram model with byte fallback, as the wire format has it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    for piece, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3)] + [(f"<0x{b:02X}>", 6) for b in range(256)]:
        m.pieces.add(piece=piece, score=0.0, type=kind)
    for i, piece in enumerate(["▁", "▁ab", "ab", "a", "b", "c", "▁c", "abc", "▁abc"]):
        m.pieces.add(piece=piece, score=-1.0 - i / 7, type=1)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.normalizer_spec.name = 1, True, "identity"
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert sentencepiece_codec.parity_errors(["abc ab c", "", "  abcab   cab ", "a", "zabz é"], str(path)) == []


def test_empty(spark):
    assert token_counts.token_counts(empty(spark), tokenizer_file(BPE_FILE)).collect() == []
    assert sentencepiece_codec.encode_decode(empty(spark), tokenizer_file(PIECE_FILE)).collect() == []



def test_compared_texts_are_not_encoded_twice():
    """op5: sentencepiece is compared with the ids and texts that the job gives out, which are not made again."""
    path = tokenizer_file(PIECE_FILE)
    own, lines = sentencepiece_codec.Codec(path), ["a plain line", "two  spaces", "", "naïve café 日本"]
    ids = own.encode(lines)
    back = [own.decode(i) for i in ids]
    own.encode = None   # whatever encodes again fails
    assert sentencepiece_codec.parity_errors(lines, path, own, (ids, back)) == []
    assert sentencepiece_codec.parity_errors(lines, path, own, ([ids[1], *ids[1:]], [*back[:3], "x"])) == [0, 3]


def test_stretches_are_whole_words():
    """op5: texts are cut before a mark that follows another character, and nowhere else."""
    cut = sentencepiece_codec.stretches
    assert list(cut("▁ab▁cd▁▁▁ef▁", 3)) == ["▁ab", "▁cd", "▁▁▁ef", "▁"]
    assert list(cut("")) == [] and list(cut("▁" * 5000)) == ["▁" * 5000] and list(cut("x" * 5000 + "▁y")) == ["x" * 5000, "▁y"]
    line = "▁some▁words▁▁▁and▁日本" * 700
    assert "".join(cut(line)) == line and max(map(len, cut(line))) < 1100


def test_stretches_equal_sentencepiece():
    """op5: long texts whose spaces, marks, byte pieces and long words lie anywhere around a stretch's end."""
    import random
    draw, path = random.Random(5), tokenizer_file(PIECE_FILE)
    words = ["the", "naïve", "日本語", "🎉", "\n", "\t", "", " ", "  ", "▁", "▁▁x", "a▁b", "x" * 300, "<s>", "<0x41>", "\u0301", "\u3000", "don't", "3.14"]
    lines = [" ".join(draw.choices(words, k=n)) for n in (1, 2, 30, 300, 3000) for _ in range(12)] + [" " * k for k in range(1, 40)] + [" " * 5000, "x" * 5000, "a" * 1023 + "  b" * 3]
    assert sentencepiece_codec.parity_errors(lines, path) == []


def test_words_with_user_pieces(tmp_path):
    """A BPE model with a piece of its own, and one that squeezes spaces, are as sentencepiece has them."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    for k, (user, squeeze) in enumerate([("[X]", False), (None, True)]):
        m = pb.ModelProto()
        for piece, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3)] + [(f"<0x{b:02X}>", 6) for b in range(256)] + [(user, 4)] * bool(user):
            m.pieces.add(piece=piece, score=0.0, type=kind)
        for i, piece in enumerate(["▁a", "ab", "▁ab", "abc", "▁", "a", "b", "c"]):
            m.pieces.add(piece=piece, score=-float(i), type=1)
        m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.normalizer_spec.name = 2, True, "identity"
        m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = squeeze, not user
        path = tmp_path / f"{k}.model"
        path.write_bytes(m.SerializeToString())
        lines = ["abc ab c", "", "  abcab   cab ", "   ", "zabz é", "ab abc " * 900] + ["ab[X]c [X] a"] * bool(user)
        assert sentencepiece_codec.parity_errors(lines, str(path)) == [], user


def test_a_task_encodes_on_one_core():
    """op5: the library's threads, one a core, would compete with the other tasks of the executor."""
    import subprocess
    import sys
    code = ("import random, time; from levybook.llm.sentencepiece_codec import Codec; c, d = Codec(%r), random.Random(1);"
            "texts = [' '.join(''.join(d.choices('etaoinshr', k=6)) for _ in range(400)) for _ in range(1000)]; c.encode(texts[:50]);"
            "cpu, wall = time.process_time(), time.time(); c.encode(texts); print(time.process_time() - cpu, time.time() - wall)") % tokenizer_file(PIECE_FILE)
    env = os.environ | {"TOKENIZERS_PARALLELISM": "true"}
    root = str(Path(sentencepiece_codec.__file__).parents[2])
    cpu, wall = map(float, subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, check=True).stdout.split())
    assert cpu < 1.3 * wall


def test_every_text_is_compared(spark):
    """op5: sentencepiece encodes all texts too, whatever they hold, and a difference anywhere ends the job."""
    rows = texts() + [(200 + i, f"line {i} of plain words") for i in range(300)]
    got = sentencepiece_codec.encode_decode(documents(spark, rows), tokenizer_file(PIECE_FILE)).collect()
    assert len(got) == len(rows) and all(r["checked"] for r in got)


def test_a_difference_in_any_text_ends_the_job(spark, monkeypatch):
    """op5: the plan's own function, on a codec that is wrong for one rare text."""
    path, run = tokenizer_file(PIECE_FILE), []
    docs = documents(spark, [(1, "plain")])
    monkeypatch.setattr(sentencepiece_codec, "lean", lambda f: run.append(f) or f)
    sentencepiece_codec.encode_decode(docs, path)
    whole = sentencepiece_codec.Codec.encode
    monkeypatch.setattr(sentencepiece_codec.Codec, "encode", lambda self, ts: [i[:-1] if t == "rare 17" else i for t, i in zip(ts, whole(self, ts))])
    for rare in range(15, 20):
        lines = [f"line {k}" for k in range(30)] + [f"rare {rare}"]
        batch = pd.DataFrame({"doc_id": range(31), "text": lines, "n_bytes": 6})
        if rare == 17:
            with pytest.raises(ValueError, match="doc_id 30"):
                list(run[0](iter([batch])))
        else:
            assert sum(len(b) for b in run[0](iter([batch]))) == 31
