"""Documents with nulls, empty and long texts, ties and repeated rows, and columns whose names the operators also use."""
from __future__ import annotations

import random

from pyspark.sql import SparkSession

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, component_id long, score double, piece string, at string, bucket string, "
          "variant int, key string, same string, `end` string, n int, digest string")


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    vocab = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(words)]
    return " ".join(r.choice(vocab) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base, other = prose(1, 120), prose(2, 90)
    ws = base.split()
    near = " ".join(ws[:60] + ["changed"] + ws[61:])
    shared = prose(3, 40)
    rows = [(1, base), (2, base), (3, near), (4, other), (5, f"{shared} {prose(4, 30)}"), (6, f"{prose(5, 30)} {shared}"), (7, None), (8, ""), (9, "   \n\t "),
            (10, "word"), (11, "WORD"), (12, "two words"), (13, "a" * 900), (14, "Ünïcödé text ✓ 日本語 " * 12), (15, "x"), (16, "12 34 !!"), (None, base), (None, None),
            (17, f"{shared}\n\n{shared}"), (18, "line one\nline two\n\nsecond section. Next. " * 8), (4, other), (19, prose(6, 6000)), (12, near), (21, near), (20, "\x00\x01 odd \x0b bytes <|endoftext|> <s> ▁▁")]
    return rows


def documents(spark: SparkSession, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(d, t, "en" if d and d % 2 else "de", None, None, 7, 0.1, "p", "a", "b", 1, "k", "s", "e", 3, "d") for d, t in rows], SCHEMA).repartition(3)


def empty(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)
