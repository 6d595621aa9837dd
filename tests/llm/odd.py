"""Rows that operators must take: nulls everywhere, empty and very long texts, ties, repeats, columns with clashing names."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
NEAR = [f"t{i}" for i in range(60)]


def near(*changes: int) -> str:
    return " ".join(f"x{i}" if i in changes else w for i, w in enumerate(NEAR))


TEXTS = [
    None, "", "   \n\t ", "one", "two words", "a b c d e", "a b c d e", "A B C D E", LONG, LONG + " tail",
    near(), near(59), near(0), near(0, 59), near(30), "\n".join([near(), near(5), near()]),
    "café naïve 中文 \U0001f600 <|endoftext|>", "x\x0by\x0cz w", "same  text here", "same text\there",
]
SOURCES = [None, "", "b", "B", "é", "src0"]


def documents(spark, extra: bool = True):
    rows = [(i, t, None if i % 5 == 0 else "en", SOURCES[i % len(SOURCES)], len(t) if t else 0) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[10], (None, near(), None, None, None), (None, None, None, None, None), (3, "another text under a used id", "en", "b", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        names = ["size", "kept", "keep_id", "n_words", "_text", "label", "key", "_parts", "n_lines", "shard", "score", "id", "print", "_print"]
        frame = frame.selectExpr("*", *[f"'own' as {n}" for n in names])
    return frame


def empty(spark):
    return documents(spark, False).limit(0)
