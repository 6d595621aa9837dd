"""Character classes: the whole text is read once, the other classes look at what is left of it."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from postlens.llm.quality import class_counts

TEXTS = ["", "abc", "Aa1 éİǅ́   \U0001F600x#*.-\t\n", "À 世界 ٣ ª (a|b), 'c'!", "A-b. 9% <c>\r\n~"]


def brute(text: str) -> list[int]:
    out = [0] * 8
    for c in text:
        kind = next((i for i, k in enumerate(("Ll", "Lu", "Lo Lm Lt Mn Mc Me", "Nd")) if unicodedata.category(c) in k.split()), None)
        if kind is None:
            kind = 4 if re.match(r"[\x20\x09-\x0D]", c) else 5 if c in ".,;:!?'\"()-" else 6 if c in "#*$%&|<>" else 7
        out[kind] += 1
    return out


def test_whole_text_is_read_once(spark):
    assert str(class_counts(F.col("t"))).count("regexp_replace(t,") == 2  # one for ASCII texts, one for others


def test_classes_count_every_character(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", class_counts(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == {t: brute(t) for t in TEXTS}
