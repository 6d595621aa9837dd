"""Readers of corpora, lexicons and result files.

Text files split on tabs without any quoting, one record per line feed. A gzip file cannot
be split, so one file is one task: give a folder of many files, or spread the rows after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import dense_index


def _field(index: int) -> Column:
    return F.split("value", "\t")[index]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def read_tsv(spark: SparkSession, path: str, columns: dict[str, int], numbered: bool = False,
             spread: int | None = None) -> DataFrame:
    """Columns picked by index from a TSV (plain or gzip) without header.

    A line lacking a column is an error. `numbered` adds `doc_id`, the 0-based line number
    over all files in name order. `spread` repartitions, for few large gzip files.
    """
    lines = _lines(spark, path)
    fields = [_field(i).alias(name) for name, i in columns.items()]
    if numbered:
        placed = lines.select(*fields, F.col("_metadata.file_path").alias("_f"),
                              F.col("_metadata.file_block_start").alias("_b"),
                              F.monotonically_increasing_id().alias("_m"))
        return dense_index(placed, ["_f", "_b", "_m"], "doc_id", 0).select("doc_id", *columns)
    rows = lines.select(*fields)
    return rows.repartition(spread) if spread else rows


def load_labelled(spark, path, label_index=0, text_index=1, **options) -> DataFrame:
    return read_tsv(spark, path, {"label": label_index, "text": text_index}, **options)


def load_positioned(spark, path, pos_index=0, text_index=1, **options) -> DataFrame:
    rows = read_tsv(spark, path, {"pos": pos_index, "text": text_index}, **options)
    return rows.withColumn("pos", F.col("pos").cast("long"))


def load_text(spark, path, text_index=1, **options) -> DataFrame:
    return read_tsv(spark, path, {"text": text_index}, **options)


def load_label_pos_text(spark, path, label_index=0, pos_index=1, text_index=2, **options) -> DataFrame:
    rows = read_tsv(spark, path, {"label": label_index, "pos": pos_index, "text": text_index}, **options)
    return rows.withColumn("pos", F.col("pos").cast("long"))


def load_raw_posts(spark: SparkSession, path: str, origin_index: int, text_index: int,
                   topic_index: int) -> DataFrame:
    """TSV with one header line → <origin, topics array, text>; columns by position."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", lineSep="\n", maxCharsPerColumn=-1)

    def field(i: int) -> Column:
        return F.coalesce(F.col(f"`{raw.columns[i]}`"), F.lit(""))

    return raw.select(field(origin_index).alias("origin"), F.split(F.lower(field(topic_index)), ",").alias("topics"),
                      field(text_index).alias("text"))


def load_emotion_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """`category<TAB>word` lines → distinct <category, word>; a word may have several categories."""
    line = F.split(F.trim("value"), "\t")
    return _lines(spark, path).select(line[0].alias("category"), line[1].alias("word")).distinct()


def load_polarity_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """`word<TAB>0|1` lines → distinct <polarity, kind, word>; a star marks a partial word."""
    line = F.split(F.trim("value"), "\t")
    return _lines(spark, path).select(
        F.when(line[1] == "0", "negative").otherwise("positive").alias("polarity"),
        F.when(F.contains(line[0], F.lit("*")), "partial").otherwise("exact").alias("kind"),
        F.replace(F.lower(line[0]), F.lit("*"), F.lit("")).alias("word")).distinct()


def load_words(spark: SparkSession, path: str, name: str = "word") -> DataFrame:
    """One entry per line, trimmed, distinct, without empty ones: stop words, emoticons."""
    return _lines(spark, path).select(F.trim("value").alias(name)).where(F.col(name) != "").distinct()


def load_emoticons(spark: SparkSession, path: str) -> DataFrame:
    return load_words(spark, path, "emoticon")


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """`score<TAB>pos` lines as integers."""
    return _lines(spark, path).select(_field(0).cast("int").alias("score"), F.trim(_field(1)).cast("long").alias("pos"))


def load_ranked(spark: SparkSession, path: str) -> DataFrame:
    """Result file <entropy, prob, pos, text>, best first."""
    return _lines(spark, path).select(_field(0).cast("double").alias("entropy"), _field(1).alias("prob"),
                                      _field(2).cast("long").alias("pos"), _field(3).alias("text"))


def load_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """`type<TAB>alias, alias, …` lines → one row per alias."""
    line = F.split("value", "\t")
    return _lines(spark, path).select(
        line[0].alias("type"), F.explode(F.split(line[1], r",\s*")).alias("alias")).where(F.col("alias") != "")


def as_lists(lexicon: DataFrame, group: str, word: str = "word") -> dict[str, list[str]]:
    """A lexicon as {group: [words]} for the in-row functions, whose expressions hold every word. `extract` also takes
    the lexicon as a table, which has no need to fit there."""
    rows = lexicon.select(group, word).orderBy(group, word).collect()
    out: dict[str, list[str]] = {}
    for g, w in rows:
        out.setdefault(g, []).append(w)
    return out
