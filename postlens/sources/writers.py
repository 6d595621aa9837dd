"""Writers of results: tab-separated text, one folder of part files per result.

Lines and fields are kept whole: tabs and line ends inside a text become spaces.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, "[\t\r\n]", " ")


def _as_text(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(name)
    return one_line(F.coalesce(F.col(name).cast("string"), F.lit("")))


def write_tsv(df: DataFrame, path: str, columns: list[str], compression: str = "none") -> None:
    """Write the columns in that order; nested ones as JSON."""
    line = F.concat_ws("\t", *[_as_text(df, c) for c in columns]).alias("value")
    df.select(line).write.option("compression", compression).text(path)


def _write_sorted(df: DataFrame, path: str, order: list[str], columns: list[str]) -> None:
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)  # a global sort reads its input twice
    write_tsv(kept.orderBy(*order), path, columns)
    kept.unpersist()


def write_curated(df: DataFrame, path: str) -> None:
    write_tsv(df, path, ["origin", "topics", "text"])


def write_dedup(df: DataFrame, path: str) -> None:
    write_tsv(df, path, ["pos", "text"])


def write_predictions(df: DataFrame, path: str) -> None:
    write_tsv(df, path, ["label", "text"])


def write_ranked(df: DataFrame, path: str) -> None:
    """Ascending by entropy: part files in name order keep the global order."""
    _write_sorted(df, path, ["entropy", "pos"], ["entropy", "dist", "pos", "text"])


def write_labelled(df: DataFrame, path: str) -> None:
    write_tsv(df, path, ["label", "entropy", "dist", "text"])


def write_topics(df: DataFrame, path: str) -> None:
    write_tsv(df, path, ["topic", "words"])


def write_topwords(df: DataFrame, path: str) -> None:
    """One list of words per cluster and line, best word first."""
    lists = df.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_w"))
    write_tsv(lists.select("cluster", F.transform("_w", lambda w: w["word"]).alias("words")), path, ["words"])


def write_clusters(df: DataFrame, path: str) -> None:
    _write_sorted(df, path, ["cluster", "doc_id"], ["cluster", "topic", "text"])


def write_analysis(df: DataFrame, path: str) -> None:
    write_tsv(df, path, ["pos", "score", "entropy", "dist"])
