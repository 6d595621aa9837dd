"""Curation of raw posts: topic filter, union of sources, dedupe, numbering, label cast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold
from .ranking import dense_index


def split_topics(topics: Column) -> Column:
    """Comma-separated topics → lower-cased array; elements are not trimmed."""
    return F.split(F.lower(topics), ",")


def topic_filter(posts: DataFrame, topics: list[str], column: str = "topics") -> DataFrame:
    """Keep posts naming at least one of the topics, by exact element equality."""
    return posts.where(F.arrays_overlap(F.col(column), F.lit(list(topics)).cast("array<string>")))


def curate(posts: DataFrame, topics: list[str]) -> DataFrame:
    """<origin, topics, text> → posts on the topics, text folded to ASCII."""
    return topic_filter(posts, topics).withColumn("text", ascii_fold(F.col("text")))


def consolidate(sources: list[DataFrame]) -> DataFrame:
    """All curated sources as one corpus, repeats kept."""
    return reduce(DataFrame.unionByName, sources)


def dedupe_first(corpus: DataFrame, key: str = "text", order: str = "doc_id",
                 carry: list[str] | None = None) -> DataFrame:
    """One row per distinct `key`: the one lowest in `order`, with the `carry` columns.

    Grouping is on a digest, and each task first reduces its own copies, so a text repeated
    in a third of the posts reaches the shuffle once per task. Leave the text out of `carry`
    and it is not shuffled at all.
    """
    carry = [key] if carry is None else carry
    first = F.min_by(F.struct(*carry), order) if carry else None
    grouped = corpus.groupBy(F.unhex(F.sha2(F.col(key), 256)).alias("_d"))
    if first is None:
        return grouped.agg(F.min(order).alias(order)).drop("_d")
    kept = grouped.agg(F.min(order).alias(order), first.alias("_row"))
    return kept.select(order, *[F.col("_row")[c].alias(c) for c in carry])


def assign_position(corpus: DataFrame, order: str = "doc_id") -> DataFrame:
    """Number rows 0..n-1 in first-seen order as `pos`."""
    return dense_index(corpus, [order], "pos", 0)


def source_counts(corpus: DataFrame, source: str = "source", key: str = "text",
                  order: str = "doc_id") -> DataFrame:
    """Rows per source: all of them, and those left after the dedupe."""
    total = corpus.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"))
    distinct = (dedupe_first(corpus, key, order, [source])
                .groupBy(source).agg(F.count(F.lit(1)).alias("n_distinct")))
    return (total.join(distinct, source, "left")
            .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)).cast("long")))


def binary_label_cast(corpus: DataFrame, label: str = "label") -> DataFrame:
    """Labels become integers if there are exactly two of them, else they stay strings."""
    if corpus.select(label).distinct().limit(3).count() == 2:
        return corpus.withColumn(label, F.col(label).cast("long"))
    return corpus
