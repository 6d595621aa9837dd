"""Clusters of documents and the words that mark them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import value_counts
from ..session import cut_lineage
from .joins import lookup_join
from .ranking import top_n_per_group


def cluster_groups(docs: DataFrame, cluster: str = "cluster", key: str = "doc_id") -> DataFrame:
    """<cluster, n, first, last>: size of each cluster and its outermost members."""
    return docs.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))


def top_words(docs: DataFrame, n: int, cluster: str = "cluster", tokens: str = "tokens") -> DataFrame:
    """<cluster, word, n, rank>: most frequent words of each cluster, ties by word.

    Words are counted per document, then per task, then per (cluster, word), so a cluster
    holding most documents is a set of totals by the time its words are ranked.
    """
    counts = docs.select(cluster, F.inline(value_counts(F.col(tokens)))).groupBy(
        cluster, F.col("item").alias("word")).agg(F.sum("n").alias("n"))
    return top_n_per_group(counts, cluster, [F.desc("n"), F.asc("word")], n)


def distinctive_top_words(docs: DataFrame, n: int, cluster: str = "cluster", tokens: str = "tokens") -> DataFrame:
    """`top_words` without the words that are in every cluster's list."""
    top = cut_lineage(top_words(docs, n, cluster, tokens))  # n rows per cluster, read three times
    clusters = F.broadcast(top.agg(F.count_distinct(cluster).alias("_k")))  # one row
    spread = top.groupBy("word").agg(F.count(F.lit(1)).alias("_in"))
    common = spread.join(clusters, spread["_in"] == clusters["_k"]).select("word")
    return lookup_join(top, common, ["word"], "left_anti").select(*top.columns)
