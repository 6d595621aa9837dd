"""Entropy of a probability array, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bits(dist: Column) -> Column:
    part = lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return -F.aggregate(F.transform(dist, part), F.lit(0.0), lambda a, x: a + x)


def entropy_by_k(dist: Column, k: Column | int) -> Column:
    """−Σ p·log2 p, divided by the number of classes."""
    return _bits(dist) / (F.lit(k) if isinstance(k, int) else k)


def entropy_normalized(dist: Column, k: Column | int) -> Column:
    """−Σ p·log2 p, divided by log2 of the number of classes (null for one class)."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.try_divide(_bits(dist), F.log2(k))


def argmax(dist: Column) -> Column:
    """Index of the largest probability, the first of equals."""
    return (F.array_position(dist, F.array_max(dist)) - 1).cast("int")


def truncated(dist: Column, least: float = 0.01) -> Column:
    """array<double> → array<struct<topic, prob>>, leaving out small probabilities."""
    named = F.transform(dist, lambda p, i: F.struct(i.alias("topic"), p.alias("prob")))
    return F.filter(named, lambda t: t["prob"] >= least)
