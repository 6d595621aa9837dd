"""Entropy statistics, thresholds and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import round_exact
from .ranking import exact_percentiles


def entropy_stats(scored: DataFrame, value: str = "entropy", key: str = "pos") -> DataFrame:
    """One row: mean, med, std, var (population), max, min."""
    med = exact_percentiles(scored, value, [50.0])[0]
    return scored.agg(
        F.avg(value).alias("mean"), F.lit(med).cast("double").alias("med"), F.stddev_pop(value).alias("std"),
        F.var_pop(value).alias("var"), F.max(value).alias("max"), F.min(value).alias("min"))


def objective_label(scored: DataFrame, threshold: float, value: str = "entropy") -> DataFrame:
    """Add `label`: '1' where the entropy reaches the threshold, else '0'."""
    return scored.withColumn("label", F.when(F.col(value) >= threshold, "1").otherwise("0"))


def label_share(labelled: DataFrame) -> DataFrame:
    """Number of rows and of objective ones, and their share to two places."""
    n, hits = F.count(F.lit(1)), F.sum((F.col("label") == "1").cast("long"))
    return labelled.agg(n.alias("n_rows"), hits.alias("n_objective"), round_exact(hits / n, 2).alias("share"))


def entropy_summary(scored: DataFrame, value: str = "entropy", key: str = "pos") -> DataFrame:
    """One row: median, mean and sample standard deviation."""
    med = exact_percentiles(scored, value, [50.0])[0]
    return scored.agg(F.lit(med).cast("double").alias("median"), F.avg(value).alias("mean"),
                      F.stddev_samp(value).alias("std"))


def entropy_histogram(scored: DataFrame, value: str = "entropy", bins: int = 10) -> DataFrame:
    """<bin, low, high, n>: equal-width bins between the extremes, empty ones included."""
    low, high = scored.agg(F.min(value), F.max(value)).first()
    spark = scored.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin long, low double, high double, n long")
    if low == high:  # a constant gets a unit-wide range around it
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    slot = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("long")
    counts = scored.where(F.col(value).isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(
        F.col("id").alias("bin"), (F.lit(low) + F.col("id") * width).alias("low"),
        (F.lit(low) + (F.col("id") + 1) * width).alias("high"))
    return edges.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def entropy_boxplot(scored: DataFrame, value: str = "entropy", key: str = "pos") -> DataFrame:
    """One row: quartiles, whiskers at 1.5 IQR and the number of outliers."""
    q1, q2, q3 = exact_percentiles(scored, value, [25.0, 50.0, 75.0])
    if q1 is None:
        return scored.sparkSession.createDataFrame(
            [], "q1 double, median double, q3 double, whisker_low double, whisker_high double, n_outliers long")
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = F.col(value).between(low, high)
    return scored.agg(
        F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("n_outliers"))
