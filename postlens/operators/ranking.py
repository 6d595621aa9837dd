"""Row numbers, percentiles and scores over a global order, without a single-task sort."""

from __future__ import annotations

import struct
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's place in its low 33 bits


def dense_index(df: DataFrame, order: Iterable[str | Column], name: str = "rank", start: int = 1,
                partitions: int | None = None) -> DataFrame:
    """Consecutive numbers along `order`, which must end in a unique key.

    Rows are range-partitioned and sorted, then written to the shared folder, so that the
    sampled ranges are fixed. The number is the count of rows in earlier partitions plus the
    place inside the own one; only one count per partition reaches the driver.
    """
    keys = list(order)
    own = not df.is_cached
    kept = df.persist(StorageLevel.MEMORY_AND_DISK) if own else df  # read by the sampling and by the shuffle
    spread = kept.repartitionByRange(partitions, *keys) if partitions else kept.repartitionByRange(*keys)
    fixed = cut_lineage(spread.sortWithinPartitions(*keys))
    if own:
        kept.unpersist()
    counts = dict(fixed.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], start
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    at = F.monotonically_increasing_id()
    base = F.get(F.lit(offsets or [start]).cast("array<bigint>"), F.shiftright("_at", _LOCAL_BITS).cast("int"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return fixed.withColumn("_at", at).withColumn(name, base + place).drop("_at")


DIGIT = 11  # bits that a counting pass settles
REST = 50_000  # rows left from which the last pass settles all bits that remain


def _ordered_bits(value: Column) -> Column:
    """A double's bits as a long of the same order: negatives have all bits but the sign turned; -0 equals 0, NaN comes last."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(value.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits))


def _double_of(ordered: int) -> float:
    bits = ordered ^ ((1 << 63) - 1) if ordered < 0 else ordered
    return struct.unpack(">d", struct.pack(">q", bits))[0]


def _values_at(rows: DataFrame, n: int, places: list[int]) -> dict[int, float]:
    """{place: value} of the rows' column `b` in ascending order, by counting passes from the highest bits down.

    A pass counts rows by the next bits, only among those that share the bits of a wanted place; tasks sum their own rows
    first, and at most 2^DIGIT counts a place (or REST in the last pass) reach the driver. A value that many rows share is
    one count.
    """
    open_, shift, size = {0: (0, places)}, 64, n
    while shift:
        step = shift if size <= REST else min(DIGIT, shift)
        first, shift = shift == 64, shift - step
        inside = rows if first else rows.where(F.shiftright("b", shift + step).isin(list(open_)))
        counts = inside.groupBy(F.shiftright("b", shift).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        before, size = {q: start for q, (start, _) in open_.items()}, 0
        inner: dict[int, tuple[int, list[int]]] = {}
        for p, own in sorted((r["p"], r["n"]) for r in counts):
            q = 0 if first else p >> step
            start, before[q] = before[q], before[q] + own
            mine = [x for x in open_[q][1] if start <= x < start + own]
            if mine:
                inner[p], size = (start, mine), size + own
        open_ = inner
    return {x: _double_of(b) for b, (_, mine) in open_.items() for x in mine}


def exact_percentiles(df: DataFrame, value: str, percents: list[float]) -> list[float | None]:
    """Linearly interpolated percentiles, exact at any size, without a sort: the wanted rows' values are found bit by bit.

    Nulls are left out; NaN is greater than all other values.
    """
    rows = df.select(_ordered_bits(F.col(value)).alias("b")).where("b is not null").persist(StorageLevel.MEMORY_AND_DISK)
    n = rows.count()
    if n == 0:
        rows.unpersist()
        return [None] * len(percents)
    spots = [p / 100 * (n - 1) for p in percents]
    at = _values_at(rows, n, sorted({int(s) for s in spots} | {min(int(s) + 1, n - 1) for s in spots}))
    rows.unpersist()
    out = []
    for s in spots:
        lo, hi = at[int(s)], at[min(int(s) + 1, n - 1)]
        out.append(lo if lo == hi or s == int(s) else lo + (hi - lo) * (s - int(s)))
    return out


def rank_by_entropy(scored: DataFrame) -> DataFrame:
    """<entropy, pos, …> → the same with `rank` 1..n, ascending, ties by position."""
    return dense_index(scored, ["entropy", "pos"], "rank", 1)


def drop_adjacent_duplicates(ranked: DataFrame, text: str = "text") -> DataFrame:
    """Leave out a row whose text equals that of the row ranked just before it.

    The neighbour is found by an equi-join on the rank, which is unique, so no key is hot;
    a digest stands for the text in the shuffled neighbour side.
    """
    digest = F.unhex(F.sha2(F.col(text), 256))
    if dict(ranked.dtypes)[text] == "binary":  # a digest already
        digest = F.col(text)
    before = ranked.select((F.col("rank") + 1).alias("rank"), digest.alias("_d"))
    return (ranked.withColumn("_d", digest).join(before, ["rank", "_d"], "left_anti").drop("_d"))


def quintile_score(ranked: DataFrame, n: int | None = None) -> DataFrame:
    """Add `score` 1–5: blocks of round(n/5) ranks (half to even), the rest counts as 5."""
    n = ranked.count() if n is None else n
    block = max(round(n / 5), 1)
    return ranked.withColumn("score", F.least(F.floor((F.col("rank") - 1) / block) + 1, F.lit(5)).cast("long"))


def top_n_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """First n rows of each group, with their `rank`.

    The filter sits right on the row number, so Spark keeps only n rows per group and task
    before the shuffle (window group limit).
    """
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
