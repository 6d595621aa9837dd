"""Sharding by a minimax contiguous partition of ordered, atomic groups.

Groups are rows of equal text (by 64-bit hash), ordered by that hash. The smallest capacity for which a greedy cut needs no
more than the given shards is found by binary search. The driver never sees all groups: it works on sizes summed by hash
range, and asks for finer ranges only where a cut may fall, until these hold one group each; the result is the exact one.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, stored

FIRST_BITS, STEP_BITS = 12, 8  # ranges of the first round: 2^12; each range asked for again is cut in 2^8
ROWS_PER_SALT, MOST_SALTS = 100_000, 4096


class Unit:
    """A hash range: its first key at `bits` bits, its size, and whether it holds one group only."""

    __slots__ = ("bits", "last", "prefix", "single", "size")

    def __init__(self, prefix: int, bits: int, size: int, single: bool, last: int):
        self.prefix, self.bits, self.size, self.single, self.last = prefix, bits, size, single, last


def _ranges(sized: DataFrame, bits: int, within: tuple[list[int], int] | None = None) -> list[Unit]:
    """Sizes summed by the hash's first `bits` bits, for all rows or for those of some coarser ranges."""
    rows = sized
    if within:
        prefixes, coarse = within
        wanted = sized.sparkSession.createDataFrame([(p,) for p in prefixes], "_p long")
        rows = sized.join(F.broadcast(wanted), F.shiftright("_hash", 64 - coarse) == F.col("_p"), "left_semi")
    at = F.shiftright("_hash", 64 - bits) if bits < 64 else F.col("_hash")
    found = rows.groupBy(at.alias("p")).agg(F.sum("_size"), F.min("_hash"), F.max("_hash")).collect()
    return sorted((Unit(p, bits, s, lo == hi, hi) for p, s, lo, hi in found), key=lambda u: u.last)


def greedy(totals: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends (as counts of units) of the shards when each takes all that fits; None if the shards don't suffice."""
    ends, at, start = [], 0, 0
    for _ in range(shards):
        at = bisect_right(totals, start + capacity)
        ends.append(at)
        if at == len(totals):
            return ends
        start = totals[at - 1] if at else 0
    return None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Smallest feasible capacity by binary search, each guess checked greedily."""
    totals = list(accumulate(sizes))
    if not totals:
        return 0
    low, high = max(max(sizes), -(-totals[-1] // shards)), totals[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(totals, mid, shards):
            high = mid
        else:
            low = mid + 1
    return low


def _unsure(units: list[Unit], shards: int) -> list[Unit]:
    """Ranges of several groups that a cut of the best partition may fall into."""
    totals = [0, *accumulate(u.size for u in units)]
    high = smallest_capacity([u.size for u in units], shards)
    low = max([-(-totals[-1] // shards), *(u.size for u in units if u.single)])
    unsure, near, far = {}, 0, 0
    for _ in range(shards):
        near = totals[bisect_right(totals, near + low) - 1]
        reach = far + high
        k = bisect_right(totals, reach) - 1
        far = totals[k] if k == len(units) or units[k].single else reach
        first = bisect_right(totals, near) - 1
        for u in units[first:min(k + 1, len(units))]:
            if not u.single:
                unsure[id(u)] = u
        if near >= totals[-1]:
            break
    return list(unsure.values())


def plan(sized: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the last hash of each shard but the last used one."""
    units = _ranges(sized, FIRST_BITS)
    while asked := _unsure(units, shards):
        drop = {id(u) for u in asked}
        units = [u for u in units if id(u) not in drop]
        for bits in sorted({u.bits for u in asked}):
            prefixes = [u.prefix for u in asked if u.bits == bits]
            units += _ranges(sized, min(bits + STEP_BITS, 64), (prefixes, bits))
        units.sort(key=lambda u: u.last)
    capacity = smallest_capacity([u.size for u in units], shards)
    ends = greedy(list(accumulate(u.size for u in units)), capacity, shards) if units else []
    return capacity, [units[e - 1].last for e in ends[:-1] if e]


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """<key, size, text_crc32, shard, slot>, one row per input row.

    Size is the text's UTF-8 bytes plus 1; null counts as empty. Rows of equal text share a shard, shards follow the order
    of the texts' hashes, and the largest shard is as small as such a cut allows. One group of more than an even share
    makes a shard of its own, and trailing shards may then stay empty. Slots count from 0 in each shard without gaps; rows
    are dealt by a hash of their key, so that no group is numbered by one task. Null or repeated keys get slots of their own.
    An empty table gives no rows.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    sized = stored(docs.select(F.col(key).alias(key), (F.octet_length(value) + 1).cast("long").alias("_size"),
                               F.crc32(value).alias("_crc"), F.xxhash64(value).alias("_hash")), "sized")
    _, cuts = plan(sized, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("_hash") > F.lit(cut)).cast("int")
    salts = partitions_for(sized.count(), shards * ROWS_PER_SALT, 16, MOST_SALTS)
    placed = sized.withColumn("_shard", shard).withColumn("_salt", F.pmod(F.xxhash64(key, "_crc"), F.lit(salts)))
    counts = placed.groupBy("_shard", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_shard", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_shard", "_salt").orderBy(key, "_hash"))
    # at most shards * MOST_SALTS offsets are broadcast
    return (placed.withColumn("_at", inside).join(F.broadcast(offsets), ["_shard", "_salt"]).select(
        key, F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"),
        (F.col("_base") + F.col("_at") - 1).alias("slot")))
