"""Exact dedup by two passes over a Bloom filter.

Pass 1 sets two bits for each text's digest and keeps the bits that were set at least twice: a small bitmap,
broadcast in pass 2. Rows whose two bits are both in it may be repeated; only they are shuffled and grouped by digest,
all others pass straight through. False positives cost a shuffled row, never a wrong result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, stored

BITS_PER_ROW = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29  # the broadcast bitmap has at most MOST_BITS / 8 = 64 MB


def normalised(text: Column) -> Column:
    """Each run of blanks becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def filter_bits(rows: int) -> int:
    """Bits of the filter: a power of two, BITS_PER_ROW for each row between the two bounds."""
    return min(max(1 << max(rows * BITS_PER_ROW - 1, 1).bit_length(), LEAST_BITS), MOST_BITS)


def _positions(digest: Column, bits: int) -> list[Column]:
    """Two independent places, from 1 to `bits`, as the bitmap functions count."""
    return [1 + F.xxhash64(F.lit(seed), digest).bitwiseAND(F.lit(bits - 1)) for seed in (1, 2)]


def repeated_bits(prints: DataFrame, digest: str, bits: int) -> DataFrame:
    """<bucket, bitmap>: the places hit at least twice, 32,768 places a bitmap; empty buckets have no row."""
    places = prints.select(F.explode(F.array(*_positions(F.col(digest), bits))).alias("place"))
    twice = places.groupBy("place").count().where("count > 1")
    return twice.groupBy(F.expr("bitmap_bucket_number(place)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bitmap"))


def with_suspicion(rows: DataFrame, digest: Column, filtered: DataFrame, bits: int, name: str) -> DataFrame:
    """Add boolean `name`: both places of the row's digest are in the broadcast filter."""
    out, hits = rows, F.lit(True)
    for i, place in enumerate(_positions(digest, bits)):
        side = filtered.select(F.col("bucket").alias(f"{name}_b{i}"), F.col("bitmap").alias(f"{name}_m{i}"))
        out = out.withColumn(f"{name}_p{i}", place)
        out = out.join(F.broadcast(side), F.expr(f"bitmap_bucket_number({name}_p{i}) = {name}_b{i}"), "left")
        bit = F.expr(f"bitmap_bit_position({name}_p{i})")
        byte = F.conv(F.hex(F.expr(f"substring({name}_m{i}, cast(1 + bitmap_bit_position({name}_p{i}) div 8 as int), 1)")),
                      16, 10).cast("int")
        is_set = F.expr(f"1 << cast(bitmap_bit_position({name}_p{i}) % 8 as int)").bitwiseAND(byte) != 0
        hits = hits & F.coalesce(is_set & bit.isNotNull(), F.lit(False))
    return out.withColumn(name, hits).drop(*[f"{name}_{k}{i}" for k in "bmp" for i in (0, 1)])


def only_asked(rows: DataFrame, asked: DataFrame, key: list[str], inside: bool = True) -> DataFrame:
    """Rows whose key may be among the asked ones, by a broadcast Bloom filter; a few others pass as well.

    What it leaves out never enters a shuffle; a join with `asked` settles the rest. With inside=False, the rows left out.
    """
    bits = filter_bits(2 * asked.count())
    digest = F.xxhash64(*key)
    marks = asked.select(F.explode(F.array(*_positions(digest, bits))).alias("place")).distinct()
    bitmap = marks.groupBy(F.expr("bitmap_bucket_number(place)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bitmap"))
    return with_suspicion(rows, digest, stored(bitmap, "filter"), bits, "_asked").where(F.col("_asked") == inside).drop("_asked")


def mark_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """<key, keep_id, group_size, kept, text_sha256>, one row per input row.

    Texts are equal when identical after each run of blanks is one space; the row with the smallest key stays. Null text
    counts as empty, so null, '' are one group and ' ' another. A null key never wins over another key; rows that repeat
    a key within a group are marked alike. An empty table gives no rows. Other columns are not read.
    """
    sha = F.sha2(normalised(F.col(text)), 256)
    prints = stored(docs.select(F.col(key).alias(key), F.unhex(sha).alias("_digest")), "prints")
    bits = bits or filter_bits(prints.count())
    filtered = stored(repeated_bits(prints, "_digest", bits), "filter")
    judged = with_suspicion(prints, F.col("_digest"), filtered, bits, "_suspect")
    hexed = F.lower(F.hex("_digest")).alias("text_sha256")
    alone = judged.where(~F.col("_suspect")).select(
        key, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
    suspects = judged.where("_suspect").select(key, "_digest")
    groups = suspects.groupBy("_digest").agg(F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    together = suspects.join(groups, "_digest").select(
        key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), hexed)
    return alone.unionByName(together)


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """The rows that stay, with their own columns. Rows outside the filter never leave their task.

    `key` must be unique among rows of equal text; rows that repeat both are reduced to one. Copies are told apart by the
    digest, so a row moves only if its digest may be repeated.
    """
    digest = F.unhex(F.sha2(normalised(F.col(text)), 256))
    prints = stored(docs.select(F.col(key).alias(key), digest.alias("_digest")), "prints")
    bits = bits or filter_bits(prints.count())
    filtered = stored(repeated_bits(prints, "_digest", bits), "filter")
    judged = with_suspicion(docs, digest, filtered, bits, "_suspect")
    losers = (with_suspicion(prints, F.col("_digest"), filtered, bits, "_suspect").where("_suspect").groupBy("_digest")
              .agg(F.min(key).alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    alone = judged.where(~F.col("_suspect")).drop("_suspect")
    moved = judged.where("_suspect").withColumn("_digest", digest).join(losers, "_digest", "left")
    first = moved.where(F.col("_n").isNull() | F.col(key).eqNullSafe(F.col("_keep"))).drop("_n", "_keep", "_suspect")
    once = first.dropDuplicates(["_digest", key]).drop("_digest")
    return alone.unionByName(once.select(*docs.columns))
