"""Joins of a large frame with a lookup table, by broadcast, or by shuffle with the hot keys taken apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEYS, KEYS_TRACKED = 128, 10_000  # keys that may be taken apart, and counters of the summary that finds them
HOT_SHARE = 4  # a key is hot from this part of a shuffle partition's fair share of the rows


def written_bytes(checkpointed: DataFrame) -> int:
    """Bytes that a checkpointed frame takes in the shared folder."""
    path = checkpointed._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    spark = checkpointed.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def _key(on: list[str]) -> Column:
    return F.xxhash64(*on)


def hot_keys(rows: DataFrame, on: list[str]) -> list[int]:
    """Hashes of the keys that hold many of the rows, HOT_KEYS at most.

    Each task keeps a frequent-items summary of its own rows; summaries are merged, so no row is shuffled. Counts are
    estimates: a key too many or too few changes where its rows are joined, not what they are joined with.
    """
    top = F.expr(f"approx_top_k(_key, {HOT_KEYS}, {KEYS_TRACKED})")
    found = rows.select(_key(on).alias("_key")).agg(F.count(F.lit(1)).alias("n"), top.alias("top")).first()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [x["item"] for x in found["top"] or [] if x["count"] * HOT_SHARE * partitions > found["n"]]


def _most_used(right: DataFrame, uses: str, limit_bytes: int) -> Column:
    """True for the rows of highest `uses` that take up to the limit together; rows of equal use are in or out together."""
    rows = max(right.count(), 1)
    share = min(limit_bytes / max(written_bytes(right), 1), 1.0)
    least = right.agg(F.percentile_approx(uses, 1.0 - share, max(min(rows, 10_000), 1))).first()[0]
    return F.coalesce(F.col(uses) > least, F.lit(False)) if least is not None else F.lit(False)


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
                limit_bytes: int = BROADCAST_BYTES, uses: str | None = None) -> DataFrame:
    """Join a table that holds each key once: by broadcast while it fits, else by a shuffle without hot keys.

    The right side is computed once, into the shared folder, and its size is that of what was written. Above the limit,
    left rows of hot keys (a word in every post) stay in their tasks and meet a broadcast of the few right rows of these
    keys; all others are shuffled by key, where no key holds much of a partition. Nothing is copied. Works for inner,
    left, left_semi and left_anti joins.

    `uses` names a column of the right side that says in how many left rows a key is found, roughly. Then the right rows
    of most use are broadcast up to the limit, and only left rows without one of them are shuffled: of words, most.
    """
    right = cut_lineage(right)
    if written_bytes(right) <= limit_bytes:
        return left.join(F.broadcast(right), on, how)
    if uses is not None and limit_bytes > 0:
        head = _most_used(right, uses, limit_bytes)
        rest = left.join(F.broadcast(right.where(head).select(*on)), on, "left_anti").join(right.where(~head), on, how)
        if how == "left_anti":
            return rest
        return rest.unionByName(left.join(F.broadcast(right.where(head)), on, "inner" if how == "left" else how))
    hot = hot_keys(left, on)
    if not hot:
        return left.join(right, on, how)
    is_hot = _key(on).isin(hot)
    apart = left.where(is_hot).join(F.broadcast(right.where(is_hot)), on, how)
    return left.where(~is_hot).join(right.where(~is_hot), on, how).unionByName(apart)
