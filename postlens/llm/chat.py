"""Chat formatting with cumulative-snapshot collapse.

A log often holds a conversation several times, each time grown by some turns. A rolling hash over each conversation's
first k turns names all of its prefixes; a conversation whose whole hash is another's prefix hash is left out by an
anti-join, and only maximal conversations are rendered. Hashes are XORs of turn hashes tagged with the turn's place, so a
conversation of any length is hashed in parts that are put together afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CHUNK = 256  # turns numbered, hashed and rendered together
START, END = "<|{role}|>\n", "<|end|>\n"


def numbered(turns: DataFrame) -> DataFrame:
    """<conv_id, i, part, c1, c2, role, text> → i counts a conversation's turns from 1; rows that repeat are one turn.

    Turns sort by number (null first), then role and text. Blocks of CHUNK consecutive turn numbers are numbered on their
    own and then shifted by the turns in earlier blocks, so no task needs a whole conversation.
    """
    hashed = turns.select("conv_id", "turn", "role", "text", *[
        F.xxhash64(F.lit(s), F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()).alias(f"t{s}")
        for s in (1, 2)])
    once = hashed.dropDuplicates(["conv_id", "turn", "t1", "t2"])
    blocked = once.withColumn("block", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))))
    sizes = blocked.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"), "t1", "t2")
    at = blocked.withColumn("at", F.row_number().over(inside)).join(base, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    i = (F.col("base") + F.col("at")).alias("i")
    placed = at.select("conv_id", i, "role", "text", "t1", "t2")
    return placed.select("conv_id", "i", F.floor((F.col("i") - 1) / CHUNK).alias("part"), "role", "text",
                         *[F.xxhash64(F.lit(s), "i", f"t{s}").alias(f"c{s}") for s in (1, 2)])


def prefixes(turns: DataFrame) -> DataFrame:
    """<conv_id, i, n, h1, h2>: the hash of each conversation's first i of n turns."""
    own = Window.partitionBy("conv_id", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rolled = turns.select("conv_id", "i", "part", *[F.bit_xor(f"c{s}").over(own).alias(f"r{s}") for s in (1, 2)])
    parts = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("m"), *[F.bit_xor(f"c{s}").alias(f"x{s}") for s in (1, 2)])
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    bases = parts.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.sum("m").over(whole).alias("n"),
                         *[F.coalesce(F.bit_xor(f"x{s}").over(ahead), F.lit(0)).alias(f"b{s}") for s in (1, 2)])
    joined = rolled.join(bases, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))
    return joined.select("conv_id", "i", "n", *[F.col(f"r{s}").bitwiseXOR(F.col(f"b{s}")).alias(f"h{s}") for s in (1, 2)])


def maximal(hashed: DataFrame) -> DataFrame:
    """<conv_id, n, copies>: of equal conversations the one with the smallest id (null last), without those that begin a longer one."""
    key = ["i", "h1", "h2"]
    full = hashed.where("i = n").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = hashed.where("i < n").select(*key).distinct()
    return full.join(inner, key, "left_anti").select("conv_id", F.col("i").alias("n"), "copies")


def render(conversations: DataFrame) -> DataFrame:
    """<conv_id, part, n_turns, copies, text, n_answer_chars>: maximal conversations in chat markup, CHUNK turns a part.

    A part holds at most CHUNK turns; a conversation's parts, in order, are its text. n_turns counts the whole
    conversation, copies the logged conversations equal to it, n_answer_chars the characters that assistants wrote in the
    part. A null role is written `unknown`, a null text is empty; a null conv_id is a conversation like others. Columns
    other than conv_id, turn, role and text are not read. An empty table gives no rows.
    """
    turns = stored(numbered(conversations.select("conv_id", "turn", "role", "text")), "turns")
    kept = stored(maximal(prefixes(turns)), "kept")
    start = F.concat(F.lit(START.split("{role}")[0]), F.coalesce("role", F.lit("unknown")), F.lit(START.split("{role}")[1]))
    turn = F.concat(start, F.coalesce("text", F.lit("")), F.lit("\n" + END))
    answered = F.when(F.col("role") == "assistant", F.char_length(F.coalesce("text", F.lit("")))).otherwise(0)
    lines = turns.alias("t").join(kept.alias("k"), F.col("t.conv_id").eqNullSafe(F.col("k.conv_id")))
    rows = lines.select(F.col("t.conv_id").alias("conv_id"), "part", F.col("n").alias("n_turns"), "copies", "i", turn.alias("turn"), answered.alias("a"))
    parts = rows.groupBy("conv_id", "part", "n_turns", "copies").agg(
        F.array_sort(F.collect_list(F.struct("i", "turn"))).alias("turns"), F.sum("a").cast("long").alias("n_answer_chars"))
    return parts.select("conv_id", "part", "n_turns", "copies", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("text"), "n_answer_chars")
