"""Mixing sources to target weights, by fixed-length blocks of words.

Each source's documents, end to end, are cut into blocks of as many words. Every output shard draws multinomial counts of
slots for the sources from what is left of their targets; the last shard takes the rest, so totals meet the targets to
half a block. A source's j-th slot takes the block at a pseudorandom permutation of j, a new permutation for each pass.
Slots and blocks are joined by index. Only a row per source reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .common import free_name, partitions_for, stored, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_PASSES = 1.5, 2
BLOCK_WORDS, SHARDS, SEED, ROUNDS = 256, 64, 20240229, 16
ROWS_PER_BUCKET = 50_000


def water_level(sizes: list[int], weights: list[float], share: float = SHARE, passes: float = MOST_PASSES) -> list[float]:
    """Targets: `share` of all sizes by weight, none above `passes` times its size, the excess reshared by weight."""
    goal, caps = share * sum(sizes), [passes * s for s in sizes]
    targets, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = goal
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > caps[i]}
        if not over:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(caps[i])
        left -= sum(caps[i] for i in over)
        free -= over
    return targets


def draw_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws by what is left, none beyond it; the last shard takes the rest."""
    rng, left = np.random.default_rng(seed), np.array(slots, dtype=np.int64)
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for k in range(shards):
        want = int(left.sum()) // (shards - k)
        while (missing := want - int(out[k].sum())) > 0 and k < shards - 1:
            room = left - out[k]
            out[k] += np.minimum(rng.multinomial(missing, room / room.sum()), room)
        if k == shards - 1:
            out[k] = left
        left = left - out[k]
    return out


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..size-1 by swap-or-not rounds, keyed by `key`."""

    def turn(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, i), size) - x, size)
        swap = F.xxhash64(*key, i, F.lit("swap"), F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), turn)


def source_plan(sized: DataFrame, block: int, weights: tuple[float, ...]) -> list[dict]:
    """Per source, by code point and null last: its size, target, blocks and slots. One row per source comes to the driver."""
    found = sorted(sized.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    targets = water_level(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    plan = []
    for i, (row, target) in enumerate(zip(found, targets, strict=True)):
        blocks = -(-row["size"] // block)
        slots = min(round(blocks * target / row["size"]), MOST_PASSES * blocks) if row["size"] else 0
        plan.append({"src": i, "source": row["source"], "source_size": row["size"], "target": target, "blocks": blocks, "slots": slots})
    return plan


def place_documents(sized: DataFrame, plan: DataFrame, rows: int) -> DataFrame:
    """Add src and `start`, the document's first word in its source. Documents are dealt to buckets by their hash, so a
    large source is summed by many tasks; only sums per source and bucket are summed again."""
    buckets = partitions_for(rows, ROWS_PER_BUCKET, 8, 1 << 16)
    known = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["source"]), "left").drop(plan["source"])
    dealt = known.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "print"), F.lit(buckets)))
    sums = dealt.groupBy("src", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("src", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("src", "_bucket").orderBy("doc_id", "print", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["src", "_bucket"])
            .withColumn("start", F.col("_base") + F.col("_inside")).drop("_bucket", "_base", "_inside"))


def slots_of(spark: SparkSession, plan: list[dict], shards: int, seed: int) -> DataFrame:
    """<src, block, pass, shard, slot>: what each slot of each shard takes, made in the tasks from a row per source and shard."""
    counts = draw_counts([p["slots"] for p in plan], shards, seed)
    before = np.cumsum(counts, axis=0) - counts
    at = np.cumsum(counts, axis=1) - counts
    rows = [(p["src"], p["blocks"], k, int(counts[k, i]), int(before[k, i]), int(at[k, i]))
            for i, p in enumerate(plan) for k in range(shards) if counts[k, i]]
    drawn = spark.createDataFrame(rows, "src int, blocks long, shard int, n long, before long, at long")
    chunk = 1 << 16
    chunks = drawn.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))).alias("c"))
    spread = chunks.repartition(max(shards, spark.sparkContext.defaultParallelism), "src", "shard", "c")
    each = spread.select("*", F.explode(F.sequence(F.col("c") * chunk, F.least((F.col("c") + 1) * chunk, F.col("n")) - 1)).alias("i"))
    j = F.col("before") + F.col("i")
    turn = F.floor(j / F.col("blocks"))
    return each.select("src", permuted(F.pmod(j, F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("src"), turn).alias("block"),
                       turn.cast("int").alias("pass"), "shard", (F.col("at") + F.col("i")).alias("slot"))


def pieces_of(placed: DataFrame, block: int) -> DataFrame:
    """<doc_id, print, src, block, from, to>: the words of a document that lie in a block, a row for each block it touches."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = placed.where("size > 0").select("doc_id", "print", "src", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    return cut.select("doc_id", "print", "src", "block", (F.greatest(F.col("block") * block, F.col("start")) - F.col("start")).alias("from"),
                      (F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.col("start")).alias("to"))


class Mix:
    """A drawn mix of `docs` (doc_id, source, text).

    Size is the number of words; null text has none. Sources sort by code point, null last, and get `weights` in turn.
    An empty table, or one without words, gives targets of 0 and an empty mix. Rows that repeat id and text are placed one
    after the other and count on their own in `report`; in `documents` and `blocks` they are one document, as the text is
    fetched by id and text hash. Columns other than these three are carried by `documents` only.
    """

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED,
                 weights: tuple[float, ...] = WEIGHTS):
        spark = docs.sparkSession
        self.docs, self.block = docs, block_words
        self.print = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
        self.sized = stored(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
                                        self.print.alias("print")), "sized")
        self.plan_rows = source_plan(self.sized, block_words, weights)
        self.plan = spark.createDataFrame([(p["src"], p["source"], p["source_size"], p["target"]) for p in self.plan_rows],
                                          "src int, source string, source_size long, target double")
        self.placed = place_documents(self.sized, self.plan, self.sized.count())
        self.slots = slots_of(spark, self.plan_rows, shards, seed)

    def _once(self, keyed: DataFrame, name: str) -> DataFrame:
        """The rows with one of each doc_id and text hash, named `name`. Which texts repeat is known from the sizes, so that
        only rows with such a text are shuffled to drop the others."""
        twice = self.sized.groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("print").alias(name)).distinct()
        if twice.isEmpty():
            return keyed
        rest = lookup_join(keyed, twice, [name], "left_anti")
        return rest.unionByName(lookup_join(keyed, twice, [name], "left_semi").dropDuplicates(["doc_id", name]))

    def report(self) -> DataFrame:
        """<doc_id, size, source_size, target, taken>, a row per input row."""
        placed = stored(self.placed, "placed")
        times = self.slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
        taken = (pieces_of(placed, self.block).join(times, ["src", "block"])
                 .groupBy("doc_id", "print").agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("_taken")))
        # rows that repeat id and text have one sum, shared evenly; the first rows get what is left over
        ordinal = Window.partitionBy("doc_id", "print").orderBy("start")
        rows = placed.withColumn("_i", F.row_number().over(ordinal)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "print")))
        same = (rows["doc_id"].eqNullSafe(taken["doc_id"])) & (rows["print"] == taken["print"])
        share = F.floor((F.col("_taken") + F.col("_n") - F.col("_i")) / F.col("_n"))
        return rows.join(taken, same, "left").select(
            rows["doc_id"], "size", "source_size", "target", F.coalesce(share, F.lit(0)).cast("long").alias("taken"))

    def spans(self) -> DataFrame:
        """<shard, slot, pass, doc_id, print, from, to>: the words each slot takes."""
        return pieces_of(self.placed, self.block).join(self.slots, ["src", "block"]).drop("src", "block")

    def blocks(self) -> DataFrame:
        """<shard, slot, text>: the mix itself, `block_words` words a slot (a source's last block may be shorter)."""
        texts = self._once(self.docs.select("doc_id", "text", self.print.alias("print")), "print")
        spans = self.spans()
        same = spans["doc_id"].eqNullSafe(texts["doc_id"]) & (spans["print"] == texts["print"])
        part = F.slice(words(F.col("text")), (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int"))
        cut = spans.join(texts, same).select("shard", "slot", spans["doc_id"], "from", F.array_join(part, " ").alias("part"))
        return cut.groupBy("shard", "slot").agg(F.array_sort(F.collect_list(F.struct("doc_id", "from", "part"))).alias("parts")).select(
            "shard", "slot", F.array_join(F.transform("parts", lambda p: p["part"]), " ").alias("text"))

    def documents(self) -> DataFrame:
        """The mix as rows of `docs`: a document for each pass that takes words of it, its text cut to these words.

        A text taken whole is left as it is. Parts that don't touch are joined by a line end.
        """
        docs = self.docs
        parts_name = free_name(docs, "_parts")
        parts = self.spans().groupBy("doc_id", "print", "pass").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias(parts_name))
        keyed = self._once(docs.withColumn("_print", self.print), "_print")
        same = keyed["doc_id"].eqNullSafe(parts["doc_id"]) & (keyed["_print"] == parts["print"])
        all_words = words(F.col("text"))

        def picked(p: Column, i: Column) -> Column:
            before = F.when(i == 0, "").when(F.get(parts_name, i - 1)["to"] == p["from"], " ").otherwise("\n")
            return F.concat(before, F.array_join(F.slice(all_words, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")), " "))

        whole = F.aggregate(parts_name, F.lit(0).cast("long"), lambda a, p: a + p["to"] - p["from"]) == F.size(all_words)
        merged = F.array_join(F.transform(parts_name, picked), "")
        text = F.when(whole, F.col("text")).otherwise(merged)
        out = keyed.join(parts, same).select(*[keyed[c] for c in docs.columns], parts_name).withColumn("text", text).drop(parts_name)
        return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
