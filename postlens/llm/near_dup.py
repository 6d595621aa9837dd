"""Near-duplicate documents by an LSH forest over minhashes of word shingles, confirmed on full sets.

A forest has TREES sorted orders; in each, a document's label is DEPTH minhashes. Rows are range-partitioned and sorted by
(tree, label), so documents with the longest common prefixes are neighbours. A region is a run of labels with a common
prefix of LEAST_DEPTH values. Documents of a small region are all candidates of one another; a larger one is split by the
next value, deeper and deeper, until its parts are small. Candidates are confirmed on whole shingle sets.

What a split may have parted is compared afterwards: the members of each crowded region that are not yet in its largest
component meet, block by block, all members that their size allows, first by signature and then by whole sets. These
blocks hold a bounded number of documents and emit confirmed links only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .common import partitions_for, ship, stored
from .components import components
from .exact_dedup import only_asked

SHINGLE, SIMILARITY = 5, 85  # words; per cent where a caller names no other
TREES, DEPTH, LEAST_DEPTH = 16, 12, 4
CROWDED = 12  # a region of more documents is split by the next minhash
BLOCK_ROWS, BLOCK_SHINGLES = 256, 2_000_000
DOUBT = 0.15  # signatures this far below the threshold, over 5 standard deviations, are not compared on sets
ROWS_PER_TASK = 400_000

_RNG = np.random.default_rng(8191)
_XOR = _RNG.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, A-Z lower-cased; fewer words than `size` are one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(size, len(found))
    out = np.full(len(found) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ hashed[k:len(hashed) - width + 1 + k]) * _STEP
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minhashes of 32 bits."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 1024):
        mixed = (low[start:start + 1024, None] ^ _XOR) * _MUL
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum(out, mixed.min(axis=0), out)
    return out


def similar(a: np.ndarray, b: np.ndarray, per_cent: int = SIMILARITY) -> bool:
    """100 * intersection >= per_cent * union, on whole sets."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < per_cent * large:
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= per_cent * (small + large - shared)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """<id, mark, n, print, sig> of each <id, mark, text>; print is a hash of the whole set, null for an empty one."""
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column("text")]
        prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        signs = [signature(s).astype(">u4").tobytes() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()),
             pa.array(signs, pa.binary())], ["id", "mark", "n", "print", "sig"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """<id, sig, shingles> of each <id, sig, text>."""
    for batch in batches:
        sets = [shingle_set(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sig"), pa.array(sets, pa.binary())], ["id", "sig", "shingles"])


def _fits(n: int, m: int, per_cent: int) -> bool:
    return 100 * min(n, m) >= per_cent * max(n, m)


def _forest(batches: Iterator[pa.RecordBatch], per_cent: int) -> Iterator[pa.RecordBatch]:
    """Walk sorted <tree, label, id, n>: candidate pairs, and for each member of a crowded region a row <region, id>.

    Of a crowded region only its path of open splits and the members of one small part are held.
    """
    pairs: list[tuple[int, int]] = []
    crowd: list[tuple[bytes, int]] = []

    def emit() -> pa.RecordBatch:
        a = [p[0] for p in pairs] + [c[1] for c in crowd]
        b = [p[1] for p in pairs] + [None] * len(crowd)
        where = [None] * len(pairs) + [c[0] for c in crowd]
        pairs.clear()
        crowd.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(where, pa.binary())], ["a", "b", "region"])

    def split(part: list[tuple[bytes, int, int]], depth: int) -> None:
        if len(part) > CROWDED and depth < DEPTH:
            start = 0
            for k in range(1, len(part) + 1):
                if k == len(part) or part[k][0][4 * depth:4 * depth + 4] != part[start][0][4 * depth:4 * depth + 4]:
                    split(part[start:k], depth + 1)
                    start = k
            return
        for i, (_, one, n) in enumerate(part):  # at full depth the nearest neighbours in order
            for _, two, m in part[i + 1:i + CROWDED]:
                if one != two and _fits(n, m, per_cent):
                    pairs.append((min(one, two), max(one, two)))

    def close(tree: int, region: list[tuple[bytes, int, int]], whole: bool) -> None:
        if not whole or len(region) > CROWDED:
            name = tree.to_bytes(2, "big") + region[0][0][:4 * LEAST_DEPTH]
            crowd.extend((name, one) for _, one, _ in region)
        split(region, LEAST_DEPTH)

    at, region, whole = None, [], True
    for batch in batches:
        for tree, label, one, n in zip(*(batch.column(c).to_pylist() for c in ("tree", "label", "id", "n")), strict=True):
            here = (tree, label[:4 * LEAST_DEPTH])
            if here != at:
                if region:
                    close(at[0], region, whole)
                at, region, whole = here, [], True
            elif len(region) >= 50_000:  # a very large region is split in runs of neighbours; all are marked as crowded
                close(tree, region, False)
                region, whole = [], False
            region.append((label, one, n))
            if len(pairs) + len(crowd) > 20_000:
                yield emit()
    if region:
        close(at[0], region, whole)
    if pairs or crowd:
        yield emit()


def _confirm(batches: Iterator[pa.RecordBatch], per_cent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), per_cent)
                for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _meet(table: pa.Table, per_cent: int) -> pa.Table:
    """Links between two blocks of one region (or inside one block) that join different components."""
    rows = table.to_pylist()
    left = [r for r in rows if r["side"] == 0]
    right = [r for r in rows if r["side"] == 1] or left
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    sets = {r["id"]: np.frombuffer(r["shingles"], np.uint64) for r in rows}
    signs = [np.frombuffer(b"".join(r["sig"] for r in side), ">u4").reshape(len(side), -1) for side in (left, right)]
    out: list[tuple[int, int]] = []
    for i, one in enumerate(left):
        near = np.flatnonzero((signs[1] == signs[0][i]).mean(axis=1) >= per_cent / 100 - DOUBT)
        for j in near:
            two = right[j]
            if find(one["comp"]) != find(two["comp"]) and similar(sets[one["id"]], sets[two["id"]], per_cent):
                out.append((one["id"], two["id"]))
                root[find(one["comp"])] = find(two["comp"])
    return pa.table({"u": pa.array([p[0] for p in out], pa.int64()), "v": pa.array([p[1] for p in out], pa.int64())})


def _sets(docs: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """<id, sig, shingles> of the wanted classes, from their texts; other documents don't leave the scan."""
    wanted = stored(reps.join(ids, "id", "left_semi").select("key", "mark", "id", "sig"), "wanted")
    texts = only_asked(docs, wanted, ["key", "mark"]).join(wanted, ["key", "mark"])
    return texts.dropDuplicates(["key", "mark"]).select("id", "sig", "text").mapInArrow(_gather, "id long, sig binary, shingles binary")


def _rest(docs: DataFrame, reps: DataFrame, crowd: DataFrame, links: DataFrame, per_cent: int) -> DataFrame:
    """Links inside crowded regions between members that are in different components so far."""
    known = components(links)
    member = (crowd.join(reps.select("id", "n"), "id").join(known.withColumnRenamed("node", "id"), "id", "left")
              .select("region", "id", "n", F.coalesce("root", "id").alias("comp")))
    sizes = member.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("region").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"),
                                       F.sum("size").alias("rows")).where("comps > 1")
    # by size, in bands that similar documents can't skip: a document meets its own band and the next
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / (per_cent - 0.1)))).cast("int")
    open_ = stored(member.join(main.select("region", "main"), "region").select(
        "region", "id", "n", "comp", band.alias("band"), (F.col("comp") != F.col("main")).alias("apart")), "open")
    load = open_.groupBy("region", "band").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("mass"), F.sum(F.col("apart").cast("int")).alias("apart"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("mass") / BLOCK_SHINGLES)).cast("int")
    plan = load.select("region", "band", blocks.alias("blocks"), "apart")
    put = open_.join(plan.drop("apart"), ["region", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    put = stored(put, "blocks")
    mixed = put.groupBy("region", "band", "block").agg(F.max("apart").alias("apart"))
    one = mixed.select("region", F.col("band").alias("b1"), F.col("block").alias("k1"), F.col("apart").alias("x1"))
    two = mixed.select("region", F.col("band").alias("b2"), F.col("block").alias("k2"), F.col("apart").alias("x2"))
    step = F.explode(F.array(F.lit(0), F.lit(1)))
    meet = (one.select("*", step.alias("step")).withColumn("b2", F.col("b1") + F.col("step")).join(two, ["region", "b2"])
            .where("(x1 or x2) and (b1 < b2 or k1 <= k2)").select("region", "b1", "k1", "b2", "k2"))
    pair = F.struct("b1", "k1", "b2", "k2").alias("pair")
    sides = (meet.select("region", pair, F.lit(0).alias("side"), F.col("b1").alias("band"), F.col("k1").alias("block"))
             .unionByName(meet.where("b1 < b2 or k1 < k2").select("region", pair, F.lit(1).alias("side"), F.col("b2").alias("band"), F.col("k2").alias("block"))))
    sets = stored(_sets(docs, reps, put.select("id").distinct()), "sets")
    full = sides.join(put, ["region", "band", "block"]).select("region", "pair", "side", "id", "comp").join(sets, "id")
    return full.groupBy("region", "pair").applyInArrow(lambda table: _meet(table, per_cent), "u long, v long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", per_cent: int = SIMILARITY) -> DataFrame:
    """<key, n_shingles, component_id, kept>, one row per input row. Keys are integers.

    Documents are linked when their sets of distinct 5-word shingles (words split at blanks, A-Z lower-cased) have a Jaccard
    similarity of at least per_cent / 100; component_id is the smallest key reachable over links. Fewer than five words make one
    shingle. Null or blank text has an empty set and no link: it is its own component. Equal sets are one class, represented
    by its smallest key; classes have numbers of their own, since texts of a repeated key may represent several. Rows with a
    null key are never linked and stay; rows that repeat a key with other text are judged
    by their own text. An empty table gives no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    asked = source.withColumnRenamed("key", "id")
    signed = stored(asked.mapInArrow(_sign, "id long, mark long, n long, print binary, sig binary"), "signed")
    usable = signed.where("print is not null and id is not null")
    least = usable.groupBy("print").agg(F.min(F.struct("id", "mark")).alias("x"))
    classes = stored(least.select("print", F.col("x.id").alias("rep"), "x.mark", F.monotonically_increasing_id().alias("class")), "classes")
    own = classes.select("print", F.col("rep").alias("id"), "mark", "class")
    reps = stored(usable.join(own, ["print", "id", "mark"]).dropDuplicates(["class"]).select(
        F.col("class").alias("id"), F.col("id").alias("key"), "mark", "n", "sig"), "reps")
    label = lambda t: F.struct(F.lit(t).alias("tree"), F.substring("sig", 4 * DEPTH * t + 1, 4 * DEPTH).alias("label"))
    rows = reps.select("id", "n", F.explode(F.array(*[label(t) for t in range(TREES)])).alias("x")).select("x.tree", "x.label", "id", "n")
    tasks = partitions_for(TREES * reps.count(), ROWS_PER_TASK, docs.sparkSession.sparkContext.defaultParallelism)
    order = ["tree", "label", "id"]
    walked = stored(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(lambda b: _forest(b, per_cent), "a long, b long, region binary"), "walked")
    pairs = stored(walked.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "pairs")
    crowd = walked.where("b is null").select("region", F.col("a").alias("id"))
    ids = stored(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "asked")
    sets = stored(_sets(source, reps, ids).drop("sig"), "sets")
    both = (pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("sa")), "u")
            .join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("sb")), "v").select("u", "v", "sa", "sb"))
    links = stored(both.mapInArrow(lambda b: _confirm(b, per_cent), "u long, v long"), "links")
    more = stored(_rest(source, reps, crowd, links, per_cent), "links")
    found = stored(components(links.unionByName(more)), "components")
    keys = found.join(classes.select(F.col("class").alias("node"), "rep"), "node")
    roots = lookup_join(keys, keys.groupBy("root").agg(F.min("rep").alias("low")), ["root"]).select(F.col("node").alias("class"), "low")
    roots = classes.join(roots, "class", "left").select("print", F.coalesce("low", "rep").alias("root"))
    return signed.join(roots, "print", "left").select(
        F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"),
        F.coalesce(F.when(F.col("id").isNotNull(), F.col("root")), F.col("id")).alias("component_id"),
        F.coalesce(F.col("root") == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", per_cent: int = SIMILARITY) -> DataFrame:
    """The documents that represent their component, with their own columns; rows that share a key go or stay together.

    Documents outside a Bloom filter of the dropped keys pass straight through.
    """
    dropped = stored(near_groups(docs, key, text, per_cent).where(~F.col("kept")).select(key).distinct(), "dropped")
    inside = only_asked(docs, dropped, [key])
    return only_asked(docs, dropped, [key], inside=False).unionByName(inside.join(dropped, key, "left_anti").select(*docs.columns))
