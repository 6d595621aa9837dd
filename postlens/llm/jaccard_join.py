"""Similarity self-join of word n-gram sets by size-banded tiles, bitmap bounds and exact intersections.

Sets of similar size are near in bands: sizes of a band and the next hold every pair that can reach the threshold. Two sets
of such a pair differ in at most D elements, D being known from the band. A band is cut in D + 1 segments of the hash range;
one segment at least must then be equal in both sets, so a tile is a band, a segment's number and its content: sets outside
a common tile are no pair, and unlike sets share no tile however common some of their n-grams are.

In a tile, sets meet by parity bitmaps first: each element flips the bit it hashes to, so the bits in which two bitmaps
differ are a lower bound of the elements in which the sets differ, and with their sizes an upper bound of the overlap. What
passes is settled by the exact intersection of the sorted arrays.

For components, not all pairs of a tile are needed. First every set meets its tile's leader, twice with different leaders;
only tiles whose sets are then in several components are compared as a whole, in blocks, between components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .common import forget, ship, slim, stored
from .components import components
from .exact_dedup import only_asked
from .near_dup import shingle_set

WORDS, SIMILARITY = 3, 90  # words of an n-gram; per cent
LEAST_BITS, BITS_PER_DIFFERENCE = 256, 8
BLOCK_ROWS = 1024  # sets of a block of a tile


# --- bands ----------------------------------------------------------------------------------


def most_different(n: int, m: int, per_cent: int) -> int:
    """Elements in which sets of these sizes may differ at most if their Jaccard similarity is per_cent / 100 or more."""
    return (100 - per_cent) * (n + m) // (100 + per_cent)


@lru_cache(maxsize=8)
def _ends(per_cent: int) -> list[int]:
    """The largest size of each band made so far."""
    return [1]


def band_of(n: int, per_cent: int) -> int:
    """The band of a size: a band goes from a size to the largest that may be similar to it."""
    ends = _ends(per_cent)
    while ends[-1] < n:
        ends.append((ends[-1] + 1) * 100 // per_cent)
    return int(np.searchsorted(ends, n))


def segments(band: int, per_cent: int) -> int:
    """Segments of a band: one more than its sets may differ from similar ones of this band and the next."""
    ends = _ends(per_cent)
    while len(ends) <= band:
        ends.append((ends[-1] + 1) * 100 // per_cent)
    return most_different(ends[band], ends[band] * 100 // per_cent, per_cent) + 1


@lru_cache(maxsize=4096)
def _edges(count: int) -> np.ndarray:
    return np.array([(k << 64) // count for k in range(1, count)], np.uint64)


def tile_keys(shingles: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a set's tiles, and of each whether the set is one of the band's own (0) or of the next band (1)."""
    band = band_of(len(shingles), per_cent)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shingles, dtype=np.uint64)))
    keys, roles = [], []
    for role, at in enumerate((band, band - 1)):
        if at < 0:
            continue
        count = segments(at, per_cent)
        cuts = np.concatenate(([0], np.searchsorted(shingles, _edges(count)), [len(shingles)]))
        held = sums[cuts[1:]] - sums[cuts[:-1]]
        place = (np.arange(count, dtype=np.uint64) + np.uint64(at << 32)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (held ^ place) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        keys.append((mixed * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
        roles.append(np.full(count, role, np.int8))
    return np.concatenate(keys), np.concatenate(roles)


def bitmap(shingles: np.ndarray, per_cent: int) -> bytes:
    """Parity bitmap; its width is a power of two that grows with the size's band."""
    differ = segments(band_of(len(shingles), per_cent), per_cent)
    width = 1 << (max(LEAST_BITS, BITS_PER_DIFFERENCE * differ) - 1).bit_length()
    flips = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, wider ones folded on the narrowest by parity."""
    width = min(map(len, bits))
    rows = [np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0) if len(b) > width else np.frombuffer(b, np.uint64) for b in bits]
    return np.stack(rows)


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, per_cent: int) -> np.ndarray:
    """Whether sizes, and a lower bound of the elements in which the sets differ, leave room for the threshold."""
    fits = 100 * np.minimum(n, m) >= per_cent * np.maximum(n, m)
    return fits & (apart <= (100 - per_cent) * (n + m) // (100 + per_cent))


def linked(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    """100 * intersection >= per_cent * union, on sorted arrays of distinct elements."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < per_cent * len(b):
        return False
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * shared >= per_cent * (len(a) + len(b) - shared)


# --- tasks ----------------------------------------------------------------------------------

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _sets(size: int) -> Run:
    """<id, n, print, set> of each <id, text>, in batches of a few MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for one, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found = shingle_set(text.as_py(), size)
                rows.append((one, len(found), xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None, found.tobytes()))
                held += found.nbytes
                if held > 8_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                          ["id", "n", "print", "set"])

    return run


def _tiles(per_cent: int) -> Run:
    """<tile, role, row> of each <row, set>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slim()
        for batch in batches:
            rows, held, size = batch.column("row").to_pylist(), [], 0
            for row, found in zip(rows, batch.column("set"), strict=True):
                keys, roles = tile_keys(np.frombuffer(found.as_buffer(), np.uint64), per_cent)
                held.append((keys, roles, np.full(len(keys), row, np.int64)))
                size += len(keys)
                if size > 200_000:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["tile", "role", "row"])

    return run


def _bitmaps(per_cent: int) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [bitmap(np.frombuffer(s.as_buffer(), np.uint64), per_cent) for s in batch.column("set")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array(bits, pa.binary())], ["row", "n", "bits"])

    return run


def _bounded(per_cent: int) -> Run:
    """The <u, v> of <u, v, n, m, x, y> whose sizes and bitmaps leave room for the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.fromiter((int(np.bitwise_count(np.bitwise_xor(*folded([x.as_py(), y.as_py()]))).sum())
                                 for x, y in zip(batch.column("x"), batch.column("y"), strict=True)), np.int64, batch.num_rows)
            keep = may_link(batch.column("n").to_numpy(), batch.column("m").to_numpy(), apart, per_cent)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return run


def _exact(per_cent: int) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), per_cent)
                    for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _meet(per_cent: int) -> Run:
    """Walk rows sorted by <tile, lo, hi>: pairs <u, v> of the two blocks that differ in `comp` and that bitmaps don't rule out.

    One pair of blocks, 2 * BLOCK_ROWS rows at most, is held at a time.
    """

    def pairs(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, lo, hi, side, row, role, comp, n, bits = zip(*rows, strict=True)
        row, role, comp, n, side = (np.array(x, np.int64) for x in (row, role, comp, n, side))
        words = folded(list(bits))
        right = np.flatnonzero(side == 1) if lo[0] < hi[0] else np.arange(len(rows))
        for i in np.flatnonzero(side == 0):
            other = right if lo[0] < hi[0] else right[i + 1:]
            other = other[(comp[other] != comp[i]) & (role[other] + role[i] < 2)]
            if len(other):
                apart = np.bitwise_count(words[other] ^ words[i]).sum(axis=1, dtype=np.int64)
                good = row[other[may_link(n[i], n[other], apart, per_cent)]]
                if len(good):
                    yield np.minimum(good, row[i]), np.maximum(good, row[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            u, v = (np.concatenate(c) for c in zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held: list[tuple] = []
        names = ["tile", "lo", "hi", "side", "row", "role", "comp", "n", "bits"]
        for batch in batches:
            for here in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if held and here[:3] != held[0][:3]:
                    out.extend(pairs(held))
                    held = []
                    if len(out) > 2_000:
                        yield flush()
                held.append(here)
        if held:
            out.extend(pairs(held))
        if out:
            yield flush()

    return run


# --- the join -------------------------------------------------------------------------------


class _Join:
    """The steps over one table of documents; step tables are deleted by `close`."""

    def __init__(self, docs: DataFrame, key: str, text: str, size: int, per_cent: int):
        ship(docs.sparkSession)
        self.per_cent = per_cent
        self.kept: list[DataFrame] = []
        source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        signed = source.mapInArrow(_sets(size), "id long, n long, print binary, set binary")
        self.signed = self.keep(signed.withColumn("row", F.monotonically_increasing_id()), "sets")
        usable = self.signed.where("print is not null and id is not null").select("row", "id", "print")
        classes = usable.groupBy("print").agg(F.min("row").alias("class"), F.min("id").alias("rep"))
        self.rows = self.keep(lookup_join(usable, classes, ["print"]).select("row", "class", "rep"), "rows")
        copies = self.keep(self.rows.where("row <> class").select("row"), "copies")
        sets = self.signed.where("print is not null and id is not null").select("row", "n", "set")
        again = only_asked(sets, copies, ["row"]).join(copies, "row", "left_anti")
        self.sets = only_asked(sets, copies, ["row"], inside=False).unionByName(again)
        tiles = self.keep(self.sets.select("row", "set").mapInArrow(_tiles(per_cent), "tile long, role byte, row long"), "tiles")
        own = F.when(F.col("role") == 0, F.col("row"))
        shared = tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("rows"), F.min(own).alias("leader")).where("rows > 1 and leader is not null")
        shared = self.keep(shared, "shared")
        self.members = self.keep(lookup_join(only_asked(tiles, shared, ["tile"]), shared, ["tile"]), "members")
        self.drop(tiles, shared)
        asked = self.keep(self.members.select("row").distinct(), "asked")
        mine = only_asked(self.signed.select("row", "n", "set"), asked, ["row"]).join(asked, "row", "left_semi")
        self.mine = self.keep(mine, "mine")
        self.bits = self.keep(self.mine.mapInArrow(_bitmaps(per_cent), "row long, n long, bits binary"), "bits")
        self.drop(asked, copies)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        self.kept.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        self.kept = [k for k in self.kept if not any(k is t for t in tables)]
        forget(*tables)

    def close(self) -> None:
        self.drop(*self.kept)

    def _sides(self, pairs: DataFrame, table: DataFrame, value: str, *more: tuple[str, str]) -> DataFrame:
        for end, name, extra in (("u", "x", "n"), ("v", "y", "m")):
            side = table.select(F.col("row").alias(end), F.col(value).alias(name), *([F.col("n").alias(extra)] if more else []))
            pairs = pairs.join(side, end)
        return pairs

    def confirmed(self, pairs: DataFrame, bounded: bool = False) -> DataFrame:
        """The pairs <u, v> that link; those not yet `bounded` by bitmaps are so first."""
        if not bounded:
            pairs = self._sides(pairs, self.bits, "bits", ("n", "m")).mapInArrow(_bounded(self.per_cent), "u long, v long")
            pairs = self.keep(pairs, "pairs")
        return self.keep(self._sides(pairs, self.mine, "set").mapInArrow(_exact(self.per_cent), "u long, v long"), "links")

    def blocks(self, members: DataFrame) -> DataFrame:
        """Candidate pairs of <tile, role, row, comp, rows> by bitmaps, between sets that differ in `comp`."""
        many = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
        put = members.join(self.bits, "row").withColumn("own", F.pmod(F.xxhash64("row"), many).cast("int"))
        other = F.explode(F.sequence(F.lit(0), many - 1)).alias("other")
        meet = put.select("tile", "row", "role", "comp", "n", "bits", "own", other)
        meet = meet.select("tile", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                           (F.col("own") > F.col("other")).cast("int").alias("side"), "row", F.col("role").cast("long").alias("role"), "comp", "n", "bits")
        order = ["tile", "lo", "hi"]
        return meet.repartition(*order).sortWithinPartitions(*order).mapInArrow(_meet(self.per_cent), "u long, v long").distinct()

    def links(self) -> DataFrame:
        """All links between sets: pairs <u, v> of rows, one row for each set."""
        pairs = self.keep(self.blocks(self.members.withColumn("comp", F.col("row"))), "pairs")
        return self.confirmed(pairs, bounded=True)

    def components(self) -> DataFrame:
        """<node, root> over sets that have links."""
        ordered = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        star = self.members.where("row <> leader").select(*ordered("row", "leader")).distinct()
        links = self.confirmed(star)
        found = self.keep(components(links), "components")
        for last in (False, True):
            in_ = F.coalesce("root", "row").alias("comp")
            known = self.members.where("rows > 2").join(found.withColumnRenamed("node", "row"), "row", "left").select("tile", "role", "row", "rows", in_)
            known = self.keep(known, "known")
            score = F.when(F.col("role") == 0, F.struct(F.xxhash64(F.lit(7), "row").alias("h"), "row", "comp"))
            several = known.groupBy("tile").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min(score).alias("x")).where("a <> b")
            several = several.select("tile", F.col("x.row").alias("leader"), F.col("x.comp").alias("lead"))
            open_ = lookup_join(only_asked(known, several.select("tile"), ["tile"]), several, ["tile"])
            if last:
                pairs = self.keep(self.blocks(open_), "pairs")
                more = self.confirmed(pairs, bounded=True)
            else:
                more = self.confirmed(open_.where("lead <> comp").select(*ordered("row", "leader")).distinct())
            self.drop(known)
            if not more.isEmpty():
                links = links.unionByName(more)
                found = self.keep(components(links), "components")
        return found


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, per_cent: int = SIMILARITY) -> DataFrame:
    """<key, n_shingles, component_id>, one row per input row. Keys are integers.

    Documents are linked when their sets of distinct `size`-word n-grams (words split at blanks, A-Z lower-cased) have a
    Jaccard similarity of at least per_cent / 100; component_id is the smallest key reachable over links. Fewer words than
    `size` make one n-gram; null or blank text has an empty set and no link. Rows with a null key are never linked and have a
    null component; rows that repeat a key are judged by their own texts. An empty table gives no rows. Other columns are not
    read.
    """
    join = _Join(docs, key, text, size, per_cent)
    found = join.components()
    nodes = join.rows.where("row = class").select("class", "rep").join(found.withColumnRenamed("node", "class"), "class")
    low = lookup_join(nodes, nodes.groupBy("root").agg(F.min("rep").alias("low")), ["root"]).select("class", "low")
    at = lookup_join(join.rows, low, ["class"], "left").select("row", F.coalesce("low", "rep").alias("component_id"))
    out = join.signed.select("row", "id", "n").join(at, "row", "left")
    out = stored(out.select(F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")), "groups")
    join.close()
    return out


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, per_cent: int = SIMILARITY) -> DataFrame:
    """<a, b>: every link between documents of different sets, each set by its smallest key, a below b; as `similar_groups` else.

    The result is as long as there are links between different sets; copies are not expanded.
    """
    join = _Join(docs, key, text, size, per_cent)
    rep = join.rows.where("row = class").select("class", "rep")
    both = join.links().join(rep.select(F.col("class").alias("u"), F.col("rep").alias("p")), "u").join(rep.select(F.col("class").alias("v"), F.col("rep").alias("q")), "v")
    out = stored(both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a < b").distinct(), "pairs")
    join.close()
    return out
