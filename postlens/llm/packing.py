"""Best-fit packing of token pieces by a linear grouping scheme.

Packing is planned on the histogram of piece lengths, which has at most CAPACITY entries however large the corpus is.
Large lengths are put in groups of equal cardinality and rounded up to the longest of their group; over these few sizes
the best mix of configurations is found by repeatedly adding the configuration of highest value under the current duals;
actual pieces take the places of their group. Small pieces then go, longest first, where the least room is left over.
Tasks count their pieces by length; a piece's rank among those of its length names its place in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slim, stored
from .tokens import Encoder

CAPACITY, END_ID = 4096, 1
#: (share of CAPACITY from which a piece is large, number of groups); the plan with the fewest sequences is taken, the first
#: of equals.
SCHEMES = ((1 / 3, 24), (1 / 3, 96), (1 / 8, 24), (1 / 8, 96))
CACHE_BYTES, SMALL_CACHE_BYTES = 128 << 20, 32 << 20  # of a task's token cache; the small one where tasks hold ids as well
BATCH_IDS = 1 << 19  # of a batch of pieces

Lot = tuple[int, int]  # first sequence, number of sequences; all of a lot hold the same lengths


class Plan:
    """Places by length: ranks from `start` on go, `copies` to a sequence, to sequences from `first` on at `offset`."""

    def __init__(self) -> None:
        self.rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.used: dict[int, int] = defaultdict(int)
        self.sequences = 0
        self.gaps: list[int] = []
        self.lots: dict[int, list[Lot]] = defaultdict(list)

    def place(self, length: int, n: int, first: int, copies: int, offset: int) -> None:
        self.rows[length].append((self.used[length], first, copies, offset))
        self.used[length] += n

    def open(self, n: int) -> Lot:
        first, self.sequences = self.sequences, self.sequences + n
        return first, n

    def put(self, gap: int, lot: Lot) -> None:
        if gap and lot[1]:
            if not self.lots[gap]:
                insort(self.gaps, gap)
            self.lots[gap].append(lot)

    def best(self, length: int) -> tuple[int, Lot] | None:
        """Take out a lot with the least gap that holds the length."""
        k = bisect_left(self.gaps, length)
        if k == len(self.gaps):
            return None
        gap = self.gaps[k]
        lot = self.lots[gap].pop()
        if not self.lots[gap]:
            del self.gaps[k]
        return gap, lot

    def best_fit(self, length: int, n: int) -> None:
        """Place n pieces of one length as best fit does one by one: a sequence takes all that fit before the next is tried."""
        while n:
            gap, (first, count) = self.best(length) or (CAPACITY, self.open(-(-n // (CAPACITY // length))))
            copies = gap // length
            full = min(count, n // copies)
            if full:
                self.place(length, full * copies, first, copies, CAPACITY - gap)
                self.put(gap - copies * length, (first, full))
                n -= full * copies
            if full < count:
                if n and n < copies:
                    self.place(length, n, first + full, n, CAPACITY - gap)
                    self.put(gap - n * length, (first + full, 1))
                    n, full = 0, full + 1
                self.put(gap, (first + full, count - full))


def groups_of(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count), longest first, in groups of equal cardinality."""
    total = sum(n for _, n in large)
    size = max(-(-total // groups), 1)
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, n in large:
        while n:
            if not room:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def _best_configuration(sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, float]:
    """The multiset of sizes within CAPACITY of the highest value, by number of items."""
    best, picks = np.zeros(CAPACITY + 1), []
    for _ in range(CAPACITY // int(sizes.min())):
        options = np.full((len(sizes), CAPACITY + 1), -1.0)
        for g, s in enumerate(sizes):
            options[g, s:] = best[:CAPACITY + 1 - s] + values[g]
        pick = options.argmax(axis=0)
        grown = options[pick, np.arange(CAPACITY + 1)]
        better = grown > best + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, pick, -1))
        best = np.where(better, grown, best)
    config, room = np.zeros(len(sizes), int), CAPACITY
    for pick in reversed(picks):
        if pick[room] >= 0:
            config[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return config, float(config @ values)


def configurations(sizes: list[int], counts: list[int], rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, so that few sequences hold all rounded pieces (may be fractional)."""
    size, demand = np.array(sizes), np.array(counts, float)
    basis = np.diag([CAPACITY // s for s in sizes]).astype(float)
    use = demand / basis.diagonal()
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        config, value = _best_configuration(size, np.maximum(duals, 0))
        if value <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, config.astype(float))
        limit = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
        out = int(limit.argmin())
        step = limit[out]
        if not np.isfinite(step):
            break
        use = np.maximum(use - step * change, 0)
        use[out], basis[:, out] = step, config
    return [(basis[:, k].astype(int), float(use[k])) for k in range(len(sizes)) if use[k] > 0]


def plan_packing(histogram: dict[int, int], schemes: tuple[tuple[float, int], ...] = SCHEMES) -> Plan:
    """Places for all pieces of the histogram (length → count, lengths from 1 to CAPACITY)."""
    return min((_plan(histogram, large, groups) for large, groups in schemes), key=lambda p: p.sequences)


def _plan(histogram: dict[int, int], large: float, groups: int) -> Plan:
    plan = Plan()
    if n := histogram.get(CAPACITY, 0):
        plan.place(CAPACITY, n, plan.open(n)[0], 1, 0)
    runs = sorted(((length, n) for length, n in histogram.items() if n and length < CAPACITY), reverse=True)
    grouped = groups_of([r for r in runs if r[0] > CAPACITY * large], groups)
    rest: dict[int, int] = defaultdict(int)
    if grouped:
        sizes = [g[0][0] for g in grouped]
        pools = [[list(r) for r in g] for g in grouped]
        for config, use in configurations(sizes, [sum(n for _, n in g) for g in grouped]):
            _substitute(plan, config, int(use + 1e-6), pools)
        for pool in pools:
            for length, n in pool:
                rest[length] += n
    for length, n in runs:
        if length <= CAPACITY * large:
            rest[length] += n
    for length in sorted(rest, reverse=True):
        plan.best_fit(length, rest[length])
    return plan


def _substitute(plan: Plan, config: np.ndarray, times: int, pools: list[list[list[int]]]) -> None:
    """Open `times` sequences of a configuration and put actual pieces, longest first, in the places of their groups."""
    if not times:
        return
    lots = [(*plan.open(times), 0)]  # first, count, filled
    for g in np.repeat(np.arange(len(config)), config):
        after = []
        for first, count, filled in lots:
            while count and pools[g]:
                run = pools[g][0]
                take = min(run[1], count)
                plan.place(run[0], take, first, 1, filled)
                after.append((first, take, filled + run[0]))
                first, count = first + take, count - take
                run[1] -= take
                if not run[1]:
                    pools[g].pop(0)
            if count:
                after.append((first, count, filled))
        lots = after
    for first, count, filled in lots:
        plan.put(CAPACITY - filled, (first, count))


def _cutter(path: str, with_ids: bool, cache_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of <key, text>, each with its task, its place among the task's pieces of its length, and its ids on request."""
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
    names = ["key", "piece", "start", "length", "ids_crc32", "task", "place", "ids"][:8 if with_ids else 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slim()
        encoder, seen, task = Encoder(path, cache_bytes), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            rows, held = [], 0

            def flush(batch: pa.RecordBatch = batch, rows: list = rows) -> pa.RecordBatch:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)]
                rows.clear()
                return pa.RecordBatch.from_arrays([batch.column("key").take(cols[0]), *cols[1:]], names)

            for i, text in enumerate(batch.column("text")):
                ids = encoder.encode(text.as_py() or "") + END_ID.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                    part = ids[at:at + 4 * CAPACITY]
                    length = len(part) // 4
                    row = (i, piece, at // 4, length, zlib.crc32(part), task, seen[length])
                    rows.append((*row, part) if with_ids else row)
                    seen[length] += 1
                    held += length
                    if held > BATCH_IDS:
                        yield flush()
                        held = 0
            if rows:
                yield flush()

    return run


def _placer(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    table = {length: np.array(rows, np.int64) for length, rows in plan.rows.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            where, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                mine = lengths == length
                rows = table[int(length)]
                row = rows[np.searchsorted(rows[:, 0], ranks[mine], "right") - 1]
                turn, copy = np.divmod(ranks[mine] - row[:, 0], row[:, 2])
                where[mine], offset[mine] = row[:, 1] + turn, row[:, 3] + copy * length
            keep = [n for n in batch.schema.names if n not in ("rank", "ids")]
            out = dict(zip([*keep, "sequence_id", "offset"], [*(batch.column(n) for n in keep), pa.array(where), pa.array(offset)], strict=True))
            if "ids" in batch.schema.names:
                values = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<i4")
                ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                out["input_ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def _placed(docs: DataFrame, path: str, key: str, text: str, with_ids: bool, cache_bytes: int) -> DataFrame:
    """Pieces with their places. Texts are tokenized once; what comes after works on the stored pieces."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    head, ids = f"key {kind}, piece int, start long, length long, ids_crc32 long", ["ids"] if with_ids else []
    shape = f"{head}, task long, place long" + (", ids binary" if with_ids else "")
    pieces = stored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_cutter(path, with_ids, cache_bytes), shape), "pieces")
    counts = stored(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select("key", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"), *ids)
    return ranked.mapInArrow(_placer(plan_packing(histogram)), f"{head}, sequence_id long, offset long" + (", input_ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """<key, piece, start, length, ids_crc32, sequence_id, offset>, a row per piece.

    A document is its ids and END_ID; null text counts as empty, so each row has at least one piece. Only documents of more
    than CAPACITY ids are cut. Null or repeated keys are packed like others. An empty table gives no rows. Only the
    histogram of lengths, CAPACITY numbers at most, reaches the driver, and only the plan made of it the tasks.
    """
    return _placed(docs, path, key, text, with_ids=False, cache_bytes=cache_bytes).withColumnRenamed("key", key)


def packed_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", cache_bytes: int = SMALL_CACHE_BYTES) -> DataFrame:
    """<sequence_id, offset, key, piece, input_ids>: the packed sequences themselves, a row per piece of a sequence.

    Every row of `docs` is packed, as `pack` does it; repeated and null keys too. Other columns are not read.
    """
    return _placed(docs, path, key, text, with_ids=True, cache_bytes=cache_bytes).select("sequence_id", "offset", F.col("key").alias(key), "piece", "input_ids")
