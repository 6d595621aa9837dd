"""Centroid clustering of vectors through a vector-approximation file.

Vectors are rows of integers. The approximation file holds, for each vector, a cell of BITS bits per dimension; the bounds of
the cells follow each dimension's mean and spread. For a centroid, a lookup table per dimension gives the least and the
largest squared difference to a cell's values, so sums over the dimensions are an interval around the exact distance. A
vector goes to the centroid whose interval lies below all others; only where intervals overlap is the full vector fetched
and the exact distance taken, with the smaller number first in a tie.

Centroids move by exact integer sums. After the first round only vectors that change their cluster add to these sums, and
those are fetched as well; vectors that stay are never read in full before the last pass, whose output holds distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, ship, stored
from .exact_dedup import only_asked

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
BITS = 6  # of a cell
LARGEST = 1 << 27  # integers beyond this may have squared distances that don't fit 64 bits

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def integers(vector: Column, dimensions: int, scale: int) -> Column:
    """floor(scale * x) of each component as a double, null unless all `dimensions` are there, finite and within LARGEST."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST / scale))
    return F.when((F.size(vector) == dimensions) & fine, scaled)


# --- cells ----------------------------------------------------------------------------------


def cell_edges(count: int, sums: np.ndarray, squares: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each dimension, the largest integers of all cells but the last: even steps over 2.5 deviations to either side."""
    mean = sums / max(count, 1)
    spread = np.sqrt(np.maximum(squares / max(count, 1) - mean * mean, 0.0))
    steps = np.linspace(-2.5, 2.5, (1 << bits) - 1)
    return np.floor(mean[:, None] + np.maximum(spread, 0.5)[:, None] * steps[None, :]).astype(np.int64)


def cells_of(vectors: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[d], vectors[:, d], "left") for d in range(len(edges))], axis=1).astype(np.uint8)


def packed(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    planes = (cells[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return [row.tobytes() for row in np.packbits(planes.reshape(len(cells), -1), axis=1)]


def unpacked(rows: list[bytes], dimensions: int, bits: int = BITS) -> np.ndarray:
    planes = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1, count=dimensions * bits)
    return (planes.reshape(len(rows), dimensions, bits) << np.arange(bits, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def lookup_tables(edges: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared difference of each <dimension, cell, centroid>; `low` and `high` bound the outer cells."""
    first = np.minimum(np.concatenate((low[:, None], edges + 1), axis=1), high[:, None])
    last = np.maximum(np.minimum(np.concatenate((edges, high[:, None]), axis=1), high[:, None]), low[:, None])
    first = np.maximum(first, low[:, None])
    below, above = first[:, :, None] - centroids.T[:, None, :], centroids.T[:, None, :] - last[:, :, None]
    least = np.maximum(np.maximum(below, above), 0) ** 2
    most = np.maximum(np.abs(below), np.abs(above)) ** 2
    return least, most


def possible(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each centroid may be the nearest of each row, by intervals alone."""
    least, most = (np.zeros((len(cells), t.shape[2]), np.int64) for t in tables)
    for d in range(cells.shape[1]):
        least += tables[0][d][cells[:, d]]
        most += tables[1][d][cells[:, d]]
    return least <= most.min(axis=1, keepdims=True)


def settle(vectors: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row among those that may be it; exact distances only where several may."""
    out = may.argmax(axis=1)
    for i in np.flatnonzero(may.sum(axis=1) > 1):
        those = np.flatnonzero(may[i])
        out[i] = those[((vectors[i] - centroids[those]) ** 2).sum(axis=1).argmin()]
    return out


# --- tasks ----------------------------------------------------------------------------------


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), width).astype(np.int64)


def _packed_vectors(dimensions: int) -> Run:
    """<id, vector> with the vector as bytes, and for each task and dimension the figures that cells are made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, squares = 0, [0] * dimensions, np.zeros(dimensions)
        low, high = np.full(dimensions, np.iinfo(np.int64).max), np.full(dimensions, np.iinfo(np.int64).min)
        names = ["id", "full", "dim", "n", "total", "squares", "low", "high"]
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("vector").flatten().to_numpy().reshape(-1, dimensions)
            count += len(values)
            sums = [a + int(b) for a, b in zip(sums, values.sum(axis=0), strict=True)]
            squares += (values.astype(float) ** 2).sum(axis=0)
            low, high = np.minimum(low, values.min(axis=0)), np.maximum(high, values.max(axis=0))
            none = [pa.nulls(len(values), t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.astype("<i8").tobytes() for v in values], pa.binary()), *none], names)
            kind = batch.column("id").type
        if count:
            yield pa.RecordBatch.from_arrays([
                pa.nulls(dimensions, kind), pa.nulls(dimensions, pa.binary()), pa.array(range(dimensions), pa.int32()), pa.array([count] * dimensions, pa.int64()),
                pa.array(sums, pa.int64()), pa.array(squares), pa.array(low), pa.array(high)], names)

    return run


class _Moves:
    """Sums of the vectors that came to each cluster less those that left it, of one task."""

    def __init__(self, clusters: int, dimensions: int):
        self.sums, self.counts = np.zeros((clusters, dimensions), np.int64), np.zeros(clusters, np.int64)

    def add(self, clusters: np.ndarray, vectors: np.ndarray, sign: int = 1) -> None:
        np.add.at(self.sums, clusters, sign * vectors)
        np.add.at(self.counts, clusters, sign)

    def batch(self) -> pa.RecordBatch:
        k, width = self.sums.shape
        rows = k * width
        return pa.RecordBatch.from_arrays(
            [pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()), pa.array(np.repeat(np.arange(k), width).astype(np.int32)), pa.array(np.tile(np.arange(width), k).astype(np.int32)),
             pa.array(self.sums.ravel()), pa.array(np.repeat(self.counts, width))], _STATE)


_STATE = ["row", "cells", "cluster", "dim", "moved", "n"]
_STATE_SCHEMA = "row long, cells binary, cluster int, dim int, moved long, n long"


def _state(row: pa.Array, cells: pa.Array, clusters: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(row), t) for t in (pa.int32(), pa.int64(), pa.int64())]
    return pa.RecordBatch.from_arrays([row, cells, pa.array(clusters.astype(np.int32)), *none], _STATE)


def _first_round(edges: np.ndarray, tables: tuple, centroids: np.ndarray) -> Run:
    """The approximation file of <row, full>, each with its first cluster, and the task's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = _Moves(*centroids.shape)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("full"), centroids.shape[1])
                cells = cells_of(vectors, edges)
                clusters = settle(vectors, possible(cells, tables), centroids)
                moves.add(clusters, vectors)
                yield _state(batch.column("row"), pa.array(packed(cells), pa.binary()), clusters)
        yield moves.batch()

    return run


def _by_cells(tables: tuple, dimensions: int) -> Run:
    """<row, cells, cluster, may>: `may` is null where the cells alone say that the vector stays in its cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                may = possible(unpacked(batch.column("cells").to_pylist(), dimensions), tables)
                clusters = batch.column("cluster").to_numpy()
                stays = (may.sum(axis=1) == 1) & (may.argmax(axis=1) == clusters)
                asked = [None if s else m.tobytes() for s, m in zip(stays, may.astype(np.uint8), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "cells", "cluster")), pa.array(asked, pa.binary())], ["row", "cells", "cluster", "may"])

    return run


def _fetched(centroids: np.ndarray) -> Run:
    """New clusters of <row, cells, cluster, may, full>, and the sums that the task's vectors moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = _Moves(*centroids.shape)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("full"), centroids.shape[1])
                may = np.frombuffer(b"".join(batch.column("may").to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(bool)
                old, new = batch.column("cluster").to_numpy(), settle(vectors, may, centroids)
                moved = old != new
                moves.add(new[moved], vectors[moved])
                moves.add(old[moved], vectors[moved], -1)
                yield _state(batch.column("row"), batch.column("cells"), new)
        yield moves.batch()

    return run


def _last_pass(edges: np.ndarray, tables: tuple, centroids: np.ndarray) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("full"), centroids.shape[1]) if batch.num_rows else np.zeros((0, centroids.shape[1]), np.int64)
            clusters = settle(vectors, possible(cells_of(vectors, edges), tables), centroids)
            distance = ((vectors - centroids[clusters]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(clusters.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return run


# --- the operator ---------------------------------------------------------------------------


def _sums(state: DataFrame, clusters: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """What a round's tasks moved: one row per cluster and dimension reaches the driver."""
    sums, counts = np.zeros((clusters, dimensions), np.int64), np.zeros(clusters, np.int64)
    for r in state.where("dim is not null").groupBy("cluster", "dim").agg(F.sum("moved").alias("moved"), F.sum("n").alias("n")).collect():
        sums[r["cluster"], r["dim"]], counts[r["cluster"]] = r["moved"], r["n"]
    return sums, counts


def _moved(centroids: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count); empty clusters keep their centroid."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)


def first_centroids(kept: DataFrame, clusters: int, seed: int, dimensions: int) -> np.ndarray:
    """The vectors of least sha256('<seed>:<id>'), in that order; a null id counts as empty text, equal hashes go by components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("h"), "vector").orderBy("h", "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in rows], np.int64).reshape(-1, dimensions)


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """<key, cluster, distance, cluster_inertia, inertia, centroid_sha256>, one row per kept vector.

    Kept are vectors of exactly `dimensions` components, none null, non-finite or beyond LARGEST / scale; the rest have no
    row. Components become floor(scale * x). Null and repeated keys are kept like others. Fewer vectors than `clusters` make
    fewer clusters; an empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[key].dataType.simpleString()
    kept = vectors.select(F.col(key).alias("id"), integers(F.col(vector), dimensions, scale).alias("vector")).where("vector is not null")
    centroids = first_centroids(kept, clusters, seed, dimensions)
    shape = f"id {kind}, full binary, dim int, n long, total long, squares double, low long, high long"
    written = stored(kept.mapInArrow(_packed_vectors(dimensions), shape).withColumn("row", F.monotonically_increasing_id()), "vectors")
    full = written.where("dim is null").select("row", "id", "full")
    per_dim = {r["dim"]: r for r in written.where("dim is not null").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("double")).alias("total"), F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    if not per_dim:
        return full.select(F.col("id").alias(key), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    figures = lambda name: np.array([per_dim[d][name] for d in range(dimensions)])
    edges = cell_edges(int(per_dim[0]["n"]), figures("total"), figures("squares"))
    bounds = figures("low").astype(np.int64), figures("high").astype(np.int64)
    state, sums, counts = None, np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
    for _ in range(rounds):
        tables = lookup_tables(edges, *bounds, centroids)
        if state is None:
            new = stored(full.select("row", "full").mapInArrow(_first_round(edges, tables, centroids), _STATE_SCHEMA), "cells")
        else:
            walked = stored(state.where("dim is null").select("row", "cells", "cluster").mapInArrow(_by_cells(tables, dimensions), "row long, cells binary, cluster int, may binary"), "walked")
            asked = walked.where("may is not null")
            fetched = only_asked(full.select("row", "full"), asked.select("row"), ["row"])
            met = asked.join(fetched, "row").mapInArrow(_fetched(centroids), _STATE_SCHEMA)
            stay = walked.where("may is null").select("row", "cells", "cluster", *[F.lit(None).cast(t).alias(c) for c, t in (("dim", "int"), ("moved", "long"), ("n", "long"))])
            new = stored(stay.unionByName(met), "cells")
            forget(state, walked)
        state = new
        change = _sums(state, *centroids.shape)
        sums, counts = sums + change[0], counts + change[1]
        centroids = _moved(centroids, sums, counts)
    if state is not None:
        forget(state)
    tables = lookup_tables(edges, *bounds, centroids)
    out = stored(full.select("id", "full").mapInArrow(_last_pass(edges, tables, centroids), f"id {kind}, cluster int, distance long"), "clusters")
    forget(written)
    inertia = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = lambda values, t: F.get(F.array(*[F.lit(v).cast(t) for v in values]), F.col("cluster"))
    return out.select(F.col("id").alias(key), "cluster", "distance", by_cluster([inertia.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
                      F.lit(sum(inertia.values())).cast("long").alias("inertia"), by_cluster(digests, "string").alias("centroid_sha256"))
