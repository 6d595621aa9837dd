"""Importance resampling towards a target distribution of hashed n-grams.

A feature is a run of words; its bucket is the CRC-32 of its text modulo BUCKETS. Words are found in two tables that are
sent to every task: the CRC states of the HEAD commonest words, and the buckets of the HEAD commonest pairs, both exact.
The rest, the tail, takes the CRC directly; a longer run continues the state of its first words, so nothing is hashed
twice. What a feature counts for never depends on the table it was found in, so bucket totals are exact for any head.

Weights compare smoothed bucket shares of the target and of the corpus; a Gumbel draw from the document's key makes the
highest scores a sample without replacement. Each document's buckets are stored once, totals come from the same pass.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import dense_index
from .common import forget, ship, stored

BUCKETS, RUNS, SEED = 10_000, 1, 2024
LEAST_WORDS, PER_CENT = 20, 10
HEAD, LONGEST = 20_000, 48  # entries of each head table, and bytes of an entry: 2 MB in all
TRACKED = 200_000  # entries a task counts at a time

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Bytes to words: A-Z lower-cased, ASCII other than letters and digits a space, all others as they are.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Buckets:
    """Buckets of a text's features, runs of 1 to `runs` words, by the head tables and CRC-32 for the tail."""

    def __init__(self, states: dict[bytes, int], pairs: dict[bytes, int], runs: int, buckets: int):
        self.states, self.pairs, self.runs, self.buckets = states, pairs, runs, buckets

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, crc = self.states.get, zlib.crc32
        states = [crc(w) if (s := known(w)) is None else s for w in words]
        out = [np.array(states, np.int64) % self.buckets]
        if self.runs > 1 and len(words) > 1:
            found = [self.pairs.get(a + b" " + b) for a, b in zip(words, words[1:])]
            if self.runs == 2:
                out.append(np.fromiter((crc(b" " + b, s) % self.buckets if p is None else p for p, s, b in zip(found, states, words[1:])), np.int64, len(found)))
            else:
                now = [crc(b" " + b, s) for s, b in zip(states, words[1:])]
                out.append(np.array(now, np.int64) % self.buckets)
                for k in range(3, self.runs + 1):
                    now = [crc(b" " + b, s) for s, b in zip(now, words[k - 1:])]
                    out.append(np.array(now, np.int64) % self.buckets)
        return np.concatenate(out)


def _common(runs: int) -> Run:
    """<feature, pair, n> of the commonest words and pairs of a task, counted TRACKED at a time."""

    def rows(counts: Counter, pair: bool) -> pa.RecordBatch:
        top = counts.most_common(HEAD)
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([pair] * len(top), pa.bool_()), pa.array([n for _, n in top], pa.int64())], ["feature", "pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double = Counter(), Counter()
        for batch in batches:
            for text in batch.column("text"):
                found = words_of(text.as_py())
                single.update(found)
                if runs == 2:
                    double.update(a + b" " + b for a, b in zip(found, found[1:]))
                for counts, pair in ((single, False), (double, True)):
                    if len(counts) > TRACKED:
                        yield rows(counts, pair)
        yield rows(single, False)
        yield rows(double, True)

    return run


def head_tables(texts: DataFrame, runs: int = RUNS) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """CRC states of the commonest words and of the commonest pairs, at most HEAD each and no entry above LONGEST bytes."""
    counts = texts.mapInArrow(_common(runs), "feature binary, pair boolean, n long").where(F.length("feature") <= LONGEST).groupBy("pair", "feature").agg(F.sum("n").alias("n"))
    counts = stored(counts.where("n > 1"), "head")
    tables = []
    for pair in (False, True):
        rows = counts.where(F.col("pair") == pair).orderBy(F.desc("n"), "feature").limit(HEAD).select("feature").collect() if runs > 1 or not pair else []
        tables.append({bytes(r["feature"]): zlib.crc32(bytes(r["feature"])) for r in rows})
    forget(counts)
    return tables[0], tables[1]


def _counted(make: Callable[[], Buckets]) -> Run:
    """<id, n_words, n_features, buckets, counts> of each <id, text>, then the task's total of each bucket."""
    names = ["id", "n_words", "n_features", "buckets", "counts", "bucket", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, kind = make(), None
        totals = np.zeros(cut.buckets, np.int64)
        for batch in batches:
            sizes, features, places, counts = [], [], [], []
            for text in batch.column("text"):
                found = words_of(text.as_py())
                at, n = np.unique(cut(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
                totals[at] += n
                sizes.append(len(found))
                features.append(int(n.sum()))
                places.append(at.astype("<u4").tobytes())
                counts.append(n.astype("<u4").tobytes())
            kind = batch.column("id").type
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(features, pa.int64()), pa.array(places, pa.binary()), pa.array(counts, pa.binary()),
                                              pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64())], names)
        some = np.flatnonzero(totals)
        if len(some):
            none = [pa.nulls(len(some), t) for t in (kind, pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(some.astype(np.int32)), pa.array(totals[some])], names)

    return run


def _totals(counted: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in counted.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the corpus, for each bucket."""
    k, t_all, s_all = len(target), int(target.sum()), int(corpus.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (float(s_all) + k) / ((float(s) + 1) * (float(t_all) + k)))) for t, s in zip(target.tolist(), corpus.tolist())], np.int64)


def _scored(gain: np.ndarray, seed: int) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, scores = [], []
            for one, n, at, counts in zip(*(batch.column(c).to_pylist() for c in ("id", "n_features", "buckets", "counts")), strict=True):
                whole = int(gain[np.frombuffer(at, "<u4")] @ np.frombuffer(counts, "<u4").astype(np.int64)) if n else 0
                weight = whole // n if n else 0
                h = int(hashlib.sha256(f"{seed}:{'' if one is None else one}".encode()).hexdigest()[:8], 16)
                weights.append(weight)
                scores.append(weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_words", "n_features")), pa.array(weights, pa.int64()), pa.array(scores, pa.int64())],
                                             ["id", "n_words", "n_features", "weight", "score"])

    return run


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", runs: int = RUNS, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = SEED) -> DataFrame:
    """<key, n_features, weight, score, rank>, one row per input row; rank is null where a document isn't drawn.

    Drawn are the highest scores, `per_cent` of the documents with `least_words` words, ties to the smaller key, a null key
    last. Null text has no words: no features, weight 0, never drawn. Rows that repeat a key share its draw, not its weight;
    repeated rows of equal score are all ranked, in any order. An empty table gives no rows, an empty target makes weights of
    the corpus alone. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    wanted = target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text"))
    head = spark.sparkContext.broadcast(head_tables(source.select("text"), runs))  # 2 * HEAD entries at most

    def make() -> Buckets:
        states, pairs = head.value
        return Buckets(states, {p: c % buckets for p, c in pairs.items()}, runs, buckets)

    shape = "n_words long, n_features long, buckets binary, counts binary, bucket int, n long"
    counted = stored(source.mapInArrow(_counted(make), f"id {kind}, {shape}"), "buckets")
    goal = stored(wanted.mapInArrow(_counted(make), f"id long, {shape}"), "target")
    gain = gains(_totals(goal, buckets), _totals(counted, buckets))
    rows = counted.where("bucket is null").select("id", "n_words", "n_features", "buckets", "counts")
    scored = stored(rows.mapInArrow(_scored(gain, seed), f"id {kind}, n_words long, n_features long, weight long, score long"), "scored")
    forget(counted, goal)
    fit = F.col("n_words") >= least_words
    drawn = per_cent * scored.where(fit).count() // 100
    cut = _cut(scored.where(fit), drawn)
    result = lambda rank: [F.col("id").alias(key), "n_features", "weight", "score", rank.cast("long").alias("rank")]
    near = fit & (F.col("score") >= F.lit(cut)) if cut is not None else F.lit(False)
    ranked = dense_index(scored.where(near), [F.desc("score"), F.asc_nulls_last("id")], "_rank")
    return scored.where(~near).select(*result(F.lit(None))).unionByName(ranked.select(*result(F.when(F.col("_rank") <= drawn, F.col("_rank")))))


def _cut(rows: DataFrame, drawn: int) -> int | None:
    """The score from which at least `drawn` rows are counted; scores are whole numbers of a bounded range."""
    if not drawn:
        return None
    seen = 0
    for r in rows.groupBy("score").count().orderBy(F.desc("score")).toLocalIterator():
        seen += r["count"]
        if seen >= drawn:
            return r["score"]
    return None


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn documents with their own columns; rows that share a key are drawn together."""
    chosen = resample(docs, target, key, text, **options).where("rank is not null").select(F.col(key).alias("_drawn")).distinct()
    return docs.join(chosen, F.col(key).eqNullSafe(F.col("_drawn")), "left_semi")

