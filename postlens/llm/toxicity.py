"""A toxicity classifier that keeps its score when identity terms are swapped.

Features are a text's distinct words and word beginnings. A bounded sample of labelled rows is taken by a hash of the key;
over it Spark counts features by label, and logistic regression is fitted on the telling ones and on the words that get
swapped. Each sampled text with such words is paired with counterfactuals in which each is swapped for another of its kind;
the loss adds the mean squared difference of the pairs' scores, so that a neutral mention doesn't raise a score.

Kinds come from two places: a table of group names by language, and the sample itself. Derived kinds are pairs of words that
stand in texts of both labels as often as texts in general do, and that are each other's nearest by the words next to them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, ship, stored

SAMPLE_ROWS = 20_000  # the bound on labelled rows that the classifier is fitted on
MOST_FEATURES, LEAST_DOCS, LEAST_G2 = 2048, 4, 16.0
L2, SWAP_PENALTY, STEPS = 2e-4, 1.0, 400
THRESHOLD = 0.3
BEGINNINGS = (4, 5)
LEAST_BOTH = 10  # texts of each label that a word of a derived kind stands in
MOST_Z = 1.96  # of the log ratio of its shares in toxic and other texts
CONTEXTS = 128  # commonest such words that count as neighbours
#: Kinds of group names by language; a name is swapped for the next of its kind.
IDENTITIES: dict[str, tuple[tuple[str, ...], ...]] = {
    "en": (
        ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
        ("immigrants", "natives", "refugees"), ("disabled", "deaf", "blind"), ("old", "young"),
        ("africans", "europeans", "americans", "asians", "arabs"),
    ),
    "de": (
        ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("muslime", "christen", "juden", "atheisten"),
        ("schwarze", "weiße"), ("schwule", "lesben"), ("ausländer", "deutsche", "flüchtlinge"), ("türken", "polen", "araber"),
    ),
    "fr": (
        ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
        ("noirs", "blancs"), ("gays", "lesbiennes"), ("étrangers", "français", "réfugiés"), ("arabes", "africains", "européens"),
    ),
    "es": (
        ("mujeres", "hombres"), ("mujer", "hombre"), ("chicas", "chicos"), ("musulmanes", "cristianos", "judíos", "ateos"),
        ("negros", "blancos"), ("lesbianas", "homosexuales"), ("extranjeros", "españoles", "refugiados"), ("árabes", "africanos", "europeos"),
    ),
}
Kinds = Iterable[tuple[str, ...]]
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


def features_of(found: set[str]) -> set[str]:
    """Words, and beginnings of longer words written with a star."""
    out = set(found)
    for k in BEGINNINGS:
        out.update(w[:k] + "*" for w in found if len(w) > k)
    return out


def swap_map(kinds: Kinds) -> dict[str, str]:
    """Each term and the next of its kind; a term of several kinds keeps its first."""
    out: dict[str, str] = {}
    for kind in kinds:
        for i, term in enumerate(kind):
            out.setdefault(term, kind[(i + 1) % len(kind)])
    return out


def listed_kinds(table: Mapping[str, Kinds] = IDENTITIES) -> list[tuple[str, ...]]:
    """The kinds of all languages: a text's language is no input of its score."""
    return [kind for kinds in table.values() for kind in kinds]


def swapped(found: set[str], swap: Mapping[str, str]) -> set[str] | None:
    """The words with each term swapped, None without such terms."""
    named = {w for w in found if w in swap}
    return (found - named) | {swap[w] for w in named} if named else None


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """<feature, pos, neg> of each task's texts."""
    for batch in batches:
        by = (Counter(), Counter())
        for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
            by[label.as_py()].update(features_of(words_of(text.as_py())))
        names = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][n] for n in names], pa.int64()),
                                          pa.array([by[0][n] for n in names], pa.int64())], ["feature", "pos", "neg"])


def _indexed(index: dict[str, int], swaps: list[dict[str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """<label, own, gained, lost>: a text's features, and for each set of swaps those a swap adds and takes (null: no term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, gained, lost = [], [], []
            for text in batch.column("text"):
                found = words_of(text.as_py())
                has = {index[f] for f in features_of(found) if f in index}
                others = [None if other is None else {index[f] for f in features_of(other) if f in index}
                          for other in (swapped(found, swap) for swap in swaps)]
                own.append(sorted(has))
                gained.append([None if o is None else sorted(o - has) for o in others])
                lost.append([None if o is None else sorted(has - o) for o in others])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(own, kind), pa.array(gained, pa.list_(kind)),
                                              pa.array(lost, pa.list_(kind))], ["label", "own", "gained", "lost"])

    return run


def _neighbours(index: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """<word, context, n>: how often an indexed word stands after (context) or before (CONTEXTS + context) a common one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text"):
                line = [index.get(w, -1) for w in _LETTERS.findall((text.as_py() or "").lower())]
                for left, right in zip(line, line[1:]):
                    if left >= 0 and right >= 0:
                        if left < CONTEXTS:
                            seen[right, left] += 1
                        if right < CONTEXTS:
                            seen[left, CONTEXTS + right] += 1
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in seen], pa.int32()), "context": pa.array([c for _, c in seen], pa.int32()),
                                              "n": pa.array(seen.values(), pa.int64())})

    return run


def mutual_nearest(contexts: np.ndarray, block: int = 512) -> list[tuple[int, int]]:
    """Pairs of rows that are each other's nearest by cosine, ties to the smaller row; rows without contexts have none."""
    length = np.linalg.norm(contexts, axis=1)
    unit = contexts / np.where(length > 0, length, 1)[:, None]
    nearest = np.full(len(unit), -1, np.int64)
    for start in range(0, len(unit), block):
        near = np.round(unit[start:start + block] @ unit.T, 9)
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -1.0
        best = near.argmax(axis=1)
        nearest[start:start + block] = np.where(near[np.arange(len(near)), best] > 0, best, -1)
    return [(i, int(j)) for i, j in enumerate(nearest) if i < j and nearest[j] == i]


def derived_kinds(sample: DataFrame, counts: DataFrame, positives: int, negatives: int, taken: Iterable[str] = ()) -> list[tuple[str, str]]:
    """Pairs of words that are alike in labels and neighbours, of <text> and <feature, pos, neg> of the same sample.

    A word takes part if it stands in LEAST_BOTH texts of either label or more and its shares there differ by no more than
    chance (MOST_Z); so there are at most a LEAST_BOTH-th as many as the sample's toxic texts have distinct words. Contexts
    are taken as square roots of counts, so that the commonest neighbour doesn't decide alone.
    """
    if not positives or not negatives:
        return []
    p, n = F.col("pos"), F.col("neg")
    z = F.log(p / positives / (n / negatives)) / F.sqrt(1 / p - 1 / F.lit(positives) + 1 / n - 1 / F.lit(negatives) + F.lit(1e-12))
    alike = counts.where(~F.col("feature").endswith("*") & (p >= LEAST_BOTH) & (n >= LEAST_BOTH)).where(F.abs(z) <= MOST_Z)
    avoid = set(taken)
    words = [r["feature"] for r in alike.orderBy(F.desc(p + n), "feature").select("feature").collect() if r["feature"] not in avoid]
    if len(words) < 2:
        return []
    seen = (sample.select("text").mapInArrow(_neighbours({w: i for i, w in enumerate(words)}), "word int, context int, n long")
            .groupBy("word", "context").agg(F.sum("n").alias("n")).toArrow())  # at most 2 * CONTEXTS rows a word
    at = seen["word"].to_numpy().astype(np.int64) * 2 * CONTEXTS + seen["context"].to_numpy()
    table = np.bincount(at, seen["n"].to_numpy(), len(words) * 2 * CONTEXTS).reshape(len(words), 2 * CONTEXTS)
    return [(words[i], words[j]) for i, j in mutual_nearest(np.sqrt(table))]


def select_features(counts: DataFrame, positives: int, negatives: int) -> list[str]:
    """The features that tell labels apart best: largest G² of those commoner in toxic texts, ties by name."""
    p, n = F.col("pos") + 0.5, F.col("neg") + 0.5
    share = (p + n) / (positives + negatives + 1.0)
    score = 2 * (p * F.log(p / (positives + 0.5) / share) + n * F.log(n / (negatives + 0.5) / share))
    common = (F.col("pos") + F.col("neg") >= LEAST_DOCS) & (p / (positives + 0.5) > n / (negatives + 0.5))
    top = counts.where(common).withColumn("score", score).where(F.col("score") >= LEAST_G2).orderBy(F.desc("score"), "feature").limit(MOST_FEATURES)
    return [r["feature"] for r in top.select("feature").collect()]


def _csr(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return at, np.fromiter((c for r in rows for c in r), np.int64, len(at))


def loss_and_gradient(w: np.ndarray, labels: np.ndarray, rows: np.ndarray, cols: np.ndarray,
                      pairs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], penalty: float) -> tuple[float, np.ndarray]:
    """The loss at weights `w` (intercept last); a set of pairs is its size and the signed features that swaps change."""
    n, width = len(labels), len(w) - 1
    z = np.bincount(rows, w[cols], n) + w[-1]
    err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
    grad = np.empty_like(w)
    grad[:-1] = np.bincount(cols, err[rows], width) + L2 * w[:-1]
    grad[-1] = err.sum()
    loss = float(np.mean(np.logaddexp(0, z) - labels * z) + L2 / 2 * w[:-1] @ w[:-1])
    for count, at, column, sign in pairs:
        gap = np.bincount(at, sign * w[column], count)
        loss += float(penalty * np.mean(gap * gap))
        grad[:-1] += np.bincount(column, sign * gap[at], width) * (2 * penalty / count)
    return loss, grad


def fit(labels: np.ndarray, own: list[list[int]], swaps: list[list[tuple[list[int], list[int]] | None]], width: int,
        penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Weights and intercept: mean logistic loss + L2 + penalty * mean squared score change, for each set of swaps (Adam).

    A set of swaps holds for each text the features that its swap adds and takes, None without a term.
    """
    n = len(labels)
    rows, cols = _csr(own)
    pairs = []
    for one in swaps:
        changed = [c for c in one if c is not None]
        more, less = _csr([c[0] for c in changed]), _csr([c[1] for c in changed])
        if changed:
            pairs.append((len(changed), np.r_[more[0], less[0]], np.r_[more[1], less[1]], np.r_[np.ones(len(more[0])), -np.ones(len(less[0]))]))
    w = np.zeros(width + 1)
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if n else 0.0
    w[-1] = np.log(rate / (1 - rate)) if n else -5.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1 if n else 1):
        _, grad = loss_and_gradient(w, labels, rows, cols, pairs, penalty)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


class Swaps(NamedTuple):
    """What swapping did in the sample: pairs of terms, texts with one, mean absolute change of their scores."""

    origin: str
    pairs: int
    texts: int
    mean_change: float


class Fitted(NamedTuple):
    weights: dict[str, float]
    intercept: float
    swaps: list[Swaps]


def fit_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
               sample_rows: int = SAMPLE_ROWS, identities: Mapping[str, Kinds] = IDENTITIES) -> Fitted:
    """The classifier with a report of its swaps, learnt from at most `sample_rows` labelled rows that aren't held out.

    Rows whose label is null or neither 0 nor 1, or that have no document, teach nothing; a key labelled twice counts by its
    larger label, and of several texts with one key the one with the smallest hash is taken. Without usable rows the intercept
    is -5 and there are no weights.
    """
    ship(docs.sparkSession)
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    chosen = usable.groupBy(key).agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64(key), key).limit(sample_rows)
    known = F.broadcast(chosen.withColumnRenamed(key, "_key"))  # at most sample_rows keys
    marked = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(known, "_key")
    one_each = marked.groupBy("_key").agg(F.min(F.struct(F.xxhash64("text").alias("_hash"), "text")).alias("_one"), F.max("label").alias("label"))
    sample = stored(one_each.select("_one.text", "label"), "sample")
    totals = dict(sample.groupBy("label").count().collect())
    counted = sample.mapInArrow(_counts, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = stored(counted, "counts")
    kinds = {"listed": listed_kinds(identities), "derived": []}
    positives, negatives = totals.get(1, 0), totals.get(0, 0)
    kinds["derived"] = derived_kinds(sample, counts, positives, negatives, swap_map(kinds["listed"]))
    swaps = [swap_map(k) for k in kinds.values()]
    names = list(dict.fromkeys([*(select_features(counts, positives, negatives) if totals else []), *(w for swap in swaps for w in swap)]))
    index = {f: i for i, f in enumerate(names)}
    shape = "label int, own array<int>, gained array<array<int>>, lost array<array<int>>"
    rows = sample.mapInArrow(_indexed(index, swaps), shape).collect()  # at most sample_rows
    forget(sample, counts)
    taught = [(r["label"], r["own"], [None if g is None else (g, t) for g, t in zip(r["gained"], r["lost"], strict=True)]) for r in rows]
    order = sorted(taught, key=lambda r: (r[0], r[1], [c or () for c in r[2]]))
    by_set = [[r[2][k] for r in order] for k in range(len(swaps))]
    weights, intercept = fit(np.array([r[0] for r in order], float), [r[1] for r in order], by_set, len(names))
    base = [weights[r[1]].sum() + intercept for r in order]
    report = []
    for origin, swap, one in zip(kinds, swaps, by_set, strict=True):
        changes = [abs(_share(z) - _share(z + weights[c[0]].sum() - weights[c[1]].sum())) for z, c in zip(base, one, strict=True) if c is not None]
        report.append(Swaps(origin, len(swap), len(changes), float(np.mean(changes)) if changes else 0.0))
    return Fitted({f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-6}, intercept, report)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          sample_rows: int = SAMPLE_ROWS, identities: Mapping[str, Kinds] = IDENTITIES) -> tuple[dict[str, float], float]:
    """Weights by feature and the intercept of `fit_sample`."""
    fitted = fit_sample(docs, labels, key, text, label, sample_rows, identities)
    return fitted.weights, fitted.intercept


def _share(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _scorer(weights: dict[str, float], intercept: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [intercept + sum(sorted(weights[f] for f in features_of(words_of(t.as_py())) if f in weights)) for t in batch.column("text")]
            scores = 1 / (1 + np.exp(-np.clip(np.array(found, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "text"), pa.array(scores)],
                                             [*(n for n in batch.schema.names if n != "text"), "score"])

    return run


def score(docs: DataFrame, model: tuple[dict[str, float], float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """<key, held_out, score, predicted>, one row per input row; whole texts, and nothing else, make the score.

    Null and empty texts get the intercept's score. A null key is not held out. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).mapInArrow(_scorer(*model), f"_key {kind}, score double")
    return scored.select(F.col("_key").alias(key), held_out(F.col("_key")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: tuple[dict[str, float], float], text: str = "text") -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns, in one scan.

    Null and empty texts are judged by the intercept alone; rows that repeat a key are judged by their own text; an empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    scorer = _scorer(*model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(text)], ["text"])
            scores = next(iter(scorer(iter([texts])))).column("score").to_numpy()
            yield batch.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
