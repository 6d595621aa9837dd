"""Term counts, weights and feature selection on the long form <doc_id, term, tf>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, value_counts
from ..session import reuse
from .joins import lookup_join
from .ranking import dense_index

def term_counts(corpus: DataFrame, tokens: str = "tokens", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Tokens per document → <doc_id, …carry, term, tf>, counted inside the row (no shuffle).

    Columns to `carry`, such as a label, are best joined before: then no term row is joined.
    """
    counts = F.transform(value_counts(F.col(tokens)), lambda c: F.struct(c["item"].alias("term"), c["n"].alias("tf")))
    return corpus.select(key, *carry, F.inline(counts))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """<term, df>; each task sums up its own documents before the shuffle."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def drop_common(counts: DataFrame, n_docs: int, max_df: float = 0.8) -> DataFrame:
    """Leave out terms in more than `max_df` of the documents.

    At most (mean distinct terms per document) / max_df terms can be that common, so the
    list of dropped terms stays small however large the vocabulary is.
    """
    common = document_frequencies(counts).where(F.col("df") > max_df * n_docs).select("term")
    return lookup_join(counts, common, ["term"], "left_anti")


def count_vectorize(corpus: DataFrame, tokens: str = "tokens", key: str = "doc_id",
                    max_df: float | None = 0.8) -> DataFrame:
    counts = term_counts(corpus, tokens, key)
    return counts if max_df is None else drop_common(counts, corpus.count(), max_df)


def _norm(pairs: Column, p: int) -> Column:
    size = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + (F.abs(x["value"]) if p == 1 else x["value"] * x["value"]))
    return size if p == 1 else F.sqrt(size)


def normalize_in_row(corpus: DataFrame, p: int = 2, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """<doc_id, term, value>: a document's term counts at unit L1 or L2 norm, without any shuffle."""
    counts = F.transform(value_counts(F.col(tokens)), lambda c: F.struct(c["item"].alias("term"), c["n"].cast("double").alias("value")))
    scaled = let(counts, lambda c: let(_norm(c, p), lambda z: F.transform(c, lambda x: F.struct(
        x["term"].alias("term"), (x["value"] / z).alias("value")))))
    return corpus.select(key, F.inline(scaled))


def normalize(rows: DataFrame, p: int = 2, key: str = "doc_id", name: str = "term", value: str = "value") -> DataFrame:
    """Scale each document's values to unit L1 or L2 norm (all-zero rows stay as they are).

    For rows that arrive long. One shuffle: a document's rows are packed together, scaled in place and unpacked.
    A group is one document, so it is as large as that document and no larger.
    """
    packed = rows.groupBy(key).agg(F.collect_list(F.struct(
        F.col(name).alias("name"), F.col(value).cast("double").alias("value"))).alias("_p"))
    scaled = let(_norm(F.col("_p"), p), lambda z: F.transform("_p", lambda x: F.struct(
        x["name"].alias(name), F.when(z > 0, x["value"] / z).otherwise(x["value"]).alias(value))))
    return packed.select(key, F.inline(scaled))


def tfidf(corpus: DataFrame, tokens: str = "tokens", key: str = "doc_id", max_df: float | None = None,
          sublinear: bool = False, norm: int | None = 2) -> DataFrame:
    """<doc_id, term, value>: tf · (ln((1+n)/(1+df)) + 1), L2-normalized.

    `sublinear` uses 1 + ln(tf); `max_df` drops terms above that document share first.
    """
    packed = reuse(corpus.select(key, value_counts(F.col(tokens)).alias("_counts")))  # counted once for all that follows
    n = packed.count()
    counts = packed.select(key, F.inline("_counts").alias("term", "tf"))
    freq = document_frequencies(counts)
    if max_df is not None:
        freq = freq.where(F.col("df") <= max_df * n)
    idf = freq.select("term", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    weight = (1 + F.log(F.col("tf"))) if sublinear else F.col("tf")
    rows = lookup_join(counts, idf, ["term"], uses="df").select(key, "term", (weight * F.col("idf")).alias("value"))
    return normalize(rows, norm, key) if norm else rows


def filter_extremes(counts: DataFrame, n_docs: int, no_below: int = 5, no_above: float = 0.2,
                    keep: int | None = None) -> DataFrame:
    """<term, df> with no_below ≤ df ≤ no_above·n; on request only the `keep` most frequent of them."""
    fit = document_frequencies(counts).where(F.col("df").between(no_below, no_above * n_docs))
    return fit if keep is None else fit.orderBy(F.desc("df"), "term").limit(keep)


def bag_of_words(counts: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """<doc_id, term_id, tf> with ids 0..V-1 along the sorted dictionary."""
    ids = dense_index(dictionary.select("term"), ["term"], "term_id", 0)
    return lookup_join(counts, ids, ["term"]).select(key, "term_id", "tf")


def dict_vectorize(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """<doc_id, feature, value> → <doc_id, column, value>, columns along sorted names."""
    names = dense_index(rows.select("feature").distinct(), ["feature"], "column", 0)
    return lookup_join(rows, names, ["feature"]).select(key, "column", "value")


def hash_place(name: Column, width: int) -> tuple[Column, Column]:
    """(column 0..width-1, sign 1 or -1) of a feature name, from separate digits of its digest. No dictionary is needed."""
    digest = F.md5(name)
    number = lambda start, n: F.conv(F.substring(digest, start, n), 16, 10).cast("long")
    even = F.substring(digest, 9, 1).isin(*"02468ace")
    return (number(1, 8) % width).cast("int"), F.when(even, F.lit(1.0)).otherwise(F.lit(-1.0))


def hash_vectorize(rows: DataFrame, width: int = 1 << 18, key: str = "doc_id", name: str = "feature", value: str = "value") -> DataFrame:
    """<doc_id, feature, value> → <doc_id, column, value> over an open vocabulary: names go to columns by a signed hash.

    Names that share a column are added up with their signs, so that their errors cancel on average; sums of 0 are left
    out. Nothing is fitted, so unseen names have a column too.
    """
    column, sign = hash_place(F.col(name), width)
    placed = rows.select(key, column.alias("column"), (sign * F.col(value)).alias("value"))
    # rows of a document come together, so that packing them into vectors needs no other shuffle; names rarely share a column
    summed = placed.repartition(key).groupBy(key, "column").agg(F.sum("value").alias("value"))
    return summed.where(F.col("value") != 0)


def hash_collisions(rows: DataFrame, width: int = 1 << 18, name: str = "feature") -> DataFrame:
    """<column, n_features> of the columns that several names share."""
    names = rows.select(name).distinct()
    return names.groupBy(hash_place(F.col(name), width)[0].alias("column")).agg(F.count(F.lit(1)).alias("n_features")).where("n_features > 1")


def chi2(rows: DataFrame, labels: DataFrame, key: str = "doc_id", name: str = "term", value: str = "value",
         label: str = "label") -> DataFrame:
    """<term, chi2>: Σ over classes of (O−E)²/E, O the feature total in the class and E the
    class share of documents times the feature total.

    Classes are few, so they become one conditional sum each: one shuffle, by feature, after
    each task summed its own rows. Rows that carry the label already are not joined again.
    """
    sizes = {r[label]: r["n"] for r in labels.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    classes = sorted(sizes)
    marked = rows if label in rows.columns else rows.join(labels.select(key, label), key)
    sums = marked.groupBy(name).agg(
        *[F.sum(F.when(F.col(label) == c, F.col(value)).otherwise(0.0)).alias(f"_c{i}") for i, c in enumerate(classes)])
    whole = sum((F.col(f"_c{i}") for i in range(len(classes))), F.lit(0.0))
    score = F.lit(0.0)
    for i, c in enumerate(classes):
        expected = F.col("_all") * F.lit(sizes[c] / total)
        score = score + F.try_divide((F.col(f"_c{i}") - expected) * (F.col(f"_c{i}") - expected), expected)
    return sums.withColumn("_all", whole).select(name, score.alias("chi2"))


def select_k_best(scores: DataFrame, k: int, name: str = "term", score: str = "chi2") -> DataFrame:
    """The k features of highest score, ties by name."""
    return scores.orderBy(F.desc_nulls_last(score), name).limit(k)


def keep_features(rows: DataFrame, chosen: DataFrame, name: str = "term") -> DataFrame:
    return lookup_join(rows, chosen.select(name), [name], "left_semi")
