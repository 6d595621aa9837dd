"""Feature extraction over a corpus: long rows <doc_id, feature, value>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions.arrays import value_counts
from ..functions.text import has_text, preprocess, sentences, whitespace_split, words_and_marks
from .joins import lookup_join


def as_rows(corpus: DataFrame, pairs: Column, key: str = "doc_id") -> DataFrame:
    """One row per feature of each document; a narrow step."""
    return corpus.select(key, F.inline(pairs))


def extract(corpus: DataFrame, options: dict, text: str = "text", key: str = "doc_id",
            preprocessed: bool = False, stops: list[str] | None = None, fixed: bool = False) -> DataFrame:
    """All feature families chosen in `options`, in their fixed order, later names winning.

    `options` keys: emoticons (list), word_feature (dict), pos (tag → words), fiveWoneH
    (6 flags), ngrams (low, high), emotion_words (category → words, or a table
    <category, word>), lsd_words (polarity → kind → words, or a table <polarity, kind, word>).
    Punctuation, upper case, interrogatives and sentence length are always extracted. One scan,
    no shuffle, unless a lexicon is a table: its families are then joined, in their places.
    """
    tables = [n for n in ("emotion_words", "lsd_words") if isinstance(options.get(n), DataFrame)]
    if tables:
        return _extract_with_tables(corpus, options, text, key, preprocessed, stops, fixed)
    raw = F.col(text)
    body = F.col("_body")
    families = []
    if "emoticons" in options:
        families.append(X.emoticons(raw, options["emoticons"]))
    if "word_feature" in options:
        families.append(X.words(raw, **options["word_feature"]))
    if "pos" in options:
        families.append(X.pos_tags(raw, options["pos"]))
    families += [X.punctuation(raw, fixed), X.uppercase(raw, fixed)]
    if "fiveWoneH" in options:
        families.append(X.five_w_one_h(body, "".join(options["fiveWoneH"])))
    if "ngrams" in options:
        low, high = options["ngrams"]
        families.append(X.ngrams(body, int(low), int(high), fixed))
    if "emotion_words" in options:
        families.append(X.emotion_words(body, options["emotion_words"]))
    if "lsd_words" in options:
        families.append(X.polarity_words(body, options["lsd_words"], fixed))
    families += [X.interrogatives(body), X.sentence_lengths(body, fixed)]
    staged = corpus.select(key, text, (preprocess(raw, stops) if preprocessed else raw).alias("_body"))
    return as_rows(staged, X.merge(*families), key)


def _extract_with_tables(corpus: DataFrame, options: dict, text: str, key: str, preprocessed: bool,
                         stops: list[str] | None, fixed: bool) -> DataFrame:
    """In-row families before and after the lexicons', and the lexicons' by join; later ones win."""
    body = preprocess(F.col(text), stops) if preprocessed else F.col(text)
    cleaned = corpus.select(key, body.alias("text"))
    rest = {k: v for k, v in options.items() if k not in ("emotion_words", "lsd_words")}
    parts = [extract(corpus, rest, text, key, preprocessed, stops, fixed)]
    for name, by_table, in_row in (("emotion_words", emotion_by_table, X.emotion_words), ("lsd_words", polarity_by_table, X.polarity_words)):
        if isinstance(options.get(name), DataFrame):
            parts.append(by_table(cleaned, options[name], key, **({"fixed": fixed} if name == "lsd_words" else {})))
        elif name in options:
            parts.append(as_rows(cleaned, in_row(F.col("text"), options[name], **({"fixed": fixed} if name == "lsd_words" else {})), key))
    parts.append(as_rows(cleaned, X.merge(X.interrogatives(F.col("text")), X.sentence_lengths(F.col("text"), fixed)), key))
    return merge_features(parts, key)


def merge_features(parts: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Union of long feature tables; where two give the same feature the later table wins."""
    ranked = reduce(DataFrame.unionByName, [p.withColumn("_o", F.lit(i)) for i, p in enumerate(parts)])
    return ranked.groupBy(key, "feature").agg(F.max_by("value", "_o").alias("value"))


def _term_rows(corpus: DataFrame, words: Column, key: str) -> DataFrame:
    counts = F.transform(value_counts(words), lambda c: F.struct(c["item"].alias("word"), c["n"].alias("n")))
    return corpus.where(has_text(F.col("text"))).select(key, F.inline_outer(counts))


def emotion_by_table(corpus: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """`emotion_words` for a lexicon table <category, word> of any size.

    Categories must be few enough for one aggregate each; words may be many.
    """
    cats = [r[0] for r in lexicon.select("category").distinct().orderBy("category").collect()]
    hits = lookup_join(_term_rows(corpus, whitespace_split(F.col("text")), key),
                       lexicon.select("category", "word").distinct(), ["word"], "left")
    counts = [F.sum(F.when(F.col("category") == c, F.col("n")).otherwise(0)).alias(f"c{i}") for i, c in enumerate(cats)]
    total = F.sum(F.when(F.col("category").isNotNull(), F.col("n")).otherwise(0)).alias("total")
    wide = hits.groupBy(key).agg(*counts, total)
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").cast("double").alias("value")) for i, c in enumerate(cats)]
    pairs.append(F.struct(F.lit("emo_words_count").alias("feature"), F.col("total").cast("double").alias("value")))
    return wide.select(key, F.inline(F.array(*pairs)))


def polarity_by_table(corpus: DataFrame, lexicon: DataFrame, key: str = "doc_id", fixed: bool = False) -> DataFrame:
    """`polarity_words` for a lexicon table <polarity, kind, word> of any size.

    Stems (kind `partial`) compare by equality; `fixed` matches every token that begins with one, by its beginnings of the
    lengths that occur among stems, so that stems too are found by an equality join.
    """
    rows = _term_rows(corpus, whitespace_split(F.col("text")), key).where(F.col("word").isNotNull())
    known, on = lexicon.select("polarity", "kind", "word").distinct(), ["word"]
    if fixed:
        lengths = sorted(r[0] for r in known.where("kind = 'partial'").select(F.length("word")).distinct().collect())  # no more than the longest stem has characters
        rows, on = rows.select(key, "n", F.inline(X.lexicon_keys(F.col("word"), lengths))), ["kind", "word"]
    hits = lookup_join(rows, known, on)
    feature = F.concat_ws("_", F.lit("lsd"), "polarity", "kind", "word").alias("feature")
    if fixed:
        return hits.groupBy(key, feature).agg(F.sum("n").cast("double").alias("value"))
    return hits.select(key, feature, F.col("n").cast("double").alias("value"))


def polarity_lenient(corpus: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """Totals per polarity, lower-cased and with marks blanked: `lsd_<polarity>`."""
    from ..functions.patterns import QUESTION_BLANKS

    words = whitespace_split(F.regexp_replace(F.lower("text"), QUESTION_BLANKS, " "))
    hits = lookup_join(_term_rows(corpus, words, key).where(F.col("word").isNotNull()),
                       lexicon.select("polarity", "kind", "word").distinct(), ["word"])
    return hits.groupBy(key, F.concat(F.lit("lsd_"), "polarity").alias("feature")).agg(
        F.sum("n").cast("double").alias("value"))


def tag_lexicon(tagged: DataFrame) -> DataFrame:
    """<word, tag> pairs → the most frequent tag of each word, ties by name."""
    counts = tagged.groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("tag")))["tag"]
    return counts.groupBy("word").agg(best.alias("tag"))


def tag_tokens(corpus: DataFrame, lexicon: DataFrame, default: str = "NN", key: str = "doc_id") -> DataFrame:
    """<doc_id, sent, words, tag, n>: tag counts of each sentence, by lookup with a default."""
    sents = corpus.where(has_text(F.col("text"))).select(
        key, F.posexplode(sentences(F.col("text"))).alias("sent", "s"))
    marked = sents.select(key, "sent", words_and_marks(F.lower("s")).alias("w"))
    counts = F.transform(value_counts(F.col("w")), lambda c: F.struct(c["item"].alias("word"), c["n"].alias("n")))
    rows = marked.select(key, "sent", F.size("w").alias("words"), F.inline(counts))
    return lookup_join(rows, lexicon, ["word"], "left").select(
        key, "sent", "words", F.coalesce("tag", F.lit(default)).alias("tag"), "n")


def pos_features(tagged: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per tag: mean, over the sentences that contain it, of its share of the sentence."""
    share = tagged.groupBy(key, "sent", "tag").agg((F.sum("n") / F.max("words")).alias("share"))
    return share.groupBy(key, F.col("tag").alias("feature")).agg(F.avg("share").alias("value"))
