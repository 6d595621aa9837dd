"""Noun lemmas by lookup: a (word, lemma) table, given or derived from the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import NOUN_ENDINGS
from ..functions.arrays import let
from ..session import cut_lineage
from .joins import lookup_join, written_bytes

LONG_WORD = 4  # only longer tokens are lemmatized
IN_ROW_BYTES = 8 * 1024 * 1024  # of a lemma table that is sent to every task


def lemma_candidates(word: Column) -> Column:
    """Forms left after each noun ending that fits."""
    options = []
    for ending, repl in NOUN_ENDINGS:
        stem = F.concat(F.left(word, F.length(word) - len(ending)), F.lit(repl))
        options.append(F.when(F.endswith(word, F.lit(ending)) & (F.length(word) > len(ending)), stem))
    return F.filter(F.array(*options), lambda c: c.isNotNull())


def lemma_table(corpus: DataFrame, tokens: str = "tokens") -> DataFrame:
    """<word, lemma> for words whose singular form also occurs in the corpus; shortest wins.

    Works on the distinct vocabulary only, and joins it with itself on the candidate form.
    """
    vocab = corpus.select(F.explode(F.array_distinct(tokens)).alias("word")).distinct()
    wanted = vocab.where(F.length("word") > LONG_WORD).select(
        "word", F.explode(lemma_candidates(F.col("word"))).alias("lemma"))
    known = vocab.select(F.col("word").alias("lemma"))
    return (wanted.join(known, "lemma", "left_semi").groupBy("word")
            .agg(F.min(F.struct(F.length("lemma").alias("n"), "lemma"))["lemma"].alias("lemma")))


def _hashed(table: DataFrame, words: int) -> DataFrame:
    """One row <_buckets>: the table as an array of buckets by hash, about two words to a bucket."""
    size = max(words // 2, 1)
    by_bucket = table.groupBy(F.pmod(F.xxhash64("word"), F.lit(size)).alias("b")).agg(F.collect_list(F.struct("word", "lemma")).alias("m"))
    every = table.sparkSession.range(size).select(F.col("id").alias("b")).join(by_bucket, "b", "left")
    filled = F.coalesce("m", F.array().cast("array<struct<word:string,lemma:string>>"))
    return every.select("b", filled.alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda x: x["m"]).alias("_buckets"))


def lemmatize(corpus: DataFrame, table: DataFrame, key: str = "doc_id", tokens: str = "tokens", limit_bytes: int = IN_ROW_BYTES) -> DataFrame:
    """Replace each token longer than four characters by its lemma, order kept; other columns than key and tokens go.

    The table <word, lemma> is written once and measured. Up to the limit it is sent to every task as one hashed row, and
    tokens are looked up inside theirs: no shuffle. Beyond it only long tokens are exploded and joined, and only documents
    in which one has a lemma are put together again.
    """
    table = cut_lineage(table.select("word", "lemma"))
    if written_bytes(table) <= limit_bytes:
        words = table.count()
        whole = F.broadcast(cut_lineage(_hashed(table, words)))  # one row of limited size
        bucket = lambda w: F.get("_buckets", F.pmod(F.xxhash64(w), F.size("_buckets")).cast("int"))
        lemma = lambda w: F.get(F.filter(bucket(w), lambda x: x["word"] == w), F.lit(0))["lemma"]
        changed = F.transform(tokens, lambda w: F.when(F.length(w) > LONG_WORD, F.coalesce(lemma(w), w)).otherwise(w))
        return corpus.select(key, tokens).crossJoin(whole).select(key, changed.alias(tokens))  # with one row
    long = corpus.select(key, F.posexplode(tokens).alias("_i", "word")).where(F.length("word") > LONG_WORD)
    packed = lookup_join(long, table, ["word"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "lemma"))).alias("_hits"))
    # hits come in token order, so a merge needs each place's last hit only
    at = let(F.transform("_hits", lambda h: h["_i"]), lambda places: F.transform(tokens, lambda w, i: let(
        F.array_position(places, i), lambda p: F.when(p > 0, F.get("_hits", (p - 1).cast("int"))["lemma"]).otherwise(w))))
    return corpus.select(key, tokens).join(packed, key, "left").select(key, F.when(F.col("_hits").isNull(), F.col(tokens)).otherwise(at).alias(tokens))
