"""Corpus-level operators on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from postlens.operators import agreement as G
from postlens.operators import curate as C
from postlens.operators import evaluate as M
from postlens.operators import features as O
from postlens.operators import models as ML
from postlens.operators import objectivity as J
from postlens.operators import ranking as R
from postlens.operators import vectorize as V
from postlens.operators.joins import lookup_join
from postlens.operators.lemmas import lemma_table, lemmatize
from postlens.session import fresh_path
from postlens.sources import readers as I
from postlens.sources import writers as W


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([(1, "x", "s1"), (2, "x", "s2"), (3, "y", "s2")], "doc_id long, text string, source string")
    rows = sorted(map(tuple, C.dedupe_first(df, carry=["source", "text"]).collect()))
    assert rows == [(1, "s1", "x"), (3, "s2", "y")]
    counts = {r["source"]: (r["n_rows"], r["n_distinct"]) for r in C.source_counts(df).collect()}
    assert counts == {"s1": (1, 1), "s2": (2, 1)}


def test_topics_are_not_trimmed(spark):
    df = spark.createDataFrame([(1, "a, b"), (2, "B")], "doc_id long, t string").withColumn("topics", C.split_topics(F.col("t")))
    assert [r["doc_id"] for r in C.topic_filter(df, ["b"]).collect()] == [2]


def test_label_cast(spark):
    two = spark.createDataFrame([("1",), ("0",)], "label string")
    three = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    assert dict(C.binary_label_cast(two).dtypes)["label"] == "bigint"
    assert dict(C.binary_label_cast(three).dtypes)["label"] == "string"


def test_dense_index_is_a_row_number(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("v"), "id")  # three hot values
    got = [r["rank"] for r in R.dense_index(df, ["v", "id"], partitions=7).orderBy("v", "id").collect()]
    assert got == list(range(1, 5001))


def test_percentiles_with_a_hot_value(spark):
    import numpy as np

    values = [0.0] * 700 + [i / 7 for i in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "pos long, entropy double")
    want = np.percentile(values, [0, 25, 50, 80, 99, 100])
    assert R.exact_percentiles(df, "entropy", [0.0, 25.0, 50.0, 80.0, 99.0, 100.0]) == pytest.approx(list(want))
    assert R.exact_percentiles(df.limit(0), "entropy", [50.0]) == [None]


def test_quintiles(spark):
    ranked = spark.range(1, 13).select(F.col("id").alias("rank"))
    assert [r["score"] for r in R.quintile_score(ranked).orderBy("rank").collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5, 5]
    assert R.quintile_score(ranked.where("rank <= 2")).count() == 2


def test_adjacent_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "a")], "rank long, text string")
    assert sorted(r["rank"] for r in R.drop_adjacent_duplicates(df).collect()) == [1, 4, 5]


def test_rank_correlations(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "pos long, rank long")
    b = spark.createDataFrame([(1, 3), (2, 2), (3, 1)], "pos long, rank long")
    assert G.spearman_unique(a, b).first()["rho"] == -1
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0)], "x double, y double")
    assert G.rank_corr_ranged(pairs).first()["rho"] == pytest.approx(1.0808650381843379)
    assert G.rank_corr_ranged(pairs, fixed=True).first()["rho"] == pytest.approx(0.7205766921228921)


def test_chi2_by_hand(spark):
    rows = spark.createDataFrame([(1, "f", 3.0), (2, "f", 2.0), (4, "f", 1.0)], "doc_id long, term string, value double")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, label int")
    assert V.chi2(rows, labels).first()["chi2"] == pytest.approx(2.6666666666666665)


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_both_ways(spark, how, limit):
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("w"))
    right = spark.createDataFrame([("hot", 1), ("7", 2), ("none", 3)], "w string, v int")
    got = sorted(map(str, lookup_join(left, right, ["w"], how, limit).collect()))
    assert got == sorted(map(str, left.join(right, ["w"], how).collect()))


def test_lemmas(spark):
    df = spark.createDataFrame([(1, ["posts", "post", "wives", "wif", "wife", "boxes", "box", "cats"]), (2, [])],
                               "doc_id long, tokens array<string>")
    table = {r["word"]: r["lemma"] for r in lemma_table(df).collect()}
    assert table == {"posts": "post", "wives": "wif", "boxes": "box"}
    out = {r["doc_id"]: r["tokens"] for r in lemmatize(df, lemma_table(df)).collect()}
    assert out == {1: ["post", "post", "wif", "wif", "wife", "box", "box", "cats"], 2: []}


def test_lexicon_tables_equal_in_row_forms(spark):
    docs = spark.createDataFrame([(1, "good warm bad bad"), (2, "nothing"), (3, " ")], "doc_id long, text string")
    emo = spark.createDataFrame([("joy", "good"), ("joy", "warm"), ("care", "warm")], "category string, word string")
    in_row = O.extract(docs, {"emotion_words": I.as_lists(emo, "category")})
    names = ["joy", "care", "emo_words_count"]
    a = sorted(map(tuple, in_row.where(F.col("feature").isin(names)).collect()))
    assert a == sorted(map(tuple, O.emotion_by_table(docs, emo).collect()))
    pol = spark.createDataFrame([("negative", "exact", "bad")], "polarity string, kind string, word string")
    assert list(map(tuple, O.polarity_by_table(docs, pol).collect())) == [(1, "lsd_negative_exact_bad", 2.0)]


def test_merge_features_later_wins(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0)], "doc_id long, feature string, value double")
    b = spark.createDataFrame([(1, "x", 5.0)], "doc_id long, feature string, value double")
    assert sorted(map(tuple, O.merge_features([a, b]).collect())) == [(1, "x", 5.0), (1, "y", 1.0)]


def test_constant_histogram_and_stats(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(4)], "pos long, entropy double")
    assert sum(r["n"] for r in J.entropy_histogram(df).collect()) == 4
    assert J.entropy_stats(df).first()["med"] == 0.5


def test_metrics_without_positive_predictions(spark):
    rows = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    assert tuple(M.binary_scores(rows, 1).first()) == (0.0, 0.0, 0.0)
    assert M.f1_macro(rows).first()["f1"] == pytest.approx((2 / 3) / 2)


def test_naive_bayes_by_hand(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 3)], "doc_id long, term string, tf long")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, label int")
    probs, priors = ML.nb_fit(counts, labels)
    got = {(r["term"], r["label"]): r["log_prob"] for r in probs.collect()}
    assert got["a", 0] == pytest.approx(math.log(3 / 5)) and got["a", 1] == pytest.approx(math.log(1 / 5))
    assert priors == {0: math.log(0.5), 1: math.log(0.5)}
    assert sorted(map(tuple, ML.nb_predict(labels, counts, probs, priors).collect())) == [(1, 0), (2, 1)]
    more = spark.createDataFrame([(3,), (4,)], "doc_id long")  # without terms: the higher prior, ties to the lower label
    assert {r["prediction"] for r in ML.nb_predict(more, counts.where("doc_id > 9"), probs, {0: -2.0, 1: -0.1}).collect()} == {1}


def test_line_numbers_over_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\tone\n2\ttwo\n")
    (tmp_path / "b.tsv").write_text("3\tthree \"quoted\n")
    rows = I.read_tsv(spark, str(tmp_path), {"n": 0, "text": 1}, numbered=True).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, "1", "one"), (1, "2", "two"), (2, "3", 'three "quoted')]


def test_polarity_file(spark, tmp_path):
    (tmp_path / "lsd.txt").write_text("Hope*\t1\nbad\t0\n")
    got = sorted(map(tuple, I.load_polarity_lexicon(spark, str(tmp_path)).collect()))
    assert got == [("negative", "exact", "bad"), ("positive", "partial", "hope")]


def test_lexicons_as_tables_give_the_same_features(spark):
    docs = spark.createDataFrame([(1, "good warm bad bad?! Why so bad"), (2, "nothing"), (3, " "), (4, "emo_words_count good")], "doc_id long, text string")
    emo = spark.createDataFrame([("joy", "good"), ("joy", "warm"), ("care", "warm")], "category string, word string")
    pol = spark.createDataFrame([("negative", "exact", "bad")], "polarity string, kind string, word string")
    lists = {"emotion_words": I.as_lists(emo, "category"), "lsd_words": {"negative": {"exact": ["bad"], "partial": []}}, "ngrams": (1, 1)}
    tables = {"emotion_words": emo, "lsd_words": pol, "ngrams": (1, 1)}
    assert sorted(map(tuple, O.extract(docs, lists).collect())) == sorted(map(tuple, O.extract(docs, tables).collect()))


def test_long_documents_keep_all_their_words(spark):
    text = " ".join(f"w{chr(97 + i // 676)}y{chr(97 + i // 26 % 26)}z{chr(97 + i % 26)}v" for i in range(1500))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = O.extract(docs, {"word_feature": {}}).where("feature like 'word_%'")
    assert rows.count() == 1500


def test_last_of_repeated_names_wins(spark):
    from postlens.functions.arrays import last_wins

    pairs = [("a", 1.0), ("b", 2.0), ("a", 3.0), ("c", 4.0), ("b", 5.0)]
    frame = spark.createDataFrame([(pairs,), ([],)], "p array<struct<feature:string,value:double>>")
    got = [{x["feature"]: x["value"] for x in r["p"]} for r in frame.select(last_wins(F.col("p")).alias("p")).collect()]
    assert got == [{"a": 3.0, "b": 5.0, "c": 4.0}, {}]


def test_one_line_round_trip(spark):
    path = fresh_path(spark, "t")
    W.write_tsv(spark.createDataFrame([("a\tb\r\nc", None)], "x string, y string"), path, ["x", "y"])
    assert tuple(I.read_tsv(spark, path, {"x": 0, "y": 1}).first()) == ("a b  c", "")
