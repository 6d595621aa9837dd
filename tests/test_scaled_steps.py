"""Steps whose cost a task or the driver must not bear alone."""

import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from postlens.functions import arrays as A
from postlens.functions import features as X
from postlens.functions.text import has_text
from postlens.operators import feature_model as FM
from postlens.operators import joins as J
from postlens.operators import models as M
from postlens.operators import vectorize as V
from postlens.operators.joins import lookup_join
from postlens.plans.composed_queries import _word_features


def test_a_document_share_is_counted_before_the_vocabulary(spark):
    docs = spark.createDataFrame([(i, ["all", f"w{i % 7}", f"own{i}"] + ["half"] * (i % 2)) for i in range(40)], "doc_id long, tokens array<string>")
    for low, high in ((1.0, 0.8), (3.0, 0.5), (1.0, 0.025), (0.1, 0.8)):
        ours = M.count_stage(min_df=low, max_df=high).fit(docs)
        plain = CountVectorizer(inputCol="tokens", outputCol="features", minDF=low, maxDF=high).fit(docs)
        assert sorted(ours.vocabulary) == sorted(plain.vocabulary)
        assert (ours.getMaxDF() == high * 40) == (low >= 1.0)  # a share makes MLlib keep all tokens to count rows


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_much_used_keys_are_not_shuffled(spark, how):
    words = spark.range(400).select("id", F.explode(F.array(F.lit("the"), F.concat(F.lit("of"), F.col("id") % 3), F.concat(F.lit("w"), "id"), F.lit(None).cast("string"))).alias("w"))
    known = spark.range(300).select(F.concat(F.lit("w"), "id").alias("w"), F.lit(1).alias("df")).unionByName(
        spark.createDataFrame([("the", 400), ("of0", 134), ("of1", 133), ("none", 500)], "w string, df int"))
    got = lookup_join(words, known, ["w"], how, limit_bytes=500, uses="df")
    assert sorted(map(str, got.collect())) == sorted(map(str, words.join(known, ["w"], how).collect()))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    whole = known.localCheckpoint()
    assert words.join(whole.where(J._most_used(J.cut_lineage(whole), "df", 500)), ["w"]).count() >= 667


def test_features_are_packed_with_one_shuffle_and_extracted_once(spark, sf):
    rows = spark.createDataFrame([(i, f"f{j}", 1.0 + j) for i in range(20) for j in range(i % 4)], "doc_id long, feature string, value double")
    cells = V.hash_vectorize(rows, 1 << 18)
    packed = cells.groupBy("doc_id").agg(F.collect_list("column").alias("c"))
    assert packed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    vectors = {r["doc_id"]: r["features"] for r in FM._vectors(spark.range(20).withColumnRenamed("id", "doc_id"), cells, 1 << 18).collect()}
    own = {(r["doc_id"], r["column"]): r["value"] for r in cells.collect()}
    assert {(i, int(c)): x for i, v in vectors.items() for c, x in zip(v.indices, v.values)} == own
    assert len(vectors) == 20 and all(v.size == 1 << 18 and list(v.indices) == sorted(v.indices) for v in vectors.values())
    extracted = _word_features(spark, sf)[1]
    assert "documents.parquet" not in extracted._jdf.queryExecution().executedPlan().toString()


def test_a_column_twice_in_a_document_is_an_error(spark):
    cells = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0)], "doc_id long, column int, value double")
    with pytest.raises(Exception, match="stands twice"):
        FM._vectors(cells.select("doc_id").distinct(), cells, 2).collect()


def test_a_value_used_twice_is_not_copied(spark):
    rows = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "ws array<string>")
    doubled = rows.select(A.let(F.col("ws"), lambda w: F.concat(w, w)).alias("x"))
    assert [r["x"] for r in doubled.collect()] == [["a", "b", "a", "b"], [], None]
    assert "transform(" not in doubled._jdf.queryExecution().analyzed().toString()  # a transform copies all it gives


def test_counts_in_a_text_without_the_needle(spark, ev):
    assert [ev(lambda t: A.occurrences(t, F.lit(n)), x) for x, n in [("aaaa", "aa"), ("aaa", "aa"), ("äaäa", "äa"), ("", "x"), ("so", "x")]] == [2, 1, 2, 0, 0]
    plan = spark.range(1).select(A.occurrences(F.col("id").cast("string"), F.lit("0")))._jdf.queryExecution().analyzed().toString()
    assert "contains(" in plan and "char_length" not in plan
    odd = ["", " ", "\u2003\t", " x", "x", "\x1c", None]
    seen = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").orderBy("i").select(has_text(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in seen] == [False, False, False, True, True, False, None]


def test_listed_words_are_found_in_one_pass(spark):
    text, lexicon = F.col("t"), {"a": ["x", "y"], "b": ["y", "z"]}
    rows = spark.createDataFrame([("x y z y other",)], "t string")
    assert {r["feature"]: r["value"] for r in rows.select(F.inline(X.emotion_words(text, lexicon))).collect()} == {"a": 3, "b": 3, "emo_words_count": 6}
    assert {r["feature"]: r["value"] for r in rows.select(F.inline(X.polarity_words(text, {"p": {"exact": ["y"], "partial": ["oth"]}}))).collect()} == {"lsd_p_exact_y": 2}
    assert {r["value"] for r in rows.select(F.inline(X.five_w_one_h(F.lit("who what how x"), "110001"))).collect()} == {0.25, 0.75}
    assert " IN (x,y,z)" in rows.select(X.emotion_words(text, lexicon))._jdf.queryExecution().analyzed().toString()


def test_a_topic_model_keeps_vectors_alone(spark, monkeypatch):
    kept = []

    class Noted:
        def fit(self, vectors):
            kept.append((vectors.columns, vectors.storageLevel.useMemory, vectors.count()))

    monkeypatch.setattr(M, "topic_model", lambda *_: Noted())
    docs = spark.createDataFrame([(i, ["a", f"w{i % 2}"]) for i in range(8)], "doc_id long, tokens array<string>")
    M.lda_fit(docs, 2, no_below=1.0, no_above=0.9)
    assert kept == [(["features"], True, 8)]
