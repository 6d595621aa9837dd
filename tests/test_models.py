"""Invariants of the fitted models."""

import pytest
from pyspark.sql import functions as F

from postlens.functions.text import preprocess_tokens
from postlens.operators import models as M
from postlens.plans.model_queries import labelled, unseen
from postlens.session import fresh_path


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return labelled(spark, sf)


def test_saved_model_predicts_the_same(spark, sf, corpus):
    model = M.classifier_pipeline("lr", feat="tfidf", norm="l1", max_iter=5).fit(corpus)
    path = fresh_path(spark, "model")
    M.save_model(model, path)
    new = unseen(spark, sf)
    before, after = (sorted(map(tuple, M.predict(m, new).select("doc_id", "prediction").collect()))
                     for m in (model, M.load_model(path)))
    assert before == after and before


def test_tfidf_vectors_are_the_long_form(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from postlens.operators.vectorize import tfidf

    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"])], "doc_id long, tokens array<string>")
    fitted = Pipeline(stages=M.vector_stages("tfidf", None, None)).fit(docs)
    words = fitted.stages[0].vocabulary
    dense = {r["doc_id"]: dict(zip(words, r["v"])) for r in
             fitted.transform(docs).select("doc_id", vector_to_array("features").alias("v")).collect()}
    for r in tfidf(docs).collect():
        assert dense[r["doc_id"]][r["term"]] == pytest.approx(r["value"])


def test_topic_shares_add_up(corpus):
    vocab, lda = M.lda_fit(corpus, 3, no_below=2.0, no_above=0.5)
    rows = M.doc_topics(vocab, lda, corpus).select("dist", "topics").collect()
    assert all(sum(r["dist"]) == pytest.approx(1) for r in rows)
    assert all(t["prob"] >= 0.01 for r in rows for t in r["topics"])
    assert M.show_topics(vocab, lda, 5).count() == 15


def test_grid_has_one_row_per_candidate(corpus):
    rows = M.grid_search(corpus, "nb", {"alpha": [0.0, 0.5]}, folds=2, norm="l2").collect()
    assert [r["place"] for r in rows] == [1, 2] and rows[0]["mean"] >= rows[1]["mean"]
    assert len(M.candidates("lr")) == 18 and len(M.candidates("nb")) == 10 and len(M.candidates("sgd")) == 8


def test_sweep_is_sorted(corpus):
    rows = M.topic_threshold_sweep(corpus.withColumn("label", F.col("label").cast("int").cast("string")), [2], [20.0, 80.0],
                                   no_below=2.0, no_above=0.5).collect()
    assert len(rows) == 2 and rows[0]["f1"] >= rows[1]["f1"]


def test_train_eval_keeps_the_full_fit(corpus):
    pipeline = M.classifier_pipeline("nb")
    model, score, held = M.train_eval(pipeline, corpus)
    assert 0.5 < score <= 1 and 0 < held.count() < corpus.count()


def test_folds_are_balanced(corpus):
    sizes = M.stratified_folds(corpus, 4).groupBy("label", "fold").count().collect()
    for label in {r["label"] for r in sizes}:
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert max(counts) - min(counts) <= 1


def test_clusters_and_their_classifier(spark, sf):
    from postlens.plans.model_queries import cluster_classifier

    rows = cluster_classifier(spark, sf).collect()
    assert all(0 <= r["entropy"] <= 1 + 1e-9 for r in rows) and len({r["cluster"] for r in rows}) > 1


def test_multiclass_uses_one_against_rest(spark, sf):
    talk = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.monotonically_increasing_id().alias("doc_id"), preprocess_tokens(F.col("text")).alias("tokens"),
        F.when(F.col("role") == "user", 0.0).when(F.col("role") == "assistant", 1.0).otherwise(2.0).alias("label"))
    model = M.classifier_pipeline("lsvc", multiclass=True, max_iter=3).fit(talk)
    assert {r[0] for r in M.predict(model, talk).select("prediction").distinct().collect()} <= {0.0, 1.0, 2.0}


def test_large_vocabulary_is_kept_whole(spark):
    """More terms than the 2^18 that MLlib keeps unasked."""
    docs = spark.range(300).selectExpr("id as doc_id", "transform(sequence(1, 1000), i -> concat('t', id * 1000 + i)) as tokens")
    assert len(M.count_stage().fit(docs).vocabulary) == 300_000


def test_penalty_counts_the_rows_it_is_fitted_on(corpus):
    half = corpus.limit(40)
    fitted = M.classifier_pipeline("lr", {"C": 2.0}, max_iter=2).fit(half)
    assert fitted.stages[-1].getRegParam() == pytest.approx(1 / (2.0 * 40))


def test_topic_model_keeps_its_priors_and_passes():
    lda = M.topic_model(4)
    assert not lda.getOptimizeDocConcentration() and lda.getSubsamplingRate() == 1.0 and lda.getMaxIter() == 10


def test_grid_by_aggregates_has_every_candidate(corpus):
    rows = M.nb_grid_search(corpus, [0.0, 0.5], folds=3).collect()
    assert [r["place"] for r in rows] == [1, 2] and 0 < rows[0]["mean"] <= 1


def test_named_labels_survive_saving(spark):
    rows = spark.createDataFrame([("tea", ["leaf", "hot"]), ("milk", ["cow", "cold"]), ("beer", ["hop", "cold"])] * 4, "label string, tokens array<string>")
    model = M.fit_named_labels(rows, "lr", max_df=None, max_iter=20)
    path = fresh_path(spark, "model")
    M.save_model(model, path)
    new = spark.createDataFrame([(["hop"],), (["leaf"],)], "tokens array<string>")
    assert [r["predicted"] for r in M.load_model(path).transform(new).collect()] == ["beer", "tea"]


def test_unknown_choices_are_refused():
    with pytest.raises(ValueError):
        M.classifier("svc", 10, {"kernel": "rbf"})
    with pytest.raises(ValueError):
        M.classifier("forest", 10)


def test_feature_model_weights_and_unknown_features(spark):
    """Sub-linear tf-idf at unit length, dictionary of the training rows only, every document gets a row."""
    import math

    from pyspark.ml.functions import vector_to_array

    from postlens.operators import feature_model as FM

    rows = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "b", 2.0), (3, "new", 9.0)], "doc_id long, feature string, value double")
    labels = spark.createDataFrame([(1, 0.0), (2, 1.0)], "doc_id long, label double")
    model = FM.train(labels, rows, "nb", idf=True, sublinear=True, unit=True)
    docs = spark.createDataFrame([(1,), (3,)], "doc_id long")
    got = {r["doc_id"]: r["v"] for r in FM.assemble(docs, rows, model.dictionary, model.width, True, True)
           .select("doc_id", vector_to_array("features").alias("v")).collect()}
    a, b = (1 + math.log(3)) * (math.log(3 / 2) + 1), 1.0
    assert got[1] == pytest.approx([a / math.hypot(a, b), b / math.hypot(a, b)]) and got[3] == [0.0, 0.0]
    assert {r["doc_id"] for r in model.predict(docs, rows).collect()} == {1, 3}


def test_fits_run_side_by_side_while_small():
    assert M.side_by_side(1000) == 4 and M.side_by_side(M.RUN_BYTES // 16) == 2 and M.side_by_side(10**10) == 1 and M.side_by_side(0) == 4


def _points(spark):
    return spark.range(40).select("id", (F.col("id") % 2).cast("double").alias("label"),
                                  F.array((F.col("id") % 2).cast("double"), F.col("id") * 0.01).alias("x"))


def test_clusters_keep_nothing_but_vectors(spark):
    from pyspark.ml.functions import array_to_vector

    frame = _points(spark).select(array_to_vector("x").alias("features"), F.when(F.col("id") >= 0, F.raise_error("read")).cast("string").alias("tokens"))
    assert M.kmeans_fit(frame, 2, restarts=2).summary.trainingCost >= 0


def test_large_centres_are_fitted_one_run_at_a_time(spark, monkeypatch):
    import threading

    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(M, "RUN_BYTES", 1)
    lock, fit = threading.Lock(), M.KMeans.fit

    def alone(self, frame):
        assert lock.acquire(blocking=False)
        try:
            return fit(self, frame)
        finally:
            lock.release()

    monkeypatch.setattr(M.KMeans, "fit", alone)
    assert M.kmeans_fit(_points(spark).select(array_to_vector("x").alias("features")), 2, restarts=3).getK() == 2


def _together(monkeypatch, cls, n):
    """Each fit waits until n of them have begun: fails where they come one after another."""
    import threading

    begun, fit = threading.Barrier(n), cls.fit

    def wait(self, frame):
        begun.wait(30)
        return fit(self, frame)

    monkeypatch.setattr(cls, "fit", wait)


def test_regressions_of_clusters_run_together(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    _together(monkeypatch, M.LogisticRegression, 2)
    rows = _points(spark).select("id", "label", array_to_vector("x").alias("features"))
    assert M.one_vs_rest_shares(rows, 2, max_iter=3, carry=("id",)).count() == 40


def test_topic_models_of_a_sweep_run_together(corpus, monkeypatch):
    _together(monkeypatch, M.LDA, 2)
    rows = M.topic_threshold_sweep(corpus.withColumn("label", F.col("label").cast("int").cast("string")), [2, 3], [50.0], no_below=2.0, no_above=0.5)
    assert {r["num_topics"] for r in rows.collect()} == {2, 3}


def test_shown_words_need_no_vocabulary_on_the_driver(corpus):
    vocab, lda = M.lda_fit(corpus, 2, no_below=2.0, no_above=0.5, passes=2)

    class Closed:
        write = vocab.write

    words = vocab.vocabulary
    shown = M.show_topics(Closed(), lda, 3).collect()
    want = {(r["topic"], i + 1): words[t] for r in lda.describeTopics(3).collect() for i, t in enumerate(r["termIndices"])}
    assert {(r["topic"], r["rank"]): r["word"] for r in shown} == want


def _without_weights(monkeypatch, cls, seen):
    """Notes for each fit whether its frame's lineage still has the steps that made the vectors."""
    fit = cls.fit

    def noted(self, frame):
        seen.append("UDF" in frame.select("features")._jdf.queryExecution().analyzed().toString())
        return fit(self, frame)

    monkeypatch.setattr(cls, "fit", noted)


def test_fits_do_not_send_the_term_weights_with_each_task(corpus, monkeypatch):
    from pyspark.ml import Pipeline

    seen = []
    _without_weights(monkeypatch, M.KMeans, seen)
    _without_weights(monkeypatch, M.LogisticRegression, seen)
    rows = corpus.select("doc_id", "tokens", F.col("label").cast("int").alias("cluster"))
    M.kmeans_fit(Pipeline(stages=M.vector_stages("tfidf", None, None)).fit(rows).transform(rows), 2, restarts=1)
    M.cluster_classifier(rows, max_iter=2).count()
    M.model_sweep(corpus, ["lr"], folds=2, max_iter=2)
    assert seen[:3] == [False] * 3 and not any(seen[3:5])
