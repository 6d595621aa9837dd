"""Models as tables, text stages, reports and one-vs-rest shares against their plain forms."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postlens.operators import evaluate as E
from postlens.operators import lemmas as L
from postlens.operators import model_tables as MT
from postlens.operators import models as M
from postlens.operators import stages
from postlens.operators.joins import hot_keys, lookup_join
from postlens.session import fresh_path

TOKENS = [(i, float(i % 2), [f"w{i % 7}", f"v{i % 3}", "a" if i % 2 else "b", "a", "all"]) for i in range(60)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(TOKENS, "doc_id long, label double, tokens array<string>")


def test_topic_words_are_the_models_own(spark, corpus):
    vocab, lda = M.lda_fit(corpus, 3, no_below=1.0, no_above=0.9, passes=3)
    got = {(r["topic"], r["rank"]): (r["word"], r["weight"]) for r in MT.topic_words(spark, vocab, lda).collect()}
    want = {(r["topic"], r["rank"]): (r["word"], r["weight"]) for r in M.show_topics(vocab, lda, len(vocab.vocabulary)).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in got)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert MT.topic_words(spark, vocab, lda, 4).count() == 12


@pytest.mark.parametrize("name,params", [("lr", {}), ("lr", {"penalty": "l1", "C": 0.3}), ("lsvc", {})])
def test_coefficients_are_the_models_own(spark, corpus, name, params):
    fitted = M.classifier_pipeline(name, params, max_df=None, max_iter=10).fit(corpus)
    weights = fitted.stages[-1].coefficients.toArray()
    want = {t: w for t, w in zip(fitted.stages[0].vocabulary, weights) if w}
    table = MT.coefficient_table(spark, fitted.stages[0], fitted.stages[-1])
    got = {r["term"]: r["weight"] for r in table.where("label = 1").collect() if r["weight"]}
    assert got == pytest.approx(want) and got
    best = MT.top_coefficients(table, 2).where("label = 0").orderBy("rank").collect()
    assert [r["rank"] for r in best] == [1, 2] and best[0]["weight"] >= best[1]["weight"]


def test_matrix_tables_of_sparse_and_turned_matrices(spark):
    schema = f"m {MT._MATRIX}"
    dense = np.array([[0.0, 2.0, 0.0], [3.0, 0.0, 4.0]])
    rows = [((1, 2, 3, None, None, [0.0, 3.0, 2.0, 0.0, 0.0, 4.0], False),), ((1, 2, 3, None, None, [0.0, 2.0, 0.0, 3.0, 0.0, 4.0], True),),
            ((0, 2, 3, [0, 1, 2, 3], [1, 0, 1], [3.0, 2.0, 4.0], False),), ((0, 2, 3, [0, 1, 3], [1, 0, 2], [2.0, 3.0, 4.0], True),)]
    for row in rows:
        got = np.zeros((2, 3))
        for r in MT.matrix_table(spark.createDataFrame([row], schema), "m").collect():
            got[r["i"], r["j"]] = r["value"]
        assert (got == dense).all()


SCRIPT = """
import sys
sys.path[:0] = [{root!r}, {tools!r}]
from check_oracle import local_session
from postlens.operators import models as M
spark = local_session(2)
rows = M.load_model({path!r}).transform(spark.read.parquet({texts!r})).orderBy("id").collect()
print("said", [r["prediction"] for r in rows])
spark.stop()
"""


def test_a_saved_text_pipeline_works_in_another_process(spark):
    from conftest import ROOT

    rows = [(i, "Good news!! really great 2day" if i % 2 else "bad http://x.y awful, bad", float(i % 2)) for i in range(20)] + [(20, None, 0.0), (21, "", 1.0)]
    texts = spark.createDataFrame(rows, "id int, text string, label double")
    fitted = stages.text_classifier("nb", stops=["really"], max_df=None).fit(texts)
    path, at = fresh_path(spark, "model"), fresh_path(spark, "texts")
    M.save_model(fitted, path)
    texts.drop("label").coalesce(1).write.parquet(at)
    before = [r["prediction"] for r in fitted.transform(texts.drop("label")).orderBy("id").collect()]
    script = SCRIPT.format(root=ROOT, tools=f"{ROOT}/tools", path=path, texts=at)
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=240, check=True).stdout
    assert f"said {before}" in out and len(set(before)) == 2


def test_one_vs_rest_shares_are_plain_arithmetic(spark):
    rng = np.random.default_rng(3)
    points = [(i, float(i % 3), Vectors.dense(rng.normal(i % 3, 1, 2))) for i in range(90)]
    frame = spark.createDataFrame(points, ["id", "label", "features"])
    got = {r["id"]: r["dist"] for r in M.one_vs_rest_shares(frame, 3, carry=("id",)).collect()}
    from pyspark.ml.classification import LogisticRegression
    each = []
    for c in range(3):
        one = frame.withColumn("label", (F.col("label") == c).cast("double"))
        fitted = LogisticRegression(regParam=1 / 90, standardization=False, maxIter=100).fit(one)
        each.append({r["id"]: r["p"][1] for r in fitted.transform(one).select("id", vector_to_array("probability").alias("p")).collect()})
    for i, dist in got.items():
        whole = [p[i] for p in each]
        assert dist == pytest.approx([p / sum(whole) for p in whole])


def test_full_report_is_the_single_figures(spark):
    rows = spark.createDataFrame([("m", a, b) for a, b in [("x", "x"), ("x", "y"), ("y", "y"), ("z", "x"), ("z", "z"), ("y", "y")]] + [("one", "x", "x")], "model string, label string, prediction string")
    for model in ("m", "one"):
        own = rows.where(F.col("model") == model)
        got = E.full_report(rows, ["model"], "x").where(F.col("model") == model).first()
        assert got["accuracy"] == pytest.approx(E.accuracy(own).first()[0]) and got["n"] == own.count()
        assert (got["precision"], got["recall"]) == pytest.approx(tuple(E.precision_recall(own, "x").first()))
        for name, fn in (("f1_micro", E.f1_micro), ("f1_macro", E.f1_macro), ("f1_weighted", E.f1_weighted)):
            assert got[name] == pytest.approx(fn(own).first()[0])
        assert got["f1"] == pytest.approx(E.f1_binary(own, "x").first()[0])
        assert {tuple(c) for c in got["matrix"]} == {tuple(r) for r in E.confusion_matrix(own).where("n > 0").collect()}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lemmas_by_either_way(spark, limit):
    docs = spark.createDataFrame([(1, ["posts", "post", "boxes", "cats", "posts"]), (2, []), (3, ["none", "at", "all"]), (4, None)], "doc_id long, tokens array<string>")
    table = spark.createDataFrame([("posts", "post"), ("boxes", "box"), ("cats", "cat")], "word string, lemma string")
    got = {r["doc_id"]: r["tokens"] for r in L.lemmatize(docs, table, limit_bytes=limit).collect()}
    assert got == {1: ["post", "post", "box", "cats", "post"], 2: [], 3: ["none", "at", "all"], 4: None}
    assert {r["doc_id"]: r["tokens"] for r in L.lemmatize(docs, table.limit(0)).collect()}[1] == ["posts", "post", "boxes", "cats", "posts"]


def test_a_word_in_every_document_is_joined_apart(spark):
    words = spark.range(3000).select("id", F.explode(F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id").cast("string")))).alias("w"))
    known = spark.range(0, 3000, 2).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("w"), F.col("id").alias("v")).union(
        spark.createDataFrame([("the", -1)], "w string, v long"))
    assert len(hot_keys(words, ["w"])) == 1
    plan = lookup_join(words, known, ["w"], "inner", limit_bytes=0)
    assert plan.count() == 4500 and plan.where("v = -1").count() == 3000


def test_stems_match_in_row_and_by_table(spark):
    from postlens.functions import features as X
    from postlens.operators import features as O

    docs = spark.createDataFrame([(1, "abused abuse abusing ab good goods"), (2, "nothing"), (3, None)], "doc_id long, text string")
    lexicon = {"negative": {"partial": ["abus", "abuse"]}, "positive": {"exact": ["good"]}}
    table = spark.createDataFrame([(p, k, w) for p, kinds in lexicon.items() for k, ws in kinds.items() for w in ws], "polarity string, kind string, word string")
    want = {(1, "lsd_negative_partial_abus", 3.0), (1, "lsd_negative_partial_abuse", 2.0), (1, "lsd_positive_exact_good", 1.0)}
    assert {tuple(r) for r in O.as_rows(docs, X.polarity_words(F.col("text"), lexicon, fixed=True)).collect()} == want
    assert {tuple(r) for r in O.polarity_by_table(docs, table, fixed=True).collect()} == want


def test_k_best_in_folds_scores_like_all_when_k_is_large(spark, corpus):
    rows = corpus.select("doc_id", F.explode("tokens").alias("feature")).groupBy("doc_id", "feature").agg(F.count(F.lit(1)).cast("double").alias("value"))
    plain = M.nb_grid_search(corpus, [0.1, 1.0], folds=3, max_df=1.0).collect()
    assert M.nb_grid_search(corpus, [0.1, 1.0], folds=3, max_df=1.0, features=rows, k_best=1000).collect() == plain
    assert M.nb_grid_search(corpus, [1.0], folds=3, max_df=1.0, features=rows, k_best=1).count() == 1


def test_no_cell_carries_its_whole_matrix(spark, corpus):
    """A generator that keeps the array beside what it takes out copies it for each cell: quadratic in the vocabulary."""
    import re

    def kept(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        return {re.sub(r"#\d+", "", name) for names in re.findall(r"Generate [^\n]*?, \[([^\]]*)\], false, \[", plan) for name in names.split(", ") if name}

    fitted = M.classifier_pipeline("lr", max_df=None, max_iter=2).fit(corpus).stages
    svc = M.classifier_pipeline("lsvc", max_df=None, max_iter=2).fit(corpus).stages
    saved = [MT._saved(spark, fitted[-1], f"coefficientMatrix {MT._MATRIX}"), MT._saved(spark, svc[-1], f"coefficients {MT._VECTOR}")]
    assert kept(MT.matrix_table(saved[0], "coefficientMatrix")) <= {"turned", "height"}
    assert kept(MT.vector_table(saved[1], "coefficients")) == set()


def test_a_large_matrix_becomes_a_table_quickly(spark):
    import time

    width = 200_000
    frame = spark.range(1).select(F.struct(
        F.lit(1).cast("tinyint").alias("type"), F.lit(2).alias("numRows"), F.lit(width).alias("numCols"), F.lit(None).cast("array<int>").alias("colPtrs"),
        F.lit(None).cast("array<int>").alias("rowIndices"), F.transform(F.sequence(F.lit(1), F.lit(2 * width)), lambda x: x.cast("double")).alias("values"),
        F.lit(True).alias("isTransposed")).alias("m"))
    path = fresh_path(spark, "matrix")
    frame.write.parquet(path)
    start = time.time()
    got = MT.matrix_table(spark.read.parquet(path), "m").where("value = i * 200000 + j + 1").count()
    assert got == 2 * width and time.time() - start < 20
