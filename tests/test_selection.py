"""Percentiles by counting passes, the hashed vocabulary and the regression grid against their plain forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import feature_model as FM
from postlens.operators import models as M
from postlens.operators import ranking as R
from postlens.operators import vectorize as V

PERCENTS = [0.0, 1.0, 12.5, 25.0, 50.0, 66.6, 99.0, 100.0]


@pytest.mark.parametrize("rest", [0, 40, 50_000])
def test_percentiles_of_ties_negatives_and_nulls(spark, monkeypatch, rest):
    monkeypatch.setattr(R, "REST", rest)
    draw = random.Random(3)
    values = [-1.5] * 300 + [0.0, -0.0] * 40 + [draw.uniform(-1e-3, 1e3) for _ in range(400)] + [5e-324, -5e-324, 1.7e308, -1.7e308, 0.1 + 0.2]
    draw.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 90, "x double")
    assert R.exact_percentiles(df, "x", PERCENTS) == pytest.approx(list(np.percentile(values, PERCENTS)))


def test_percentiles_of_few_rows_and_of_infinities(spark):
    one = spark.createDataFrame([(7,), (None,)], "x int")
    assert R.exact_percentiles(one, "x", [0.0, 50.0, 100.0]) == [7.0, 7.0, 7.0]
    odd = spark.createDataFrame([(-math.inf,), (1.0,), (math.inf,), (math.nan,)], "x double")
    low, last = R.exact_percentiles(odd, "x", [0.0, 100.0])
    assert low == -math.inf and math.isnan(last)


ROWS = [(d, f"f{(d * 7 + j * j) % 23}", 1.0 + j) for d in range(40) for j in range(4)]


def test_hashed_columns_against_plain_sums(spark):
    import hashlib

    rows = spark.createDataFrame(ROWS, "doc_id long, feature string, value double")
    want = {}
    for doc, name, value in ROWS:
        digest = hashlib.md5(name.encode()).hexdigest()
        place = doc, int(digest[:8], 16) % 5
        want[place] = want.get(place, 0.0) + (value if int(digest[8], 16) % 2 == 0 else -value)
    got = {(r["doc_id"], r["column"]): r["value"] for r in V.hash_vectorize(rows, 5).collect()}
    assert got == {k: v for k, v in want.items() if v}
    shared = {r["column"]: r["n_features"] for r in V.hash_collisions(rows, 5).collect()}
    names = {n for _, n, _ in ROWS}
    assert sum(shared.values()) + (5 - len(shared)) >= len(names) and all(n > 1 for n in shared.values())


def test_widths_without_collisions_agree_with_the_dictionary(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, feature string, value double")
    labels = spark.createDataFrame([(d, float(d % 23 < 11)) for d in range(40)], "doc_id long, label double")
    docs = labels.select("doc_id").unionByName(spark.createDataFrame([(99,)], "doc_id long"))  # one without features
    found = []
    for width in (1 << 16, 1 << 18):
        assert V.hash_collisions(rows, width).isEmpty()
        found.append(dict(FM.train_hashed(labels, rows, "lr", width=width).predict(docs, rows).collect()))
    plain = FM.train(labels, rows, "lr", unit=True).predict(docs, rows)
    assert found[0] == found[1] == dict(plain.select("doc_id", "prediction").collect()) and len(found[0]) == 41


def test_the_whole_regression_grid(spark):
    rows = [(i, float(i % 3 == 0), ["a" if i % 3 == 0 else "b", f"w{i % 5}", "a" if i % 7 == 0 else "c"]) for i in range(36)]
    corpus = spark.createDataFrame(rows, "doc_id long, label double, tokens array<string>")
    got = M.grid_search(corpus, "lr", folds=3, max_iter=15).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 19))
    assert {r["params"] for r in got} == {f"penalty={p}, C={c}" for p in ("l1", "l2") for c in range(1, 10)}
    means = [r["mean"] for r in got]
    assert means == sorted(means, reverse=True)
    folded, scores = M.stratified_folds(corpus, 3), []
    for fold in range(3):  # one candidate fitted plainly
        train, test = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        fitted = M.classifier_pipeline("lr", {"penalty": "l2", "C": 3}, norm="l2", max_iter=15).fit(train)
        pairs = [(r["label"], r["prediction"]) for r in fitted.transform(test).collect()]
        scores.append(2 * sum(a * b for a, b in pairs) / max(sum(a + b for a, b in pairs), 1))
    own = next(r for r in got if r["params"] == "penalty=l2, C=3")
    assert own["mean"] == pytest.approx(np.mean(scores)) and own["std"] == pytest.approx(np.std(scores))
