"""K-means and regressions over blocks of terms, held against dense arithmetic."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import models as M
from postlens.operators import term_blocks as T
from postlens.plans import model_queries as Q


def _docs(n=120, groups=3):
    rng = np.random.default_rng(3)
    rows = [(int(i), [f"a{j}" for j in rng.integers(0, 30, 10)] + [f"c{i % groups}_{j}" for j in rng.integers(0, 6, 5)]) for i in range(n)]
    return rows + [(n, []), (n + 1, None), (0, ["a1", "alone"])]  # without words, and a key that comes twice


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)


def _dense(rows):
    counts = [Counter(t or []) for t in rows]
    terms = sorted(set().union(*counts))
    df = {t: sum(t in c for c in counts) for t in terms}
    x = np.array([[c[t] * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t in terms] for c in counts])
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def _closed(*args, **kwargs):
    raise AssertionError("the vocabulary came to the driver")


@pytest.fixture
def few(monkeypatch):
    """No vocabulary is short enough for the driver."""
    monkeypatch.setattr(M, "DRIVER_TERMS", 0)
    for cls in (M.CountVectorizer, M.KMeans, M.LogisticRegression):
        monkeypatch.setattr(cls, "fit", _closed)


def test_clusters_without_the_vocabulary_on_the_driver(spark, few, monkeypatch):
    monkeypatch.setattr(Q, "prepared", lambda *_: _frame(spark, _docs()))
    rows = Q.clusters(spark, None, 3).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in _docs())
    x, label = _dense([r["tokens"] for r in rows]), np.array([r["cluster"] for r in rows])
    centres = np.stack([x[label == k].mean(axis=0) for k in range(3)])
    far = ((x[:, None] - centres) ** 2).sum(axis=2)
    assert (far[np.arange(len(x)), label] <= far.min(axis=1) + 1e-9).all()  # at rest: each is nearest to its own mean
    own = [Counter(r["cluster"] for r in rows if 1 <= r["doc_id"] < 120 and r["doc_id"] % 3 == g).most_common(1)[0] for g in range(3)]
    assert len({k for k, _ in own}) == 3 and min(n for _, n in own) > 35


def test_costs_are_plain_arithmetic(spark, monkeypatch):
    monkeypatch.setattr(T, "SUM_BYTES", 1)  # a task holds the sums of one run at a time
    frame = _frame(spark, _docs())
    blocks = T.TermBlocks(frame)
    states, best, cost = T.cluster(blocks, 4, restarts=2)
    rows = blocks.table(states, lambda s: s["label"][:, best].tolist(), "cluster int").collect()
    x, label = _dense([r["tokens"] for r in rows]), np.array([r["cluster"] for r in rows])
    assert cost == pytest.approx(sum(((x[label == k] - x[label == k].mean(axis=0)) ** 2).sum() for k in set(label)))


def test_fewer_texts_than_clusters(spark):
    frame = _frame(spark, [(i, [f"w{i % 3}"]) for i in range(30)])
    rows = T.cluster_documents(frame, 5, restarts=2).collect()
    assert len({(r["tokens"][0], r["cluster"]) for r in rows}) == 3 and len({r["cluster"] for r in rows}) == 3


def test_an_empty_cluster_goes_on_from_the_farthest_document(spark, monkeypatch):
    frame = _frame(spark, [(i, [f"w{i % 3}", "all"]) for i in range(30)])
    blocks = T.TermBlocks(frame)
    chunk = next(iter(blocks.sizes))
    monkeypatch.setattr(T, "_starts", lambda *_: [[(chunk, 0, j, 1.0) for j in range(1)]])  # one centre, two clusters empty
    states, best, cost = T.cluster(blocks, 3, restarts=1)
    assert cost == pytest.approx(0.0, abs=1e-9)
    rows = blocks.table(states, lambda s: s["label"][:, best].tolist(), "cluster int").collect()
    assert len({(r["tokens"][0], r["cluster"]) for r in rows}) == 3


def test_shares_are_those_of_the_exact_regressions(spark, few):
    rows = [(d, t, int(d % 3)) for d, t in _docs()]
    frame = spark.createDataFrame(rows, "doc_id long, tokens array<string>, cluster int").repartition(3)
    got = M.cluster_classifier(frame).collect()
    assert got[0].asDict().keys() == {"doc_id", "tokens", "cluster", "dist"} and len(got) == len(rows)
    x, label, n = _dense([r["tokens"] for r in got]), np.array([r["cluster"] for r in got]), len(got)
    each = []
    for k in range(3):
        y, a, w = (label == k) * 1.0, np.c_[x, np.ones(n)], np.zeros(x.shape[1] + 1)
        reg = np.r_[np.ones(x.shape[1]) / n, 0]
        for _ in range(40):
            p = 1 / (1 + np.exp(-a @ w))
            w -= np.linalg.solve((a.T * (p * (1 - p))) @ a / n + np.diag(reg), a.T @ (p - y) / n + reg * w)
        each.append(1 / (1 + np.exp(-a @ w)))
    want = np.stack(each, axis=1)
    assert np.abs(np.stack([r["dist"] for r in got]) - want / want.sum(axis=1, keepdims=True)).max() < 1e-3


def test_a_single_class_has_all(spark):
    got = T.cluster_shares(_frame(spark, _docs(10)).withColumn("cluster", F.lit(1)), "cluster").collect()
    assert all(r["dist"] == [0.0, 1.0] for r in got)


def test_a_short_vocabulary_is_known_from_a_long_one(spark, monkeypatch):
    frame = _frame(spark, _docs())
    assert not M.many_terms(frame)
    monkeypatch.setattr(M, "DRIVER_TERMS", 10)
    assert M.many_terms(frame)
