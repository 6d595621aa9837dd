"""Classifiers, topic models and clusters on MLlib, and the splits they are judged on."""

from __future__ import annotations

import math
import statistics
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.base import Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.clustering import LDA, KMeans, LDAModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import argmax, truncated
from ..session import cut_lineage, reuse
from .joins import lookup_join
from .model_tables import vocabulary_table
from .ranking import dense_index
from .term_blocks import cluster_shares
from .vectorize import term_counts

RUN_BYTES = 512 * 1024 * 1024  # dense numbers that fits which run side by side may hold together
DRIVER_TERMS = 1_000_000  # of a vocabulary that MLlib's clusters and their regressions may hold on the driver


def many_terms(corpus: DataFrame, tokens: str = "tokens") -> bool:
    """Whether a corpus has more terms, by an estimate, than a fit may hold on the driver."""
    return corpus.select(F.explode(tokens).alias("t")).agg(F.approx_count_distinct("t")).first()[0] > DRIVER_TERMS


def side_by_side(doubles: int, most: int = 4) -> int:
    """How many fits may run at a time if each holds so many numbers of 8 bytes; one, if it is larger than the bound."""
    return max(1, min(most, RUN_BYTES // (8 * max(doubles, 1))))


def _width(vectors: DataFrame) -> int:
    """Length of the vectors in `features`."""
    row = vectors.select("features").first()
    return row["features"].size if row else 0


# --- splits -------------------------------------------------------------------------------


def _bucket(key: str, buckets: int, seed: int = 0) -> Column:
    """0..buckets-1 from the digest of the key: the same row falls the same way each time."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets))


def holdout_split(rows: DataFrame, test_percent: int = 50, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """Add `is_test` for about `test_percent` of the rows, decided by the key alone."""
    return rows.withColumn("is_test", _bucket(key, 100, seed) < test_percent)


def stratified_folds(rows: DataFrame, folds: int = 10, key: str = "doc_id", label: str = "label") -> DataFrame:
    """Add `fold` 0..folds-1: labels are dealt out evenly, in digest order.

    Rows are numbered over the whole corpus in (label, digest, key) order; the place inside a
    label is that number less the label's first, so a label of any size spreads over tasks.
    """
    placed = rows.withColumn("_h", F.md5(F.col(key).cast("string")))
    indexed = dense_index(placed, [label, "_h", key], "_i", 0)
    firsts = indexed.groupBy(label).agg(F.min("_i").alias("_first"))
    return (lookup_join(indexed, firsts, [label])
            .withColumn("fold", ((F.col("_i") - F.col("_first")) % folds).cast("int")).drop("_h", "_i", "_first"))


# --- vectors ------------------------------------------------------------------------------

_EVERY_TERM = 2**31 - 1  # MLlib's largest integer: no vocabulary is that large


class SmoothIdf(Estimator, HasInputCol, HasOutputCol):
    """tf → tf · (ln((1+n)/(1+df)) + 1): MLlib's IDF lacks the one.

    Fits to a plain ElementwiseProduct, so a fitted pipeline stays a JVM pipeline.
    """

    @keyword_only
    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> Transformer:
        idf = IDF(inputCol=self.getInputCol(), outputCol="_idf").fit(dataset).idf
        scaling = DenseVector(idf.toArray() + 1.0)
        return ElementwiseProduct(scalingVec=scaling, inputCol=self.getInputCol(), outputCol=self.getOutputCol())


class CountedTerms(Estimator):
    """A count vectorizer whose largest document share becomes a number of documents before it is fitted.

    Given a share, MLlib keeps the tokens of a whole partition as objects to count the rows first. Here rows are counted
    without their tokens, and the fit reads each document once. Fits to MLlib's own model.
    """

    def __init__(self, stage: CountVectorizer):
        super().__init__()
        self._stage = stage

    def _fit(self, dataset: DataFrame) -> Transformer:
        stage, share = self._stage, self._stage.getMaxDF()
        if stage.getMinDF() >= 1.0 and share < 1.0 and (most := share * dataset.count()) >= 1.0:
            stage = stage.copy().setMaxDF(most)
        return stage.fit(dataset)


def count_stage(min_df: float = 1.0, max_df: float | None = None, output: str = "features") -> Estimator:
    """Token counts over the whole vocabulary, none of it cut. MLlib keeps a model's coefficients, and so the terms
    they belong to, on the driver; the aggregate forms (`nb_fit`, `nb_grid_search`, `chi2`, `tfidf`) do not."""
    stage = CountVectorizer(inputCol="tokens", outputCol=output, minDF=min_df, vocabSize=_EVERY_TERM)
    return CountedTerms(stage.setMaxDF(max_df)) if max_df is not None else stage


def vector_stages(feat: str = "count", norm: str | None = None, max_df: float | None = 0.8, min_df: float = 1.0) -> list:
    """Stages from `tokens` to `features`: counts, or tf-idf with unit L2 rows; then a norm."""
    last = "features"
    raw = "_vectors" if (norm or feat == "tfidf") else last
    stages = [count_stage(min_df=min_df, max_df=max_df, output=raw)]
    if feat == "tfidf":
        stages += [SmoothIdf(inputCol=raw, outputCol="_weighted"),
                   Normalizer(p=2.0, inputCol="_weighted", outputCol="_unit" if norm else last)]
        raw = "_unit"
    if norm:
        stages.append(Normalizer(p=1.0 if norm == "l1" else 2.0, inputCol=raw, outputCol=last))
    return stages


# --- classifiers --------------------------------------------------------------------------


def classifier(model: str, n_rows: int, params: dict | None = None, multiclass: bool = False,
               max_iter: int = 100):
    """lr, nb, sgd, svc (linear), lsvc or gnb with the library-neutral parameters
    C / alpha / penalty / loss. C weighs the loss sum, hence regParam = 1/(C·n)."""
    p = params or {}
    if model == "lr":
        return LogisticRegression(regParam=1.0 / (p.get("C", 1.0) * n_rows), standardization=False, maxIter=max_iter,
                                  elasticNetParam=1.0 if p.get("penalty", "l2") == "l1" else 0.0)
    if model == "nb":
        return NaiveBayes(modelType="multinomial", smoothing=max(p.get("alpha", 1.0), 1e-10))
    if model == "gnb":
        return NaiveBayes(modelType="gaussian")
    if model == "sgd" and p.get("loss", "hinge") == "log":
        return LogisticRegression(regParam=p.get("alpha", 1e-4), standardization=False, maxIter=max_iter)
    if model in ("sgd", "svc", "lsvc"):
        if p.get("kernel", "linear") != "linear" or p.get("loss", "hinge") != "hinge":
            raise ValueError("only the linear kernel and the hinge loss are supported")
        reg = p.get("alpha", 1e-4) if model == "sgd" else 1.0 / (p.get("C", 1.0) * n_rows)
        svc = LinearSVC(regParam=reg, standardization=False, maxIter=max_iter)
        return OneVsRest(classifier=svc) if multiclass else svc
    raise ValueError(f"unknown model: {model}")


class CountedClassifier(Estimator):
    """`classifier` for as many rows as it is fitted on, so that C means the same in folds, refits and full fits."""

    def __init__(self, model: str, params: dict | None = None, multiclass: bool = False, max_iter: int = 100,
                 label: str = "label"):
        super().__init__()
        self._make = lambda n: classifier(model, n, params, multiclass, max_iter).setLabelCol(label)
        self._counts = model in ("lr", "svc", "lsvc")

    def _fit(self, dataset: DataFrame) -> Transformer:
        return self._make(max(dataset.count(), 1) if self._counts else 1).fit(dataset)


def classifier_pipeline(model: str, params: dict | None = None, feat: str = "count", norm: str | None = None,
                        multiclass: bool = False, max_df: float | None = 0.8, max_iter: int = 100) -> Pipeline:
    """<tokens, label> → vectors → classifier, as one pipeline whose fitted form saves and loads whole."""
    return Pipeline(stages=[*vector_stages(feat, norm, max_df), CountedClassifier(model, params, multiclass, max_iter)])


def fit_named_labels(corpus: DataFrame, model: str, params: dict | None = None, feat: str = "count", norm: str | None = None,
                     max_df: float | None = 0.8, max_iter: int = 100) -> PipelineModel:
    """Fit on labels of any type and number, numbered along their names; the fitted pipeline adds `predicted`, a name.

    Applied to rows without a label it needs none, and it saves and loads with its names.
    """
    names = StringIndexer(inputCol="label", outputCol="_number", stringOrderType="alphabetAsc").fit(corpus)
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=names.labels)
    counted = CountedClassifier(model, params, len(names.labels) > 2, max_iter, "_number")
    return Pipeline(stages=[names, *vector_stages(feat, norm, max_df), counted, named]).fit(corpus)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, corpus: DataFrame) -> DataFrame:
    """<…, tokens> → the same rows with `prediction`."""
    return model.transform(corpus).select(*corpus.columns, "prediction")


def predict_proba(model: PipelineModel, corpus: DataFrame) -> DataFrame:
    """As `predict`, with the class probabilities as array `dist`."""
    return model.transform(corpus).select(*corpus.columns, "prediction", vector_to_array("probability").alias("dist"))


def train_eval(pipeline: Pipeline, corpus: DataFrame, test_percent: int = 50,
               compat: bool = False) -> tuple[PipelineModel, float, DataFrame]:
    """Fit on everything (training accuracy), refit on the training part, predict the rest.

    Returns the model to keep, the training accuracy and <label, prediction> of the held-out
    rows. The model kept is the full fit; `compat` keeps the half-data refit.
    """
    full = pipeline.fit(corpus)
    score = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(full.transform(corpus))
    split = holdout_split(corpus, test_percent)
    part = pipeline.fit(split.where(~F.col("is_test")))
    held = part.transform(split.where("is_test")).select("doc_id", "label", "prediction")
    return (part if compat else full), score, held


# The search grids.
GRIDS = {
    "lr": {"penalty": ["l1", "l2"], "C": [1, 2, 3, 4, 5, 6, 7, 8, 9]},
    "nb": {"alpha": [0.0, 0.001, 0.002, 0.003, 0.004, 0.005, 0.006, 0.007, 0.008, 0.009]},
    "sgd": {"loss": ["log", "hinge"], "alpha": [0.001, 0.0001, 0.00001, 0.000001]},
    "svc": {"C": [1, 10, 100, 1000], "kernel": ["linear"]},
    "lsvc": {"C": [1, 10, 100, 1000], "loss": ["hinge"]},
}


def candidates(model: str, grid: dict | None = None) -> list[dict]:
    """All parameter combinations of a grid, in grid order."""
    out: list[dict] = [{}]
    for name, values in (grid or GRIDS[model]).items():
        out = [{**c, name: v} for c in out for v in values]
    return out


def _searched(corpus: DataFrame, choices: list[tuple[str, dict]], folds: int, feat: str, norm: str | None,
              parallelism: int, metric: str, max_iter: int, max_df: float | None = 0.8) -> list[dict]:
    """Mean and deviation of a metric for each (model, parameters) over the same folds.

    Vectors are fitted once per fold, on its training part, and serve all candidates.
    """
    folded = stratified_folds(corpus, folds)
    multiclass = corpus.select("label").distinct().limit(3).count() > 2
    evaluator = (MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)
                 if metric == "f1_binary" else MulticlassClassificationEvaluator(metricName=metric))
    scores: list[list[float]] = [[] for _ in choices]
    for fold in range(folds):
        train, test = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        vectors = Pipeline(stages=vector_stages(feat, norm, max_df)).fit(train)
        fit_on, judge_on = (reuse(cut_lineage(vectors.transform(part).select("label", "features"))) for part in (train, test))
        n = max(fit_on.count(), 1)

        def judged(choice: tuple[str, dict]) -> float:
            fitted = classifier(choice[0], n, choice[1], multiclass, max_iter).fit(fit_on)
            return evaluator.evaluate(fitted.transform(judge_on))

        with ThreadPoolExecutor(parallelism) as pool:
            for i, value in enumerate(pool.map(inheritable_thread_target(corpus.sparkSession)(judged), choices)):
                scores[i].append(value)
        fit_on.unpersist()
        judge_on.unpersist()
    return [{"model": m, "params": ", ".join(f"{k}={v}" for k, v in p.items()),
             "mean": statistics.fmean(s), "std": statistics.pstdev(s)} for (m, p), s in zip(choices, scores)]


def grid_search(corpus: DataFrame, model: str, grid: dict | None = None, folds: int = 10, feat: str = "count",
                norm: str | None = "l2", parallelism: int = 4, max_iter: int = 100) -> DataFrame:
    """<model, params, mean, std> of binary F1 for each candidate, best first.

    Vectorizing is part of each fold's pipeline, so a fold never sees its test vocabulary.
    """
    choices = [(model, p) for p in candidates(model, grid)]
    rows = _searched(corpus, choices, folds, feat, norm, parallelism, "f1_binary", max_iter)
    return cv_report(corpus, rows)


def cv_report(corpus: DataFrame, rows: list[dict]) -> DataFrame:
    """One row per candidate, `place` 1 being the best mean."""
    ordered = sorted(rows, key=lambda r: -r["mean"])
    return corpus.sparkSession.createDataFrame(
        [(i + 1, r["model"], r["params"], r["mean"], r["std"]) for i, r in enumerate(ordered)],
        "place int, model string, params string, mean double, std double")


def model_sweep(corpus: DataFrame, models: list[str] = ("lr", "nb", "lsvc", "gnb"), folds: int = 10,
                test_percent: int = 25, parallelism: int = 4, max_iter: int = 100) -> tuple[DataFrame, DataFrame]:
    """Compare model families on tf-idf by cross-validation, refit the best on the training
    part; returns the report and <label, prediction> of the held-out rows."""
    split = holdout_split(corpus, test_percent)
    train, test = split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")
    rows = _searched(train, [(m, {}) for m in models], folds, "tfidf", None, parallelism, "accuracy", max_iter, None)
    best = max(rows, key=lambda r: r["mean"])["model"]
    fitted = classifier_pipeline(best, feat="tfidf", max_df=None, max_iter=max_iter).fit(train)
    return cv_report(corpus, rows), fitted.transform(test).select("doc_id", "label", "prediction")


# --- multinomial naive Bayes as plain aggregates ------------------------------------------


def nb_fit(counts: DataFrame, labels: DataFrame, alpha: float = 1.0, key: str = "doc_id",
           label: str = "label") -> tuple[DataFrame, dict]:
    """<term, label, log_prob> with log((N_ct+α)/(N_c+α·V)), and {label: log share}.

    Closed form over the long counts, so the vocabulary is not bounded by driver memory.
    Classes are few and become one conditional sum each. Counts that carry the label already
    are not joined.
    """
    sizes = {r[label]: r["n"] for r in labels.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(sizes)
    total = sum(sizes.values())
    sums = [F.sum(F.when(F.col(label) == c, F.col("tf")).otherwise(0)).alias(f"_c{i}") for i, c in enumerate(classes)]
    marked = counts if label in counts.columns else counts.join(labels.select(key, label), key)
    by_term = cut_lineage(marked.groupBy("term").agg(*sums))
    whole = by_term.agg(F.count(F.lit(1)), *[F.sum(f"_c{i}") for i in range(len(classes))]).first()
    a = max(alpha, 1e-10)
    rows = [F.struct(F.lit(c).alias(label),
                     F.log((F.col(f"_c{i}") + a) / F.lit(float(whole[i + 1] + a * whole[0]))).alias("log_prob"))
            for i, c in enumerate(classes)]
    return by_term.select("term", F.inline(F.array(*rows))), {c: math.log(sizes[c] / total) for c in classes}


def nb_predict(docs: DataFrame, counts: DataFrame, log_probs: DataFrame, priors: dict, key: str = "doc_id",
               label: str = "label") -> DataFrame:
    """<doc_id, prediction> for every row of `docs`: the class of highest log posterior, ties to the lower label.

    Unknown terms are ignored; a document left without terms gets the class of highest prior.
    """
    classes = sorted(priors)
    wide = log_probs.groupBy("term").agg(
        *[F.max(F.when(F.col(label) == c, F.col("log_prob"))).alias(f"_p{i}") for i, c in enumerate(classes)])
    joined = lookup_join(counts, wide, ["term"])
    sums = joined.groupBy(key).agg(*[F.sum(F.col("tf") * F.col(f"_p{i}")).alias(f"_s{i}") for i in range(len(classes))])
    scores = docs.select(key).join(sums, key, "left").select(key, *[
        (F.coalesce(f"_s{i}", F.lit(0.0)) + F.lit(priors[c])).alias(f"_s{i}") for i, c in enumerate(classes)])
    best = F.array_max(F.array(*[F.struct(F.col(f"_s{i}").alias("s"), F.lit(-i).alias("o"))
                                 for i in range(len(classes))]))
    names = F.lit(classes) if isinstance(classes[0], str) else F.array(*[F.lit(c) for c in classes])
    return scores.select(key, F.get(names, -best["o"]).alias("prediction"))


def nb_grid_search(corpus: DataFrame, alphas: list[float], folds: int = 10, max_df: float = 0.8,
                   key: str = "doc_id", features: DataFrame | None = None, k_best: int | None = None) -> DataFrame:
    """<place, model, params, mean, std> of binary F1 for each alpha, labels 0 and 1, best first.

    A fold's training sums are the whole sums less its own, so one aggregate by term serves all folds, and one by
    document all alphas: two shuffles for the whole grid, and no vocabulary on the driver. A term counts in a fold if
    its training part has it, in at most `max_df` of its documents.

    Terms are the corpus's tokens, or long `features` <doc_id, feature, value>. With `k_best`, each fold keeps the terms of
    highest chi-square over its own training sums, ties by name.
    """
    docs = reuse(stratified_folds(corpus, folds).select(key, "label", "fold", *(["tokens"] if features is None else [])))
    sizes = {(r["fold"], int(r["label"])): r["n"] for r in docs.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = [sum(n for (_, c), n in sizes.items() if c == label) for label in (0, 1)]
    inside = [[whole[c] - sizes.get((f, c), 0) for c in (0, 1)] for f in range(folds)]
    if features is None:
        counts = term_counts(docs, key=key, carry=("label", "fold"))
    else:
        counts = cut_lineage(features.join(docs, key).select(key, "label", "fold", F.col("feature").alias("term"), F.col("value").alias("tf")))
    own = lambda f, c: F.sum(F.when((F.col("fold") == f) & (F.col("label") == c), F.col("tf")).otherwise(0))
    by_term = counts.groupBy("term").agg(
        *[F.array(*[own(f, c) for f in range(folds)]).alias(f"n{c}") for c in (0, 1)],
        F.array(*[F.sum((F.col("fold") == f).cast("long")) for f in range(folds)]).alias("d"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    without = lambda a: F.transform(a, lambda x: total(F.col(a)) - x)
    limits = F.array(*[F.lit(max_df * sum(n)) for n in inside])
    known = by_term.select("term", *[without(c).alias(c) for c in ("n0", "n1", "d")])
    used = F.zip_with("d", limits, lambda d, most: (d > 0) & (d <= most))
    known = known.select("term", "n0", "n1", used.alias("used"))
    if k_best is not None:
        known = _best_in_folds(cut_lineage(known), inside, k_best)
    known = cut_lineage(known)
    sums = known.agg(*[F.sum(F.when(F.get("used", F.lit(f)), v).otherwise(0)).alias(f"{name}{f}")
                       for f in range(folds) for name, v in (("v", F.lit(1)), ("a", F.get("n0", F.lit(f))), ("b", F.get("n1", F.lit(f))))]).first()
    size = {n: F.array(*[F.lit(float(sums[f"{n}{f}"] or 0)) for f in range(folds)]) for n in "vab"}
    rows = lookup_join(counts, known, ["term"]).where(F.get("used", F.col("fold")))
    terms = []
    for i, alpha in enumerate(alphas):
        a = max(alpha, 1e-10)
        for c, name in ((0, "a"), (1, "b")):
            base = F.get(size[name], F.col("fold")) + a * F.get(size["v"], F.col("fold"))
            terms.append(F.sum(F.col("tf") * F.log((F.get(f"n{c}", F.col("fold")) + a) / base)).alias(f"s{i}_{c}"))
    scores = docs.select(key, "label", "fold").join(rows.groupBy(key).agg(*terms), key, "left")
    prior = [F.array(*[F.lit(math.log(max(n[c], 1e-300) / max(sum(n), 1))) for n in inside]) for c in (0, 1)]
    gain = F.get(prior[1], F.col("fold")) - F.get(prior[0], F.col("fold"))
    said = [(F.coalesce(F.col(f"s{i}_1") - F.col(f"s{i}_0"), F.lit(0.0)) + gain > 0).cast("int") for i in range(len(alphas))]
    each = scores.select("label", "fold", F.posexplode(F.array(*said)).alias("i", "said"))
    judged = each.groupBy("i", "fold").agg(F.sum(F.col("said") * F.col("label")).alias("tp"), F.sum(F.col("said") + F.col("label")).alias("both"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("both")), F.lit(0.0))
    found = {r["i"]: r for r in judged.groupBy("i").agg(F.avg(f1).alias("mean"), F.stddev_pop(f1).alias("std")).collect()}
    rows = [{"model": "nb", "params": f"alpha={a}", "mean": round(found[i]["mean"], 9), "std": found[i]["std"]} for i, a in enumerate(alphas) if i in found]
    return cv_report(corpus, rows)


def _best_in_folds(known: DataFrame, inside: list[list[int]], k: int) -> DataFrame:
    """<term, n0, n1, used> with `used` left true only in folds where the term is among the k of highest chi-square."""
    share = [F.array(*[F.lit(n[c] / max(sum(n), 1)) for n in inside]) for c in (0, 1)]
    both = lambda i: F.get("n0", i) + F.get("n1", i)

    def part(c: int, i: Column) -> Column:
        expected = both(i) * F.get(share[c], i)
        gap = F.get(f"n{c}", i) - expected
        return F.coalesce(F.try_divide(gap * gap, expected), F.lit(0.0))

    score = F.transform("used", lambda u, i: F.struct(i.alias("fold"), F.when(u, F.round(part(0, i) + part(1, i), 6)).alias("chi2")))
    each = known.select("term", F.inline(score)).where("chi2 is not null")
    best = each.withColumn("_r", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("chi2"), "term"))).where(F.col("_r") <= k)
    chosen = best.groupBy("term").agg(F.collect_set("fold").alias("_folds"))  # k rows per fold at most
    kept = lookup_join(known, chosen, ["term"])
    return kept.select("term", "n0", "n1", F.transform("used", lambda u, i: u & F.array_contains("_folds", i)).alias("used"))


def top_features_per_class(log_probs: DataFrame, k: int = 50, label: str = "label") -> DataFrame:
    """<label, term, log_prob, rank>: the k strongest terms of each class."""
    w = Window.partitionBy(label).orderBy(F.desc("log_prob"), "term")
    return log_probs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- topics and clusters ------------------------------------------------------------------


def topic_model(k: int, passes: int = 10, seed: int = 0) -> LDA:
    """Online variational Bayes with symmetric priors of 1/k that stay as they are, offset 1, decay 0.5.

    A pass draws as many documents as there are, with replacement (MLlib has no other way): a document is in none of
    10 passes with probability e^-10, or 0.005 %. Passes don't grow with the corpus, so work is linear in it.
    """
    return LDA(k=k, optimizer="online", seed=seed, learningOffset=1.0, learningDecay=0.5, optimizeDocConcentration=False,
               docConcentration=[1.0 / k], topicConcentration=1.0 / k, subsamplingRate=1.0, maxIter=passes)


def lda_fit(corpus: DataFrame, k: int, no_below: float = 5.0, no_above: float = 0.2, passes: int = 10, seed: int = 0):
    """(vocabulary model, LDA model) over all terms between the two document frequencies."""
    vocab = count_stage(min_df=no_below, max_df=no_above).fit(corpus)
    vectors = vocab.transform(corpus).select("features").persist()  # every pass reads them: nothing else takes memory beside them
    model = topic_model(k, passes, seed).fit(vectors)
    vectors.unpersist()
    return vocab, model


def doc_topics(vocab, lda: LDAModel, corpus: DataFrame, least: float = 0.01) -> DataFrame:
    """Add `topics`, array<struct<topic, prob>> without small shares, and the full `dist`."""
    rows = lda.transform(vocab.transform(corpus)).select(
        *corpus.columns, vector_to_array("topicDistribution").alias("dist"))
    return rows.withColumn("topics", truncated(F.col("dist"), least))


def show_topics(vocab, lda: LDAModel, n: int = 10) -> DataFrame:
    """<topic, rank, word, weight>: the n heaviest words of each topic."""
    described = lda.describeTopics(n)
    top = described.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("i", "t"))
    chosen = top.select("topic", (F.col("i") + 1).alias("rank"), F.col("t.termIndices").alias("index"), F.col("t.termWeights").alias("weight"))
    words = vocabulary_table(described.sparkSession, vocab)
    return words.join(F.broadcast(chosen), "index").select("topic", "rank", F.col("term").alias("word"), "weight")


def clean_topic_words(topics: DataFrame) -> DataFrame:
    """<topic, words>: the words of each topic, comma-separated, heaviest first."""
    listed = topics.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_w"))
    return listed.select("topic", F.array_join(F.transform("_w", lambda w: w["word"]), ",").alias("words"))


def argmax_topic(distributed: DataFrame) -> DataFrame:
    return distributed.withColumn("topic", argmax(F.col("dist")))


def kmeans_fit(vectors: DataFrame, k: int, restarts: int = 10, seed: int = 0, max_iter: int = 300):
    """The k-means model of least cost over several seeds, each run until its centres rest; vectors are kept for all of them.

    Centres are dense, and a run begins with up to 4k + 1 of them on every executor: runs go side by side while those are
    small, one after another with a large vocabulary. Nothing but the vectors is kept, and their lineage is cut: it holds the
    weight of every term, which would go out with each task of each iteration.
    """
    kept = cut_lineage(vectors.select("features")).persist()
    start = inheritable_thread_target(kept.sparkSession)(lambda i: KMeans(k=k, seed=seed + i, initMode="k-means||", maxIter=max_iter).fit(kept))
    with ThreadPoolExecutor(side_by_side((4 * k + 1) * _width(kept))) as pool:
        best = min(pool.map(start, range(restarts)), key=lambda m: m.summary.trainingCost)  # the centres of the others are let go
    kept.unpersist()
    return best


_LBFGS_VECTORS = 24  # of the vocabulary's length, held by a regression on the driver: ten steps, ten gradients and the current ones


def one_vs_rest_shares(vectors: DataFrame, classes: int, label: str = "label", max_iter: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """<carry…, dist>: class shares of one binary regression per class, each probability divided by the sum of all.

    Classes are 0 to `classes` - 1; their regressions are apart and run side by side. A row to which every regression gives 0 has equal shares.
    """
    n = max(vectors.count(), 1)

    def fitted(c: int):
        one = LogisticRegression(labelCol="_is", regParam=1.0 / n, standardization=False, maxIter=max_iter, predictionCol="_said", rawPredictionCol="_raw", probabilityCol=f"_p{c}")
        return one.fit(vectors.select("features", (F.col(label) == c).cast("double").alias("_is")))

    with ThreadPoolExecutor(side_by_side(_LBFGS_VECTORS * _width(vectors))) as pool:
        models = list(pool.map(inheritable_thread_target(vectors.sparkSession)(fitted), range(classes)))
    out = vectors.select(*carry, label, "features")
    for model in models:
        out = model.transform(out).drop("_said", "_raw")
    each = F.array(*[F.get(vector_to_array(f"_p{c}"), F.lit(1)) for c in range(classes)])
    whole = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    return out.select(*carry, F.transform(each, lambda p: F.coalesce(F.try_divide(p, whole), F.lit(1.0 / classes))).alias("dist"))


def cluster_classifier(corpus: DataFrame, cluster: str = "cluster", max_iter: int = 100, multinomial: bool = False) -> DataFrame:
    """Fit tf-idf + regression on cluster ids 0, 1, …; the same documents with `dist`, a share for each cluster.

    One regression per cluster against the rest, or with `multinomial` a joint one. With too many terms for the driver, the
    regressions per cluster are fitted over blocks of terms.
    """
    if not multinomial and many_terms(corpus):
        return cluster_shares(corpus, cluster, max_iter)
    labelled = corpus.withColumn("label", F.col(cluster).cast("double"))
    if multinomial:
        lr = LogisticRegression(family="multinomial", regParam=1.0 / max(labelled.count(), 1), standardization=False, maxIter=max_iter)
        model = Pipeline(stages=[*vector_stages("tfidf", None, None), lr]).fit(labelled)
        return predict_proba(model, labelled).drop("label", "prediction")
    vectors = cut_lineage(Pipeline(stages=vector_stages("tfidf", None, None)).fit(labelled).transform(labelled).select(*corpus.columns, "label", "features"))
    classes = int(vectors.agg(F.coalesce(F.max("label"), F.lit(0.0))).first()[0]) + 1
    return one_vs_rest_shares(vectors, classes, "label", max_iter, tuple(corpus.columns))


def topic_threshold_sweep(corpus: DataFrame, ks: list[int], percents: list[float], no_below: float = 3.0,
                          no_above: float = 0.1, seed: int = 0) -> DataFrame:
    """<num_topics, threshold, precision, recall, f1>, best F1 first.

    The vocabulary and the vectors are made once. One topic model per k serves every percentile; all percentiles of a k are
    judged in one aggregate over its documents. Models of a few ks are fitted side by side. `label` must be '1' or '0'.
    """
    from ..functions.scores import entropy_by_k
    from .evaluate import _ratio
    from .ranking import exact_percentiles

    parts = []
    vectors = count_stage(min_df=no_below, max_df=no_above).fit(corpus).transform(corpus).select("doc_id", "label", "features").persist()
    wide = side_by_side(3 * max(ks) * _width(vectors))  # the topics, their expectations and a pass's sums
    fit = inheritable_thread_target(corpus.sparkSession)(lambda k: topic_model(k, seed=seed).fit(vectors))

    def models():
        with ThreadPoolExecutor(wide) as pool:
            for i in range(0, len(ks), wide):
                yield from zip(ks[i:i + wide], list(pool.map(fit, ks[i:i + wide])))

    for k, lda in models():
        shares = F.transform(truncated(vector_to_array("topicDistribution"), 0.01), lambda t: t["prob"])
        scored = cut_lineage(lda.transform(vectors).select(
            "doc_id", (F.col("label") == "1").alias("is_true"), entropy_by_k(shares, k).alias("entropy")))
        cuts = exact_percentiles(scored, "entropy", percents)
        sums = []
        for i, cut in enumerate(cuts):
            said = F.col("entropy") >= F.lit(cut)
            sums += [F.sum((said & F.col("is_true")).cast("long")).alias(f"tp{i}"), F.sum(said.cast("long")).alias(f"said{i}")]
        sums_of = scored.agg(F.sum(F.col("is_true").cast("long")).alias("true"), *sums)
        parts.append(sums_of.select(F.inline(F.array(*[F.struct(
            F.lit(k).alias("num_topics"), F.lit(float(p)).alias("threshold"),
            _ratio(F.col(f"tp{i}"), F.col(f"said{i}")).alias("precision"),
            _ratio(F.col(f"tp{i}"), F.col("true")).alias("recall"),
            _ratio(2 * F.col(f"tp{i}"), F.col(f"said{i}") + F.col("true")).alias("f1"))
            for i, p in enumerate(percents)]))))
    vectors.unpersist()
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("f1"), "num_topics", "threshold")
