"""Queries: classifiers, topic models and clusters on the documents."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.scores import entropy_normalized
from ..functions import features as X
from ..functions.text import preprocess_tokens, vector_tokens
from ..functions.words import stop_words
from ..operators import models as M
from ..operators import vectorize as V
from ..operators import features as O
from ..operators import model_tables as MT
from ..operators import stages
from ..operators import term_blocks as T
from ..operators.evaluate import METRICS, full_report
from ..session import fresh_path, reuse
from . import sqltext as S
from .feature_queries import words_sql
from .registry import query, table

STOPS = stop_words(extra=True)


def labelled(spark, sf):
    """<doc_id, label, tokens> of the labelled documents."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return reuse(docs.select("doc_id", F.col("quality").cast("double").alias("label"),
                             preprocess_tokens(F.col("text"), STOPS).alias("tokens")))


def unseen(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"), preprocess_tokens(F.col("text"), STOPS).alias("tokens"))


def prepared(spark, sf):
    return reuse(table(spark, sf, "documents").select(
        "doc_id", "source", preprocess_tokens(F.col("text"), STOPS).alias("tokens")))


def _fitted_predictions(spark, sf, model, params, feat="tfidf"):
    corpus = labelled(spark, sf)
    fitted = M.classifier_pipeline(model, params, feat).fit(corpus)
    return M.predict(fitted, corpus).select("doc_id", "label", "prediction")


@query("lr")
def lr(spark, sf):
    return _fitted_predictions(spark, sf, "lr", {"penalty": "l2", "C": 1})


@query("sgd")
def sgd(spark, sf):
    return _fitted_predictions(spark, sf, "sgd", {"loss": "log", "alpha": 0.0001})


@query("sgd_hinge")
def sgd_hinge(spark, sf):
    return _fitted_predictions(spark, sf, "sgd", {"loss": "hinge", "alpha": 0.0001})


@query("lsvc")
def lsvc(spark, sf):
    return _fitted_predictions(spark, sf, "lsvc", {"C": 1})


@query("svc_linear")
def svc_linear(spark, sf):
    return _fitted_predictions(spark, sf, "svc", {"C": 10, "kernel": "linear"}, "count")


NB = f"""lab as (select doc_id, quality as label from labels),
tf as (select doc_id, term, count(*) as tf from (
  select doc_id, unnest({S.vector_tokens('text')}) as term from documents semi join lab using (doc_id)) group by all),
size as (select label, count(*) as n_c from lab group by label),
vocab as (select distinct term from tf),
tot as (select label, sum(tf) as t from tf join lab using (doc_id) group by label),
nct as (select term, label, sum(tf) as n from tf join lab using (doc_id) group by all),
lp as (select term, label, ln((coalesce(n, 0) + 1.0) / (t + (select count(*) from vocab))) as log_prob
       from vocab cross join tot left join nct using (term, label))"""


def _nb(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id")
    corpus = reuse(docs.select("doc_id", "label", vector_tokens(F.col("text")).alias("tokens")))
    counts = V.term_counts(corpus, carry=("label",))
    return corpus, counts, *M.nb_fit(counts, labels)


@query("nb", f"""with {NB}, sums as (select doc_id, lp.label, sum(tf * log_prob) as s from tf join lp using (term) group by doc_id, lp.label),
s as (select d.doc_id, size.label, coalesce(s, 0) + ln(n_c / (select count(*) from lab)) as s
  from (select doc_id from documents semi join lab using (doc_id)) d cross join size
  left join sums on sums.doc_id = d.doc_id and sums.label = size.label)
select doc_id, arg_max(label, s) as prediction from s group by doc_id""")
def nb(spark, sf):
    docs, counts, log_probs, priors = _nb(spark, sf)
    return M.nb_predict(docs, counts, log_probs, priors)


@query("top_features_per_class", f"""with {NB} select label, term, round(log_prob, 6) as log_prob, rank from (
select *, row_number() over (partition by label order by round(log_prob, 9) desc, term)::integer as rank from lp) where rank <= 50""")
def top_features_per_class(spark, sf):
    log_probs = _nb(spark, sf)[2].withColumn("log_prob", F.round("log_prob", 9))
    return M.top_features_per_class(log_probs).select("label", "term", F.round("log_prob", 6).alias("log_prob"), "rank")


@query("named_labels", f"""with tf as materialized (select conv_id, turn, role, term, count(*) as tf from (
  select conv_id, turn, role, unnest({S.vector_tokens('text')}) as term from conversations) group by all),
size as (select role, count(*) as n_c from conversations group by role),
vocab as (select distinct term from tf),
tot as (select role, sum(tf) as t from tf group by role),
nct as (select term, role, sum(tf) as n from tf group by all),
lp as materialized (select term, role, ln((coalesce(n, 0) + 1.0) / (t + (select count(*) from vocab))) as p
  from vocab cross join tot left join nct using (term, role)),
sums as (select conv_id, turn, lp.role, sum(tf * p) as s from tf join lp using (term) group by conv_id, turn, lp.role),
s as (select c.conv_id, c.turn, c.role as label, size.role, coalesce(s, 0) + ln(n_c + 1) as s from conversations c cross join size
  left join sums on sums.conv_id = c.conv_id and sums.turn = c.turn and sums.role = size.role)
select conv_id, turn, any_value(label) as label, arg_max(role, s) as predicted from s group by conv_id, turn""")
def named_labels(spark, sf):
    """Three roles by name, predicted from what was said."""
    talk = reuse(table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("label"), vector_tokens(F.col("text")).alias("tokens")))
    model = M.fit_named_labels(talk, "nb", max_df=None)
    return model.transform(talk).select("conv_id", "turn", "label", "predicted")


GAUSS = """v as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
u as (select vec_id, label, i, x / sum(abs(x)) over (partition by vec_id) as x from v),
eps as (select 1e-9 * max(var) as eps from (select var_pop(x) as var from u group by i)),
g as (select label, i, avg(x) as m, var_pop(x) + (select eps from eps) as s2 from u group by label, i),
p as (select label, ln(count(*) / (select count(*) from embeddings)) as prior from embeddings group by label),
ll as (select vec_id, g.label, any_value(prior) + sum(-0.5 * ln(2 * pi() * s2) - (x - m) * (x - m) / (2 * s2)) as s
  from u join g using (i) join p on p.label = g.label group by vec_id, g.label)"""


@query("gaussian_nb", f"with {GAUSS} select vec_id, arg_max(label, s) as prediction from ll group by vec_id")
def gaussian_nb(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("raw"))
    pipeline = Pipeline(stages=[Normalizer(p=1.0, inputCol="raw", outputCol="features"),
                                M.classifier("gnb", 1)])
    return pipeline.fit(rows).transform(rows).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


def _lda(spark, sf, k=4):
    corpus = prepared(spark, sf)
    return corpus, *M.lda_fit(corpus, k)


@query("lda_fit")
def lda_fit(spark, sf):
    """Every term's weight in every topic, from the saved model's matrix."""
    _, vocab, model = _lda(spark, sf)
    return MT.topic_words(spark, vocab, model)


@query("doc_topics")
def doc_topics(spark, sf):
    corpus, vocab, model = _lda(spark, sf)
    rows = M.doc_topics(vocab, model, corpus)
    return rows.select("doc_id", F.inline("topics"))


@query("show_topics")
def show_topics(spark, sf):
    _, vocab, model = _lda(spark, sf)
    return M.show_topics(vocab, model, 10)


@query("clean_topic_words")
def clean_topic_words(spark, sf):
    _, vocab, model = _lda(spark, sf)
    return M.clean_topic_words(M.show_topics(vocab, model, 10))


@query("argmax_topic")
def argmax_topic(spark, sf):
    corpus, vocab, model = _lda(spark, sf)
    return M.argmax_topic(M.doc_topics(vocab, model, corpus)).select("doc_id", "topic")


def clusters(spark, sf, k=4):
    corpus = prepared(spark, sf)
    if M.many_terms(corpus):
        return T.cluster_documents(corpus.select("doc_id", "tokens"), k)
    vectors = Pipeline(stages=M.vector_stages("tfidf", None, None)).fit(corpus).transform(corpus)
    model = M.kmeans_fit(vectors, k)
    return model.transform(vectors).select("doc_id", "tokens", F.col("prediction").alias("cluster"))


@query("kmeans")
def kmeans(spark, sf):
    return clusters(spark, sf).select("doc_id", "cluster")


@query("cluster_classifier")
def cluster_classifier(spark, sf):
    rows = M.cluster_classifier(clusters(spark, sf))
    return rows.select("doc_id", "cluster", entropy_normalized(F.col("dist"), F.size("dist")).alias("entropy"))


@query("predict")
def predict(spark, sf):
    corpus = labelled(spark, sf)
    model = M.classifier_pipeline("lr", feat="tfidf").fit(corpus)
    return M.predict(model, unseen(spark, sf)).select("doc_id", "prediction")


@query("predict_proba")
def predict_proba(spark, sf):
    corpus = labelled(spark, sf)
    model = M.classifier_pipeline("nb").fit(corpus)
    return M.predict_proba(model, unseen(spark, sf)).select("doc_id", F.posexplode("dist").alias("class", "prob"))


@query("save_load_model")
def save_load_model(spark, sf):
    """Saved, loaded again, and applied to unseen texts."""
    corpus = labelled(spark, sf)
    model = M.classifier_pipeline("lr", feat="tfidf", norm="l2").fit(corpus)
    path = fresh_path(spark, "model")
    M.save_model(model, path)
    return M.predict_proba(M.load_model(path), unseen(spark, sf)).select("doc_id", "prediction")


def _figures(report):
    return report.select(*[c for c in report.columns if c not in ("matrix", *METRICS)], *[F.round(c, 6).alias(c) for c in METRICS],
                         F.array_join(F.transform("matrix", lambda x: F.concat_ws(" ", x["label"].cast("int"), x["prediction"].cast("int"), x["n"])), ", ").alias("matrix"))


@query("train_eval")
def train_eval(spark, sf):
    """Every figure of the held-out half, and the matrix, beside the training accuracy."""
    corpus = labelled(spark, sf)
    _, score, held = M.train_eval(M.classifier_pipeline("nb"), corpus)
    return _figures(full_report(held.withColumn("model", F.lit("nb")), ["model"], 1.0)).withColumn("training_accuracy", F.lit(score))


@query("top_features_linear")
def top_features_linear(spark, sf):
    """The strongest terms of each class for two linear classifiers, from their saved coefficients."""
    corpus, found = labelled(spark, sf), []
    for name in ("lr", "lsvc"):
        fitted = M.classifier_pipeline(name, max_iter=20).fit(corpus)
        table_ = MT.coefficient_table(spark, fitted.stages[0], fitted.stages[-1]).withColumn("weight", F.round("weight", 6))
        found.append(MT.top_coefficients(table_).select(F.lit(name).alias("model"), "label", "term", "weight", "rank"))
    return found[0].unionByName(found[1])


UNSEEN = f"""lab as (select doc_id, quality as label from labels semi join documents using (doc_id)),
tf as materialized (select doc_id, label, term, count(*) as tf from (
  select doc_id, unnest({S.tokens('text', STOPS)}) as term from documents semi join lab using (doc_id)) join lab using (doc_id) group by all),
size as (select label, count(*) as n_c from lab group by label),
vocab as materialized (select term from tf group by term having count(*) <= 0.8 * (select count(*) from lab)),
own as (select tf.* from tf semi join vocab using (term)),
tot as (select label, sum(tf) as t from own group by label),
nct as (select term, label, sum(tf) as n from own group by all),
lp as materialized (select term, label, ln((coalesce(n, 0) + 1.0) / (t + (select count(*) from vocab))) as log_prob
  from vocab cross join tot left join nct using (term, label)),
said as (select item_id, term, count(*) as tf from (select item_id, unnest({S.tokens('text', STOPS)}) as term from benchmark) group by all),
s as (select b.item_id, size.label, ln(n_c / (select count(*) from lab)) + coalesce(sum(tf * log_prob), 0) as s from benchmark b cross join size
  left join said on said.item_id = b.item_id left join lp on lp.term = said.term and lp.label = size.label group by b.item_id, size.label, n_c)"""


@query("predict_from_text", f"with {UNSEEN} select item_id, arg_max(label, s)::double as prediction from s group by item_id")
def predict_from_text(spark, sf):
    """A saved pipeline, loaded again, takes unseen texts as they are."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("quality").cast("double").alias("label"), "text")
    path = fresh_path(spark, "model")
    M.save_model(stages.text_classifier("nb", stops=STOPS).fit(docs), path)
    return M.load_model(path).transform(table(spark, sf, "benchmark")).select("item_id", "prediction")


ALPHAS = M.GRIDS["nb"]["alpha"]

# Each fold's training sums by brute force: terms against all other folds.
GRID = f"""lab as (select doc_id, quality as label, ((row_number() over (partition by quality order by md5(doc_id::varchar), doc_id) - 1) % 10) as fold
  from labels semi join documents using (doc_id)),
tf as materialized (select doc_id, label, fold, term, count(*) as tf from (
  select doc_id, unnest({S.tokens('text', STOPS)}) as term from documents semi join lab using (doc_id)) join lab using (doc_id) group by all),
f as (select unnest(range(10)) as held),
size as (select held, sum((label = 0)::int) as d0, sum((label = 1)::int) as d1 from lab, f where fold <> held group by held),
train as materialized (select held, term, sum(case when label = 0 then tf else 0 end) as n0, sum(case when label = 1 then tf else 0 end) as n1
  from tf, f where fold <> held group by held, term
  having count(*) <= 0.8 * (select any_value(d0 + d1) from size where size.held = f.held)),
tot as (select held, count(*) as v, sum(n0) as t0, sum(n1) as t1 from train group by held),
a as (select unnest({[max(x, 1e-10) for x in ALPHAS]}) as a, unnest({[f"alpha={x}" for x in ALPHAS]}) as params, unnest(range({len(ALPHAS)})) as i),
score as (select i, doc_id, sum(tf * (ln((n1 + a) / (t1 + a * v)) - ln((n0 + a) / (t0 + a * v)))) as s
  from tf join train on train.term = tf.term and train.held = tf.fold join tot on tot.held = tf.fold, a group by i, doc_id),
said as (select a.i, lab.fold, label, (coalesce(s, 0) + ln(d1 / (d0 + d1)) - ln(d0 / (d0 + d1)) > 0)::int as said
  from lab cross join a join size on size.held = lab.fold left join score on score.i = a.i and score.doc_id = lab.doc_id),
f1 as (select i, fold, coalesce(2 * sum(said * label) / nullif(sum(said + label), 0), 0) as f1 from said group by i, fold),
grid as (select i, round(avg(f1), 9) as mean, stddev_pop(f1) as std from f1 group by i)
select (row_number() over (order by mean desc, i))::integer as place, 'nb' as model, params, round(mean, 6) as mean, round(std, 6) as std from grid join a using (i)"""


def _nb_grid(spark, sf):
    found = M.nb_grid_search(labelled(spark, sf), ALPHAS)
    return found.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("grid_search", f"with {GRID}")
def grid_search(spark, sf):
    return _nb_grid(spark, sf)


GRID_DICT = GRID.replace(f"""tf as materialized (select doc_id, label, fold, term, count(*) as tf from (
  select doc_id, unnest({S.tokens('text', STOPS)}) as term from documents semi join lab using (doc_id)) join lab using (doc_id) group by all)""",
    f"tf as materialized (select doc_id, label, fold, feature as term, value as tf from ({words_sql()}) join lab using (doc_id))").replace(
    "train as materialized (", "every as materialized (").replace("tot as (select held", """chi as (select *, row_number() over (partition by held order by c desc, term) as r from (
  select every.*, round((n0 - (n0 + n1) * d0 / (d0 + d1)) ** 2 / ((n0 + n1) * d0 / (d0 + d1)) + (n1 - (n0 + n1) * d1 / (d0 + d1)) ** 2 / ((n0 + n1) * d1 / (d0 + d1)), 6) as c
  from every join size using (held))),
train as materialized (select held, term, n0, n1 from chi where r <= 500),
tot as (select held""")


@query("grid_search_dict", f"with {GRID_DICT}")
def grid_search_dict(spark, sf):
    """The grid over extracted features, the 500 of highest chi-square chosen anew in each fold."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = O.as_rows(docs, X.words(F.col("text"), stop_words=stop_words()))
    found = M.nb_grid_search(labels.join(docs.select("doc_id"), "doc_id", "left_semi"), ALPHAS, features=rows, k_best=500)
    return found.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("cv_report", f"select place, params, mean, std from (with {GRID})")
def cv_report(spark, sf):
    return _nb_grid(spark, sf).select("place", "params", "mean", "std")


@query("model_sweep")
def model_sweep(spark, sf):
    """Cross-validated accuracy of each family, and every held-out figure of the best, refitted."""
    report, held = M.model_sweep(labelled(spark, sf))
    judged = _figures(full_report(held.withColumn("place", F.lit(1)), ["place"], 1.0)).withColumnRenamed("n", "n_held")
    return report.join(judged, "place", "left")


@query("topic_threshold_sweep")
def topic_threshold_sweep(spark, sf):
    corpus = labelled(spark, sf).withColumn("label", F.col("label").cast("int").cast("string"))
    return M.topic_threshold_sweep(corpus, list(range(5, 20)), [10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0])
