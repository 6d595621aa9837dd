"""Queries: whole chains, from documents over a model to a written and reread ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import entropy_by_k, entropy_normalized
from ..functions import features as X
from ..functions.words import stop_words
from ..operators import agreement as A
from ..operators import feature_model as FM
from ..operators import features as O
from ..operators import models as M
from ..operators import ranking as R
from ..session import cut_lineage, fresh_path, on_disk
from ..sources import readers as I
from ..sources import writers as W
from .feature_queries import words_sql
from .model_queries import clusters, labelled, prepared
from .registry import query, table

TOPICS = 4


def _by_topics(spark, sf):
    """<pos, entropy, dist>: each document's topic shares of at least 1 %, and their entropy by the number of topics."""
    corpus = prepared(spark, sf)
    shares = F.transform("topics", lambda t: t["prob"])
    found = M.doc_topics(*M.lda_fit(corpus, TOPICS), corpus)
    return cut_lineage(found.select(F.col("doc_id").alias("pos"), entropy_by_k(shares, TOPICS).alias("entropy"), shares.alias("dist")))


def _by_clusters(spark, sf):
    """<pos, entropy, dist>: how sure a classifier of k-means clusters is of each document."""
    rows = M.cluster_classifier(clusters(spark, sf))
    return cut_lineage(rows.select(F.col("doc_id").alias("pos"), entropy_normalized(F.col("dist"), F.size("dist")).alias("entropy"), "dist"))


def _ranked_file(spark, sf, scored):
    """Write the ranking with its texts and read it back."""
    path = fresh_path(spark, "ranked")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text")
    W.write_ranked(R.rank_by_entropy(scored).join(texts, "pos"), path)
    return R.rank_by_entropy(I.load_ranked(spark, path)).select("rank", "entropy", "pos", "text")


@query("ranked_by_topics")
def ranked_by_topics(spark, sf):
    return _ranked_file(spark, sf, _by_topics(spark, sf))


@query("ranked_by_clusters")
def ranked_by_clusters(spark, sf):
    return _ranked_file(spark, sf, _by_clusters(spark, sf))


@query("topics_against_clusters")
def topics_against_clusters(spark, sf):
    """Rank correlation of the two ways to find objective texts."""
    return A.compare_rankings(_by_topics(spark, sf).select("pos", "entropy"), _by_clusters(spark, sf).select("pos", "entropy"))


@query("ranked_by_class_shares")
def ranked_by_class_shares(spark, sf):
    """Classifier probabilities to entropies, ranked, texts equal to the one before left out."""
    corpus = labelled(spark, sf)
    proba = M.predict_proba(M.classifier_pipeline("nb").fit(corpus), corpus)
    texts = table(spark, sf, "documents").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    scored = proba.select("doc_id", entropy_by_k(F.col("dist"), F.size("dist")).alias("entropy")).join(texts, "doc_id")
    ranked = R.rank_by_entropy(cut_lineage(scored.withColumnRenamed("doc_id", "pos")))
    return R.drop_adjacent_duplicates(ranked, "digest").select("rank", "entropy", "pos")


def _word_features(spark, sf):
    """The documents and their features, extracted once, as training and predicting read them several times."""
    docs = table(spark, sf, "documents")
    pairs = docs.select("doc_id", X.words(F.col("text"), stop_words=stop_words()).alias("pairs"))
    return docs, O.as_rows(on_disk(pairs, "features"), F.col("pairs"))


FEATURES = f"""known as (select doc_id, quality as label from labels semi join documents using (doc_id)),
train as (select * from known where ('0x' || substr(md5('0:' || doc_id), 1, 8))::bigint % 100 >= 25),
f as materialized (select doc_id, feature, value from ({words_sql()})),
own as materialized (select f.*, label from f join train using (doc_id))"""

PREDICTED = """n as (select label, count(*) as n_c from train group by label),
cell as (select feature, sum(case when label = 0 then value else 0 end) as n0, sum(case when label = 1 then value else 0 end) as n1
  from own semi join chosen using (feature) group by feature),
tot as (select sum(n0) as t0, sum(n1) as t1, count(*) as v from cell),
s as (select doc_id, sum(value * (ln((n1 + 1) / (t1 + v)) - ln((n0 + 1) / (t0 + v)))) as s from f join cell using (feature), tot group by doc_id),
prior as (select ln(sum(case when label = 1 then n_c else 0 end) + 1) - ln(sum(case when label = 0 then n_c else 0 end) + 1) as p from n)
select d.doc_id, (coalesce(s, 0) + p > 0)::int::double as prediction from documents d left join s using (doc_id), prior"""


def _trained(spark, sf, **options):
    docs, rows = _word_features(spark, sf)
    known = table(spark, sf, "labels").join(docs.select("doc_id"), "doc_id", "left_semi")
    split = M.holdout_split(known.select("doc_id", F.col("quality").cast("double").alias("label")), 25)
    model = FM.train(split.where(~F.col("is_test")).drop("is_test"), rows, "nb", **options)
    path = fresh_path(spark, "feature-model")
    model.save(path)
    return FM.load(spark, path).predict(docs, rows).select("doc_id", "prediction")


@query("train_dict_features", f"with {FEATURES}, chosen as (select distinct feature from own), {PREDICTED}")
def train_dict_features(spark, sf):
    """Extracted features to a saved classifier, applied to every document, seen in training or not."""
    return _trained(spark, sf)


@query("select_k_best_pipeline", f"""with {FEATURES}, share as (select avg(label) as one, 1 - avg(label) as zero from train),
o as (select feature, sum(case when label = 1 then value else 0 end) as o1, sum(case when label = 0 then value else 0 end) as o0 from own group by feature),
chi as (select feature, (o1 - (o1 + o0) * one) ** 2 / ((o1 + o0) * one) + (o0 - (o1 + o0) * zero) ** 2 / ((o1 + o0) * zero) as c from o, share),
chosen as (select feature from chi order by round(c, 6) desc, feature limit 200), {PREDICTED}""")
def select_k_best_pipeline(spark, sf):
    """As above, on the 200 features that tell the training labels apart best."""
    return _trained(spark, sf, k_best=200)


@query("train_hashed_features")
def train_hashed_features(spark, sf):
    """Extracted features to a classifier over hashed columns, without a dictionary, applied to every document."""
    docs, rows = _word_features(spark, sf)
    known = table(spark, sf, "labels").join(docs.select("doc_id"), "doc_id", "left_semi")
    split = M.holdout_split(known.select("doc_id", F.col("quality").cast("double").alias("label")), 25)
    model = FM.train_hashed(split.where(~F.col("is_test")).drop("is_test"), rows, "lr")
    return model.predict(docs, rows)
