"""Queries: entropy, ranks, agreement, clusters and metrics.

The distribution scored here is each document's share of words by first letter, in four
groups: like topic shares it adds up to one, but SQL can recompute it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as E
from ..functions.arrays import round_exact
from ..functions.text import preprocess_tokens, vector_tokens
from ..functions.words import stop_words
from ..operators import agreement as A
from ..operators import clusters as K
from ..operators import evaluate as M
from ..operators import objectivity as J
from ..operators import ranking as R
from ..session import reuse
from . import sqltext as S
from .registry import query, table

STOPS = stop_words(extra=True)
GROUPS = [("a", "f"), ("g", "l"), ("m", "r"), ("s", "z")]

_shares = ", ".join(f"len(list_filter(w, lambda x: x[1] >= '{a}' and x[1] <= '{b}'))::double / len(w) as p{i}"
                    for i, (a, b) in enumerate(GROUPS))
_bits = " + ".join(f"case when p{i} > 0 then p{i} * log2(p{i}) else 0.0 end" for i in range(4))
DIST = f"""dist as (select doc_id as pos, text, n_chars, {_shares} from (
    select doc_id, text, n_chars, regexp_extract_all(lower(text), '[a-z]+') as w from documents) where len(w) > 0),
scored as (select *, round(-({_bits}) / 2, 9) as entropy, round(-({_bits}) / 4, 9) as entropy_k from dist)"""
RANKED = f"""{DIST}, ranked as (select *, row_number() over (order by entropy, pos) as rank from scored),
n as (select count(*) as n from ranked),
quint as (select ranked.*, least(floor((rank - 1) / greatest(round_even(n / 5, 0), 1)) + 1, 5)::bigint as score
          from ranked, n)"""


def scored(spark, sf):
    """<pos, text, n_chars, dist, entropy> for every document with a word."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text", "n_chars", words.alias("w"))

    def share(a, b):
        return (F.size(F.filter("w", lambda x: F.substring(x, 1, 1).between(a, b))) / F.size("w")).cast("double")

    dist = F.array(*[share(a, b) for a, b in GROUPS])
    rows = docs.where(F.size("w") > 0).select("pos", "text", "n_chars", dist.alias("dist"))
    return rows.withColumn("entropy", F.round(E.entropy_normalized(F.col("dist"), 4), 9))


def entropies(spark, sf):
    return reuse(scored(spark, sf).select("pos", "entropy"))


@query("entropy_by_k", f"with {DIST} select pos, entropy_k as entropy from scored")
def entropy_by_k(spark, sf):
    return scored(spark, sf).select("pos", F.round(E.entropy_by_k(F.col("dist"), 4), 9).alias("entropy"))


@query("entropy_normalized", f"with {DIST} select pos, entropy from scored")
def entropy_normalized(spark, sf):
    return scored(spark, sf).select("pos", "entropy")


def _six(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("entropy_stats", f"""with {DIST} select round(avg(entropy), 6) as mean, round(median(entropy), 6) as med,
round(stddev_pop(entropy), 6) as std, round(var_pop(entropy), 6) as var, round(max(entropy), 6) as max,
round(min(entropy), 6) as min from scored""")
def entropy_stats(spark, sf):
    return _six(J.entropy_stats(entropies(spark, sf)))


PERCENTS = [20, 30, 40, 50, 60, 70, 80, 90]


@query("percentile_threshold", f"with {DIST} " + " union all ".join(
    f"select {p}::bigint as percent, round(quantile_cont(entropy, {p / 100}), 6) as threshold from scored" for p in PERCENTS))
def percentile_threshold(spark, sf):
    cuts = R.exact_percentiles(entropies(spark, sf), "entropy", [float(p) for p in PERCENTS])
    return spark.createDataFrame([(p, float(c)) for p, c in zip(PERCENTS, cuts)], "percent long, threshold double") \
        .withColumn("threshold", F.round("threshold", 6))


@query("objective_label", f"""with {DIST}, t as (select quantile_cont(entropy, 0.6) as t from scored)
select pos, case when entropy >= t then '1' else '0' end as label from scored, t""")
def objective_label(spark, sf):
    rows = entropies(spark, sf)
    cut = R.exact_percentiles(rows, "entropy", [60.0])[0]
    return J.objective_label(rows, cut).select("pos", "label")


@query("objective_share", f"""with {DIST}, t as (select median(entropy) as t from scored)
select count(*) as n_rows, count_if(entropy >= t)::bigint as n_objective,
printf('%.2f', count_if(entropy >= t) / count(*))::double as share from scored, t""")
def objective_share(spark, sf):
    rows = entropies(spark, sf)
    cut = R.exact_percentiles(rows, "entropy", [50.0])[0]
    return J.label_share(J.objective_label(rows, cut))


@query("rank_by_entropy", f"with {RANKED} select pos, entropy, rank from ranked")
def rank_by_entropy(spark, sf):
    return R.rank_by_entropy(scored(spark, sf).select("pos", "entropy"))


@query("drop_adjacent_duplicates", f"""with {RANKED} select pos, rank from (
  select pos, rank, text, lag(text) over (order by rank) as before from ranked) where before is distinct from text""")
def drop_adjacent_duplicates(spark, sf):
    digest = F.unhex(F.sha2("text", 256)).alias("digest")  # stands for the text in the range shuffle
    ranked = R.rank_by_entropy(scored(spark, sf).select("pos", "entropy", digest))
    return R.drop_adjacent_duplicates(ranked, "digest").select("pos", "rank")


@query("quintile_score", f"with {RANKED} select pos, rank, score from quint")
def quintile_score(spark, sf):
    return R.quintile_score(R.rank_by_entropy(scored(spark, sf).select("pos", "entropy"))).select("pos", "rank", "score")


@query("ranked_details", f"""with {RANKED} select pos, rank, entropy,
array_to_string([printf('%.4f', p0), printf('%.4f', p1), printf('%.4f', p2), printf('%.4f', p3)], ' ') as dist from ranked""")
def ranked_details(spark, sf):
    ranked = R.rank_by_entropy(scored(spark, sf).select("pos", "entropy", "dist"))
    shown = F.array_join(F.transform("dist", lambda p: F.format_string("%.4f", round_exact(p, 4))), " ")
    return ranked.select("pos", "rank", "entropy", shown.alias("dist"))


def _by_length(spark, sf):
    """The same documents scored by length instead."""
    return scored(spark, sf).select("pos", F.col("n_chars").cast("double").alias("entropy"))


@query("spearman_unique", f"""with {RANKED}, b as (select pos, row_number() over (order by n_chars, pos) as rb from scored)
select round(1 - 6 * sum((rank - rb)::double * (rank - rb)) / (count(*)::double * (count(*)::double * count(*) - 1)), 6) as rho,
count(*) as n from ranked join b using (pos)""")
def spearman_unique(spark, sf):
    a = R.rank_by_entropy(scored(spark, sf).select("pos", "entropy"))
    return _six(A.spearman_unique(a, R.rank_by_entropy(_by_length(spark, sf))))


@query("rank_corr_ranged", """select
round(covar_samp(n_chars, length(source)) / (stddev_pop(n_chars) * stddev_pop(length(source))), 6) as rho,
count(*) as n from documents""")
def rank_corr_ranged(spark, sf):
    pairs = table(spark, sf, "documents").select(F.col("n_chars").cast("double").alias("x"),
                                                 F.length("source").cast("double").alias("y"))
    return _six(A.rank_corr_ranged(pairs))


@query("compare_rankings", f"""with {RANKED}, b as (
  select doc_id as pos, row_number() over (order by len(w), doc_id) as rb from (
    select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w from documents) where len(w) > 0)
select round(1 - 6 * sum((rank - rb)::double * (rank - rb)) / (count(*)::double * (count(*)::double * count(*) - 1)), 6) as rho,
count(*) as n from ranked join b using (pos)""")
def compare_rankings(spark, sf):
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))
    other = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), words.cast("double").alias("entropy"))
    return _six(A.compare_rankings(scored(spark, sf), other.where(F.col("entropy") > 0)))


def annotations(spark, sf):
    """Stand-in annotations: a score of 1–5 on every labelled document."""
    return table(spark, sf, "labels").select((F.col("doc_id") % 5 + 1).cast("int").alias("score"),
                                             F.col("doc_id").alias("pos"))


MARKS = "marks as (select doc_id as pos, doc_id % 5 + 1 as human from labels)"


@query("compare_annotations", f"""with {RANKED}, {MARKS}
select round(covar_samp(score, human) / (stddev_pop(score) * stddev_pop(human)), 6) as rho, count(*) as n
from quint join marks using (pos)""")
def compare_annotations(spark, sf):
    ranked = R.rank_by_entropy(scored(spark, sf).select("pos", "entropy"))
    return _six(A.compare_annotations(ranked, annotations(spark, sf)))


@query("analysis_report", f"""with {RANKED}, {MARKS} select pos, score, entropy,
array_to_string([printf('%.4f', p0), printf('%.4f', p1), printf('%.4f', p2), printf('%.4f', p3)], ' ') as dist
from quint semi join marks using (pos)""")
def analysis_report(spark, sf):
    ranked = R.rank_by_entropy(scored(spark, sf).select("pos", "entropy", "dist"))
    shown = F.array_join(F.transform("dist", lambda p: F.format_string("%.4f", round_exact(p, 4))), " ")
    return A.analysis_report(ranked, annotations(spark, sf)).withColumn("dist", shown)


@query("entropy_summary", f"""with {DIST} select round(median(entropy), 6) as median, round(avg(entropy), 6) as mean,
round(stddev_samp(entropy), 6) as std from scored""")
def entropy_summary(spark, sf):
    return _six(J.entropy_summary(entropies(spark, sf)))


@query("entropy_histogram", f"""with {DIST}, r as (select min(entropy) as low, (max(entropy) - min(entropy)) / 10 as w from scored),
h as (select least(floor((entropy - low) / w), 9)::bigint as bin, count(*) as n from scored, r group by 1)
select i as bin, round(low + i * w, 6) as low, round(low + (i + 1) * w, 6) as high, coalesce(n, 0) as n
from range(10) t(i) cross join r left join h on h.bin = i""")
def entropy_histogram(spark, sf):
    return _six(J.entropy_histogram(entropies(spark, sf)))


@query("entropy_boxplot", f"""with {DIST}, q as (select quantile_cont(entropy, 0.25) as q1, median(entropy) as q2,
  quantile_cont(entropy, 0.75) as q3 from scored),
b as (select *, q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from q)
select round(any_value(q1), 6) as q1, round(any_value(q2), 6) as median, round(any_value(q3), 6) as q3,
round(min(entropy) filter (entropy >= low), 6) as whisker_low, round(max(entropy) filter (entropy <= high), 6) as whisker_high,
count_if(entropy < low or entropy > high)::bigint as n_outliers from scored, b""")
def entropy_boxplot(spark, sf):
    return _six(J.entropy_boxplot(entropies(spark, sf)))


# --- clusters -----------------------------------------------------------------------------


def clustered(spark, sf):
    """Documents with their source as cluster and their words as tokens."""
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("cluster"),
                                                vector_tokens(F.col("text")).alias("tokens"))


TOP = f"""top as (select * from (
  select cluster, word, count(*) as n, row_number() over (partition by cluster order by count(*) desc, word)::integer as rank
  from (select source as cluster, unnest({S.vector_tokens('text')}) as word from documents) group by cluster, word)
  where rank <= 30)"""


@query("cluster_groups", """select source as cluster, count(*) as n, min(doc_id) as first, max(doc_id) as last
from documents group by source""")
def cluster_groups(spark, sf):
    return K.cluster_groups(table(spark, sf, "documents").withColumnRenamed("source", "cluster"))


@query("top_words", f"with {TOP} select cluster, word, n, rank from top")
def top_words(spark, sf):
    return K.top_words(clustered(spark, sf), 30)


@query("distinctive_top_words", f"""with {TOP} select cluster, word, n, rank from top where word not in (
  select word from top group by word having count(*) = (select count(distinct cluster) from top))""")
def distinctive_top_words(spark, sf):
    return K.distinctive_top_words(clustered(spark, sf), 30)


# --- metrics ------------------------------------------------------------------------------

PAIRS = "pairs as (select quality as label, case when n_chars > 600 then 1 else 0 end as prediction from labels join documents using (doc_id))"
MULTI = """multi as (select role as label, case when length(text) > 400 then 'assistant' when turn = 0 then 'system' else 'user' end
as prediction from conversations)"""
PER_CLASS = """per as (select c as label, count_if(label = c) as support, count_if(prediction = c) as predicted,
  count_if(label = c and prediction = c) as tp from multi,
  (select distinct label as c from multi union select prediction from multi) group by c),
f as (select *, coalesce(2 * tp / nullif(support + predicted, 0), 0) as f1 from per)"""


def binary_pairs(spark, sf):
    """Quality labels against a guess from the text length."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("quality").alias("label"), (F.col("n_chars") > 600).cast("int").alias("prediction"))


def multi_pairs(spark, sf):
    """Speaker roles against a guess from length and turn."""
    guess = F.when(F.length("text") > 400, "assistant").when(F.col("turn") == 0, "system").otherwise("user")
    return table(spark, sf, "conversations").select(F.col("role").alias("label"), guess.alias("prediction"))


@query("confusion_matrix", f"""with {MULTI}, c as (select distinct label as c from multi union select prediction from multi)
select a.c as label, b.c as prediction, count(multi.label) as n from c a cross join c b
left join multi on multi.label = a.c and multi.prediction = b.c group by all""")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(multi_pairs(spark, sf))


@query("accuracy", f"with {MULTI} select round(avg((label = prediction)::integer), 6) as accuracy from multi")
def accuracy(spark, sf):
    return _six(M.accuracy(multi_pairs(spark, sf)))


@query("precision_recall", f"""with {PAIRS} select
round(count_if(label = 1 and prediction = 1) / count_if(prediction = 1), 6) as precision,
round(count_if(label = 1 and prediction = 1) / count_if(label = 1), 6) as recall from pairs""")
def precision_recall(spark, sf):
    return _six(M.precision_recall(binary_pairs(spark, sf), 1))


@query("f1_binary", f"""with {PAIRS} select round(2 * count_if(label = 1 and prediction = 1)
/ (count_if(prediction = 1) + count_if(label = 1)), 6) as f1 from pairs""")
def f1_binary(spark, sf):
    return _six(M.f1_binary(binary_pairs(spark, sf), 1))


@query("f1_micro", f"with {MULTI} select round(avg((label = prediction)::integer), 6) as f1 from multi")
def f1_micro(spark, sf):
    return _six(M.f1_micro(multi_pairs(spark, sf)))


@query("f1_macro", f"with {MULTI}, {PER_CLASS} select round(avg(f1), 6) as f1 from f")
def f1_macro(spark, sf):
    return _six(M.f1_macro(multi_pairs(spark, sf)))


@query("f1_weighted", f"with {MULTI}, {PER_CLASS} select round(sum(f1 * support) / sum(support), 6) as f1 from f")
def f1_weighted(spark, sf):
    return _six(M.f1_weighted(multi_pairs(spark, sf)))


GUESSES = f"""with {MULTI}, g as (select 'by length and turn' as model, label, prediction from multi
  union all select 'by turn', role, case when turn % 2 = 1 then 'user' else 'assistant' end from conversations),
side as (select model, label as c, 1 as s, 0 as p, (label = prediction)::int as tp from g union all select model, prediction, 0, 1, 0 from g),
per as (select model, c, sum(s) as support, sum(p) as predicted, sum(tp) as tp from side group by model, c),
f as (select *, coalesce(2 * tp / nullif(support + predicted, 0), 0) as f1 from per)"""


def guesses(spark, sf):
    """Two ways to guess a speaker's role, as two models."""
    by_turn = table(spark, sf, "conversations").select(F.lit("by turn").alias("model"), F.col("role").alias("label"),
                                                      F.when(F.col("turn") % 2 == 1, "user").otherwise("assistant").alias("prediction"))
    return multi_pairs(spark, sf).select(F.lit("by length and turn").alias("model"), "label", "prediction").unionByName(by_turn)


@query("full_report", GUESSES + """ select model, sum(support)::bigint as n, round(sum(tp) / sum(support), 6) as accuracy,
round(coalesce(sum(tp) filter (c = 'user') / nullif(sum(predicted) filter (c = 'user'), 0), 0), 6) as precision,
round(coalesce(sum(tp) filter (c = 'user') / nullif(sum(support) filter (c = 'user'), 0), 0), 6) as recall,
round(coalesce(sum(f1) filter (c = 'user'), 0), 6) as f1, round(2 * sum(tp) / sum(support + predicted), 6) as f1_micro,
round(avg(f1), 6) as f1_macro, round(sum(f1 * support) / sum(support), 6) as f1_weighted,
(select string_agg(label || '>' || prediction || ':' || n, ' ' order by label, prediction) from (
  select label, prediction, count(*) as n from g where g.model = f.model group by all)) as matrix from f group by model""")
def full_report(spark, sf):
    """All figures and the matrix of several models in one aggregate."""
    found = M.full_report(guesses(spark, sf), ["model"], "user")
    cells = F.transform("matrix", lambda x: F.concat(x["label"], F.lit(">"), x["prediction"], F.lit(":"), x["n"].cast("string")))
    return _six(found.withColumn("matrix", F.array_join(cells, " ")))


# --- flagship -----------------------------------------------------------------------------


def flagship(spark, sf):
    """Preprocessed documents → words that mark each source."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("cluster"),
                                                preprocess_tokens(F.col("text"), STOPS).alias("tokens"))
    return K.distinctive_top_words(docs, 30)


query("marking_words", f"""with top as (select * from (
  select cluster, word, count(*) as n, row_number() over (partition by cluster order by count(*) desc, word)::integer as rank
  from (select source as cluster, unnest({S.tokens('text')}) as word from documents)
  where word not in {S.in_list(STOPS)} group by cluster, word)
  where rank <= 30)
select cluster, word, n, rank from top where word not in (
  select word from top group by word having count(*) = (select count(distinct cluster) from top))""")(flagship)
