"""Queries: files written from the tables, and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import round_exact
from ..functions.text import ascii_fold, whitespace_split
from ..functions.words import stop_words
from ..operators import curate as C
from ..operators import ranking as R
from ..session import fresh_path
from ..sources import readers as I
from ..sources import writers as W
from . import sqltext as S
from .model_queries import STOPS, UNSEEN
from .registry import query, table
from .result_queries import DIST, RANKED, clustered, scored, TOP, annotations

LINE = S.one_line("text")


def written(spark, df, name, columns, compression="gzip"):
    path = fresh_path(spark, name)
    W.write_tsv(df, path, columns, compression)
    return path


def labelled_docs(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")


@query("load_labelled", f"""select quality::varchar as label, {LINE} as text, count(*) as n
from documents join labels using (doc_id) group by all""")
def load_labelled(spark, sf):
    path = written(spark, labelled_docs(spark, sf), "labelled", ["quality", "text"])
    return I.load_labelled(spark, path).groupBy("label", "text").agg(F.count(F.lit(1)).alias("n"))


@query("load_positioned", f"select doc_id as pos, {LINE} as text from documents")
def load_positioned(spark, sf):
    return I.load_positioned(spark, written(spark, table(spark, sf, "documents"), "positioned", ["doc_id", "text"]))


@query("load_text", f"select {LINE} as text, count(*) as n from documents group by all")
def load_text(spark, sf):
    path = written(spark, table(spark, sf, "documents"), "texts", ["doc_id", "text"])
    return I.load_text(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("load_label_pos_text", f"""select quality::varchar as label, doc_id as pos, {LINE} as text
from documents join labels using (doc_id)""")
def load_label_pos_text(spark, sf):
    path = written(spark, labelled_docs(spark, sf), "clusters", ["quality", "doc_id", "text"], "none")
    return I.load_label_pos_text(spark, path)


@query("load_raw_posts", f"""select source as origin, lower(lang) || ' ' || lower(source) as topics, {LINE} as text, count(*) as n
from documents group by all""")
def load_raw_posts(spark, sf):
    path = fresh_path(spark, "posts")
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", F.concat_ws(",", "lang", "source").alias("topics"), W.one_line(F.col("text")).alias("text"))
    docs.write.csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")
    rows = I.load_raw_posts(spark, path, origin_index=1, text_index=3, topic_index=2)
    return (rows.groupBy("origin", F.array_join("topics", " ").alias("topics"), "text")
            .agg(F.count(F.lit(1)).alias("n")))


def talk_words(spark, sf):
    return table(spark, sf, "conversations").select("role", F.explode(whitespace_split(F.col("text"))).alias("word"))


TALK = f"talk as (select role, unnest({S.split_ws('text')}) as word from conversations)"


@query("load_emotion_lexicon", f"""with {TALK} select category, word from (
select distinct role as category, word from talk)""")
def load_emotion_lexicon(spark, sf):
    return I.load_emotion_lexicon(spark, written(spark, talk_words(spark, sf), "emotions", ["role", "word"], "none"))


@query("load_polarity_lexicon", f"""with {TALK} select distinct
case when length(word) % 2 = 0 then 'negative' else 'positive' end as polarity,
case when length(word) > 8 or contains(word, '*') then 'partial' else 'exact' end as kind,
replace(lower(word), '*', '') as word from talk""")
def load_polarity_lexicon(spark, sf):
    lines = talk_words(spark, sf).select(
        F.when(F.length("word") > 8, F.concat("word", F.lit("*"))).otherwise(F.col("word")).alias("w"),
        (F.length("word") % 2).alias("flag"))
    return I.load_polarity_lexicon(spark, written(spark, lines, "polarity", ["w", "flag"], "none"))


RUNS = r"[!*%$#]{2,}"


@query("load_emoticons", f"""select distinct emoticon from (
select unnest(regexp_extract_all(html, {S.lit(RUNS)})) as emoticon from pages)""")
def load_emoticons(spark, sf):
    runs = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(RUNS), 0)).alias("e"))
    padded = runs.select(F.concat(F.lit(" "), "e", F.lit("  ")).alias("e"))
    return I.load_emoticons(spark, written(spark, padded, "emoticons", ["e"], "none"))


@query("load_stopwords", f"""with {TALK} select word, count(*) as n from talk
where word in {S.in_list(stop_words(True))} group by word""")
def load_stopwords(spark, sf):
    """The default list as a file, and how often its words occur."""
    listed = spark.createDataFrame([(w,) for w in stop_words(extra=True)], "word string")
    stops = I.load_words(spark, written(spark, listed, "stops", ["word"], "none"))
    return (talk_words(spark, sf).join(F.broadcast(stops), "word", "left_semi")  # a fixed list of 212 words
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


@query("load_annotations", "select (doc_id % 5 + 1)::integer as score, doc_id as pos from labels")
def load_annotations(spark, sf):
    return I.load_annotations(spark, written(spark, annotations(spark, sf), "annotations", ["score", "pos"], "none"))


SHOWN = "array_to_string([printf('%.4f', p0), printf('%.4f', p1), printf('%.4f', p2), printf('%.4f', p3)], ' ')"


def shown(df):
    return df.withColumn("dist", F.array_join(F.transform("dist", lambda p: F.format_string("%.4f", round_exact(p, 4))), " "))


@query("load_ranked", f"with {DIST} select entropy, {SHOWN} as prob, pos, {LINE} as text from scored")
def load_ranked(spark, sf):
    return I.load_ranked(spark, written(spark, shown(scored(spark, sf)), "ranked", ["entropy", "dist", "pos", "text"]))


@query("load_gazetteer", f"""select type, alias, count(*) as n from (
select source as type, unnest(list_filter(string_split_regex({LINE}, ',\\s*'), lambda a: a <> '')) as alias from documents)
group by all""")
def load_gazetteer(spark, sf):
    path = written(spark, table(spark, sf, "documents"), "gazetteer", ["source", "text"], "none")
    return I.load_gazetteer(spark, path).groupBy("type", "alias").agg(F.count(F.lit(1)).alias("n"))


# --- writers: each result is read back ------------------------------------------------------


@query("write_curated", f"""select source as origin, '["' || lower(lang) || '","' || lower(source) || '"]' as topics,
{S.one_line(S.fold('text'))} as text, count(*) as n from documents where lower(lang) = 'en' group by all""")
def write_curated(spark, sf):
    path = fresh_path(spark, "curated")
    posts = table(spark, sf, "documents").select(
        F.col("source").alias("origin"), C.split_topics(F.concat_ws(",", "lang", "source")).alias("topics"), "text")
    W.write_curated(C.curate(posts, ["en"]), path)
    rows = I.read_tsv(spark, path, {"origin": 0, "topics": 1, "text": 2})
    return rows.groupBy("origin", "topics", "text").agg(F.count(F.lit(1)).alias("n"))


@query("write_dedup", f"""select row_number() over (order by doc_id) - 1 as pos, {LINE} as text
from (select text, min(doc_id) as doc_id from documents group by text)""")
def write_dedup(spark, sf):
    path = fresh_path(spark, "dedup")
    W.write_dedup(C.assign_position(C.dedupe_first(table(spark, sf, "documents"))), path)
    return I.load_positioned(spark, path)


@query("write_predictions", f"""with {UNSEEN}, said_label as (select item_id, arg_max(label, s) as label from s group by item_id)
select label::integer::varchar as label, {LINE} as text, count(*) as n from benchmark join said_label using (item_id) group by all""")
def write_predictions(spark, sf):
    """Labels that a classifier learnt from the documents gives the unseen passages."""
    from ..operators.stages import text_classifier

    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("quality").cast("double").alias("label"), "text")
    said = text_classifier("nb", stops=STOPS).fit(docs).transform(table(spark, sf, "benchmark"))
    path = fresh_path(spark, "predictions")
    W.write_predictions(said.select(F.col("prediction").cast("int").cast("string").alias("label"), "text"), path)
    return I.load_labelled(spark, path).groupBy("label", "text").agg(F.count(F.lit(1)).alias("n"))


@query("write_ranked", f"with {RANKED} select rank, entropy, {SHOWN} as prob, pos, {LINE} as text from ranked")
def write_ranked(spark, sf):
    """Written in rank order; the line number read back is the rank."""
    path = fresh_path(spark, "ranked")
    W.write_ranked(shown(scored(spark, sf)), path)
    rows = I.read_tsv(spark, path, {"entropy": 0, "prob": 1, "pos": 2, "text": 3}, numbered=True)
    return rows.select((F.col("doc_id") + 1).alias("rank"), F.col("entropy").cast("double").alias("entropy"), "prob",
                       F.col("pos").cast("long").alias("pos"), "text")


@query("write_labelled", f"""with {DIST} select case when entropy >= 0.9 then '1' else '0' end as label, entropy,
{SHOWN} as dist, {LINE} as text, count(*) as n from scored group by all""")
def write_labelled(spark, sf):
    from ..operators.objectivity import objective_label

    path = fresh_path(spark, "labelled")
    W.write_labelled(objective_label(shown(scored(spark, sf)), 0.9), path)
    rows = I.read_tsv(spark, path, {"label": 0, "entropy": 1, "dist": 2, "text": 3})
    return (rows.withColumn("entropy", F.col("entropy").cast("double"))
            .groupBy("label", "entropy", "dist", "text").agg(F.count(F.lit(1)).alias("n")))


@query("write_topics", f"with {TOP} select cluster as topic, string_agg(word, ',' order by rank) as words from top group by cluster")
def write_topics(spark, sf):
    from ..operators.clusters import top_words
    from ..operators.models import clean_topic_words

    path = fresh_path(spark, "topics")
    W.write_topics(clean_topic_words(top_words(clustered(spark, sf), 30).withColumnRenamed("cluster", "topic")), path)
    return I.read_tsv(spark, path, {"topic": 0, "words": 1})


@query("write_topwords", f"""with {TOP} select '["' || string_agg(word, '","' order by rank) || '"]' as words from top group by cluster""")
def write_topwords(spark, sf):
    from ..operators.clusters import top_words

    path = fresh_path(spark, "topwords")
    W.write_topwords(top_words(clustered(spark, sf), 30), path)
    return I.read_tsv(spark, path, {"words": 0})


@query("write_clusters", f"select source as cluster, lang as topic, {S.one_line(S.fold('text'))} as text, count(*) as n from documents group by all")
def write_clusters(spark, sf):
    path = fresh_path(spark, "clusters")
    docs = table(spark, sf, "documents").select(F.col("source").alias("cluster"), "doc_id", F.col("lang").alias("topic"),
                                                ascii_fold(F.col("text")).alias("text"))
    W.write_clusters(docs, path)
    rows = I.read_tsv(spark, path, {"cluster": 0, "topic": 1, "text": 2})
    return rows.groupBy("cluster", "topic", "text").agg(F.count(F.lit(1)).alias("n"))


@query("write_analysis", f"""with {RANKED} select pos::varchar as pos, score::varchar as score, entropy, {SHOWN} as dist
from quint semi join (select doc_id as pos from labels) using (pos)""")
def write_analysis(spark, sf):
    from ..operators.agreement import analysis_report

    path = fresh_path(spark, "analysis")
    ranked = R.rank_by_entropy(shown(scored(spark, sf)).select("pos", "entropy", "dist"))
    W.write_analysis(analysis_report(ranked, annotations(spark, sf)), path)
    rows = I.read_tsv(spark, path, {"pos": 0, "score": 1, "entropy": 2, "dist": 3})
    return rows.withColumn("entropy", F.col("entropy").cast("double"))
