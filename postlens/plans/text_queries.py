"""Queries: curation and text normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import stop_words
from ..operators import curate as C
from ..operators.lemmas import lemma_table, lemmatize
from ..session import reuse
from . import sqltext as S
from ..functions import patterns as P
from .registry import query, table

TOPICS = ["en", "src3", "fr"]


def posts(spark, sf):
    """Documents as curated posts: source, topic list, text, and the file order."""
    d = table(spark, sf, "documents")
    topics = C.split_topics(F.concat_ws(",", "lang", "source"))
    return d.select("doc_id", F.col("source").alias("origin"), topics.alias("topics"), "text")


@query("topic_filter", f"""
select doc_id, source as origin, array_to_string([lower(lang), lower(source)], ',') as topics
from documents where lower(lang) in {S.in_list(TOPICS)} or lower(source) in {S.in_list(TOPICS)}""")
def topic_filter(spark, sf):
    kept = C.topic_filter(posts(spark, sf), TOPICS)
    return kept.select("doc_id", "origin", F.array_join("topics", ",").alias("topics"))


@query("ascii_fold", f"select doc_id, {S.fold('text')} as text from documents")
def ascii_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.ascii_fold(F.col("text")).alias("text"))


DEDUPED = "select text, min(doc_id) as doc_id, arg_min(source, doc_id) as source from documents group by text"


@query("dedupe_first", f"select doc_id, source, text from ({DEDUPED})")
def dedupe_first(spark, sf):
    return C.dedupe_first(table(spark, sf, "documents"), carry=["source", "text"])


@query("assign_position", f"""
select row_number() over (order by doc_id) - 1 as pos, doc_id, source from ({DEDUPED})""")
def assign_position(spark, sf):
    return C.assign_position(C.dedupe_first(table(spark, sf, "documents"), carry=["source"]))


@query("source_counts", f"""
select a.source, a.n_rows, coalesce(b.n_distinct, 0) as n_distinct
from (select source, count(*) as n_rows from documents group by source) a
left join (select source, count(*) as n_distinct from ({DEDUPED}) group by source) b using (source)""")
def source_counts(spark, sf):
    return C.source_counts(table(spark, sf, "documents"))


@query("binary_label_cast", "select doc_id, cast(quality as bigint) as label from labels")
def binary_label_cast(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return C.binary_label_cast(rows)


@query("consolidate_sources", f"""
select source as origin, lower(lang) as topics, {S.fold('text')} as text from documents
where lower(lang) in ('en', 'user', 'assistant')
union all
select 'conversations', lower(role), {S.fold('text')} from conversations
where lower(role) in ('en', 'user', 'assistant')""")
def consolidate_sources(spark, sf):
    wanted = ["en", "user", "assistant"]
    first = table(spark, sf, "documents").select(
        F.col("source").alias("origin"), C.split_topics(F.col("lang")).alias("topics"), "text")
    second = table(spark, sf, "conversations").select(
        F.lit("conversations").alias("origin"), C.split_topics(F.col("role")).alias("topics"), "text")
    both = C.consolidate([C.curate(first, wanted), C.curate(second, wanted)])
    return both.withColumn("topics", F.array_join("topics", ","))


ALL_TEXTS = """(select 'd' as kind, doc_id as id, text from documents
union all select 'p', page_id, html from pages)"""


def all_texts(spark, sf):
    """Documents and raw pages: the pages hold the URLs, mentions and digits."""
    docs = table(spark, sf, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf, "pages").select(F.lit("p").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages)


def _step(name, column, sql):
    """One clean-up step alone, on lower-cased text."""

    def run(spark, sf):
        return all_texts(spark, sf).select("kind", "id", column(F.lower("text")).alias("text"))

    query(name, f"select kind, id, {sql('lower(text)')} as text from {ALL_TEXTS}")(run)


_step("pp_lower", lambda c: c, lambda e: e)
_step("pp_newline_slash", T.newline_slash, S.newline_slash)
_step("pp_wrote", T.drop_wrote, lambda e: S.rx(e, P.WROTE, " "))
_step("pp_gagt", T.drop_gagt, lambda e: S.rx(e, P.GAGT, " "))
_step("pp_phone_model", T.drop_phone_models, lambda e: S.rx(e, P.PHONE_MODEL, " "))
_step("pp_mentions", T.drop_mentions, lambda e: S.rx(e, P.MENTION, ""))
_step("pp_urls", T.drop_urls, lambda e: S.rx(e, P.URL, " "))
_step("pp_numbers", T.drop_numbers, lambda e: S.rx(e, P.DIGITS, ""))
_step("pp_ampm", T.drop_am_pm, S.am_pm)
_step("pp_nonword", T.words_only, lambda e: S.rx(e, P.NON_WORD, " "))
_step("pp_fold", lambda c: T.ascii_fold(T.words_only(c)), lambda e: S.fold(S.rx(e, P.NON_WORD, " ")))


@query("pp_tokens", f"""
select kind, id, array_to_string({S.tokens('text')}, ' ') as tokens from {ALL_TEXTS}""")
def pp_tokens(spark, sf):
    return all_texts(spark, sf).select("kind", "id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


STOPS = stop_words(extra=True)


@query("pp_stopwords", f"""
select doc_id, array_to_string({S.tokens('text', STOPS)}, ' ') as tokens from documents""")
def pp_stopwords(spark, sf):
    kept = T.drop_stop_words(T.tokens(F.col("text")), STOPS)
    return table(spark, sf, "documents").select("doc_id", F.array_join(kept, " ").alias("tokens"))


LEMMAS = f"""
with t as (select doc_id, {S.tokens('text', STOPS)} as tokens from documents),
w as (select doc_id, unnest(tokens) as word, generate_subscripts(tokens, 1) as i from t),
vocab as (select distinct word from w),
endings(e, r) as (values ('s', ''), ('ses', 's'), ('xes', 'x'), ('zes', 'z'), ('ches', 'ch'),
                         ('shes', 'sh'), ('men', 'man'), ('ies', 'y'), ('ves', 'f')),
cand as (select word, left(word, length(word) - length(e)) || r as lemma from vocab, endings
         where length(word) > 4 and ends_with(word, e) and length(word) > length(e)),
lemmas as (select word, arg_min(lemma, (length(lemma), lemma)) as lemma from cand
           where lemma in (select word from vocab) group by word)"""


def preprocessed(spark, sf):
    corpus = reuse(table(spark, sf, "documents").select(
        "doc_id", T.preprocess_tokens(F.col("text"), STOPS).alias("tokens")))
    return corpus, lemma_table(corpus)


@query("pp_lemmatize", LEMMAS + " select word, lemma from lemmas")
def pp_lemmatize(spark, sf):
    return preprocessed(spark, sf)[1]


@query("preprocess", LEMMAS + """
select t.doc_id, coalesce(x.text, '') as text from t left join (
  select doc_id, string_agg(coalesce(lemma, w.word), ' ' order by i) as text
  from w left join lemmas using (word) group by doc_id) x using (doc_id)""")
def preprocess(spark, sf):
    corpus, lemmas = preprocessed(spark, sf)
    return lemmatize(corpus, lemmas).select("doc_id", F.array_join("tokens", " ").alias("text"))


@query("split_sentences", f"""
select doc_id, unnest(range(len(s))) as sent, unnest(s) as text
from (select doc_id, {S.sentences('text')} as s from documents)""")
def split_sentences(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent", "text"))
    return rows.withColumn("sent", F.col("sent").cast("long"))


@query("split_words", f"""
select conv_id, turn, token, count(*) as n
from (select conv_id, turn, unnest({S.words_and_marks('text')}) as token from conversations)
group by all""")
def split_words(spark, sf):
    words = T.words_and_marks(F.col("text"))
    return (table(spark, sf, "conversations").select("conv_id", "turn", F.explode(words).alias("token"))
            .groupBy("conv_id", "turn", "token").agg(F.count(F.lit(1)).alias("n")))
