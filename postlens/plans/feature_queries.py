"""Queries: features per document, as rows <doc_id, feature, value>."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import patterns as P
from ..functions.text import has_text, whitespace_split
from ..functions.words import FIVE_W_ONE_H, INTERROGATIVES, stop_words
from ..operators import features as O
from . import sqltext as S
from .registry import query, table

MARKS = ["!!", "***", "%%%", "$$$", "###", "##"]
EMOTIONS = {"article": ["the", "der", "die", "la", "le", "The"], "joining": ["and", "und", "et", "y"],
            "pointing": ["that", "this", "the", "was"]}


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def rounded(rows):
    return rows.withColumn("value", F.round("value", 6))


def per_row(name, column, sql):
    """A family that needs one row only."""

    def run(spark, sf):
        return O.as_rows(docs(spark, sf), column(F.col("text")))

    query(name, f"select doc_id, feature, value from ({sql})")(run)


def emoticons_sql(source="documents"):
    marks = ", ".join(f"({S.lit(m)})" for m in MARKS)
    return f"""select doc_id, 'emoticon_' || m as feature, {S.count_in('text', 'm')}::double as value
from {source}, (values {marks}) v(m) where contains(text, m) and {S.has_text('text')}"""


STOPS = stop_words()


def words_sql(source="documents"):
    e = S.rx(S.rx(S.rx("lower(text)", P.ENTITIES, " "), "[^a-zA-Z0-9]", " "), "[0-9]", " ")
    e = S.rx(e, "|".join(f"{c}{{3,}}" for c in "abcdefghijklmnopqrstuvwxyz"), " ")
    ws = f"list_filter({S.split_ws(e)}, lambda w: w not in {S.in_list(STOPS)} and length(w) >= 3)"
    return f"""select doc_id, 'word_' || word as feature, n::double as value from (
  select doc_id, word, count(*) as n from (select doc_id, unnest({ws}) as word from {source}) group by doc_id, word)"""


def ngrams_sql(low, high, source="documents", text="text", fixed=False):
    last = "+ 2" if fixed else "+ 1"
    parts = [f"""select doc_id, array_to_string(ws[i:i + {n - 1}], ' ') as g
from (select doc_id, ws, unnest(range(1, len(ws) - {n} {last})) as i from w)""" for n in range(low, high + 1)]
    return f"""select doc_id, g as feature, count(*)::double as value from (
  with w as (select doc_id, {S.split_ws(f'lower({text})')} as ws from {source} where {S.has_text(text)})
  {' union all '.join(parts)}) group by doc_id, g"""


def five_w_sql(source="documents", text="text"):
    ws = S.split_ws(S.rx(f"lower({text})", P.QUESTION_BLANKS, " "))
    one = [f"select doc_id, {S.lit(q)} as feature, len(list_filter(ws, lambda x: x = {S.lit(q)}))::double / len(ws) as value from w"
           for q in FIVE_W_ONE_H]
    one.append(f"""select doc_id, 'dict_5w1h_avg', len(list_filter(ws, lambda x: x in {S.in_list(FIVE_W_ONE_H)}))::double
/ len(ws) from w""")
    return f"""with w as (select * from (select doc_id, {ws} as ws from {source} where {S.has_text(text)}) where len(ws) > 0)
{' union all '.join(one)}"""


def emotion_sql(source="documents", text="text"):
    one = [f"select doc_id, {S.lit(k)} as feature, len(list_filter(ws, lambda x: x in {S.in_list(v)}))::double as value from w"
           for k, v in EMOTIONS.items()]
    total = " + ".join(f"len(list_filter(ws, lambda x: x in {S.in_list(v)}))" for v in EMOTIONS.values())
    one.append(f"select doc_id, 'emo_words_count', ({total})::double from w")
    return f"""with w as (select doc_id, {S.split_ws(text)} as ws from {source} where {S.has_text(text)})
{' union all '.join(one)}"""


def punctuation_sql(source="documents", fixed=False):
    n = "count(*)" if fixed else "1"
    return f"""with t as materialized (select doc_id, {S.split_ws(S.rx('text', '[a-zA-Z0-9]', ' '))} as runs,
    len({S.words_and_marks('text')}) as words from {source} where {S.has_text('text')}),
r as (select doc_id, run, {n}::double as n, any_value(words) as words
    from (select doc_id, unnest(runs) as run, words from t) group by doc_id, run)
select doc_id, 'num_punc_' || run as feature, n as value from r
union all select doc_id, 'mean_num_punc_' || run, n / words from r"""


def uppercase_sql(source="documents", fixed=False):
    ss = S.sentences("text") if fixed else S.sentences("text") + "[1:1]"
    caps = S.rx("s", rf"[^{P.WORD}]|[0-9a-z]", "")
    return f"""with c as (select * from (select doc_id, list_transform({ss}, lambda s: length({caps})) as c
from {source} where {S.has_text('text')}) where len(c) > 0)
select doc_id, 'mean_cap_words_per_sentence' as feature, printf('%.4f', list_avg(c))::double as value from c
union all select doc_id, 'max_cap_words_per_sentence', list_max(c)::double from c"""


def sentence_len_sql(source="documents", text="text", fixed=False):
    ss = S.sentences(text) if fixed else S.sentences(text) + "[1:1]"
    return f"""with c as (select * from (select doc_id, list_transform({ss}, lambda s: length(s)) as c
from {source} where {S.has_text(text)}) where len(c) > 0)
select doc_id, 'max_length' as feature, list_max(c)::double as value from c
union all select doc_id, 'min_length', list_min(c)::double from c
union all select doc_id, 'mean_length', printf('%.4f', list_avg(c))::double from c
union all select doc_id, 'std_length', printf('%.4f', list_stddev_pop(c))::double from c"""


def interrogative_sql(source="documents", text="text"):
    any_word = "|".join(INTERROGATIVES)
    out = [f"""select doc_id, 'num_interrogative_sents' as feature, k::double as value from c
union all select doc_id, 'pct_interrogative_sents', printf('%.4f', k / len(ss))::double from c"""]
    for q in INTERROGATIVES:
        total = f"list_sum(list_transform(ss, lambda s: {S.count_in('s', S.lit(q))}))::double"
        out += [f"select doc_id, 'num_{q}_sents', {total} from c",
                f"select doc_id, 'pct_{q}_sents', printf('%.4f', {total} / len(ss))::double from c"]
    return f"""with c as (select *, len(list_filter(ss, lambda s: regexp_matches(s, '{any_word}')))::double as k
from (select doc_id, list_transform({S.sentences(text)}, lambda s: lower(s)) as ss from {source} where {S.has_text(text)})
where len(ss) > 0) {' union all '.join(out)}"""


def repeated_sql(source="documents"):
    """Runs found by numbering characters and subtracting, as RE2 has no back-references."""
    return f"""with t as (select doc_id, {S.rx('lower(text)', '[0-9]', '')} as t from {source} where {S.has_text('text')}),
ch as (select doc_id, unnest(string_split(t, '')) as c, generate_subscripts(string_split(t, ''), 1) as i from t),
runs as (select doc_id, c from (select doc_id, c, i - row_number() over (partition by doc_id, c order by i) as g from ch)
  where regexp_matches(c, '^[{P.WORD}]$') group by doc_id, c, g having count(*) >= 3)
select distinct doc_id, c as feature, {S.count_in('t', 'c')}::double as value from runs join t using (doc_id)"""


per_row("feat_emoticons", lambda t: X.emoticons(t, MARKS), emoticons_sql())
per_row("feat_words", lambda t: X.words(t, stop_words=STOPS), words_sql())
per_row("feat_ngrams", lambda t: X.ngrams(t, 1, 2), ngrams_sql(1, 2))
per_row("feat_ngrams_fixed", lambda t: X.ngrams(t, 2, 2, fixed=True), ngrams_sql(2, 2, fixed=True))
per_row("feat_5w1h", X.five_w_one_h, five_w_sql())
per_row("feat_emotion", lambda t: X.emotion_words(t, EMOTIONS), emotion_sql())
per_row("feat_punctuation", X.punctuation, punctuation_sql())
per_row("feat_punctuation_fixed", lambda t: X.punctuation(t, fixed=True), punctuation_sql(fixed=True))
per_row("feat_uppercase", X.uppercase, uppercase_sql())
per_row("feat_uppercase_fixed", lambda t: X.uppercase(t, fixed=True), uppercase_sql(fixed=True))
per_row("feat_sentence_len", X.sentence_lengths, sentence_len_sql())
per_row("feat_sentence_len_fixed", lambda t: X.sentence_lengths(t, fixed=True), sentence_len_sql(fixed=True))
per_row("feat_interrogative", X.interrogatives, interrogative_sql())
per_row("feat_repeated_chars", X.repeated_chars, repeated_sql())


POLARITY = f"""with lex as (select distinct case when length(word) % 2 = 0 then 'negative' else 'positive' end as polarity,
  case when length(word) >= 6 then 'partial' else 'exact' end as kind, word
  from (select unnest({S.split_ws('lower(text)')}) as word from benchmark))"""


def polarity_lexicon(spark, sf):
    """A lexicon derived from the benchmark passages: <polarity, kind, word>."""
    words = table(spark, sf, "benchmark").select(F.explode(whitespace_split(F.lower("text"))).alias("word"))
    n = F.length("word")
    return words.select(F.when(n % 2 == 0, "negative").otherwise("positive").alias("polarity"),
                        F.when(n >= 6, "partial").otherwise("exact").alias("kind"), "word").distinct()


@query("feat_polarity", POLARITY + f"""
select doc_id, 'lsd_' || polarity || '_' || kind || '_' || word as feature, count(*)::double as value
from (select doc_id, unnest({S.split_ws('text')}) as word from documents) join lex using (word)
group by all""")
def feat_polarity(spark, sf):
    return O.polarity_by_table(docs(spark, sf), polarity_lexicon(spark, sf))


@query("feat_polarity_fixed", POLARITY + f"""
select doc_id, 'lsd_' || polarity || '_' || kind || '_' || lex.word as feature, count(*)::double as value
from (select doc_id, unnest({S.split_ws('text')}) as w from documents) join (select *, left(word, 4) as head from lex where kind = 'partial')
lex on left(w, 4) = head and starts_with(w, lex.word) group by all
union all select doc_id, 'lsd_' || polarity || '_' || kind || '_' || word as feature, count(*)::double as value
from (select doc_id, unnest({S.split_ws('text')}) as word from documents) join (select * from lex where kind = 'exact') lex using (word) group by all""")
def feat_polarity_fixed(spark, sf):
    """Stems of the lexicon match every word that begins with them."""
    return O.polarity_by_table(docs(spark, sf), polarity_lexicon(spark, sf), fixed=True)


@query("feat_polarity_lenient", POLARITY + f"""
select doc_id, 'lsd_' || polarity as feature, count(*)::double as value
from (select doc_id, unnest({S.split_ws(S.rx('lower(text)', P.QUESTION_BLANKS, ' '))}) as word from documents)
join lex using (word) group by all""")
def feat_polarity_lenient(spark, sf):
    return O.polarity_lenient(docs(spark, sf), polarity_lexicon(spark, sf))


@query("feat_emotion_table", f"""
with lex as (select distinct role as category, word from (
  select role, unnest({S.split_ws('text')}) as word from conversations)),
h as (select doc_id, word, category from (select doc_id, unnest({S.split_ws('text')}) as word from documents)
      left join lex using (word))
select doc_id, c as feature, sum(case when category = c then 1 else 0 end)::double as value
from h, (select distinct role as c from conversations) group by doc_id, c
union all
select doc_id, 'emo_words_count', count(category)::double from h group by doc_id""")
def feat_emotion_table(spark, sf):
    talk = table(spark, sf, "conversations")
    lexicon = talk.select(F.col("role").alias("category"), F.explode(whitespace_split(F.col("text"))).alias("word"))
    return O.emotion_by_table(docs(spark, sf), lexicon)


@query("feat_pos", f"""
with lex as (select word, tag from (
    select word, tag, row_number() over (partition by word order by count(*) desc, tag) as rn
    from (select unnest({S.words_and_marks('lower(text)')}) as word, role as tag from conversations)
    group by word, tag) where rn = 1),
s as (select doc_id, unnest(range(len(ss))) as sent, unnest(ss) as s
      from (select doc_id, {S.sentences('text')} as ss from documents where {S.has_text('text')})),
w as (select doc_id, sent, len(ws) as n, unnest(ws) as word
      from (select doc_id, sent, {S.words_and_marks('lower(s)')} as ws from s)),
t as (select doc_id, sent, coalesce(tag, 'NN') as tag, count(*) / any_value(n) as share
      from w left join lex using (word) group by all)
select doc_id, tag as feature, round(avg(share), 6) as value from t group by all""")
def feat_pos(spark, sf):
    from ..functions.text import words_and_marks

    tagged = table(spark, sf, "conversations").select(
        F.explode(words_and_marks(F.lower("text"))).alias("word"), F.col("role").alias("tag"))
    return rounded(O.pos_features(O.tag_tokens(docs(spark, sf), O.tag_lexicon(tagged))))


@query("merge_features", f"""
select doc_id, feature, arg_max(value, o) as value from (
  select *, 0 as o from ({ngrams_sql(1, 1)}) union all select *, 1 from ({five_w_sql()})
  union all select *, 2 from ({emotion_sql()})) group by doc_id, feature""")
def merge_features(spark, sf):
    corpus, t = docs(spark, sf), F.col("text")
    return O.merge_features([O.as_rows(corpus, X.ngrams(t, 1, 1)), O.as_rows(corpus, X.five_w_one_h(t)),
                                     O.as_rows(corpus, X.emotion_words(t, EMOTIONS))])


TAGS = {"DT": ["the", "der", "die", "la", "le"], "CC": ["and", "und", "et", "y"]}
POLAR = {"positive": {"exact": ["the", "der", "la"], "partial": ["with"]}, "negative": {"exact": ["that", "und"], "partial": ["les", "was"]}}


def tags_sql(source="documents"):
    tag = "case " + " ".join(f"when word in {S.in_list(v)} then {S.lit(k)}" for k, v in TAGS.items()) + " else 'NN' end"
    return f"""select doc_id, tag as feature, round(avg(share), 6) as value from (
  select doc_id, sent, {tag} as tag, count(*) / any_value(n) as share from (
    select doc_id, sent, len(ws) as n, unnest(ws) as word from (
      select doc_id, sent, {S.words_and_marks('lower(s)')} as ws from (
        select doc_id, unnest(range(len(ss))) as sent, unnest(ss) as s
        from (select doc_id, {S.sentences('text')} as ss from {source} where {S.has_text('text')})))) group by all) group by doc_id, tag"""


def polar_sql(source="documents", text="text"):
    lex = ", ".join(f"({S.lit(p)}, {S.lit(k)}, {S.lit(w)})" for p, kinds in POLAR.items() for k, listed in kinds.items() for w in listed)
    return f"""select doc_id, 'lsd_' || polarity || '_' || kind || '_' || word as feature, count(*)::double as value
from (select doc_id, unnest({S.split_ws(text)}) as word from {source}) join (values {lex}) lex(polarity, kind, word) using (word) group by all"""


def _extract_sql():
    body = f"array_to_string({S.tokens('text', STOPS)}, ' ')"
    parts = [emoticons_sql(), words_sql(), tags_sql(), punctuation_sql(), uppercase_sql(), five_w_sql("b"), ngrams_sql(1, 1, "b"),
             emotion_sql("b"), polar_sql("b"), interrogative_sql("b"), sentence_len_sql("b")]
    union = " union all ".join(f"select *, {i} as o from ({p})" for i, p in enumerate(parts))
    return f"""with b as materialized (select doc_id, {body} as text from documents)
select doc_id, feature, arg_max(value, o) as value from ({union}) group by doc_id, feature"""


@query("extract_all", _extract_sql())
def extract_all(spark, sf):
    """All eleven families in one scan."""
    options = {"emoticons": MARKS, "word_feature": {"stop_words": STOPS}, "pos": TAGS, "fiveWoneH": "111111", "ngrams": (1, 1),
               "emotion_words": EMOTIONS, "lsd_words": POLAR}
    rows = O.extract(docs(spark, sf), options, preprocessed=True, stops=STOPS)
    shares = F.col("feature").isin([*TAGS, "NN"])  # means, whose last digit depends on the order of adding
    return rows.withColumn("value", F.when(shares, F.round("value", 6)).otherwise(F.col("value")))
