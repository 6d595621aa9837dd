"""Features of one text as Column expressions: array<struct<feature string, value double>>.

Every family stays inside its row, so any mix of them costs one scan and no shuffle.
A blank text yields an empty array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .arrays import last_wins, let, occurrences, round_exact, value_counts, value_counts_placed, word_ngrams
from .text import has_text, sentences, whitespace_split, words_and_marks
from .words import FIVE_W_ONE_H, INTERROGATIVES

PAIRS = "array<struct<feature:string,value:double>>"


def _none() -> Column:
    return F.array().cast(PAIRS)


def _pair(feature: Column | str, value: Column) -> Column:
    name = F.lit(feature) if isinstance(feature, str) else feature
    return F.struct(name.alias("feature"), value.cast("double").alias("value"))


def _if_text(text: Column, pairs: Column) -> Column:
    return F.when(has_text(text), pairs).otherwise(_none())


def _counted(items: Column, prefix: str = "") -> Column:
    name = (lambda c: F.concat(F.lit(prefix), c["item"])) if prefix else (lambda c: c["item"])
    return F.transform(value_counts(items), lambda c: _pair(name(c), c["n"]))


def _member(listed) -> Callable[[Column], Column]:
    """Hash-set membership test against a bounded word list."""
    allowed = list(listed)
    return lambda w: w.isin(allowed)


def _listed(words: Column, listed: list[str]) -> Column:
    """The words that a list has, so that tests of its parts read these few instead of the whole text."""
    return F.filter(words, _member(dict.fromkeys(listed)))


def emoticons(text: Column, marks: list[str]) -> Column:
    """`emoticon_<e>`: how often each emoticon occurs, if at all."""
    listed = F.lit([m for m in dict.fromkeys(marks) if m]).cast("array<string>")
    counts = F.transform(listed, lambda e: _pair(F.concat(F.lit("emoticon_"), e), occurrences(text, e)))
    return _if_text(text, F.filter(counts, lambda p: p["value"] > 0))


# The default word options.
WORD_OPTIONS = {"case_insensitive": True, "strip_entities": True, "strip_punctuation": True,
                "strip_numbers": True, "strip_repeated_chars": True, "stop_words": None,
                "min_token_length": 3, "max_features": None}


def _strip_entities(text: Column, marks_too: bool) -> Column:
    """Blank mentions, hash tags and URLs (and marks), with the simplest pattern that can matter."""
    plain = F.regexp_replace(text, P.MARKS, " ") if marks_too else text
    return (F.when(text.contains("://"), F.regexp_replace(text, P.ENTITIES, " "))
            .when(text.contains("@") | text.contains("#"),
                  F.regexp_replace(text, P.TAGS_AND_MARKS if marks_too else P.TAGS, " "))
            .otherwise(plain))


def _most_frequent(ws: Column, counts: Column, most: int) -> Column:
    """The `most` highest counts, ties by first place; ranked only in documents that have more."""
    by_rank = F.sort_array(F.transform(value_counts_placed(ws), lambda c: F.struct(
        (-c["n"]).alias("r"), c["first"].alias("first"), c["item"].alias("item"))))
    kept = F.transform(F.slice(by_rank, 1, most), lambda c: F.struct(c["item"].alias("item"), (-c["r"]).alias("n")))
    return F.when(F.size(counts) <= most, counts).otherwise(kept)


def words(text: Column, **options) -> Column:
    """`word_<t>`: counts of cleaned words, the most frequent first, ties by first place."""
    o = {**WORD_OPTIONS, **options}
    t = F.lower(text) if o["case_insensitive"] else text
    if o["strip_entities"]:
        # marks blanked by a later step need not be blanked here
        t = let(t, lambda x: _strip_entities(x, marks_too=not o["strip_punctuation"]))
    if o["strip_punctuation"] and o["strip_numbers"]:
        t = F.regexp_replace(t, r"\P{Alpha}+", " ")
    elif o["strip_punctuation"]:
        t = F.regexp_replace(t, r"\P{Alnum}+", " ")
    elif o["strip_numbers"]:
        t = F.regexp_replace(t, "[0-9]", " ")
    if o["strip_repeated_chars"]:
        one = r"\p{Alnum}" if o["strip_punctuation"] else f"[{P.WORD}]"
        t = F.regexp_replace(t, rf"({one})\1{{2,}}", " ")
    if o["stop_words"] and not o["strip_punctuation"]:
        t = F.translate(t, "_-", "  ")
    ws = whitespace_split(t)
    if o["stop_words"]:
        ws = ws if o["case_insensitive"] else F.transform(ws, F.lower)
        ws = F.filter(ws, lambda w: ~w.isin(list(o["stop_words"])))
    ws = F.filter(ws, lambda w: F.length(w) >= o["min_token_length"])
    most = o["max_features"]

    def pairs(w: Column) -> Column:
        counts = value_counts(w)
        if most:
            counts = let(counts, lambda c: _most_frequent(w, c, most))
        return F.transform(counts, lambda c: _pair(F.concat(F.lit("word_"), c["item"]), c["n"]))

    return _if_text(text, let(ws, pairs))


def ngrams(text: Column, low: int, high: int, fixed: bool = False) -> Column:
    """Lower-cased word n-grams for n in low..high; the last one of each n only if `fixed`."""
    pieces = let(whitespace_split(F.lower(text)), lambda w: F.concat(
        *[word_ngrams(w, n, fixed) for n in range(low, high + 1)]))
    return _if_text(text, _counted(pieces))


def five_w_one_h(text: Column, mask: str = "111111") -> Column:
    """Share of each chosen question word, and of all of them as `dict_5w1h_avg`."""
    chosen = [w for w, flag in zip(FIVE_W_ONE_H, mask) if flag == "1"]

    def pairs(ws: Column) -> Column:
        n = F.size(ws)

        def shares(hits: Column) -> Column:
            return F.array(*[_pair(w, F.size(F.filter(hits, _member([w]))) / n) for w in chosen], _pair("dict_5w1h_avg", F.size(hits) / n))

        return F.when(n > 0, let(_listed(ws, chosen), shares)).otherwise(_none())

    return let(whitespace_split(F.regexp_replace(F.lower(text), P.QUESTION_BLANKS, " ")), pairs)


def emotion_words(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """Tokens per emotion category, zeros included, and their sum as `emo_words_count`."""

    def pairs(ws: Column) -> Column:
        counts = [F.size(F.filter(ws, _member(v))) for v in lexicon.values()]
        named = [_pair(k, c) for k, c in zip(lexicon, counts)]
        total = counts[0]
        for c in counts[1:]:
            total = total + c
        return F.array(*named, _pair("emo_words_count", total))

    if not lexicon:
        return _if_text(text, F.array(_pair("emo_words_count", F.lit(0))))
    return _if_text(text, let(_listed(whitespace_split(text), [w for v in lexicon.values() for w in v]), pairs))


def lexicon_keys(word: Column, lengths: list[int]) -> Column:
    """array<struct<kind, word>> by which a token meets a lexicon: itself, and its beginnings of the lengths of stems."""
    exact = F.struct(F.lit("exact").alias("kind"), word.alias("word"))
    stems = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(word))
    return F.concat(F.array(exact), F.transform(stems, lambda n: F.struct(F.lit("partial").alias("kind"), F.substring(word, 1, n).alias("word"))))


def polarity_words(text: Column, lexicon: dict[str, dict[str, list[str]]], fixed: bool = False) -> Column:
    """`lsd_<polarity>_<kind>_<word>` counts. Stems (kind `partial`) compare by equality; `fixed` counts the tokens that begin
    with a stem, under the stem."""

    def found(ws: Column, kind: str, listed: list[str]) -> Column:
        if not fixed or kind != "partial":
            return F.filter(ws, _member(listed))
        lengths = F.array(*[F.lit(n) for n in sorted({len(v) for v in listed})]).cast("array<int>")
        starts = F.transform(ws, lambda w: F.transform(F.filter(lengths, lambda n: n <= F.length(w)), lambda n: F.substring(w, 1, n)))
        return F.filter(F.flatten(starts), _member(listed))

    def pairs(ws: Column) -> Column:
        parts = [_counted(found(ws, kind, v), f"lsd_{polarity}_{kind}_")
                 for polarity, kinds in lexicon.items() for kind, v in kinds.items()]
        return F.concat(*parts) if parts else _none()

    ws = whitespace_split(text)
    if not fixed:
        ws = _listed(ws, [w for kinds in lexicon.values() for v in kinds.values() for w in v])
    return _if_text(text, let(ws, pairs))


def _round4(value: Column) -> Column:
    return round_exact(value, 4)


def interrogatives(text: Column) -> Column:
    """Substring counts of question words per text and share of sentences that hold any.

    A question word never spans two sentences, so its count over the text is the sum over
    the sentences.
    """

    def pairs(t: Column, ss: Column) -> Column:
        n = F.size(ss)
        asking = F.size(F.filter(ss, lambda s: s.rlike(P.ASKING)))
        out = [_pair("num_interrogative_sents", asking),
               _pair("pct_interrogative_sents", _round4(asking / n))]
        for q in INTERROGATIVES:
            c = occurrences(t, F.lit(q))
            out += [_pair(f"num_{q}_sents", c), _pair(f"pct_{q}_sents", _round4(c / n))]
        return F.when(n > 0, F.array(*out)).otherwise(_none())

    return _if_text(text, let(F.lower(text), lambda t: let(sentences(t), lambda ss: pairs(t, ss))))


def uppercase(text: Column, fixed: bool = False) -> Column:
    """Mean and most upper-case characters per sentence; of the first one only unless `fixed`."""
    ss = sentences(text) if fixed else F.slice(sentences(text), 1, 1)
    caps = F.transform(ss, lambda s: F.length(F.regexp_replace(s, rf"[^{P.WORD}]|[0-9a-z]", "")))
    return _if_text(text, let(caps, lambda c: F.when(F.size(c) > 0, F.array(
        _pair("mean_cap_words_per_sentence", _round4(_mean(c))),
        _pair("max_cap_words_per_sentence", F.array_max(c)))).otherwise(_none())))


def _mean(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, b: a + b) / F.size(c)


def sentence_lengths(text: Column, fixed: bool = False) -> Column:
    """Longest, shortest, mean and deviation of sentence length; first one only unless `fixed`."""
    ss = sentences(text) if fixed else F.slice(sentences(text), 1, 1)

    def pairs(c: Column) -> Column:
        spread = let(_mean(c), lambda m: F.sqrt(_mean(F.transform(c, lambda x: (x - m) * (x - m)))))
        return F.when(F.size(c) > 0, F.array(
            _pair("max_length", F.array_max(c)), _pair("min_length", F.array_min(c)),
            _pair("mean_length", _round4(_mean(c))), _pair("std_length", _round4(spread)))).otherwise(_none())

    return _if_text(text, let(F.transform(ss, F.length), pairs))


def punctuation(text: Column, fixed: bool = False) -> Column:
    """`num_punc_<run>` and `mean_num_punc_<run>` = that per token.

    The plain count is 1 for every run that occurs; `fixed` counts them.
    """
    runs = whitespace_split(F.regexp_replace(text, r"\p{Alnum}+", " "))
    if fixed:
        counts = value_counts(runs)
    else:
        counts = F.transform(F.array_distinct(runs), lambda r: F.struct(r.alias("item"), F.lit(1).cast("long").alias("n")))

    def pairs(cs: Column) -> Column:
        named = F.transform(cs, lambda c: _pair(F.concat(F.lit("num_punc_"), c["item"]), c["n"]))
        means = let(F.size(words_and_marks(text)), lambda n: F.transform(cs, lambda c: _pair(
            F.concat(F.lit("mean_num_punc_"), c["item"]), c["n"] / n)))
        return F.concat(named, means)

    return _if_text(text, let(counts, pairs))


def repeated_chars(text: Column, at_least: int = 3, digits: bool = False, single: bool = True) -> Column:
    """Characters repeated `at_least` times in a row; the value counts the key as a substring."""
    t = F.lower(text) if digits else F.regexp_replace(F.lower(text), "[0-9]", "")
    pattern = rf"(([{P.WORD}])\2{{{at_least - 1},}})"
    return _if_text(text, let(t, lambda x: F.transform(
        F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), 2 if single else 1)),
        lambda k: _pair(k, occurrences(x, k)))))


def pos_tags(text: Column, tag_words: dict[str, list[str]], default: str = "NN") -> Column:
    """Mean share of each tag over the sentences that hold it; words are tagged by lookup."""

    def tag(word: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(default))
        for name, listed in tag_words.items():
            chain = chain.when(word.isin(list(listed)), F.lit(name))
        return chain.otherwise(F.lit(default))

    def shares(sentence: Column) -> Column:
        tags = F.transform(words_and_marks(F.lower(sentence)), tag)
        return let(tags, lambda ts: F.transform(value_counts(ts), lambda c: _pair(c["item"], c["n"] / F.size(ts))))

    def pairs(ps: Column) -> Column:
        names = F.array_distinct(F.transform(ps, lambda p: p["feature"]))
        return F.transform(names, lambda t: _pair(t, _mean(F.transform(
            F.filter(ps, lambda p: p["feature"] == t), lambda p: p["value"]))))

    return _if_text(text, let(F.flatten(F.transform(sentences(text), shares)), pairs))


def merge(*families: Column) -> Column:
    """Join families; a later family's value replaces an earlier one of the same name."""
    return last_wins(F.concat(*families))
