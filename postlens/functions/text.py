"""Text normalisation as Column → Column functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .arrays import let


def _fold_pairs() -> tuple[str, str]:
    """Code points whose canonical decomposition keeps exactly one ASCII character."""
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        kept = [c for c in unicodedata.normalize("NFD", chr(cp)) if ord(c) < 128]
        if kept:
            src.append(chr(cp))
            dst.append(kept[0])
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_pairs()


def ascii_fold(text: Column) -> Column:
    """Drop accents, then everything still outside ASCII. Pure-ASCII rows pass untouched."""
    return let(text, lambda t: F.when(is_ascii(t), t).otherwise(
        F.regexp_replace(F.translate(t, FOLD_FROM, FOLD_TO), P.NON_ASCII, "")))


def newline_slash(text: Column) -> Column:
    """Line feeds become spaces, escaped slashes plain ones."""
    return F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\\/"), F.lit("/"))


def _if_contains(needles: list[str], pattern: str, repl: str):
    """regexp_replace that only runs where one of the needles occurs at all."""

    def apply(text: Column) -> Column:
        def body(t: Column) -> Column:
            hit = F.contains(t, F.lit(needles[0]))
            for needle in needles[1:]:
                hit = hit | F.contains(t, F.lit(needle))
            return F.when(hit, F.regexp_replace(t, pattern, repl)).otherwise(t)

        return let(text, body)

    return apply


drop_wrote = _if_contains(["wrote"], P.WROTE, " ")
drop_gagt = _if_contains(["gagt"], P.GAGT, " ")
drop_mentions = _if_contains(["@"], P.MENTION, "")
drop_urls = _if_contains(["://", "www."], P.URL, " ")


def _if_digit(pattern: str, repl: str):
    """regexp_replace for patterns that need a digit, skipped where there is none."""
    return lambda text: let(text, lambda t: F.when(
        t.rlike("[0-9]"), F.regexp_replace(t, pattern, repl)).otherwise(t))


drop_phone_models = _if_digit(P.PHONE_MODEL, " ")
drop_numbers = _if_digit(P.DIGITS, "")


def drop_am_pm(text: Column) -> Column:
    return F.regexp_replace(text, P.AM_PM, "$1")


def words_only(text: Column) -> Column:
    return F.regexp_replace(text, P.NON_WORD, " ")


def _before_words(text: Column) -> Column:
    for step in (F.lower, newline_slash, drop_wrote, drop_gagt, drop_phone_models, drop_mentions,
                 drop_urls, drop_numbers):
        text = step(text)
    return text


def clean(text: Column) -> Column:
    """The whole clean-up, lower-casing to ASCII folding, in its fixed order."""
    return ascii_fold(words_only(drop_am_pm(_before_words(text))))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def whitespace_split(text: Column) -> Column:
    """Split on Unicode white space, without empty pieces."""
    return F.filter(let(text, lambda t: F.when(is_ascii(t), F.split(t, P.ASCII_SPACES)).otherwise(
        F.split(t, P.SPACES))), lambda w: w != "")


def tokens(text: Column) -> Column:
    """`clean` cut into tokens of two or more characters.

    Cutting at non-word runs and leaving out the whole words am and pm gives the same tokens
    as blanking them in the text, with two passes fewer; only rows with accents are folded.
    """
    words = F.filter(F.split(_before_words(text), P.NON_WORD), lambda w: ~w.isin("am", "pm", ""))

    def fold(ws: Column) -> Column:
        return let(F.array_join(ws, " "), lambda t: F.when(is_ascii(t), ws).otherwise(
            F.split(ascii_fold(t), " ")))

    return F.filter(let(words, fold), lambda w: F.length(w) > 1)


def drop_stop_words(words: Column, stops: list[str]) -> Column:
    """Hash-set membership test per token; keeps order and repeats."""
    return F.filter(words, lambda w: ~w.isin(list(stops))) if stops else words


def preprocess_tokens(text: Column, stops: list[str] | None = None) -> Column:
    return drop_stop_words(tokens(text), stops or [])


def preprocess(text: Column, stops: list[str] | None = None) -> Column:
    """Raw text → one space-joined string of kept tokens (lemmas need a table: see lemmas.py)."""
    return F.array_join(preprocess_tokens(text, stops), " ")


def sentences(text: Column) -> Column:
    """Split after runs of . ! ? followed by white space."""
    free = F.replace(text, F.lit(P.SENTENCE_MARK), F.lit(""))  # the mark itself never splits
    marked = F.regexp_replace(free, P.SENTENCE_END, "$1" + P.SENTENCE_MARK)
    return F.filter(F.split(marked, P.SENTENCE_MARK), lambda s: s != "")


def words_and_marks(text: Column) -> Column:
    """Runs of word characters, and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(P.WORD_OR_MARK), 0)


def vector_tokens(text: Column) -> Column:
    """Lower-cased word runs of two or more characters, as count vectorizers cut them."""
    return F.regexp_extract_all(F.lower(text), F.lit(P.VECTOR_TOKEN), 0)


def has_text(text: Column) -> Column:
    """True where anything but white space is left; mostly the first character says so, and the text isn't decoded."""
    return F.substring(text, 1, 1).rlike(rf"[^{P.SPACE}]") | text.rlike(rf"[^{P.SPACE}]")
