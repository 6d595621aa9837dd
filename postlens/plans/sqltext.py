"""SQL spellings of the text functions, for the checking queries."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.text import FOLD_FROM, FOLD_TO


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(items) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def re2(pattern: str) -> str:
    """The pattern as a literal, with Java's set names spelled out for RE2."""
    spelled = pattern.replace(P.SPACE, r"\x09-\x0d\x1c-\x1f\x{85}\p{Z}")
    return lit(spelled.replace(r"[^\p{Alnum}", "[^0-9A-Za-z").replace(r"\p{Alnum}", "[0-9A-Za-z]"))


def rx(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {re2(pattern)}, {lit(repl)}, 'g')"


def newline_slash(e: str) -> str:
    return f"replace(replace({e}, chr(10), ' '), '\\/', '/')"


def am_pm(e: str) -> str:
    # no look-ahead here, so separators are consumed and a second pass takes the neighbours
    pattern = rf"(^|[^{P.WORD}])[0-9]*[apAP][mM]([^{P.WORD}]|$)"
    return rx(rx(e, pattern, r"\1\2"), pattern, r"\1\2")


def fold(e: str) -> str:
    return rx(f"translate({e}, {lit(FOLD_FROM)}, {lit(FOLD_TO)})", P.NON_ASCII, "")


def clean(e: str) -> str:
    e = newline_slash(f"lower({e})")
    for pattern, repl in ((P.WROTE, " "), (P.GAGT, " "), (P.PHONE_MODEL, " "), (P.MENTION, ""),
                          (P.URL, " "), (P.DIGITS, "")):
        e = rx(e, pattern, repl)
    return fold(rx(am_pm(e), P.NON_WORD, " "))


def tokens(e: str, stops: list[str] | None = None) -> str:
    keep = f" and w not in {in_list(stops)}" if stops else ""
    return f"list_filter(string_split({clean(e)}, ' '), lambda w: length(w) > 1{keep})"


def split_ws(e: str) -> str:
    return f"list_filter(string_split_regex({e}, {re2(P.SPACES)}), lambda w: w <> '')"


def sentences(e: str) -> str:
    marked = rx(f"replace({e}, {lit(P.SENTENCE_MARK)}, '')", P.SENTENCE_END, chr(92) + "1" + P.SENTENCE_MARK)
    return f"list_filter(string_split({marked}, {lit(P.SENTENCE_MARK)}), lambda s: s <> '')"


def words_and_marks(e: str) -> str:
    return f"regexp_extract_all({e}, {re2(P.WORD_OR_MARK)})"


def vector_tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), {lit(P.VECTOR_TOKEN)})"


def has_text(e: str) -> str:
    return f"regexp_matches({e}, {re2('[^' + P.SPACE + ']')})"


def one_line(e: str) -> str:
    return f"regexp_replace({e}, {lit('[' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n]')}, ' ', 'g')"


def count_in(e: str, needle: str) -> str:
    return f"((length({e}) - length(replace({e}, {needle}, ''))) // length({needle}))"
