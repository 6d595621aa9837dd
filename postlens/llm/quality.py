"""Quality rules by distribution divergence.

Each document's histograms over character classes and over its language's commonest words are compared with the histograms
of all documents of that language, by Jensen-Shannon distance (base 2, 0 to 1). Short documents, whose histograms say
little, and languages with little text are not judged this way.

Which words may be a language's commonest comes from a mergeable frequent-items summary. One scan then takes every measure
of a document, counts of these words among them; the language's histograms are sums of what was stored. The summary's error
bounds prove that no other word is commoner; where they don't, more candidates are taken, and at last all words counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..operators.ranking import top_n_per_group
from .common import BLANK_CHARS, forget, stored, words

COMMON_WORDS = 20
LEAST_WORDS, LEAST_REFERENCE = 80, 5_000  # words of a document, and of a language, from which it is compared
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.3, 0.4
BASE_WORDS, BASE_REPEAT = 50, 50  # fewer words fail; more than this per cent in repeated windows fail
WINDOW = 3
CANDIDATES, MOST_CANDIDATES, TRACKED = 28, 224, 8192  # words per language, and counters of the summary (a power of two)
#: Character classes, apart from one another, in any script; what is in none is the last class.
CLASSES = {"lower": r"\p{Ll}+", "upper": r"\p{Lu}+", "letter": r"[\p{Lo}\p{Lm}\p{Lt}\p{M}]+", "digit": r"\p{Nd}+",
           "blank": r"[\x20\x09-\x0D]+", "stop": "[.,;:!?'\"()-]+", "symbol": "[#*$%&|<>]+"}
#: The same for ASCII texts, which need no tables; None where ASCII has nothing of the class.
ASCII_CLASSES = {**CLASSES, "lower": "[a-z]+", "upper": "[A-Z]+", "letter": None, "digit": "[0-9]+"}
BROADCAST_LANGUAGES = 10_000


def repeated_words(found: Column) -> Column:
    """Words that lie in a WINDOW-word window found at least twice; windows are sorted by hash and compared with neighbours."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                           lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        same = lambda x, j, k: F.coalesce(x["h"] == F.get(s, j + k)["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, j: same(x, j, -1) | same(x, j, 1)), lambda x: x["i"])

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    # most texts repeat no window; only the others are sorted
    once = lambda w: let(hashes(w), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    some = let(found, lambda w: F.when(once(w), F.lit(0)).otherwise(let(F.sort_array(windows(w)), lambda s: let(F.sort_array(places(s)), covered))))
    return F.when(F.size(found) < WINDOW, F.lit(0)).otherwise(some).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    with_word = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANK_CHARS)) != "")
    return let(with_word, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def class_counts(text: Column) -> Column:
    """Array of the characters of each class and, last, of none.

    Classes are taken out one after another, so all but the first look at the little that is left.
    """
    length = lambda x: F.char_length(x).cast("long")

    def counts(left: Column, classes: list[str | None], found: tuple[Column, ...] = ()) -> Column:
        if not classes:
            return F.array(*found, length(left))
        if classes[0] is None:
            return counts(left, classes[1:], (*found, F.lit(0).cast("long")))
        return let(F.regexp_replace(left, classes[0], ""), lambda rest: counts(rest, classes[1:], (*found, length(left) - length(rest))))

    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, counts(text, list(ASCII_CLASSES.values()))).otherwise(counts(text, list(CLASSES.values())))


def candidates(rows: DataFrame, most: int) -> DataFrame:
    """<_ref, _cand, _limit> of <_lang, _text>: words that may be a language's commonest, and how often any other word may occur.

    Languages of fewer than LEAST_REFERENCE words have no row. An untracked word occurs at most 3.5 / TRACKED of all words
    often, as the summary's makers prove; a tracked one at most as often as its estimate.
    """
    each = rows.select("_lang", F.explode(words(F.col("_text"))).alias("_word"))
    found = each.groupBy("_lang").agg(F.expr(f"approx_top_k(_word, {most}, {TRACKED})").alias("_top"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST_REFERENCE)
    last = F.when(F.size("_top") == most, F.array_min(F.transform("_top", lambda x: x["count"]))).otherwise(F.lit(0).cast("long"))
    return found.select(F.col("_lang").alias("_ref"), F.transform("_top", lambda x: x["item"]).alias("_cand"),
                        F.greatest(last, F.ceil(F.col("_n") * F.lit(3.5 / TRACKED)).cast("long")).alias("_limit"))


def counted_candidates(rows: DataFrame) -> DataFrame:
    """As `candidates`, by counting every word: the commonest themselves."""
    each = rows.select("_lang", F.explode(words(F.col("_text"))).alias("_word"))
    by_word = each.groupBy("_lang", "_word").agg(F.count(F.lit(1)).alias("_n"))
    best = top_n_per_group(by_word, "_lang", [F.desc("_n"), F.asc("_word")], COMMON_WORDS)
    total = by_word.groupBy("_lang").agg(F.sum("_n").alias("_all")).where(F.col("_all") >= LEAST_REFERENCE)
    top = best.groupBy("_lang").agg(F.collect_list("_word").alias("_cand")).alias("t")
    return total.alias("s").join(top, F.col("s._lang").eqNullSafe(F.col("t._lang"))).select(
        F.col("s._lang").alias("_ref"), "_cand", F.lit(-1).cast("long").alias("_limit"))


def _measured(rows: DataFrame, cand: DataFrame) -> DataFrame:
    """Every measure of <_key, _lang, _text> in one scan, and `_hist`, the occurrences of its language's candidates."""
    cand = F.broadcast(cand) if cand.count() <= BROADCAST_LANGUAGES else cand
    rows = rows.join(cand.select("_ref", "_cand"), F.col("_lang").eqNullSafe(F.col("_ref")), "left").withColumn("_words", words(F.col("_text")))
    hist = let(F.filter("_words", lambda w: F.array_contains("_cand", w)), lambda hits: F.transform("_cand", lambda c: F.size(F.filter(hits, lambda w: w == c))))
    return rows.select("_key", "_lang", F.size("_words").cast("long").alias("n_words"), F.char_length("_text").cast("long").alias("_chars"), class_counts(F.col("_text")).alias("_classes"),
                       repeated_lines(F.col("_text")).alias("n_dup_lines"), repeated_words(F.col("_words")).alias("n_repeat_words"),
                       F.when(F.col("_cand").isNotNull(), hist).alias("_hist"))


def _references(measured: DataFrame, cand: DataFrame, most: int) -> DataFrame:
    """<_ref, _ref_classes, _places, _ref_words, _proven>: a language's histograms, and where its common words are in `_hist`.

    Common words are those with the most occurrences; ties go by code point. The word histogram ends with all other words.
    """
    width = len(CLASSES) + 1
    sums = measured.where("_hist is not null").groupBy("_lang").agg(
        F.sum("n_words").alias("_all"), F.array(*[F.sum(F.get("_classes", F.lit(i))) for i in range(width)]).alias("_ref_classes"),
        F.array(*[F.coalesce(F.sum(F.get("_hist", F.lit(i))), F.lit(0)).cast("long") for i in range(most)]).alias("_sums"))
    both = sums.join(F.broadcast(cand) if cand.count() <= BROADCAST_LANGUAGES else cand, F.col("_lang").eqNullSafe(F.col("_ref")))
    listed = F.transform("_cand", lambda w, i: F.struct((-F.get("_sums", i)).alias("n"), w.alias("w"), i.alias("i")))
    top = F.slice(F.sort_array(listed), 1, COMMON_WORDS)
    with_top = both.select("_ref", "_ref_classes", "_all", "_limit", top.alias("_top"))
    counts = F.transform("_top", lambda x: -x["n"])
    rest = F.col("_all") - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    whole = (rest == 0) | (F.col("_limit") < 0)  # all words are listed, or were counted
    return with_top.select("_ref", "_ref_classes", F.transform("_top", lambda x: x["i"]).alias("_places"), F.concat(counts, F.array(rest)).alias("_ref_words"),
                           (whole | ((F.size("_top") == COMMON_WORDS) & (-F.element_at("_top", -1)["n"] > F.col("_limit")))).alias("_proven"))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence of two histograms; 0 for an empty one."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x).cast("double")

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def divergence(sums: Column) -> Column:
        terms = F.zip_with(p, q, lambda a, b: let(F.struct((a / sums["p"]).alias("a"), (b / sums["q"]).alias("b")), lambda s: (
            part(s["a"], (s["a"] + s["b"]) / 2) + part(s["b"], (s["a"] + s["b"]) / 2)) / 2))
        value = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
        return F.when((sums["p"] > 0) & (sums["q"] > 0), F.sqrt(F.greatest(value, F.lit(0.0)))).otherwise(0.0)

    return let(F.struct(total(p).alias("p"), total(q).alias("q")), divergence)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """<key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance>.

    One row per input row. Null text has no words and fails. A null language is a language like others. Distances are null
    where the guards leave a document unjudged; such a document is kept unless it fails the base. Key and other columns may
    be null or repeated. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    most = CANDIDATES
    while True:
        guessed = most <= MOST_CANDIDATES
        cand = stored(candidates(rows, most) if guessed else counted_candidates(rows), "candidates")
        measured = stored(_measured(rows, cand), "measures")
        refs = stored(_references(measured, cand, most), "references")
        if not guessed or refs.where(~F.col("_proven")).isEmpty():
            break
        forget(cand, measured, refs)
        most *= 2
    refs = F.broadcast(refs) if refs.count() <= BROADCAST_LANGUAGES else refs
    out = measured.join(refs, F.col("_lang").eqNullSafe(F.col("_ref")), "left")
    judged = (F.col("n_words") >= LEAST_WORDS) & F.col("_ref").isNotNull()
    own = F.transform("_places", lambda i: F.get("_hist", i).cast("long"))
    hist = let(own, lambda a: F.concat(a, F.array(F.col("n_words") - F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x))))
    names = list(CLASSES)
    out = out.withColumns({
        "word_chars": F.col("_chars") - F.get("_classes", F.lit(names.index("blank"))),
        "n_symbols": F.get("_classes", F.lit(names.index("symbol"))),
        "word_distance": F.when(judged, js_distance(hist, F.col("_ref_words"))),
        "class_distance": F.when(judged, js_distance(F.col("_classes"), F.col("_ref_classes"))),
        "base_failed": (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))})
    fits = F.coalesce((F.col("class_distance") <= MOST_CLASS_DISTANCE) & (F.col("word_distance") <= MOST_WORD_DISTANCE), F.lit(True))
    return out.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & fits).alias("kept"), "class_distance", "word_distance")
