"""Line dedup by a segment-partition edit join over words.

A line goes when an earlier one (by document key and line number) equals it or differs from it by one word put in, left out
or changed. Two such lines share one of two halves: the shorter line's halves are the index, and a line one word longer
probes it with its own beginning and end of the halves' lengths. Lines that share a key are candidates, confirmed by a
banded bit-parallel edit distance.

Keys that many lines share would make a number of pairs that grows with its square. Such lines agree on the shared half, so
only the words left have to be within an edit: these are split in halves again, and so on, until few lines share a key or
few words are left. Then a line is indexed by its words without the p-th, and the earliest line of an index entry
settles the others without a pair being made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import BLANK_CHARS, free_name, stored, without
from .exact_dedup import only_asked

LEAST_WORDS = 8  # shorter lines always stay
EDITS = 1
CROWDED = 8  # lines of a key from which it makes no pairs
BEFORE_ALL, LINES_OF_TEXT = str(-(1 << 63) - 1), str(1 << 31)  # stands for a null key; room for line numbers under a key
SHORT = 4  # words of a remainder that is indexed by leaving out each word


def _count(text: str, mark: str) -> Column:
    """Parts of a text between one-byte marks."""
    return F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit(mark), F.lit(""))) + 1


def _number(digits: str) -> Column:
    return F.lit(digits).cast("decimal(20,0)")


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """<place, print, line, n, h1, h2, raw> of each line with LEAST_WORDS words; lines are equal when their words are.

    `raw` holds the n words with one space between, so they are counted by their spaces and split only where needed.
    `place` puts key and line number into one decimal; `print` is the hash of the document's text.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    blanks = r"[\x20\x09\x0B-\x0D]+"
    even = F.when(value.rlike(r"[\x09\x0B-\x0D]|\x20\x20"), F.regexp_replace(value, blanks, " ")).otherwise(value)
    cut = docs.select(F.col(key).cast("decimal(20,0)").alias("key"), F.xxhash64(value).alias("print"), F.posexplode(F.split(even, "\n")).alias("line", "raw"))
    lines = cut.withColumn("raw", F.trim("raw")).withColumn("n", _count("raw", " "))
    place = (F.coalesce("key", _number(BEFORE_ALL)) * F.lit(LINES_OF_TEXT).cast("decimal(10,0)") + F.col("line")).cast("decimal(32,0)")
    return lines.where(F.col("n") >= LEAST_WORDS).select(place.alias("place"), "print", "line", "n", F.xxhash64(F.lit(1), "raw").alias("h1"),
                                                         F.xxhash64(F.lit(2), "raw").alias("h2"), "raw")


def _halves(length: Column) -> tuple[Column, Column]:
    first = F.floor(length / 2).cast("int")
    return first, (length - first).cast("int")


def _keys(words: Column, size: Column, length: Column, role: Column, context: Column) -> list[Column]:
    """The keys by which a line meets lines of `length` words: its beginning and its end of the halves' lengths.

    Each comes with the index line's words left to compare (`base`) and where the own ones start and how many they are.
    """
    first, second = _halves(length)
    begins = F.struct(F.xxhash64(F.lit(1), context, length, F.slice(words, F.lit(1), first)).alias("seg"), role.alias("role"),
                      second.alias("base"), first.alias("from"), (size - first).alias("left"))
    ends = F.struct(F.xxhash64(F.lit(2), context, length, F.slice(words, size - second + 1, second)).alias("seg"), role.alias("role"),
                    first.alias("base"), F.lit(0).alias("from"), (size - second).alias("left"))
    return [begins, ends]


def banded_distance_within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether the edit distance of two arrays is at most `edits`, by bit-parallel steps along a band of 2 * edits + 1 diagonals.

    State e holds a bit for each diagonal that e edits can reach; one step per element of b moves all diagonals at once.
    """
    width, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1

    def step(state: Column, j: Column) -> Column:
        same = [F.when(F.get(a, j + d - edits).eqNullSafe(F.get(b, j)) & (j + d - edits >= 0) & (j + d - edits < F.size(a)), F.lit(1 << d)).otherwise(0)
                for d in range(width)]
        equal = reduce(Column.bitwiseOR, same)
        out: list[Column] = []
        for e in range(edits + 1):
            now = state[f"r{e}"].bitwiseAND(equal)
            if e:
                before = state[f"r{e - 1}"]
                now = now.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(out[-1], 1).bitwiseAND(F.lit(full)))
            out.append(now)
        return F.struct(*[c.cast("int").alias(f"r{e}") for e, c in enumerate(out)])

    start = F.struct(*[F.lit(sum(1 << (edits + k) for k in range(e + 1))).alias(f"r{e}") for e in range(edits + 1)])
    last = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, step)
    goal = F.size(a) - F.size(b) + edits
    bits = reduce(Column.bitwiseOR, [last[f"r{e}"] for e in range(edits + 1)])
    return bits.bitwiseAND(_bit(goal, width)) != 0


def _bit(place: Column, width: int) -> Column:
    """1 << place for places 0 to width - 1, else 0."""
    out = F.lit(0)
    for d in range(width):
        out = F.when(place == d, F.lit(1 << d)).otherwise(out)
    return out


def _shared(keys: DataFrame) -> DataFrame:
    """<seg, n>: keys of several lines, one of which is an index line."""
    found = keys.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("role")).where("n > 1 and role = 0")
    return stored(found.select("seg", "n"), "counts")


def _pairs(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """<h1, h2, g1, g2> over keys of few lines, the earlier line first."""
    few = keys.join(counts.where(F.col("n") <= CROWDED).select("seg"), "seg")
    sets = few.groupBy("seg").agg(F.collect_list(F.struct("first", "h1", "h2", "role")).alias("m"))  # CROWDED at most
    one = sets.select(F.posexplode("m").alias("i", "a"), "m")
    both = one.select("a", F.explode(F.expr("filter(m, (x, k) -> k > i and (x.role = 0 or a.role = 0) and (x.h1 <> a.h1 or x.h2 <> a.h2))")).alias("b"))
    later = F.col("a")["first"] > F.col("b")["first"]
    ordered = both.select(F.when(later, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(later, F.col("a")).otherwise(F.col("b")).alias("y"))
    return ordered.select("x.h1", "x.h2", F.col("y.h1").alias("g1"), F.col("y.h2").alias("g2")).distinct()


def _by_left_out(items: DataFrame) -> DataFrame:
    """<h1, h2> of lines with an earlier one within an edit, where few words are left to compare.

    Index lines of a context have `base` words left, others one more. Without its p-th word an index line equals those that
    differ there, and another line equals the index line that lacks the word; the earliest of each such group is enough.
    """
    rest = lambda p: F.concat(F.slice("words", F.lit(1), p), F.slice("words", p + 2, F.size("words")))
    each = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    row = lambda p, kind, left: F.struct(p.alias("p"), F.lit(kind).alias("kind"), F.xxhash64(F.lit(1), "seg", left).alias("k1"), F.xxhash64(F.lit(2), "seg", left).alias("k2"))
    nowhere = F.lit(-1)
    changed = F.concat(F.transform(each, lambda p: row(p, 0, rest(p))), F.array(row(nowhere, 2, F.col("words"))))
    longer = F.transform(each, lambda p: row(nowhere, 1, rest(p)))
    rows = items.select("h1", "h2", "first", F.inline(F.when(F.col("role") == 0, changed).otherwise(longer)))
    group = ["k1", "k2", "p"]
    least = rows.groupBy(*group).agg(F.min("first").alias("least"), F.min(F.when(F.col("kind") == 1, F.col("first"))).alias("long"),
                                     F.min(F.when(F.col("kind") == 2, F.col("first"))).alias("own"), F.count(F.lit(1)).alias("c")).where("c > 1")
    earliest = F.when(F.col("kind") == 0, F.col("least")).when(F.col("kind") == 1, F.col("own")).otherwise(F.col("long"))
    return rows.join(least, group).where(earliest < F.col("first")).select("h1", "h2")


def _within_an_edit(keys: DataFrame, lines: DataFrame) -> DataFrame:
    """<h1, h2> of lines with an earlier one within an edit. `keys` are those of all distinct lines, `lines` have their words.

    Each round's findings are stored: one plan over all rounds would be planned anew, whole, as each of its stages ends.
    """
    counts = _shared(keys)
    keys = stored(only_asked(keys, counts, ["seg"]).join(counts.select("seg"), "seg"), "keys")
    asked = stored(keys.select("h1", "h2").distinct(), "asked")
    again = only_asked(lines.select("h1", "h2", "raw"), asked, ["h1", "h2"])
    once = again.join(asked, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("raw").alias("raw"))
    words = stored(once.select("h1", "h2", F.split("raw", " ").alias("words")), "words")
    pairs, gone = [stored(_pairs(keys, counts), "pairs")], []
    crowded = keys.join(counts.where(F.col("n") > CROWDED).select("seg"), "seg")
    items = crowded.join(words, ["h1", "h2"])
    while True:
        left = F.slice("words", F.col("from") + 1, F.col("left"))
        items = stored(items.select("h1", "h2", "first", "seg", "role", "base", left.alias("words")), "crowded")
        gone.append(stored(_by_left_out(items.where(F.col("base") <= SHORT)), "left-out"))
        longer = items.where(F.col("base") > SHORT)
        if longer.isEmpty():
            break
        parts = F.array(*_keys(F.col("words"), F.size("words"), F.col("base"), F.col("role"), F.col("seg")))
        split = stored(longer.select("h1", "h2", "first", "words", F.inline(parts)), "split")
        counts = _shared(split)
        pairs.append(stored(_pairs(split, counts), "pairs"))
        items = split.join(counts.where(F.col("n") > CROWDED).select("seg"), "seg")
    found = reduce(DataFrame.unionByName, pairs).distinct()
    other = words.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("words").alias("other"))
    full = found.join(words, ["h1", "h2"]).join(other, ["g1", "g2"])
    near = full.where(banded_distance_within(F.col("words"), F.col("other"))).select(F.col("g1").alias("h1"), F.col("g2").alias("h2"))
    return reduce(DataFrame.unionByName, gone, near).distinct()


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """<place, print, line> of the lines that go; print is the hash of their document's text.

    Lines of fewer than LEAST_WORDS words never go. Null text has no lines. Keys are integers; a null key is earlier than
    others. Lines at the same place of rows that repeat a key are not earlier or later than one another.
    """
    size, none = F.col("n"), F.lit(0).cast("long")
    segments = [*_keys(F.col("words"), size, size, F.lit(0), none), *_keys(F.col("words"), size, size - 1, F.lit(1), none)]
    lines = stored(lines_of(docs, key, text).withColumn("words", F.split("raw", " ")).select("place", "print", "line", "n", "h1", "h2", "raw", *[
        part["seg"].alias(f"s{i}") for i, part in enumerate(segments)]), "lines")
    distinct = stored(lines.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.first("n").alias("n"), *[
        F.first(f"s{i}").alias(f"s{i}") for i in range(4)]), "distinct")

    def known(i: int) -> Column:
        length = size - i // 2
        first, second = _halves(length)
        base, start, left = (second, first, size - first) if i % 2 == 0 else (first, F.lit(0), size - second)
        return F.struct(F.col(f"s{i}").alias("seg"), F.lit(i // 2).alias("role"), base.alias("base"), start.alias("from"), left.alias("left"))

    keys = distinct.select("h1", "h2", "first", F.inline(F.array(*[known(i) for i in range(4)])))
    gone = stored(_within_an_edit(keys, lines).withColumn("gone", F.lit(True)), "gone")
    judged = stored(distinct.select("h1", "h2", "first", (F.col("last") > F.col("first")).alias("again")).join(gone, ["h1", "h2"], "left")
                    .where("again or gone").select("h1", "h2", "first", F.coalesce("gone", F.lit(False)).alias("gone")), "judged")
    asked = only_asked(lines.select("place", "print", "line", "h1", "h2"), judged.select("h1", "h2"), ["h1", "h2"])
    return asked.join(judged, ["h1", "h2"]).where(F.col("gone") | (F.col("place") > F.col("first"))).select("place", "print", "line").distinct()


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The rows of `docs` without the lines that go, and with two counts added: lines, and lines that went.

    Other lines, and texts without such lines (null and empty ones too), stay as they are. A text all of whose lines go
    becomes empty. Texts that lose nothing pass straight through. An empty table gives no rows; own columns that are
    called like the counts are replaced.
    """
    n_lines, n_dropped = counts
    gone = stored(repeated_lines(docs, key, text), "repeated")
    number = ((F.col("place") - F.col("line")) / F.lit(LINES_OF_TEXT).cast("decimal(10,0)")).cast("decimal(20,0)")
    per_text = stored(gone.groupBy(number.alias("key"), "print").agg(F.array_sort(F.collect_list("line")).alias("lines")), "changes")
    mark = free_name(docs, "_key")
    ready = without(docs, *counts).withColumn(mark, F.coalesce(F.col(key).cast("decimal(20,0)"), _number(BEFORE_ALL)))
    asked = per_text.select(F.col("key").alias(mark)).distinct()
    counted = lambda rows: rows.withColumn(n_lines, F.coalesce(_count(text, "\n"), F.lit(0)).cast("long")).withColumn(n_dropped, F.lit(0).cast("long"))
    touched = counted(only_asked(ready, asked, [mark]))
    own = F.xxhash64(F.coalesce(F.col(f"d.{text}"), F.lit("")))
    cut = touched.alias("d").join(per_text.alias("p"), (F.col(f"d.{mark}") == F.col("p.key")) & (own == F.col("p.print")), "left")

    def without_lines(lines: Column) -> Column:
        ends = F.concat(F.array(F.lit(-1)), F.col("p.lines"), F.array(F.size(lines)))
        return let(ends, lambda e: F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda j: F.slice(
            lines, F.get(e, j - 1) + 2, F.get(e, j) - F.get(e, j - 1) - 1))), "\n"))

    # cut once, not once for each line that goes
    changed = F.when(F.col("p.lines").isNull(), F.col(f"d.{text}")).otherwise(let(F.split(F.col(f"d.{text}"), "\n"), without_lines))
    dropped = F.coalesce(F.size("p.lines"), F.lit(0)).cast("long")
    after = cut.select(*[changed.alias(c) if c == text else dropped.alias(c) if c == n_dropped else F.col(f"d.{c}").alias(c)
                         for c in touched.columns if c != mark])
    return counted(only_asked(ready, asked, [mark], inside=False)).drop(mark).unionByName(after)


def without_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their own columns, repeated lines taken out and n_chars brought up to date.

    A document that lost lines and has no word left goes; others stay, also those that had no word before.
    """
    lines, lost = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    cut = drop_lines(docs, key, text, (lines, lost)).where(~((F.col(lost) > 0) & (F.btrim(text, F.lit(BLANK_CHARS)) == "")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(lost) > 0, F.char_length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
