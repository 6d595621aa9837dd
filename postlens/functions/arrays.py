"""Column helpers over arrays. All stay inside the row: no shuffle, no Python worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`.

    The start of an aggregate over nothing, which its last step takes: other than a transform, it copies neither value nor result.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping substring count, in bytes: these need no pass to be counted, and a text without the needle no copy."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))
    return F.when(~F.contains(text, needle), F.lit(0)).otherwise(gone / F.octet_length(needle)).cast("long")


def value_counts(items: Column) -> Column:
    """array<string> → array<struct<item, n>>.

    Sorting the array once and cutting it where the value changes counts a document in
    O(n log n) without leaving its row, so term frequencies need no shuffle.
    """

    def cut(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i - 1) != F.get(s, i)))
        return let(starts, lambda b: F.transform(b, lambda st, k: F.struct(
            F.get(s, st).alias("item"), (F.coalesce(F.get(b, k + 1), n) - st).cast("long").alias("n"))))

    empty = F.array().cast("array<struct<item:string,n:bigint>>")
    return let(items, lambda a: F.when(F.size(a) > 0, let(F.sort_array(a), cut)).otherwise(empty))


def value_counts_placed(items: Column) -> Column:
    """As `value_counts`, with `first`, the 0-based first index of each value."""
    pairs = F.sort_array(F.transform(items, lambda t, i: F.struct(t.alias("item"), i.alias("at"))))

    def cut(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda p, i: F.when((i == 0) | (F.get(s, i - 1)["item"] != p["item"]), i)),
            lambda i: i.isNotNull(),
        )
        return let(starts, lambda b: F.transform(b, lambda st, k: F.struct(
            F.get(s, st)["item"].alias("item"),
            (F.coalesce(F.get(b, k + 1), F.size(s)) - st).cast("long").alias("n"),
            F.get(s, st)["at"].alias("first"),
        )))

    return let(pairs, cut)


def last_wins(pairs: Column) -> Column:
    """array<struct<feature, value>> → same, keeping the last value of each feature.

    Where a name repeats, names are sorted with their places and the last of each run stays:
    O(n log n) however many repeat.
    """

    def resolve(ps: Column) -> Column:
        placed = F.sort_array(F.transform(ps, lambda p, i: F.struct(p["feature"].alias("feature"), i.alias("at"))))
        lasts = let(placed, lambda s: F.filter(s, lambda x, k: ~F.coalesce(F.get(s, k + 1)["feature"] == x["feature"], F.lit(False))))
        return F.transform(lasts, lambda x: F.get(ps, x["at"]))

    def several(ps: Column) -> Column:
        names = F.transform(ps, lambda p: p["feature"])
        return F.when(F.size(F.array_distinct(names)) == F.size(ps), ps).otherwise(resolve(ps))

    return let(pairs, several)


def word_ngrams(words: Column, n: int, fixed: bool = False) -> Column:
    """Space-joined n-grams. By default the last one is left out; `fixed` includes it."""
    last = F.size(words) - n + (1 if fixed else 0)
    if n == 1:
        grams = F.slice(words, 1, last)
    else:
        grams = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.concat_ws(
            " ", *[F.get(words, i + k) for k in range(n)]))
    return F.when(last > 0, grams).otherwise(F.array().cast("array<string>"))


def round_exact(value: Column, digits: int) -> Column:
    """Round a non-negative double by its exact binary value, ties to even, as printf does.

    Spark's own rounding works on the shortest decimal form and so moves some ties. The value
    is split into two halves short enough for exact products with the scale.
    """
    scale = float(10 ** digits)

    def body(x: Column) -> Column:
        big = x * F.lit(134217729.0)  # 2^27 + 1
        high = big - (big - x)
        low = x - high
        r = F.floor(x * scale).cast("double")
        side = (high * (2 * scale) - (2 * r + 1)) + low * (2 * scale)
        up = (side > 0) | ((side == 0) & (r % 2 == 1))
        return F.when(up, r + 1).otherwise(r) / scale

    return let(value.cast("double"), body)
