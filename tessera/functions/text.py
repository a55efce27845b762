"""Text normalization and string similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.bind import let


def normalize_text(text: Column) -> Column:
    """Lower case, every run of other than letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def token_sort_key(text: Column) -> Column:
    """The normalized words of a text in order, joined by spaces."""
    return F.array_join(F.array_sort(F.array_remove(F.split(normalize_text(text), " "), "")), " ")


def _letters(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings.

    One pass over ``a``; the state is the dynamic programme's row over ``b``.
    """

    def over(letters: Column) -> Column:
        columns = F.when(F.size(letters) > 0, F.sequence(F.lit(1), F.size(letters))).otherwise(F.array().cast("array<int>"))
        start = F.concat(F.array(F.lit(0)), F.transform(letters, lambda _: F.lit(0)))

        def next_row(row: Column, x: Column) -> Column:
            def cell(acc: Column, j: Column) -> Column:
                best = F.when(F.get(letters, j - 1) == x, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.element_at(acc, -1)))
                return F.concat(acc, F.array(best))

            return F.aggregate(columns, F.array(F.lit(0)), cell)

        return F.element_at(F.aggregate(_letters(a), start, next_row), -1)

    return let(_letters(b), over)


def indel_ratio(a: Column, b: Column) -> Column:
    """Indel similarity of two strings, 0 to 100: 200 * LCS / (|a| + |b|); two empty strings are equal."""

    def ratio(pair: Column) -> Column:
        x, y = pair["a"], pair["b"]
        return F.when(x == y, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(x, y) / (F.length(x) + F.length(y)))

    return let(F.struct(a.alias("a"), b.alias("b")), ratio)


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio of two strings of these lengths is higher."""
    return F.coalesce(F.try_divide(F.lit(200.0) * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)), F.lit(100.0))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Indel similarity of the two texts' sorted words."""
    return indel_ratio(token_sort_key(a), token_sort_key(b))


def token_coverage(a: Column, b: Column) -> Column:
    """The share of the words of ``a`` that ``b`` has, too."""
    words = lambda t: F.array_distinct(F.array_remove(F.split(normalize_text(t), " "), ""))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(words(a)), F.lit(1))
