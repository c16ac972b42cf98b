"""Column functions for typo-tolerant term matching.

The distance counts inserting, deleting and replacing a letter and swapping two
neighbours, each as one edit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def allowed_edits(term: Column) -> Column:
    """0 edits for up to two letters, 1 for three to five, 2 beyond."""
    n = F.length(term)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def plain_distance(a: Column, b: Column) -> Column:
    """Distance without swaps, -1 beyond 4: two edits are at most four when a swap is two."""
    return F.levenshtein(a, b, 4)


def edit_count(a: Column, b: Column, plain: Column) -> Column:
    """0, 1 or 2 edits, null beyond; ``plain`` is ``plain_distance(a, b)``.

    A swap counts two in the plain distance, so only pairs above it by the right amount
    are tried with swaps. A swap keeps the length and the letters, which is looked at first. A swap
    undoes itself, so two swaps lead from one term to the other if one swap of each gives the same.
    """
    apart = F.abs(F.length(a) - F.length(b))
    one_swap = (apart == 0) & (_strangers(a, b) == 0) & F.array_contains(_swaps(a), b)
    swap_and_edit = (apart <= 1) & (
        F.exists(_swaps(a), lambda s: _near(s, b)) | F.exists(_swaps(b), lambda s: _near(a, s))
    )
    two_swaps = (apart == 0) & (_strangers(a, b) == 0) & F.arrays_overlap(_swaps(a), _swaps(b))
    return (
        F.when(plain == 0, 0)
        .when(plain == 1, 1)
        .when(plain == 2, F.when(one_swap, 1).otherwise(2))
        .when((plain > 2) & (_strangers(a, b) <= 1) & (_strangers(b, a) <= 1) & _same_letters(a, b) & (swap_and_edit | two_swaps), 2)
    )


def drop_letters(term: Column, i: Column, j: Column) -> Column:
    """``term`` without letters ``i`` and ``j`` (one if equal, none if both are 0, as pieces of negative length are empty)."""
    head, tail = F.substring(term, F.lit(1), i - 1), F.substring(term, j + 1, F.length(term))
    return F.concat(head, F.substring(term, i + 1, j - i - 1), tail)


def segment(length: Column, s: Column, parts: int) -> tuple[Column, Column]:
    """(start, size) of segment ``s`` when ``length`` letters are cut into ``parts``."""
    start = F.floor(length * s / parts).cast("int")
    end = F.floor(length * (s + 1) / parts).cast("int")
    return start + 1, end - start


def _swap_at(term: Column, i: Column) -> Column:
    return F.concat(
        F.substring(term, F.lit(1), i - 1),
        F.substring(term, i + 1, F.lit(1)),
        F.substring(term, i, F.lit(1)),
        F.substring(term, i + 2, F.length(term)),
    )


def _swaps(term: Column) -> Column:
    """Every result of swapping two neighbours; empty for terms under two letters."""
    steps = F.sequence(F.lit(1), F.greatest(F.length(term) - 1, F.lit(1)))
    return F.when(F.length(term) >= 2, F.transform(steps, lambda i: _swap_at(term, i))).otherwise(
        F.array().cast("array<string>")
    )


def _strangers(a: Column, b: Column) -> Column:
    """How many letters of ``a`` do not occur in ``b``."""
    return F.length(F.call_function("translate", a, b, F.lit("")))


def _same_letters(a: Column, b: Column) -> Column:
    """Whether the letters in sorted order differ by at most one letter exchanged for another."""
    def letters(term: Column) -> Column:
        return F.array_join(F.sort_array(F.split(term, "")), "")

    return F.levenshtein(letters(a), letters(b), 2) >= 0


def _near(a: Column, b: Column) -> Column:
    # With a threshold, levenshtein answers -1 beyond it.
    return F.levenshtein(a, b, 1) >= 0
