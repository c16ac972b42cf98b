"""Pairs of a searched term and the catalogue terms within its allowed edits.

The two lists are joined on keys and the pairs compared exactly:

- a term under ``LONG_TERM`` letters is keyed by itself with up to as many letters
  dropped as edits are allowed. Two terms within that distance share such a key: dropping
  the letters an edit touches (one of the two for a swap) makes both equal.
  For as many searched terms as a task may hold, these keys are numbers, made and looked up a column at a time.
- a longer one is cut into five segments. Two edits touch at most four of them, as a
  swap touches two at most, so one segment stands whole in the other term, moved by at
  most two letters. That is fewer keys than all ways to drop two letters.

Keys are made by exploding positions and cutting the term, which runs as generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.edits import allowed_edits, drop_letters, edit_count, plain_distance, segment
from shelfmark.operators.arrays import pairs_of_dropped
from shelfmark.operators.skew import fits_broadcast
from shelfmark.session import spread

LONG_TERM = 16
SEGMENTS = 5

# Searched terms whose keys every task may hold, up to some hundred of 16 bytes each.
ARRAY_TERMS = 50_000

# Term lengths from here on count as one, so a list of lengths has at most this many entries.
LONGEST = 255


def query_keys(words: DataFrame, term: str = "qterm") -> tuple[DataFrame, DataFrame]:
    """``words`` with a row per key in ``_key``: those keyed by dropped letters, and those keyed by pieces."""
    n = F.length(term)
    short = _dropped(words.where(n < LONG_TERM), term, F.when(n <= 2, 0).otherwise(n), n >= 6)
    start, size = segment(n, F.col("_i"), SEGMENTS)
    piece = _piece_key(n, F.col("_i"), F.substring(term, start, size))
    long = words.where(n >= LONG_TERM).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)))).withColumn("_key", piece)
    return short, long.drop("_i")


def term_keys(terms: DataFrame, term: str = "term") -> tuple[DataFrame, DataFrame]:
    """As ``query_keys`` for catalogue terms: any term within the allowed edits shares a key.

    A partner may have two letters more or fewer, so both kinds of key are made for
    lengths around ``LONG_TERM``; a piece is made for each partner length, segment and
    shift.
    """
    n = F.length(term)
    short = _dropped(terms.where(n <= LONG_TERM + 1), term, F.when(n == 1, 0).otherwise(n), n >= 4)
    m = F.col("_i")
    partner = n + F.floor(m / (5 * SEGMENTS)).cast("int") - 2
    s = F.floor(m / 5).cast("int") % SEGMENTS
    start, size = segment(partner, s, SEGMENTS)
    cut = terms.where(n >= LONG_TERM - 2).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(5 * SEGMENTS * 5 - 1)))).select(
        *terms.columns, partner.alias("_partner"), s.alias("_s"), (start + m % 5 - 2).alias("_start"), size.alias("_size")
    )
    fits = cut.where((F.col("_partner") >= LONG_TERM) & (F.col("_start") >= 1) & (F.col("_start") + F.col("_size") - 1 <= n))
    piece = _piece_key(F.col("_partner"), F.col("_s"), F.substring(term, F.col("_start"), F.col("_size")))
    return short, fits.select(*terms.columns, piece.alias("_key"))


def fuzzy_terms(
    words: DataFrame, terms: DataFrame, max_expansions: int | None = None
) -> DataFrame:
    """(qterm, term, df, edits, weight) for every term within the allowed edits of ``qterm``.

    With ``max_expansions`` each searched term keeps so many of the closest terms, weight first,
    then term order.
    """
    wanted = words.select("qterm").distinct()
    # Few bytes make many keys, so the terms are spread before they are expanded.
    near = spread(_near_lengths(terms, wanted).select("term", "df"), "term")
    q, t = F.col("qterm"), F.col("term")
    # Pairs share several keys, so each is compared once, and each step through ``explode``: as a plain column
    # it would be computed again by the filter on it.
    # Each kind of key is joined by itself: code for both in one stage is too long to be compiled by the JVM.
    allowed = F.abs(F.length(q) - F.length(t)) <= allowed_edits(q)
    made, asked = term_keys(near), query_keys(wanted)
    if fits_broadcast(wanted, ARRAY_TERMS):
        searched = [r["qterm"] for r in wanted.where(F.length(q) < LONG_TERM).collect()]
        short = pairs_of_dropped(near.where(F.length(t) <= LONG_TERM + 1), searched, LONG_TERM + 1, 6, 4).where(allowed)
    else:
        short = made[0].join(asked[0], "_key").where(allowed).select("qterm", "term", "df")
    long = made[1].join(asked[1], "_key").where(allowed).select("qterm", "term", "df")
    candidates = short.unionByName(long).distinct()
    pairs = (
        candidates.select("*", F.explode_outer(F.array(plain_distance(q, t))).alias("_plain"))
        .where("_plain >= 0")
        .select("*", F.explode_outer(F.array(edit_count(q, t, F.col("_plain")))).alias("edits"))
        .where(F.col("edits") <= allowed_edits(q))
        .select("qterm", "term", "df", "edits")
    )
    weighted = pairs.withColumn("weight", F.lit(1.0) - F.col("edits") / F.least(F.length(q), F.length(t)))
    if max_expansions is None:
        return weighted
    best = Window.partitionBy("qterm").orderBy(F.desc("weight"), F.asc("term"))
    return weighted.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= max_expansions).drop("_r")


def _dropped(rows: DataFrame, term: str, letters: Column, two: Column) -> DataFrame:
    """A key for the term itself and for each of its ``letters`` dropped, or two of them where ``two``."""
    i, j = F.col("_i"), F.col("_j")
    last = F.when((i > 0) & two, F.length(term)).otherwise(i)
    return (
        rows.withColumn("_i", F.explode(F.sequence(F.lit(0), letters)))
        .withColumn("_j", F.explode(F.sequence(i, last)))
        .withColumn("_key", drop_letters(F.col(term), i, j))
        .drop("_i", "_j")
    )


def _piece_key(length: Column, s: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit(""), length, s, text)


def _near_lengths(terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """Terms whose length is within two letters of some searched term."""
    shifts = F.array(*[F.lit(i) for i in range(-2, 3)])
    near = F.explode(F.transform(shifts, lambda i: F.least(F.length("qterm") + i, F.lit(LONGEST))))
    lengths = wanted.select(near.alias("n")).agg(F.collect_set("n").alias("l")).scalar()
    return terms.where(F.array_contains(lengths, F.least(F.length("term"), F.lit(LONGEST))))
