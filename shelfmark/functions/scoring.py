"""BM25 as column functions.

Lengths are exact and statistics cover the whole catalogue, so scores can differ in
the last digits from an engine that stores lengths in a byte or scores per shard. The
set of matches and the order among them are what is kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.fixed import BM25_B, BM25_K1


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def saturation(freq: Column, length: Column, average: Column) -> Column:
    """The frequency part, including the factor k1 + 1."""
    norm = F.lit(1 - BM25_B) + F.lit(BM25_B) * length / average
    return F.lit(BM25_K1 + 1) * freq / (freq + F.lit(BM25_K1) * norm)
