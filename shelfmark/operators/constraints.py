"""Key checks as reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n) for every key held by more than one row."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def null_counts(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls) for columns that must not be null, one pass."""
    totals = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns
    ])))


def orphan_keys(child: DataFrame, foreign_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(foreign_key, n) for referenced keys the parent lacks; counted before the join."""
    counts = child.where(F.col(foreign_key).isNotNull()).groupBy(foreign_key).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.select(F.col(parent_key).alias(foreign_key))
    return counts.join(parents, foreign_key, "left_anti")


def restricted_deletes(keys: DataFrame, key: str, child: DataFrame, foreign_key: str) -> DataFrame:
    """(key, references): keys that may not be deleted because rows still refer to them."""
    counts = child.groupBy(F.col(foreign_key).alias(key)).agg(F.count(F.lit(1)).alias("references"))
    return counts.join(keys.select(key).distinct(), key, "left_semi")
