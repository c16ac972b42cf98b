"""Raw text tables to typed tables, with the reason each refused row was refused."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.fixed import INDEXED_CLASS, MEASURE_NAMES
from shelfmark.functions.parsing import blank_to_null, clean_text, safe_date, safe_double, safe_int
from shelfmark.operators.skew import BROADCAST_KEYS, keep_known, with_membership
from shelfmark.sources.files import READ_ORDER


def load_reference(raw: DataFrame, mapping: Mapping[int, str] = MEASURE_NAMES) -> DataFrame:
    """Listed reference rows; blank names and units become null."""
    return raw.select(
        safe_int("measure_id").alias("measure_id"),
        blank_to_null("name").alias("name"),
        blank_to_null("unit_name").alias("unit_name"),
        *_order(raw),
    ).where(_listed(mapping)).withColumn("measure_id", F.col("measure_id").cast("int"))


def judge_items(raw: DataFrame, item_class: str = INDEXED_CLASS, keep: Mapping[str, Column] | None = None) -> DataFrame:
    """Typed items with ``reject_reason`` (null for rows to load). A blank description stays ''.

    ``keep`` are further columns, by name, worked out on the raw ones.
    """
    return raw.select(
        safe_int("item_id").alias("item_id"),
        clean_text("item_class").alias("item_class"),
        clean_text("description").alias("description"),
        safe_date("published").alias("published"),
        *_order(raw),
        *[value.alias(name) for name, value in (keep or {}).items()],
    ).withColumn(
        "reject_reason",
        F.when(F.col("item_class") != item_class, "other_class").when(F.col("item_id").isNull(), "bad_item_id"),
    )


def load_items(raw: DataFrame, item_class: str = INDEXED_CLASS) -> DataFrame:
    return judge_items(raw, item_class).where("reject_reason IS NULL").drop("reject_reason")


def judge_measures(
    raw: DataFrame,
    items: DataFrame,
    mapping: Mapping[int, str] = MEASURE_NAMES,
    broadcast_limit: int = BROADCAST_KEYS,
) -> DataFrame:
    """Typed measures with ``reject_reason``; a row is judged by its first failure.

    The order is: measure not listed, amount, row id, item id, item not loaded.
    """
    typed = typed_measures(raw)
    marked = with_membership(typed, items, "item_id", "_loaded", broadcast_limit)
    return marked.withColumn(
        "reject_reason",
        F.when(~F.coalesce(_listed(mapping), F.lit(False)), "unlisted_measure")
        .when(F.col("amount").isNull(), "bad_amount")
        .when(F.col("row_id").isNull(), "bad_row_id")
        .when(F.col("item_id").isNull(), "bad_item_id")
        .when(~F.col("_loaded"), "unknown_item"),
    ).drop("_loaded")


def load_measures(
    raw: DataFrame,
    items: DataFrame,
    mapping: Mapping[int, str] = MEASURE_NAMES,
    broadcast_limit: int = BROADCAST_KEYS,
) -> DataFrame:
    """The rows ``judge_measures`` finds nothing against, dropped before the join where possible."""
    valid = _listed(mapping)
    for column in ("amount", "row_id", "item_id"):
        valid = valid & F.col(column).isNotNull()
    known = keep_known(typed_measures(raw).where(valid), items, "item_id", broadcast_limit)
    return known.withColumn("measure_id", F.col("measure_id").cast("int"))


def item_counters(judged: DataFrame) -> DataFrame:
    """(source, inserted, skipped, distinct_ids). ``inserted`` counts rows sent, duplicates too."""
    sent = F.col("reject_reason").isNull()
    return judged.agg(
        F.count_if(sent).alias("inserted"),
        F.count_if(~sent).alias("skipped"),
        F.count_distinct(F.when(sent, F.col("item_id"))).alias("distinct_ids"),
    ).select(F.lit("items").alias("source"), "inserted", "skipped", "distinct_ids")


def measure_counters(judged: DataFrame, items: DataFrame) -> DataFrame:
    """As ``item_counters``. Unlisted measures are not skips; without any item all are zero."""
    reason = F.col("reject_reason")
    sent = reason.isNull()
    counted = judged.agg(
        F.count_if(sent).alias("inserted"),
        F.count_if(~sent & (reason != "unlisted_measure")).alias("skipped"),
        F.count_distinct(F.when(sent, F.col("row_id"))).alias("distinct_ids"),
    )
    # One row: an item or none. Without one nothing was sent, and what was refused is no skip.
    any_item = items.select(F.lit(True).alias("any")).limit(1)
    both = counted.join(F.broadcast(any_item), F.lit(True), "left")
    there = F.col("any").isNotNull()
    return both.select(F.lit("measures").alias("source"), *[
        F.when(there, F.col(c)).otherwise(0).alias(c) for c in ("inserted", "skipped", "distinct_ids")
    ])


def load_counters(judged_items: DataFrame, judged_measures: DataFrame) -> DataFrame:
    items = judged_items.where("reject_reason IS NULL")
    return item_counters(judged_items).unionByName(measure_counters(judged_measures, items))


def load_funnel(judged_measures: DataFrame) -> DataFrame:
    """One row: how many measure rows pass each step, one pass over the judged rows."""
    reason = F.coalesce("reject_reason", F.lit("loaded"))
    listed = reason != "unlisted_measure"
    loaded = reason == "loaded"
    counts = judged_measures.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(listed).alias("listed_measure"),
        F.count_if(listed & (reason != "bad_amount")).alias("valid_amount"),
        F.count_if(loaded).alias("known_item"),
        F.count_distinct(F.when(loaded, F.col("row_id"))).alias("to_insert"),
    )
    return counts.select(
        "total_rows",
        "listed_measure",
        "valid_amount",
        "known_item",
        (F.col("known_item") - F.col("to_insert")).alias("duplicate_row_ids"),
        "to_insert",
        (F.col("listed_measure") - F.col("to_insert")).alias("skipped"),
    )


def typed_measures(raw: DataFrame) -> DataFrame:
    """Measures with every value that can be read, null for the others."""
    return raw.select(
        safe_int("row_id").alias("row_id"),
        safe_int("item_id").alias("item_id"),
        safe_int("measure_id").alias("measure_id"),
        safe_double("amount").alias("amount"),
        *_order(raw),
    )


def reject_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reject_reason", F.lit("loaded")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _order(raw: DataFrame) -> list[str]:
    """The column that says in which order rows were read, where the reader added it."""
    return [READ_ORDER] if READ_ORDER in raw.columns else []


def _listed(mapping: Mapping[int, str]) -> Column:
    return F.col("measure_id").isin(list(mapping))
