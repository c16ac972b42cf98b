"""Load, counters, funnel and quality checks from one reading of each raw table.

What can be said of a row by itself is counted while the row is written, with ``DataFrame.observe``; what needs all rows of a key is counted
where the rows of a key come together for the load anyway. An observed count stands above no shuffle but in the stage that
writes, as only there a task that is run again, or whose output is lost, counts once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.fixed import INDEXED_CLASS, MEASURE_NAMES
from shelfmark.functions.parsing import blank_to_null, clean_text, safe_double, safe_int
from shelfmark.operators import quality
from shelfmark.operators.ingest import judge_items
from shelfmark.operators.skew import with_membership
from shelfmark.session import scratch_dir, written
from shelfmark.sources.files import READ_ORDER


@dataclass(frozen=True)
class Loaded:
    """The tables that were loaded, and three reports with the columns of ``load_counters``, ``load_funnel`` and the checks."""

    reference: DataFrame
    items: DataFrame
    measures: DataFrame
    counters: DataFrame
    funnel: DataFrame
    checks: DataFrame


def load_observed(
    raw_items: DataFrame,
    raw_measures: DataFrame,
    raw_reference: DataFrame,
    target: str,
    item_class: str = INDEXED_CLASS,
    mapping: Mapping[int, str] = MEASURE_NAMES,
    missing_columns: Sequence[str] = (),
) -> Loaded:
    """Writes reference, items and measures below ``target``, of rows with one key the last one read, and reports on the raw tables.

    The raw tables have the columns of the readers, text all of them; ``missing_columns`` are required ones that the reference file lacks.
    Without ``READ_ORDER`` any row of a key may be kept. No items leave the measures' counters at zero, as they are not loaded then.
    """
    items, item_counts = _items(raw_items, target, item_class)
    measures, measure_counts = _measures(raw_measures, items, target, mapping)
    reference, reference_counts = _reference(raw_reference, target, mapping, missing_columns)
    any_item = item_counts["distinct_ids"] > 0
    spark = raw_items.sparkSession
    counters = [
        ("items", item_counts["inserted"], item_counts["skipped"], item_counts["distinct_ids"]),
        ("measures", measure_counts["known_item"], measure_counts["listed_measure"] - measure_counts["known_item"], measure_counts["to_insert"])
        if any_item else ("measures", 0, 0, 0),
    ]
    m = measure_counts
    funnel = [(m["total_rows"], m["listed_measure"], m["valid_amount"], m["known_item"], m["known_item"] - m["to_insert"], m["to_insert"], m["listed_measure"] - m["to_insert"])]
    parts = zip((item_counts, measure_counts, reference_counts), quality.SOURCES, (quality.ITEM_LABELS, quality.MEASURE_LABELS, quality.REFERENCE_LABELS), strict=True)
    checks = [quality.check_rows(_one_row(spark, {c: counts[c] for c in labels}), source, labels) for counts, source, labels in parts]
    return Loaded(
        reference, items, measures,
        spark.createDataFrame(counters, "source STRING, inserted BIGINT, skipped BIGINT, distinct_ids BIGINT"),
        spark.createDataFrame(
            funnel, "total_rows BIGINT, listed_measure BIGINT, valid_amount BIGINT, known_item BIGINT, duplicate_row_ids BIGINT, to_insert BIGINT, skipped BIGINT"
        ),
        checks[0].unionByName(checks[1]).unionByName(checks[2]),
    )


def _items(raw: DataFrame, target: str, item_class: str) -> tuple[DataFrame, dict[str, int]]:
    text, clean = F.coalesce("description", F.lit("")), clean_text("description")
    rows = judge_items(raw, item_class, keep={"_padded": (clean != "") & (clean != text)})
    of_class = ~F.col("reject_reason").eqNullSafe("other_class")
    kept, seen = _observed(
        rows, f"{target}/judged_items",
        {
            "inserted": F.count_if(F.col("reject_reason").isNull()),
            "skipped": F.count_if(F.col("reject_reason").isNotNull()),
            "class_rows": F.count_if(of_class),
            "bad_ids": F.count_if(of_class & F.col("item_id").isNull()),
            "empty_descriptions": F.count_if(of_class & (F.col("description") == "")),
            "padded_descriptions": F.count_if(of_class & F.col("_padded")),
        },
        lambda df: df.where("reject_reason IS NULL").drop("reject_reason", "_padded"),
    )
    return _folded(kept, "item_id", target, "items", seen)


def _measures(raw: DataFrame, items: DataFrame, target: str, mapping: Mapping[int, str]) -> tuple[DataFrame, dict[str, int]]:
    listed = F.coalesce(F.col("measure_id").isin(list(mapping)), F.lit(False))
    typed = raw.select(
        safe_int("row_id").alias("row_id"), safe_int("item_id").alias("item_id"), safe_int("measure_id").alias("measure_id"),
        safe_double("amount").alias("amount"), (clean_text("amount") == "").alias("_empty"), *_order(raw),
    )
    amount, valid = F.col("amount").isNotNull(), listed & F.col("amount").isNotNull() & F.col("row_id").isNotNull()
    kept, seen = _observed(
        typed, f"{target}/judged_measures",
        {
            "total_rows": F.count(F.lit(1)),
            "listed_measure": F.count_if(listed),
            "valid_amount": F.count_if(listed & amount),
            "empty_amounts": F.count_if(listed & F.col("_empty")),
            "bad_amounts": F.count_if(listed & ~F.col("_empty") & ~amount),
            "bad_item_ids": F.count_if(valid & F.col("item_id").isNull()),
        },
        lambda df: df.where(valid).drop("_empty").withColumn("measure_id", F.col("measure_id").cast("int")),
    )
    # A listed measure has a valid id by definition; the line is kept for its shape.
    seen["bad_measure_ids"] = 0
    known = with_membership(kept, items, "item_id", "_loaded")
    return _folded(known, "row_id", target, "measures", seen, F.col("_loaded"))


def _reference(raw: DataFrame, target: str, mapping: Mapping[int, str], missing: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    typed = raw.select(
        safe_int("measure_id").alias("measure_id"), blank_to_null("name").alias("name"), blank_to_null("unit_name").alias("unit_name"), *_order(raw)
    )
    table, seen = _folded(typed, "measure_id", target, "reference", {}, F.col("measure_id").isin(list(mapping)))
    seen["missing_columns"] = int(bool(missing) and seen["rows"] > 0)
    return table.withColumn("measure_id", F.col("measure_id").cast("int")), seen


def _folded(rows: DataFrame, key: str, target: str, name: str, seen: dict[str, int], loaded: Column | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The last row of each key among those ``loaded``, written; adds counts over all rows of a key to ``seen``."""
    loaded = F.coalesce(loaded, F.lit(False)) if loaded is not None else F.lit(True)
    rest = [c for c in rows.columns if c not in (key, READ_ORDER, "_loaded")]
    order = F.col(READ_ORDER) if READ_ORDER in rows.columns else F.lit(0)
    row = F.when(loaded, F.struct(*rest))
    keys = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(loaded).alias("_known"),
        F.max_by(row, F.when(loaded, F.struct(order.isNotNull(), order))).alias("_row"),
    )
    there = F.col(key).isNotNull()
    table, found = _observed(
        keys, f"{target}/{name}",
        {
            "rows": F.coalesce(F.sum("_n"), F.lit(0)),
            "bad_ids": F.coalesce(F.sum(F.when(~there, F.col("_n"))), F.lit(0)),
            "duplicate_ids": F.count_if(there & (F.col("_n") > 1)),
            "known_item": F.coalesce(F.sum(F.when(there, F.col("_known"))), F.lit(0)),
            "to_insert": F.count_if(there & (F.col("_known") > 0)),
            "distinct_ids": F.count_if(there),
        },
        lambda df: df.where(there & (F.col("_known") > 0)).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]),
    )
    return table, found | seen


def _observed(rows: DataFrame, path: str, metrics: dict[str, Column], then) -> tuple[DataFrame, dict[str, int]]:
    """``then(rows)`` written to ``path``, and the metrics over ``rows`` seen on the way."""
    observation = Observation()
    table = written(then(rows.observe(observation, *[m.alias(name) for name, m in metrics.items()])), path)
    found = observation.get
    return table, {name: found.get(name) or 0 for name in metrics}


def _one_row(spark, counts: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"`{c}` BIGINT" for c in counts))


def _order(raw: DataFrame) -> list[str]:
    return [READ_ORDER] if READ_ORDER in raw.columns else []


def scratch_load(raw_items: DataFrame, raw_measures: DataFrame, raw_reference: DataFrame, **options) -> Loaded:
    """``load_observed`` into the cluster's scratch folder."""
    return load_observed(raw_items, raw_measures, raw_reference, scratch_dir(raw_items.sparkSession), **options)
