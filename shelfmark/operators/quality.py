"""Data-quality checks over the raw tables, one row per check.

Each source is read once: rows are grouped by their key with the counts carried along,
and duplicates are the keys whose group has more than one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.fixed import INDEXED_CLASS, MEASURE_NAMES, REPORT_ISSUES, REPORT_NO_ISSUES
from shelfmark.functions.parsing import clean_text, safe_double, safe_int

# Check name -> label of its report line, in report order. Fixed values.
ITEM_LABELS = {
    "class_rows": "Foundation_food rows in scan (data_type=foundation_food)",
    "duplicate_ids": "Duplicate fdc_id among foundation_food",
    "bad_ids": "Empty or non-integer fdc_id",
    "empty_descriptions": "Empty description",
    "padded_descriptions": "Leading/trailing whitespace in description",
}
MEASURE_LABELS = {
    "empty_amounts": "Empty amount (among 4 nutrients we care about)",
    "bad_amounts": "Non-numeric amount (among 4 nutrients we care about)",
    "duplicate_ids": "Duplicate id (among valid-amount rows for those nutrients)",
    "bad_item_ids": "Empty or non-integer fdc_id (among valid-amount rows)",
    "bad_measure_ids": "Empty or non-integer nutrient_id (among valid-amount rows)",
}
REFERENCE_LABELS = {
    "missing_columns": "Missing required columns (id, name, unit_name)",
    "duplicate_ids": "Duplicate nutrient id",
    "bad_ids": "Empty or non-integer id",
}
SOURCES = ("food", "food_nutrient", "nutrient")


def scanned(raw: DataFrame, max_rows: int | None = None, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """The rows that a check looks at: all by default.

    ``max_rows`` stops before so many rows, so one less is looked at; none and 0 are no cap. ``fraction`` takes a random share of all
    rows, the same one for a ``seed``; it is read in every task, while a cap ends with the first rows found.
    """
    rows = raw if fraction is None else raw.sample(fraction=fraction, seed=seed)
    return rows.limit(max_rows - 1) if max_rows else rows


def item_checks(raw: DataFrame, item_class: str = INDEXED_CLASS, source: str = SOURCES[0]) -> DataFrame:
    text = F.coalesce("description", F.lit(""))
    clean = clean_text("description")
    groups = (
        raw.where(clean_text("item_class") == item_class)
        .groupBy(safe_int("item_id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(clean == "").alias("empty"),
            F.count_if((clean != "") & (clean != text)).alias("padded"),
        )
    )
    totals = groups.agg(
        _sum("n").alias("class_rows"),
        F.count_if(F.col("id").isNotNull() & (F.col("n") > 1)).alias("duplicate_ids"),
        _sum(F.when(F.col("id").isNull(), F.col("n"))).alias("bad_ids"),
        _sum("empty").alias("empty_descriptions"),
        _sum("padded").alias("padded_descriptions"),
    )
    return check_rows(totals, source, ITEM_LABELS)


def reference_checks(
    raw: DataFrame, missing_columns: Sequence[str] = (), source: str = SOURCES[2]
) -> DataFrame:
    """``missing_columns`` are required columns the file lacks; they count only if it has rows."""
    groups = raw.groupBy(safe_int("measure_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    totals = groups.agg(
        F.when(F.lit(bool(missing_columns)) & (_sum("n") > 0), 1).otherwise(0).cast("bigint").alias("missing_columns"),
        F.count_if(F.col("id").isNotNull() & (F.col("n") > 1)).alias("duplicate_ids"),
        _sum(F.when(F.col("id").isNull(), F.col("n"))).alias("bad_ids"),
    )
    return check_rows(totals, source, REFERENCE_LABELS)


def measure_checks(
    raw: DataFrame, mapping: Mapping[int, str] = MEASURE_NAMES, source: str = SOURCES[1]
) -> DataFrame:
    """Listed measures only; a row stops at its first failure, a bad row id is passed over."""
    state = (
        F.when(clean_text("amount") == "", "empty")
        .when(safe_double("amount").isNull(), "bad")
        .when(safe_int("row_id").isNotNull(), "valid")
        .otherwise("no_row_id")
    )
    valid = F.col("state") == "valid"
    groups = (
        raw.where(safe_int("measure_id").isin(list(mapping)))
        .select(state.alias("state"), safe_int("row_id").alias("row_id"), safe_int("item_id").alias("item_id"))
        .groupBy(F.when(valid, F.col("row_id")).alias("id"))
        .agg(
            F.count_if(F.col("state") == "empty").alias("empty"),
            F.count_if(F.col("state") == "bad").alias("bad"),
            F.count_if(valid).alias("n"),
            F.count_if(valid & F.col("item_id").isNull()).alias("no_item"),
        )
    )
    totals = groups.agg(
        _sum("empty").alias("empty_amounts"),
        _sum("bad").alias("bad_amounts"),
        F.count_if(F.col("n") > 1).alias("duplicate_ids"),
        _sum("no_item").alias("bad_item_ids"),
        # A listed measure has a valid id by definition; the line is kept for its shape.
        F.lit(0).cast("bigint").alias("bad_measure_ids"),
    )
    return check_rows(totals, source, MEASURE_LABELS)


def unreadable_source(spark, source: str, message: str) -> DataFrame:
    """The check row of a source that could not be read, for instance ``File not found: path``."""
    return spark.range(1).select(
        F.lit(source).alias("source"),
        F.lit(0).alias("position"),
        F.lit("unreadable").alias("check"),
        F.lit(message).alias("label"),
        F.lit(1).cast("bigint").alias("n"),
        F.lit(True).alias("is_issue"),
    )


def report_lines(checks: DataFrame) -> DataFrame:
    """Adds ``line``: ``label: none`` or ``label: N found``."""
    line = F.when(F.col("check") == "unreadable", F.col("label")).when(
        F.col("n") <= 0, F.concat("label", F.lit(": none"))
    ).otherwise(F.format_string("%s: %d found", "label", "n"))
    return checks.withColumn("line", line)


def summarize(checks: DataFrame) -> DataFrame:
    """(source, issues): how many checks of each source are issues."""
    return checks.groupBy("source").agg(F.count_if("is_issue").alias("issues"))


def summary_text(checks: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """One row (has_issues, summary)."""
    counts = checks.agg(*[
        F.count_if(F.col("is_issue") & (F.col("source") == s)).alias(f"n{i}") for i, s in enumerate(sources)
    ])
    columns = [f"n{i}" for i in range(len(sources))]
    found = reduce(lambda a, b: a | b, [F.col(c) > 0 for c in columns])
    parts = ", ".join(f"{s}=%d" for s in sources)
    return counts.select(
        found.alias("has_issues"),
        F.when(found, F.format_string(REPORT_ISSUES % parts, *columns)).otherwise(REPORT_NO_ISSUES).alias("summary"),
    )


def _sum(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def check_rows(totals: DataFrame, source: str, labels: Mapping[str, str]) -> DataFrame:
    """The one-row ``totals`` turned into a row per check."""
    checks = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("check"),
            F.lit(label).alias("label"),
            F.col(name).alias("n"),
        )
        for i, (name, label) in enumerate(labels.items())
    ])
    # Finding rows of the class is good news; finding none is the issue.
    is_issue = F.when(F.col("check") == "class_rows", F.col("n") <= 0).otherwise(F.col("n") > 0)
    return totals.select(F.lit(source).alias("source"), F.inline(checks)).withColumn("is_issue", is_issue)
