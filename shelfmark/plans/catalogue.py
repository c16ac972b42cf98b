"""Whole jobs over a folder of raw files: load, report, rebuild."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.fixed import INDEXED_CLASS, MEASURE_NAMES, REPORT_HEADING, REPORT_IDS, REPORT_TITLES
from shelfmark.operators import quality
from shelfmark.operators.documents import build_documents, of_class, write_documents
from shelfmark.operators.index import SearchIndex, save_index
from shelfmark.operators.ingest import (
    judge_items,
    judge_measures,
    load_counters,
    load_funnel,
    load_items,
    load_measures,
    load_reference,
)
from shelfmark.operators.search import search
from shelfmark.operators.skew import latest
from shelfmark.session import written
from shelfmark.sources.files import READ_ORDER, RawTable, read_items, read_measures, read_reference

FILES = {"items": "food.csv", "measures": "food_nutrient.csv", "reference": "nutrient.csv"}


@dataclass(frozen=True)
class Catalogue:
    reference: DataFrame
    items: DataFrame
    measures: DataFrame
    documents: DataFrame
    index: SearchIndex

    def search(self, requests: DataFrame, **options) -> DataFrame:
        """(query_id, rank, doc_id, score, name, nutrients)."""
        return search(requests, self.index, self.documents.withColumnRenamed("item_id", "doc_id"), **options)


@dataclass(frozen=True)
class RawCatalogue:
    items: RawTable
    measures: RawTable
    reference: RawTable


def read_catalogue(
    spark: SparkSession, folder: str, multi_line: bool = True, ordered: bool = False
) -> RawCatalogue:
    at = {name: f"{folder.rstrip('/')}/{file}" for name, file in FILES.items()}
    return RawCatalogue(
        read_items(spark, at["items"], multi_line, ordered),
        read_measures(spark, at["measures"], multi_line, ordered),
        read_reference(spark, at["reference"], multi_line, ordered),
    )


def load_catalogue(spark: SparkSession, folder: str, target: str, multi_line: bool = True) -> Catalogue:
    """Read, check, deduplicate and write the tables, then the documents and their search index.

    Everything below ``target`` is replaced, so running it again is a reset and rebuild.
    Of rows with the same key the last one read is kept: the last of the last file by name.
    """
    raw = read_catalogue(spark, folder, multi_line, ordered=True)
    reference = _one_per_key(load_reference(raw.reference.rows), "measure_id")
    items = _one_per_key(load_items(raw.items.rows), "item_id")
    reference = written(reference, f"{target}/reference")
    items = written(items, f"{target}/items")
    measures = written(
        _one_per_key(load_measures(raw.measures.rows, items), "row_id"), f"{target}/measures"
    )
    # Loaded classes are trimmed, so the plain comparison is right and reaches the scan.
    write_documents(build_documents(items, measures, trim_class=False), f"{target}/documents")
    documents = spark.read.parquet(f"{target}/documents")
    index = save_index(documents, "item_id", "name", f"{target}/index")
    return Catalogue(reference, items, measures, documents, index)


def counters(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    raw = read_catalogue(spark, folder, multi_line)
    judged = judge_items(raw.items.rows)
    return load_counters(judged, judge_measures(raw.measures.rows, judged.where("reject_reason IS NULL")))


def funnel(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    raw = read_catalogue(spark, folder, multi_line)
    return load_funnel(judge_measures(raw.measures.rows, load_items(raw.items.rows)))


def quality_checks(
    spark: SparkSession, folder: str, multi_line: bool = True, max_rows: int | None = None, fraction: float | None = None
) -> DataFrame:
    """All checks over the three files; a missing or unreadable file is an issue of its source.

    ``max_rows`` or ``fraction`` limit the rows of items and measures looked at, as in ``quality.scanned``.

    The checks of a source are computed here, a handful of rows each, as only reading a file shows
    whether it can be read.
    """
    item_source, measure_source, reference_source = quality.SOURCES
    at = {name: f"{folder.rstrip('/')}/{file}" for name, file in FILES.items()}
    parts = [
        (at["items"], read_items, item_source, lambda t: quality.item_checks(quality.scanned(t.rows, max_rows, fraction))),
        (at["measures"], read_measures, measure_source, lambda t: quality.measure_checks(quality.scanned(t.rows, max_rows, fraction))),
        (at["reference"], read_reference, reference_source, lambda t: quality.reference_checks(t.rows, t.missing_columns)),
    ]
    checks = [_checked(spark, lambda read=read, path=path: read(spark, path, multi_line), source, build) for path, read, source, build in parts]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


def _checked(spark: SparkSession, read: Callable[[], RawTable], source: str, build: Callable[[RawTable], DataFrame]) -> DataFrame:
    try:
        table = read()
        if not table.found:
            return quality.unreadable_source(spark, source, f"File not found: {table.path}")
        checks = build(table)
        return spark.createDataFrame(checks.collect(), checks.schema)
    except (PySparkException, Py4JJavaError) as error:
        return quality.unreadable_source(spark, source, f"Error reading {source} CSV: {error}")


def quality_report(checks: DataFrame) -> str:
    """The report as text. ``checks`` has a row per check, so it is small."""
    lines = quality.report_lines(checks).orderBy("position").collect()
    summary = quality.summary_text(checks).first()
    text = [
        REPORT_HEADING,
        "",
        REPORT_IDS % sorted(MEASURE_NAMES),
        "",
        f"Has issues: {summary['has_issues']}",
        "",
        f"Summary: {summary['summary']}",
    ]
    for source, title in REPORT_TITLES.items():
        own = [f"  - {row['line']}" for row in lines if row["source"] == source]
        text += ["", title, *(own or ["  (none)"])]
    return "\n".join(text)


def write_quality_report(checks: DataFrame, path: str) -> str:
    """Save the report as a text file in the folder ``path`` and return it."""
    text = quality_report(checks)
    checks.sparkSession.createDataFrame([(text,)], "value STRING").coalesce(1).write.mode("overwrite").text(path)
    return text


def table_counts(
    items: DataFrame, measures: DataFrame, item_class: str = INDEXED_CLASS, trim_class: bool = True
) -> DataFrame:
    """One row: items, items of the class, measures."""
    n_measures = measures.agg(F.count(F.lit(1)).alias("n")).scalar()
    return items.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(of_class("item_class", item_class, trim_class)).alias("class_items"),
    ).select("items", "class_items", n_measures.alias("measures"))


def _one_per_key(table: DataFrame, key: str) -> DataFrame:
    """``table`` with the last row read of each key."""
    rest = [c for c in table.columns if c not in (key, READ_ORDER)]
    return latest(table, key, READ_ORDER).select(key, *rest)
