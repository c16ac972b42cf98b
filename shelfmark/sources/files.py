"""Raw delimited files as tables of text columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfmark.fixed import ITEM_COLUMNS, MEASURE_COLUMNS, REFERENCE_COLUMNS


# Where a row lay in its file: comparable, larger for rows read later.
READ_ORDER = "_read"


@dataclass(frozen=True)
class RawTable:
    """``rows`` has every asked-for column as text, null where the file lacks it."""

    rows: DataFrame
    path: str
    found: bool
    missing_columns: tuple[str, ...]


def read_raw(
    spark: SparkSession, path: str, columns: Mapping[str, str], multi_line: bool = False, ordered: bool = False
) -> RawTable:
    """Read ``path`` (a file or a folder) by header name; ``columns`` maps header to column name.

    Doubled quotes are one quote, absent and short fields are null, extra fields and
    blank lines are passed over, nothing is inferred. ``multi_line`` allows line breaks
    inside quotes: where ``has_broken_records`` finds none, files are still read by as many tasks as they have
    splits, otherwise each by one task, as Spark can only find such records from a file's start. All files of a folder
    must have the same header; a different one fails the read. A missing path gives an
    empty table with ``found`` false. ``ordered`` adds ``READ_ORDER``: file, split and place in
    the split, taken on the scan, so no later shuffle changes it.
    """
    reader = (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .option("maxCharsPerColumn", -1)
    )
    try:
        table = reader.csv(path)
        if multi_line and has_broken_records(spark, path):
            table = reader.option("multiLine", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        schema = StructType([StructField(c, StringType()) for c in columns.values()])
        empty = spark.createDataFrame([], schema)
        if ordered:
            empty = empty.withColumn(READ_ORDER, _place(F.lit(""), F.lit(0).cast("long")))
        return RawTable(empty, path, False, ())
    present = set(table.columns)
    place = _place(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias(READ_ORDER)
    rows = table.select(*[
        (F.col(f"`{header}`") if header in present else F.lit(None).cast("string")).alias(name)
        for header, name in columns.items()
    ], *([place] if ordered else []))
    return RawTable(rows, path, True, tuple(h for h in columns if h not in present))


def has_broken_records(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, as the first and the last line of a record with line breaks do.

    The scan has one column and no shuffle, and ends at the first such line. Without one, every line is a record of its own.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def _place(file: Column, start: Column) -> Column:
    return F.struct(file.alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("row"))


def read_reference(spark: SparkSession, path: str, multi_line: bool = False, ordered: bool = False) -> RawTable:
    return read_raw(spark, path, REFERENCE_COLUMNS, multi_line, ordered)


def read_items(spark: SparkSession, path: str, multi_line: bool = False, ordered: bool = False) -> RawTable:
    return read_raw(spark, path, ITEM_COLUMNS, multi_line, ordered)


def read_measures(spark: SparkSession, path: str, multi_line: bool = False, ordered: bool = False) -> RawTable:
    return read_raw(spark, path, MEASURE_COLUMNS, multi_line, ordered)
