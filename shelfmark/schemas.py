"""Table shapes. Column names are those used throughout the package."""

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

REFERENCE = StructType([
    StructField("measure_id", IntegerType(), False),
    StructField("name", StringType()),
    StructField("unit_name", StringType()),
])

ITEMS = StructType([
    StructField("item_id", LongType(), False),
    StructField("item_class", StringType()),
    StructField("description", StringType()),
    StructField("published", DateType()),
])

MEASURES = StructType([
    StructField("row_id", LongType(), False),
    StructField("item_id", LongType(), False),
    StructField("measure_id", IntegerType(), False),
    StructField("amount", DoubleType(), False),
])

PUBLISHED_MEASURE = StructType([
    StructField("type", StringType()),
    StructField("amount", DoubleType()),
])

DOCUMENTS = StructType([
    StructField("item_id", LongType(), False),
    StructField("name", StringType()),
    StructField("nutrients", ArrayType(PUBLISHED_MEASURE)),
])

REQUESTS = StructType([
    StructField("query_id", LongType(), False),
    StructField("query", StringType()),
    StructField("size", IntegerType()),
])

EVENTS = StructType([
    StructField("seq", LongType(), False),
    StructField("payload", StringType()),
])
