"""The given tables seen as a catalogue.

Items are parts, measures are line items, the class that is indexed is PROMO. Raw text
tables are derived from the whole tables with column expressions, so every kind of dirty
value occurs; the same expressions are valid in Spark and in ANSI SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.skew import latest

CLASS = "PROMO"
MAPPING = {1: "calories", 2: "protein", 3: "carbs", 4: "fat"}
REFERENCE_IDS = {1: "calories", 2: "protein", 3: "carbs", 4: "fat"}

_PART = "CAST(p_partkey AS STRING)"
RAW_ITEMS = {
    "item_id": f"""CASE WHEN p_size = 7 THEN ' ' || {_PART} || chr(9) WHEN p_size = 8 THEN {_PART} || '.0'
        WHEN p_size = 9 THEN '' WHEN p_size = 10 THEN 'x' || {_PART}
        WHEN p_size = 11 THEN CAST(p_partkey - 1 AS STRING) ELSE {_PART} END""",
    "item_class": "CASE WHEN p_size < 5 THEN '  ' || p_type || chr(9) ELSE p_type END",
    "description": """CASE WHEN p_size = 12 THEN '   ' WHEN p_size = 13 THEN p_name || '  '
        WHEN p_size = 14 THEN '' WHEN p_size = 15 THEN NULL WHEN p_size = 16 THEN chr(9) || p_name
        ELSE p_name END""",
    "published": """CASE WHEN p_size = 17 THEN '2024' WHEN p_size = 18 THEN '2024-1-5' WHEN p_size = 19 THEN 'bad'
        WHEN p_size = 20 THEN '' ELSE '2024-' || lpad(CAST(p_size % 14 AS STRING), 2, '0') || '-'
        || lpad(CAST(p_size % 33 AS STRING), 2, '0') END""",
}

_ROW = "CAST(l_orderkey * 10 + l_linenumber AS STRING)"
_LINE = "CAST(l_linenumber AS STRING)"
_QUANTITY = "CAST(l_quantity AS STRING)"
RAW_MEASURES = {
    "row_id": f"""CASE WHEN l_quantity = 1 THEN ' ' || {_ROW} || ' ' WHEN l_quantity = 2 THEN {_ROW} || '.0'
        WHEN l_quantity = 3 THEN '' WHEN l_quantity = 4 THEN 'x' ELSE {_ROW} END""",
    "item_id": """CASE WHEN l_quantity = 5 THEN NULL WHEN l_quantity = 6 THEN 'abc'
        WHEN l_quantity = 7 THEN CAST(-1 - l_partkey AS STRING) ELSE CAST(l_partkey AS STRING) END""",
    "measure_id": f"CASE WHEN l_quantity = 8 THEN ' ' || {_LINE} || ' ' WHEN l_quantity = 18 THEN 'm' || {_LINE} ELSE {_LINE} END",
    "amount": f"""CASE WHEN l_quantity = 9 THEN '  ' WHEN l_quantity = 10 THEN 'abc'
        WHEN l_quantity = 11 THEN {_QUANTITY} || 'd' WHEN l_quantity = 12 THEN '1e3' WHEN l_quantity = 13 THEN 'nan'
        WHEN l_quantity = 14 THEN 'inf' WHEN l_quantity = 15 THEN '-.5' WHEN l_quantity = 16 THEN '0x1p3'
        WHEN l_quantity = 17 THEN ' 5. ' ELSE {_QUANTITY} END""",
}

RAW_REFERENCE = {
    "measure_id": """CASE WHEN c_mktsegment = 'BUILDING' THEN ' ' || CAST(c_nationkey AS STRING)
        WHEN c_acctbal < 0 THEN 'n' || CAST(c_nationkey AS STRING) ELSE CAST(c_nationkey AS STRING) END""",
    "name": "CASE WHEN c_acctbal > 9000 THEN '  ' ELSE ' ' || c_name END",
    "unit_name": "CASE WHEN c_acctbal > 8000 THEN NULL ELSE c_mktsegment || chr(9) END",
}


def _event(table: str, op: str, id: str) -> str:
    return "'{\"table\":\"" + table + "\",\"op\":\"" + op + "\",\"fdc_id\":' || " + id + " || '}'"


_USER = "CAST(user_id AS STRING)"
PAYLOAD = f"""CASE
    WHEN event_type = 'view' AND value < 5 THEN props
    WHEN event_type = 'view' AND value < 8 THEN 'not json'
    WHEN event_type = 'view' AND value < 10 THEN {_event('', 'INSERT', _USER)}
    WHEN event_type = 'view' AND value < 12 THEN {_event('foods', '', _USER)}
    WHEN event_type = 'view' AND value < 14 THEN {_event('foods', 'INSERT', "'null'")}
    WHEN event_type = 'view' AND value < 16 THEN {_event('foods', 'INSERT', "'\"abc\"'")}
    WHEN event_type = 'view' AND value < 18 THEN {_event('foods', 'INSERT', "'true'")}
    WHEN event_type = 'view' AND value < 20 THEN {_event('foods', 'DELETE', _USER + " || '.7'")}
    WHEN event_type = 'view' THEN {_event('  ', 'INSERT', _USER)}
    WHEN event_type = 'click' THEN {_event('  foods  ', '  DELETE  ', _USER)}
    WHEN event_type = 'error' THEN {_event('foods', 'DELETE', _USER)}
    WHEN event_type = 'signup' THEN {_event('foods', 'INSERT', "'\"' || " + _USER + " || '\"'")}
    ELSE {_event('food_nutrients', 'UPDATE', _USER)} END"""

# Two images of the tables. Brands and flags decide what changed in between.
OLD_ITEMS = "SELECT p_partkey AS item_id, p_type AS item_class, p_name AS description FROM part WHERE p_brand <> 'Brand#4'"
NEW_ITEMS = """SELECT p_partkey AS item_id, CASE WHEN p_brand = 'Brand#3' THEN 'PROMO' WHEN p_brand = 'Brand#5'
    THEN 'SMALL' ELSE p_type END AS item_class, CASE WHEN p_brand = 'Brand#2' THEN p_name || ' (new)'
    ELSE p_name END AS description FROM part WHERE p_brand <> 'Brand#1'"""
OLD_MEASURES = """SELECT row_id, item_id, measure_id, amount FROM measures
    WHERE NOT (l_returnflag = 'A' AND l_linestatus = 'F')"""
NEW_MEASURES = """SELECT row_id, CASE WHEN l_discount = 0 THEN item_id + 1 ELSE item_id END AS item_id, measure_id,
    CASE WHEN l_tax = 0 THEN amount + 1 ELSE amount END AS amount FROM measures
    WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'F')"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _derived(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def raw_items(spark: SparkSession, sf: str) -> DataFrame:
    return _derived(table(spark, sf, "part"), RAW_ITEMS)


def raw_measures(spark: SparkSession, sf: str) -> DataFrame:
    return _derived(table(spark, sf, "lineitem"), RAW_MEASURES)


def raw_reference(spark: SparkSession, sf: str) -> DataFrame:
    return _derived(table(spark, sf, "customer"), RAW_REFERENCE)


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_type").alias("item_class"),
        F.col("p_name").alias("description"),
    )


def measures(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item as a measure; ``seq`` orders the rows of one (item, measure)."""
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("item_id"),
        F.col("l_linenumber").alias("measure_id"),
        F.col("l_quantity").alias("amount"),
        _by_date("l_orderkey").alias("seq"),
    )


def keyed_measures(spark: SparkSession, sf: str) -> DataFrame:
    """One row per row id (order and line number), the latest shipped."""
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_linenumber").alias("measure_id"),
        F.col("l_quantity").alias("amount"),
        "l_returnflag", "l_linestatus", "l_discount", "l_tax",
        _by_date("l_partkey").alias("seq"),
    )
    return latest(rows, "row_id", "seq").drop("seq")


def images(spark: SparkSession, sf: str, measure: DataFrame | None = None) -> dict[str, DataFrame]:
    """Both images of the tables. Who reads both of the measures gives ``keyed_measures`` settled, which are folded for each image otherwise."""
    part, measure = table(spark, sf, "part"), keyed_measures(spark, sf) if measure is None else measure
    return {
        "old_items": spark.sql(OLD_ITEMS.replace("FROM part", "FROM {part}"), part=part),
        "new_items": spark.sql(NEW_ITEMS.replace("FROM part", "FROM {part}"), part=part),
        "old_measures": spark.sql(OLD_MEASURES.replace("FROM measures", "FROM {m}"), m=measure),
        "new_measures": spark.sql(NEW_MEASURES.replace("FROM measures", "FROM {m}"), m=measure),
    }


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, payload) from all events."""
    return table(spark, sf, "events").selectExpr("event_id AS seq", f"{PAYLOAD} AS payload")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, name): long texts."""
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("name"))


def names(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, name): short texts."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"))


# One new measure per event: some without a key, some of unknown items or measures, some with an id of their own.
NEW_MEASURES_BATCH = {
    "row_id": "CASE WHEN value > 20 THEN event_id % 400 END",
    "item_id": "CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN -1 - user_id ELSE user_id END",
    "measure_id": "CAST(CASE WHEN value < 5 THEN 99 WHEN value < 8 THEN NULL ELSE event_id % 25 END AS INT)",
    "amount": "value",
    "seq": "event_id",
}


def measure_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _derived(table(spark, sf, "events"), NEW_MEASURES_BATCH)


# One change of a measure per event: of rows that are there and others, to items and measures that are there and others.
MEASURE_CHANGES = {
    "row_id": "(event_id % 3000) * 10 + 1 + event_id % 7",
    "item_id": "CASE WHEN event_type = 'view' THEN user_id WHEN event_type = 'error' THEN -1 - user_id END",
    "measure_id": "CAST(CASE WHEN value < 5 THEN 99 WHEN value < 20 THEN event_id % 25 END AS INT)",
    "amount": "CASE WHEN value > 30 THEN value END",
    "seq": "event_id",
}


def measure_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _derived(table(spark, sf, "events"), MEASURE_CHANGES)


# Every event tries to insert its user; some have no key, some no order.
INSERTS = {
    "item_id": "CASE WHEN event_type = 'error' THEN NULL ELSE user_id END",
    "seq": "CASE WHEN event_type = 'signup' THEN NULL ELSE event_id END",
}


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query, size): every benchmark text as a request."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(None).cast("int").alias("size")
    )


# One request per distinct part name: two letters swapped, a sign added, the last letter missing.
NAME_REQUESTS = """SELECT min(p_partkey) AS query_id,
    substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3, length(p_name) - 3) || ' +' AS query,
    CAST(10 + length(p_name) AS INT) AS size FROM part GROUP BY p_name"""

# One request per distinct part name as it is being typed: all but the last two letters.
TYPED_REQUESTS = """SELECT min(p_partkey) AS query_id, substr(p_name, 1, length(p_name) - 2) AS query,
    CAST(NULL AS INT) AS size FROM part GROUP BY p_name"""


def name_requests(spark: SparkSession, sf: str, sql: str = NAME_REQUESTS) -> DataFrame:
    return spark.sql(sql.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))


def conversation_requests(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query, size): every turn of every conversation as a request."""
    return table(spark, sf, "conversations").selectExpr(*[f"{e} AS {n}" for n, e in CONVERSATION_REQUESTS.items()])


CONVERSATION_REQUESTS = {
    "query_id": "conv_id * 1000 + turn",
    "query": "CASE WHEN role = 'system' THEN chr(9) || '  ' WHEN role = 'user' THEN '  ' || text || ' - ' ELSE text END",
    "size": "CAST(CASE WHEN turn = 0 THEN NULL WHEN turn = 1 THEN length(text) ELSE turn - 2 END AS INT)",
}


def _by_date(tie: str):
    return F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * 1_000_000_000_000 + F.col(tie)
