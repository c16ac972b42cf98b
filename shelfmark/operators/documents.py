"""One nested document per item, and the shape of search results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.fixed import DEFAULT_SIZE, INDEXED_CLASS, MEASURE_NAMES, PUBLISHED_NAMES
from shelfmark.functions.parsing import clean_text, safe_double
from shelfmark.operators.mutations import upsert
from shelfmark.operators.skew import keep_known

def published_mapping(
    mapping: Mapping[int, str] = MEASURE_NAMES, names: Sequence[str] = PUBLISHED_NAMES
) -> dict[int, str]:
    """The entries of ``mapping`` with an integer id and a publishable name."""
    return {i: n for i, n in mapping.items() if isinstance(i, int) and n in names}


def map_measures(
    measures: DataFrame,
    mapping: Mapping[int, str] = MEASURE_NAMES,
    order: Column | str = "row_id",
    names: Sequence[str] = PUBLISHED_NAMES,
) -> DataFrame:
    """(item_id, measure_id, type, amount): the last amount per item and published measure.

    The list of ids reaches the scan as a filter. Amounts that are null or not numeric
    are dropped, zero is kept.
    """
    known = published_mapping(mapping, names)
    order = F.col(order) if isinstance(order, str) else order
    last = (
        measures.where(F.col("measure_id").isin(list(known)))
        .select("item_id", "measure_id", _amount(measures), order.alias("_order"))
        .groupBy("item_id", "measure_id")
        .agg(F.max_by("amount", "_order").alias("amount"))
    )
    return last.where("amount IS NOT NULL").select(
        "item_id", "measure_id", _type_of(known).alias("type"), "amount"
    )


def measure_arrays(
    measures: DataFrame,
    mapping: Mapping[int, str] = MEASURE_NAMES,
    order: Column | str = "row_id",
    names: Sequence[str] = PUBLISHED_NAMES,
) -> DataFrame:
    """(item_id, nutrients): the published measures of each item, in the order of ``mapping``.

    The last amount of each measure is found first, combined before the shuffle, so an item with
    very many rows brings one row per measure to its list. An item without any amount has no row.
    """
    known = published_mapping(mapping, names)
    rank = F.array_position(F.array(*[F.lit(i) for i in known]).cast("array<int>"), F.col("measure_id").cast("int"))
    entry = F.struct(rank.alias("rank"), "type", "amount")
    return (
        map_measures(measures, mapping, order, names)
        .groupBy("item_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("e"))
        .select("item_id", F.transform("e", lambda x: F.struct(x["type"].alias("type"), x["amount"].alias("amount"))).alias("nutrients"))
    )


def of_class(column: str, item_class: str = INDEXED_CLASS, trim_class: bool = True) -> Column:
    """Whether a class is the indexed one; without ``trim_class`` exactly, which reaches the scan of loaded items."""
    return (clean_text(column) if trim_class else F.col(column)) == item_class


def indexable(items: DataFrame, item_class: str = INDEXED_CLASS, trim_class: bool = True) -> DataFrame:
    """Items that get a document."""
    return items.where(of_class("item_class", item_class, trim_class) & F.col("item_id").isNotNull())


def build_documents(
    items: DataFrame,
    measures: DataFrame,
    item_class: str = INDEXED_CLASS,
    mapping: Mapping[int, str] = MEASURE_NAMES,
    order: Column | str = "row_id",
    trim_class: bool = True,
    names: Sequence[str] = PUBLISHED_NAMES,
) -> DataFrame:
    """(item_id, name, nutrients) for every indexable item; no measures gives an empty list."""
    chosen = indexable(items, item_class, trim_class).select("item_id", clean_text("description").alias("name"))
    arrays = measure_arrays(measures, mapping, order, names)
    return chosen.join(arrays, "item_id", "left").select(
        "item_id", "name", F.coalesce("nutrients", _no_measures()).alias("nutrients")
    )


def documents_for(
    items: DataFrame,
    measures: DataFrame,
    ids: DataFrame,
    **options,
) -> DataFrame:
    """``build_documents`` restricted to the given ids."""
    chosen = items.join(ids.select("item_id"), "item_id", "left_semi")
    return build_documents(chosen, keep_known(measures, ids, "item_id"), **options)


def upsert_documents(documents: DataFrame, changed: DataFrame, order: str) -> DataFrame:
    """Whole documents replaced or added by id; stale ones stay. Rows without id are passed over."""
    return upsert(documents, changed.where("item_id IS NOT NULL"), "item_id", order)


def write_documents(documents: DataFrame, path: str) -> None:
    """Empties the target and writes the documents."""
    documents.write.mode("overwrite").parquet(path)


def explode_documents(documents: DataFrame) -> DataFrame:
    """(item_id, name, type, amount): a row per measure, one with nulls where there is none."""
    return documents.select("item_id", "name", F.explode_outer("nutrients").alias("m")).select(
        "item_id", "name", F.col("m.type").alias("type"), F.col("m.amount").alias("amount")
    )


def shape_hits(hits: DataFrame, names: Sequence[str] = PUBLISHED_NAMES) -> DataFrame:
    """(query_id, rank, name, nutrients): defaults for missing parts, unusable measures dropped."""
    usable = F.filter(
        F.coalesce("nutrients", _no_measures()),
        lambda m: m["type"].isin(*names) & m["amount"].isNotNull(),
    )
    return hits.select("query_id", "rank", F.coalesce("name", F.lit("")).alias("name"), usable.alias("nutrients"))


def responses(shaped: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, response) per request: its results in rank order as JSON, an empty list without any.

    A request has at most a hundred results, so the list of one is short.
    """
    entry = F.struct("rank", "name", "nutrients")
    lists = shaped.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("hits"))
    foods = F.transform(
        F.coalesce("hits", F.array()),
        lambda h: F.struct(h["name"].alias("name"), h["nutrients"].alias("nutrients")),
    )
    found = requests.select("query_id").join(lists, "query_id", "left")
    return found.select("query_id", F.to_json(F.struct(foods.alias("foods"))).alias("response"))


def page(items: DataFrame, key: str, offset: int = 0, limit: int = DEFAULT_SIZE, after=None) -> DataFrame:
    """One page in key order: past ``offset`` rows, or past the key ``after`` of the page before.

    With ``after`` only ``limit`` rows leave each task however deep the page lies; an offset costs
    as many rows more.
    """
    rows = items if after is None else items.where(F.col(key) > after)
    ordered = rows.orderBy(key)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose key (its own, not a foreign one) is asked for."""
    return table.join(keys.select(key).distinct(), key, "left_semi").select(*table.columns)


def _no_measures() -> Column:
    return F.array().cast("array<struct<type:string,amount:double>>")


def _amount(measures: DataFrame) -> Column:
    if dict(measures.dtypes)["amount"] == "string":
        return safe_double("amount").alias("amount")
    return F.col("amount").cast("double").alias("amount")


def _type_of(known: Mapping[int, str]) -> Column:
    if not known:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for pair in known.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.col("measure_id"))
