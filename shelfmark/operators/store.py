"""Tables kept in buckets of a key, so a batch reads and rewrites only the buckets that it touches.

Bucket and folder of a row are the same hash of its key that Spark's bucketed tables use: the table is partitioned by ``_bucket`` and
bucketed by the key into as many buckets, so each folder holds one of them. A filter on ``_bucket`` prunes folders before a
file is opened; joins and aggregates by the key need no exchange; a batch is written with dynamic partition overwrite, which
replaces the folders it has rows for and leaves the others. A folder that a batch empties keeps a row without key, which readers pass over.

``CatalogueStore`` keeps items and measures in buckets of the item, so a document is built from one bucket of each. Which item a
measure belongs to is kept by measure, as changes name measures by their own key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shelfmark.operators.documents import build_documents
from shelfmark.operators.mutations import partial_update, upsert
from shelfmark.operators.skew import BROADCAST_KEYS, fits_broadcast, latest
from shelfmark.session import settled

BUCKET = "_bucket"

# Rows of a bucket, about, when a table is created; their number decides how many buckets there are.
BUCKET_ROWS = 1_000_000

# Folders with new rows are replaced, the others stay; a join on the key and more columns needs no exchange of a table in buckets of the key.
_WRITING = {
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


@contextmanager
def _rewriting(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in _WRITING}
    try:
        for name, value in _WRITING.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path`` in ``buckets`` of ``key``; ``name`` is its name in the session's catalogue."""

    spark: SparkSession
    path: str
    key: str
    buckets: int
    schema: StructType
    name: str

    def rows(self) -> DataFrame:
        return self._read().where(F.col(self.key).isNotNull()).select(*self.schema.names)

    def near(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that hold ``keys``; no other file is opened."""
        return self._in(self.touched(keys))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows with one of ``keys`` (a column named as the key)."""
        asked = self._keys(keys)
        return self.near(asked).join(_local(asked, self), self.key, "left_semi").select(*self.schema.names)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of ``keys``, at most ``buckets``."""
        return sorted(r[0] for r in self._keys(keys).select(self._bucket().alias("b")).distinct().collect())

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replaces the rows of the buckets of ``keys`` by what ``change`` makes of them; returns these buckets.

        ``change`` must keep rows in their buckets or give rows of other buckets of ``keys``. The new rows are written aside, by the overwrite
        itself, before a folder is replaced. Folders are replaced one by one, so a reader may see some of them new and others not yet; a batch that is run again
        after a failure gives the same rows where ``change`` gives the same on its own result, as upserts, updates and deletes do.
        """
        buckets = self.touched(keys)
        if buckets:
            self._write(change(self._in(buckets)).select(*self.schema.names), buckets)
        return buckets

    def upsert(self, changes: DataFrame, order: str, on_duplicate: str = "last") -> list[int]:
        """``mutations.upsert`` on the touched buckets alone."""
        return self.rewrite(changes, lambda old: upsert(old, changes, self.key, order, on_duplicate))

    def update(self, changes: DataFrame, order: str) -> list[int]:
        """``mutations.partial_update`` on the touched buckets alone."""
        return self.rewrite(changes, lambda old: partial_update(old, changes, self.key, order))

    def delete(self, keys: DataFrame) -> list[int]:
        asked = self._keys(keys)
        return self.rewrite(asked, lambda old: old.join(asked, self.key, "left_anti"))

    def _read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def _in(self, buckets: list[int]) -> DataFrame:
        rows = self._read().where(F.col(BUCKET).isin(buckets) & F.col(self.key).isNotNull())
        return rows.select(*self.schema.names)

    def _keys(self, keys: DataFrame) -> DataFrame:
        own = F.col(self.key).cast(self.schema[self.key].dataType)
        return keys.select(own.alias(self.key)).where(F.col(self.key).isNotNull()).distinct()

    def _bucket(self) -> Column:
        return F.pmod(F.hash(self.key), F.lit(self.buckets))

    def _write(self, rows: DataFrame, buckets: list[int]) -> None:
        placed = rows.withColumn(BUCKET, self._bucket()).repartition(self.buckets, self.key)
        marks = self.spark.createDataFrame([(b,) for b in buckets], f"{BUCKET} INT")
        empty = marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], BUCKET)
        with _rewriting(self.spark):
            placed.unionByName(empty.coalesce(1)).write.insertInto(self.name, overwrite=True)


def open_table(spark: SparkSession, path: str, key: str, buckets: int, schema: StructType) -> KeyedTable:
    """A table that was created at ``path`` before, in this or another session; all its folders are there from then on."""
    table = _registered(spark, path, key, buckets, schema)
    spark.catalog.recoverPartitions(table.name)
    return table


def _registered(spark: SparkSession, path: str, key: str, buckets: int, schema: StructType) -> KeyedTable:
    nullable = StructType([StructField(f.name, f.dataType) for f in schema.fields])
    name = f"shelfmark_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nullable.fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}, {BUCKET} INT) USING parquet PARTITIONED BY ({BUCKET}) "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return KeyedTable(spark, path, key, buckets, nullable, name)


def create_table(rows: DataFrame, path: str, key: str, buckets: int | None = None) -> KeyedTable:
    """Writes ``rows`` to ``path``; those without key are passed over. Without ``buckets`` their number follows the rows."""
    spark = rows.sparkSession
    kept = rows.where(F.col(key).isNotNull())
    if buckets is None:
        kept = settled(kept)
        buckets = buckets_for(kept)
    table = _registered(spark, path, key, buckets, rows.schema)
    table._write(kept, list(range(buckets)))
    return table


def buckets_for(rows: DataFrame) -> int:
    """Of about ``BUCKET_ROWS`` rows each."""
    return max(1, -(-rows.count() // BUCKET_ROWS))


def _local(keys: DataFrame, table: KeyedTable, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Distinct ``keys`` to be joined with ``table``: few are broadcast, more are brought to its buckets; the table stays where it is."""
    return F.broadcast(keys) if fits_broadcast(keys, limit) else keys.repartition(table.buckets, table.key)


@dataclass(frozen=True)
class CatalogueStore:
    """Items and measures in the same buckets of ``item_id``, and (row_id, item_id) of every measure in buckets of ``row_id``."""

    items: KeyedTable
    measures: KeyedTable
    owners: KeyedTable

    def documents_for(self, ids: DataFrame, **options) -> DataFrame:
        """The documents of ``ids`` (item_id), from their buckets alone and without an exchange of items or measures.

        A bucket is read by one task, which folds the measures of an item as it reads them, however many there are.
        """
        asked = settled(self.items._keys(ids))
        buckets = self.items.touched(asked)
        keys = _local(asked, self.items)
        chosen, own = (t._in(buckets).join(keys, "item_id", "left_semi") for t in (self.items, self.measures))
        return build_documents(chosen, own, **options)

    def upsert_measures(self, changes: DataFrame, order: str) -> DataFrame:
        """Measures replaced or added by row_id, the last of each; returns (item_id) of the items they belonged or belong to."""
        new = settled(latest(changes.where("row_id IS NOT NULL"), "row_id", order).select(*self.measures.schema.names))
        was = settled(self.owners.lookup(new))
        touched = settled(was.select("item_id").unionByName(new.select("item_id")).where("item_id IS NOT NULL").distinct())
        self.measures.rewrite(touched, lambda old: self._without(old, was).unionByName(new.where("item_id IS NOT NULL")))
        self.owners.rewrite(new, lambda old: old.join(new.select("row_id"), "row_id", "left_anti").unionByName(new.select("row_id", "item_id")))
        return touched

    def delete_measures(self, keys: DataFrame) -> DataFrame:
        """Measures deleted by row_id; returns (item_id) of their items, which stay."""
        gone = settled(self.owners._keys(keys))
        was = settled(self.owners.lookup(gone))
        touched = settled(was.select("item_id").where("item_id IS NOT NULL").distinct())
        self.measures.rewrite(touched, lambda old: self._without(old, was))
        self.owners.delete(gone)
        return touched

    def delete_items(self, keys: DataFrame) -> None:
        """Items deleted with their measures."""
        gone = settled(self.items._keys(keys))
        measures = settled(self.measures.lookup(gone).select("row_id"))
        self.measures.delete(gone)
        self.items.delete(gone)
        self.owners.delete(measures)

    def _without(self, old: DataFrame, was: DataFrame) -> DataFrame:
        """Measures without those in ``was`` (row_id, item_id). They are found within their item, so the measures stay in their buckets."""
        return old.join(was, ["item_id", "row_id"], "left_anti")


def create_store(items: DataFrame, measures: DataFrame, path: str, buckets: int | None = None) -> CatalogueStore:
    """``items`` (item_id, ...) and ``measures`` (row_id, item_id, ...) written below ``path``; their number of buckets follows the measures."""
    rows = settled(measures.where("row_id IS NOT NULL AND item_id IS NOT NULL"))
    if buckets is None:
        buckets = buckets_for(rows)
    return CatalogueStore(
        create_table(items, f"{path}/items", "item_id", buckets),
        create_table(rows, f"{path}/measures", "item_id", buckets),
        create_table(rows.select("row_id", "item_id"), f"{path}/owners", "row_id", buckets),
    )
