"""Batches of inserts, partial updates and deletes applied to keyed tables.

A batch is a DataFrame; where it may hold several rows for one key, ``order`` names the
column (unique within the batch) that says which came later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.parsing import clean_text, safe_date
from shelfmark.operators.skew import drop_known, latest, with_membership

# Rows of a range when a batch is numbered; their number decides how many ranges there are.
NUMBERED_ROWS = 500_000


def upsert(
    base: DataFrame, changes: DataFrame, key: str, order: str, on_duplicate: str = "last"
) -> DataFrame:
    """``base`` with every changed key replaced or added, all other columns overwritten.

    A key that is changed twice takes its last row, or fails the job when
    ``on_duplicate`` is ``"error"``. Rows without a key are passed over; one without an order
    counts as the earliest. Both sides of the join have one row per key.
    """
    new = _fold(changes.where(F.col(key).isNotNull()), key, order, on_duplicate).select(*base.columns)
    return base.join(new.select(key), key, "left_anti").select(*base.columns).unionByName(new)


def upsert_counts(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """One row: rows sent, and of the distinct keys how many were inserted and updated."""
    keys = changes.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    seen = base.select(key, F.lit(True).alias("_old"))
    return keys.join(seen, key, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("sent"),
        F.count_if(F.col("_old").isNull()).alias("inserted"),
        F.count_if(F.col("_old").isNotNull()).alias("updated"),
    )


def insert_status(base: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``new`` with ``status``: ``inserted``, or ``conflict`` where the key exists or came earlier.

    A row that cannot be judged has the status ``null_key`` or ``null_order``. The winners are found per key with map-side combine and joined back on key and
    order, so the conflicts of one busy key stay spread.
    """
    usable = F.col(key).isNotNull() & F.col(order).isNotNull()
    first = new.where(usable).groupBy(key).agg(F.min(order).alias(order))
    winners = first.join(base.select(key), key, "left_anti").withColumn("_won", F.lit(True))
    status = (
        F.when(F.col(key).isNull(), "null_key")
        .when(F.col(order).isNull(), "null_order")
        .when(F.col("_won"), "inserted")
        .otherwise("conflict")
    )
    return new.join(winners, [key, order], "left").withColumn("status", status).select(*new.columns, "status")


def insert_only(base: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    won = insert_status(base, new, key, order).where("status = 'inserted'")
    return base.unionByName(won.select(*base.columns))


def partial_update(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """``base`` with the non-null fields of ``changes`` applied; a field cannot be set to null."""
    fields = [c for c in changes.columns if c not in (key, order)]
    # Per field the last value given; max_by passes over rows without an order.
    folded = changes.groupBy(key).agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f"_new_{f}") for f in fields
    ])
    merged = base.join(folded, key, "left")
    return merged.select(*[
        F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns
    ])


def update_status(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, status) per change: ``updated``, ``no_change`` (no field given) or ``not_found``."""
    fields = [c for c in changes.columns if c not in (key, order)]
    given = F.coalesce(*[F.when(F.col(f).isNotNull(), True) for f in fields], F.lit(False))
    known = changes.select(key).distinct().join(base.select(key), key, "left_semi")
    marked = with_membership(changes.select(key, order, given.alias("_given")), known, key, "_known")
    return marked.select(
        key,
        order,
        F.when(~F.col("_given"), "no_change").when(F.col("_known"), "updated").otherwise("not_found").alias("status"),
    )


def measure_update_status(
    base: DataFrame, changes: DataFrame, items: DataFrame, reference: DataFrame, key: str = "row_id", order: str = "seq"
) -> DataFrame:
    """``update_status`` of measures: a change to an item or a measure that is not there is refused, as ``unknown_item`` or ``unknown_measure``."""
    marked = _referred(changes, items, reference)
    refused = marked.where("_reason IS NOT NULL").select(key, order, F.col("_reason").alias("status"))
    good = marked.where("_reason IS NULL").select(*changes.columns)
    return refused.unionByName(update_status(base, good, key, order))


def update_measures(
    base: DataFrame, changes: DataFrame, items: DataFrame, reference: DataFrame, key: str = "row_id", order: str = "seq"
) -> DataFrame:
    """``partial_update`` of measures with the changes that ``measure_update_status`` does not refuse."""
    good = _referred(changes, items, reference).where("_reason IS NULL").select(*changes.columns)
    return partial_update(base, good, key, order)


def _referred(changes: DataFrame, items: DataFrame, reference: DataFrame) -> DataFrame:
    """``changes`` with ``_reason`` where they refer to what is not there; a field that is null changes nothing."""
    marked = with_membership(changes, items, "item_id", "_item")
    marked = with_membership(marked, reference, "measure_id", "_measure")
    reason = F.when(F.col("item_id").isNotNull() & ~F.col("_item"), "unknown_item").when(
        F.col("measure_id").isNotNull() & ~F.col("_measure"), "unknown_measure"
    )
    return marked.withColumn("_reason", reason)


def delete_status(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(key, deleted) per distinct key asked for."""
    asked = keys.select(key).distinct()
    found = base.select(key).distinct().withColumn("_found", F.lit(True))
    return asked.join(found, key, "left").select(key, F.coalesce("_found", F.lit(False)).alias("deleted"))


def delete_items(items: DataFrame, measures: DataFrame, keys: DataFrame, key: str = "item_id"):
    """(items, measures) without the given items; their measures go with them."""
    asked = keys.select(key).distinct()
    left = items.join(asked, key, "left_anti").select(*items.columns)
    return left, drop_known(measures, asked, key)


def delete_measures(measures: DataFrame, keys: DataFrame, key: str = "row_id", owner: str = "item_id"):
    """(measures left, deleted keys with their owner). The owners stay, even without measures."""
    asked = keys.select(key).distinct()
    left = measures.join(asked, key, "left_anti").select(*measures.columns)
    return left, measures.join(asked, key, "left_semi").select(key, owner)


def assign_ids(base: DataFrame, batch: DataFrame, id_column: str, order: str) -> DataFrame:
    """``batch`` with ``id_column``: the highest id of ``base`` plus 1, 2, 3, ... in ``order``.

    ``order`` is numeric and unique within the batch. It is cut at estimated quantiles into
    ranges of about ``NUMBERED_ROWS`` rows; ranges are counted, the counts (one row per
    range) added up, and rows numbered inside their range, so no task sees the whole batch.
    The cut points are read once and fixed in the plan.
    """
    ranges_wanted = max(2, -(-batch.count() // NUMBERED_ROWS))
    steps = [i / ranges_wanted for i in range(1, ranges_wanted)]
    cuts = sorted(set(batch.approxQuantile(order, steps, 1 / (4 * ranges_wanted)))) or [0.0]
    ranges = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol="_order", outputCol="_range", handleInvalid="keep"
    )
    ranged = ranges.transform(batch.withColumn("_order", F.col(order).cast("double"))).drop("_order")

    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    highest = base.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("bigint").alias("m")).scalar()
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return (
        ranged.withColumn("_rank", within)
        .join(F.broadcast(starts), "_range")
        .withColumn(id_column, (highest + F.col("_start") + F.col("_rank")).cast("bigint"))
        .select(id_column, *[c for c in batch.columns if c != id_column])
    )


def insert_measures(
    base: DataFrame, batch: DataFrame, items: DataFrame, reference: DataFrame, id_column: str = "row_id", order: str = "seq"
) -> DataFrame:
    """``batch`` with ``status``, and an id for each row inserted without one.

    A row is refused by the first of: ``null_key`` (no item, measure or order), ``unknown_item``,
    ``unknown_measure``. One with an id is ``inserted`` or a ``conflict`` as in ``insert_status``; the
    others take the ids after the highest of ``base`` and of those inserted, in ``order``.
    """
    marked = with_membership(batch, items, "item_id", "_item")
    marked = with_membership(marked, reference, "measure_id", "_measure")
    missing = F.col("item_id").isNull() | F.col("measure_id").isNull() | F.col(order).isNull()
    reason = (
        F.when(missing, "null_key").when(~F.col("_item"), "unknown_item").when(~F.col("_measure"), "unknown_measure")
    )
    judged = marked.select(*batch.columns, reason.alias("status"))
    refused = judged.where("status IS NOT NULL")
    good = judged.where("status IS NULL").drop("status")
    supplied = insert_status(base, good.where(F.col(id_column).isNotNull()), id_column, order)
    taken = base.select(id_column).unionByName(supplied.where("status = 'inserted'").select(id_column))
    numbered = assign_ids(taken, good.where(F.col(id_column).isNull()).drop(id_column), id_column, order)
    return refused.unionByName(supplied).unionByName(numbered.withColumn("status", F.lit("inserted")))


def delete_reference(reference: DataFrame, keys: DataFrame, child: DataFrame, key: str, foreign_key: str):
    """(reference rows left, (key, status) per distinct key asked for): a row still referred to stays.

    The status is ``deleted``, ``restricted`` or ``not_found``.
    """
    asked = keys.select(key).where(F.col(key).isNotNull()).distinct()
    used = child.select(F.col(foreign_key).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("_used", F.lit(True))
    there = reference.select(key).distinct().withColumn("_there", F.lit(True))
    status = (
        F.when(F.col("_there").isNull(), "not_found").when(F.col("_used").isNotNull(), "restricted").otherwise("deleted")
    )
    statuses = asked.join(there, key, "left").join(used, key, "left").select(key, status.alias("status"))
    gone = statuses.where("status = 'deleted'").select(key)
    return reference.join(gone, key, "left_anti").select(*reference.columns), statuses


def typed_item_changes(raw: DataFrame) -> DataFrame:
    """Item mutations with ``published`` given as text: typed, with ``reject_reason`` for a bad date."""
    given = clean_text("published") != ""
    date = safe_date("published")
    return raw.withColumn(
        "reject_reason", F.when(given & date.isNull(), "bad_published")
    ).withColumn("published", date)


def _fold(changes: DataFrame, key: str, order: str, on_duplicate: str) -> DataFrame:
    if on_duplicate == "last":
        return latest(changes, key, order)
    if on_duplicate != "error":
        raise ValueError(f"on_duplicate must be 'last' or 'error', not {on_duplicate!r}")
    rest: Sequence[str] = [c for c in changes.columns if c != key]
    repeated = F.concat(F.lit("more than one row for key "), F.col(key).cast("string"))
    row = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(repeated))
    folded = changes.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(F.struct(*rest), order).alias("_row")
    )
    return folded.withColumn("_row", row).select(key, "_row.*").select(*changes.columns)
