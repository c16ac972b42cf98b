"""Change events: derived from two table images, parsed, routed, folded and applied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.fixed import EVENT_KEYS, INDEXED_CLASS, ITEM_TABLE, MAX_RETRIES, MEASURE_TABLE
from shelfmark.functions.parsing import clean_text
from shelfmark.operators.digests import DEPTH, differing_rows
from shelfmark.operators.documents import documents_for, of_class
from shelfmark.session import settled


def item_events(
    old: DataFrame, new: DataFrame, item_class: str = INDEXED_CLASS, trim_class: bool = True
) -> DataFrame:
    """(table, op, item_id) for items that differ between two images.

    An insert or delete counts if the row is of the class, an update if it was or is.
    """
    both = changed_rows(old, new, "item_id")
    was, now = (of_class(f"{side}.item_class", item_class, trim_class) for side in ("_old", "_new"))
    return both.where(F.coalesce(was, F.lit(False)) | F.coalesce(now, F.lit(False))).select(
        F.lit(ITEM_TABLE).alias("table"), _op().alias("op"), "item_id"
    )


def measure_events(old: DataFrame, new: DataFrame, notify_both_owners: bool = True) -> DataFrame:
    """(table, op, item_id) for measures that differ; every change counts.

    A measure that moved to another item notifies the new owner, and the old one too
    unless ``notify_both_owners`` is off, as its document would stay stale.
    """
    both = changed_rows(old, new, "row_id")
    before, after = F.col("_old.item_id"), F.col("_new.item_id")
    owners = F.array(F.coalesce(after, before))
    if notify_both_owners:
        owners = F.array_distinct(F.array_compact(F.array(after, before)))
    return both.select(
        F.lit(MEASURE_TABLE).alias("table"), _op().alias("op"), F.explode(owners).alias("item_id")
    )


def table_events(
    old_items: DataFrame,
    new_items: DataFrame,
    old_measures: DataFrame,
    new_measures: DataFrame,
    item_class: str = INDEXED_CLASS,
    notify_both_owners: bool = True,
    trim_class: bool = True,
) -> DataFrame:
    """Events of both tables; measures that went with their item are among them."""
    return item_events(old_items, new_items, item_class, trim_class).unionByName(
        measure_events(old_measures, new_measures, notify_both_owners)
    )


def table_events_by_digests(
    old_items: DataFrame,
    new_items: DataFrame,
    old_measures: DataFrame,
    new_measures: DataFrame,
    item_class: str = INDEXED_CLASS,
    notify_both_owners: bool = True,
    trim_class: bool = True,
    depth: int = DEPTH,
) -> DataFrame:
    """``table_events`` with the images joined only where their digests differ; the same events."""
    items = differing_rows(old_items, new_items, "item_id", depth=depth)
    measures = differing_rows(old_measures, new_measures, "row_id", depth=depth)
    return table_events(*items, *measures, item_class, notify_both_owners, trim_class)


def with_payload(events: DataFrame) -> DataFrame:
    """Adds ``payload``, the event as JSON text."""
    table, op, item = EVENT_KEYS
    return events.withColumn(
        "payload",
        F.to_json(F.struct(F.col("table").alias(table), F.col("op").alias(op), F.col("item_id").alias(item))),
    )


def parse_events(events: DataFrame) -> DataFrame:
    """``events`` with table, op, item_id and ``reject_reason`` read from ``payload``.

    Table and op are missing where they are empty, zero, false or null; they are trimmed after that
    test, so a blank one passes. An id is a number, whose fraction is cut off, or text that is an
    integer; booleans are refused.
    """
    # Fields taken out with inline are read once; as plain columns they would be read
    # again for every condition on them.
    # The text itself is read once, for all fields: the steps of one ``inline`` do not share it.
    event = F.col("_event")
    read = events.select(*events.columns, F.explode_outer(F.array(F.try_parse_json("payload"))).alias("_event"))
    parts = []
    for name, key in zip(("_table", "_op", "_id"), EVENT_KEYS):
        value = F.try_variant_get(event, f"$.{key}", "variant")
        parts += [
            F.try_variant_get(event, f"$.{key}", "string").alias(name),
            F.schema_of_variant(value).alias(f"{name}_kind"),
        ]
    names = [f"{n}{s}" for n in ("_table", "_op", "_id") for s in ("", "_kind")]
    fields = read.select(*events.columns, F.inline_outer(F.array(F.struct(*parts))).alias(*names))
    text = clean_text("_id")
    number = F.when(F.col("_id_kind") == "STRING", F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))).when(
        F.col("_id_kind").rlike("^(BIGINT|DECIMAL.*)$"), F.col("_id").try_cast("decimal(38,18)").try_cast("bigint")
    ).when(F.col("_id_kind").rlike("^(DOUBLE|FLOAT)$"), F.col("_id").try_cast("double").try_cast("bigint"))
    reason = (
        F.when(F.col("_table").isNull() & F.col("_op").isNull() & F.col("_id").isNull(), "not_an_event")
        .when(_missing("_table"), "no_table")
        .when(_missing("_op"), "no_op")
        .when(F.col("_id").isNull(), "no_id")
        .when(number.isNull(), "bad_id")
    )
    return fields.select(
        *events.columns,
        clean_text("_table").alias("table"),
        clean_text("_op").alias("op"),
        number.alias("item_id"),
        reason.alias("reject_reason"),
    )


def _missing(field: str) -> Column:
    """Empty text, or another value that stands for nothing."""
    value, kind = F.coalesce(field, F.lit("")), F.col(f"{field}_kind")
    zero = F.coalesce(value.try_cast("double") == 0, F.lit(False))
    nothing = (kind != "STRING") & (value.isin("false", "[]", "{}") | zero)
    return (value == "") | F.coalesce(nothing, F.lit(False))


def is_delete() -> Column:
    return (F.col("table") == ITEM_TABLE) & (F.col("op") == "DELETE")


def route_events(parsed: DataFrame) -> DataFrame:
    """Valid events with ``action``: ``delete`` for a deleted item, ``refresh`` for all else."""
    return (
        parsed.where("reject_reason IS NULL")
        .drop("reject_reason")
        .withColumn("action", F.when(is_delete(), "delete").otherwise("refresh"))
    )


def last_actions(routed: DataFrame, order: str = "seq") -> DataFrame:
    """(item_id, action): the last one per item.

    A refresh reads only current tables and a delete only removes, so against one
    snapshot the last event decides. Folded before the shuffle.
    """
    last = routed.groupBy("item_id").agg(F.max_by(F.col("action") == "delete", order).alias("_d"))
    return last.select("item_id", F.when(F.col("_d"), "delete").otherwise("refresh").alias("action"))


def document_changes(actions: DataFrame, items: DataFrame, measures: DataFrame, **options) -> DataFrame:
    """(item_id, name, nutrients, deleted) for every item acted on.

    A refreshed item that is gone or not of the class becomes a deletion. ``actions`` is read several times, so it is best settled.
    """
    return changes_by(actions, lambda ids: documents_for(items, measures, ids, **options))


def changes_by(actions: DataFrame, rebuild: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``document_changes`` with the documents of the refreshed ids (item_id) that ``rebuild`` gives."""
    rebuilt = rebuild(actions.where("action = 'refresh'").select("item_id")).withColumn("_built", F.lit(True))
    return actions.join(rebuilt, "item_id", "left").select(
        "item_id", "name", "nutrients", F.col("_built").isNull().alias("deleted")
    )


def apply_changes(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """``documents`` with rebuilt ones in place and deleted ones gone; both may be absent before."""
    untouched = documents.join(changes.select("item_id"), "item_id", "left_anti")
    return untouched.unionByName(changes.where("NOT deleted").select(*documents.columns))


def apply_events(
    documents: DataFrame, routed: DataFrame, items: DataFrame, measures: DataFrame, order: str = "seq", **options
) -> DataFrame:
    return apply_changes(documents, document_changes(settled(last_actions(routed, order)), items, measures, **options))


def split_failures(failures: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Failed events with their attempt raised and ``outcome``: ``retry`` or ``dead``."""
    raised = failures.withColumn("attempt", F.col("attempt") + 1)
    return raised.withColumn("outcome", F.when(F.col("attempt") <= max_retries, "retry").otherwise("dead"))


def settle_events(routed: DataFrame, failed: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """``routed`` events with ``outcome`` after a batch in which the items of ``failed`` (item_id, error) failed.

    An event of another item is ``done``; one of a failed item is tried again or dead, on its own count of attempts.
    """
    marked = routed.join(failed.select("item_id", "error"), "item_id", "left")
    bad = split_failures(marked.where("error IS NOT NULL"), max_retries)
    return bad.unionByName(marked.where("error IS NULL").withColumn("outcome", F.lit("done")))


def changed_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, _old, _new) for the keys whose rows differ; either image may be absent."""
    columns = [c for c in new.columns if c != key]
    before = old.select(key, F.struct(*columns).alias("_old"))
    after = new.select(key, F.struct(*columns).alias("_new"))
    return before.join(after, key, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))


def _op() -> Column:
    return F.when(F.col("_old").isNull(), "INSERT").when(F.col("_new").isNull(), "DELETE").otherwise("UPDATE")
