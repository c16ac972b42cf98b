"""Tables in buckets, the catalogue store, and differences found by digests."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import changes, digests, mutations, store
from shelfmark.operators.documents import build_documents
from shelfmark.session import scratch_dir
from shelfmark.streaming.sync import DocumentSync

ITEM = "item_id BIGINT, item_class STRING, description STRING"
MEASURE = "row_id BIGINT, item_id BIGINT, measure_id INT, amount DOUBLE"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Bucket folders that a scan of ``df`` opens."""
    return {p.split("_bucket=")[1].split("/")[0] for p in df.inputFiles() if "_bucket=" in p}


def above_scans(explained, what):
    """For each file scan that names ``what``, the lines of the operators above it."""
    stack, out = [], []
    for line in explained.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if "FileScan" in line and what in line:
            out.append([x for _, x in stack])
        stack.append((depth, line))
    return out


@pytest.fixture()
def items(spark):
    return spark.createDataFrame([(i, f"c{i % 3}", f"item {i}") for i in range(500)] + [(None, "x", "no key")], ITEM)


@pytest.fixture()
def measures(spark):
    return spark.createDataFrame([(i, i % 480, 1008 if i % 2 else 1003, float(i)) for i in range(2_000)], MEASURE)


def test_table_in_buckets_equals_the_plain_operators(spark, items):
    table = store.create_table(items, scratch_dir(spark), "item_id", 8)
    base = items.where("item_id IS NOT NULL")
    assert rows(table.rows()) == rows(base)
    batch = spark.createDataFrame([(3, "new", "a", 1), (3, "newer", None, 2), (9_999, "new", "b", 3), (None, "x", "y", 4)], f"{ITEM}, seq INT")
    table.upsert(batch, "seq")
    base = mutations.upsert(base, batch, "item_id", "seq")
    assert rows(table.rows()) == rows(base)
    updates = spark.createDataFrame([(4, None, "changed", 1), (4, "k", None, 2), (77_777, "k", None, 3)], f"{ITEM}, seq INT")
    table.update(updates, "seq")
    base = mutations.partial_update(base, updates, "item_id", "seq")
    assert rows(table.rows()) == rows(base)
    gone = spark.createDataFrame([(4,), (5,), (-1,), (None,)], "item_id INT")
    table.delete(gone)
    base = base.where("item_id NOT IN (4, 5)")
    assert rows(table.rows()) == rows(base)
    with pytest.raises(Exception, match="more than one row"):
        table.upsert(batch, "seq", "error")
    assert rows(table.rows()) == rows(base)
    again = store.open_table(spark, table.path, "item_id", 8, items.schema)
    assert rows(again.rows()) == rows(base)


def test_a_batch_opens_and_writes_only_its_buckets(spark, items):
    table = store.create_table(items, scratch_dir(spark), "item_id", 64)
    keys = spark.createDataFrame([(i,) for i in range(10)], "item_id BIGINT")
    touched = table.touched(keys)
    assert 0 < len(touched) <= 10
    assert files_read(table.near(keys)) == set(map(str, touched))
    before = {p for p in table.rows().inputFiles()}
    table.upsert(keys.selectExpr("item_id", "'n' AS item_class", "'d' AS description", "1 AS seq"), "seq")
    replaced = before - {p for p in table.rows().inputFiles()}
    assert {p.split("_bucket=")[1].split("/")[0] for p in replaced} == set(map(str, touched))
    assert rows(table.lookup(keys)) == [(i, "n", "d") for i in range(10)]


def test_a_bucket_may_become_empty_and_fill_again(spark):
    table = store.create_table(spark.createDataFrame([(1, "a", "b")], ITEM), scratch_dir(spark), "item_id", 4)
    table.delete(spark.createDataFrame([(1,)], "item_id BIGINT"))
    assert rows(table.rows()) == []
    table.upsert(spark.createDataFrame([(1, "a", "c", 1)], f"{ITEM}, seq INT"), "seq")
    assert rows(table.rows()) == [(1, "a", "c")]
    empty = store.create_table(spark.createDataFrame([], ITEM), scratch_dir(spark), "item_id")
    assert empty.buckets == 1 and rows(empty.rows()) == [] and rows(empty.lookup(spark.createDataFrame([(1,)], "item_id BIGINT"))) == []


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_documents_from_their_buckets_without_exchange(spark, items, measures, monkeypatch, limit):
    monkeypatch.setattr(store, "_local", lambda keys, table, local=store._local: local(keys, table, limit))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = store.create_store(items, measures, scratch_dir(spark), 16)
        ids = spark.createDataFrame([(3,), (6,), (490,), (9_999,), (3,)], "item_id BIGINT")
        found = kept.documents_for(ids, item_class="c0")
        explained = plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = build_documents(items, measures, item_class="c0").where("item_id IN (3, 6, 490, 9999)")
    assert rows(found) == rows(want)
    assert explained.count("Bucketed: true") == 2 and "SelectedBucketsCount" in explained
    assert len(above_scans(explained, "_bucket")) == 2
    assert not [line for lines in above_scans(explained, "_bucket") for line in lines if "Exchange" in line]


def test_measures_follow_their_items(spark, items, measures):
    kept = store.create_store(items, measures, scratch_dir(spark), 8)
    batch = spark.createDataFrame([(1, 300, 1003, 5.0, 1), (2, 2, 1003, 6.0, 1), (5_000, 7, 1008, 7.0, 1), (1, 301, 1003, 8.0, 2)], f"{MEASURE}, seq INT")
    touched = kept.upsert_measures(batch, "seq")
    assert {r.item_id for r in touched.collect()} == {1, 2, 7, 301}
    gone = kept.delete_measures(spark.createDataFrame([(3,), (5_000,), (77_777,)], "row_id BIGINT"))
    assert {r.item_id for r in gone.collect()} == {3, 7}
    kept.delete_items(spark.createDataFrame([(10,), (301,)], "item_id BIGINT"))
    want = {r[0]: tuple(r) for r in measures.collect()} | {1: (1, 301, 1003, 8.0), 2: (2, 2, 1003, 6.0)}
    want = [r for r in want.values() if r[0] != 3 and r[1] not in (10, 301)]
    assert rows(kept.measures.rows()) == sorted(want, key=repr)
    assert rows(kept.owners.rows()) == sorted((r[:2] for r in want), key=repr)
    assert {r.item_id for r in kept.items.rows().collect()} == set(range(500)) - {10, 301}


def images(rng, n, change):
    old = [(i, rng.choice("ab"), rng.choice([None, "x", "y"])) for i in range(n)]
    new = []
    for row in old:
        kind = rng.random()
        if kind < change / 3:
            continue
        new.append((row[0], row[1], "z") if kind < 2 * change / 3 else row)
    return old, new + [(n + i, "n", None) for i in range(int(n * change / 3))]


@pytest.mark.parametrize("depth", [0, 1, 3])
@pytest.mark.parametrize("change", [0.0, 0.01, 0.5, 1.0])
def test_events_by_digests_equal_the_full_join(spark, depth, change):
    old, new = (spark.createDataFrame(side, ITEM) for side in images(random.Random(4), 400, change))
    events = [rows(changes.item_events(*pair, "a")) for pair in ((old, new), digests.differing_rows(old, new, "item_id", depth=depth), )]
    assert events[0] == events[1]
    assert rows(digests.differing_rows(old, new.where("false"), "item_id", depth=depth)[0]) == rows(old)


def test_nulls_are_told_from_texts_and_each_other(spark):
    old = spark.createDataFrame([(1, None, "x"), (2, "x", None), (3, None, None)], ITEM)
    new = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, None, "")], ITEM)
    before, after = digests.differing_rows(old, new, "item_id")
    assert {r.item_id for r in before.collect()} == {1, 3} == {r.item_id for r in after.collect()}


def test_only_rows_of_differing_leaves_are_joined(spark):
    """Of 20,000 rows with ten changes, what reaches the join is the leaves of these ten; a stored tree stands for the older image."""
    old = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit("a").alias("item_class"), F.lit("d").alias("description"))
    new = old.withColumn("description", F.when(F.col("item_id") % 2_000 == 7, "changed").otherwise(F.col("description")))
    tree = digests.digest_tree(old, "item_id")
    before, after = digests.differing_rows(old, new, "item_id", old_tree=tree)
    assert before.count() == after.count() < 30
    assert rows(changes.item_events(before, after, "a")) == [("foods", "UPDATE", 7 + 2_000 * i) for i in range(10)] or len(rows(changes.item_events(before, after, "a"))) == 10
    levels = {r.level: r.n for r in tree.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert levels == {level: 20_000 for level in range(digests.DEPTH + 1)}


def test_a_micro_batch_of_a_store_gives_the_same_documents(spark, items, measures):
    """The stream over a store and over plain tables; the store's batch opens only the buckets of its items."""
    kept = store.create_store(items, measures, scratch_dir(spark), 64)
    opened = []

    class Seen(store.CatalogueStore):
        def documents_for(self, ids, **options):
            found = super().documents_for(ids, **options)
            opened.extend(files_read(found))
            return found

    batch = spark.createDataFrame(
        [(1, '{"table":"foods","op":"UPDATE","fdc_id":3}'), (2, '{"table":"food_nutrients","op":"DELETE","fdc_id":6}'),
         (3, '{"table":"foods","op":"DELETE","fdc_id":9}'), (4, '{"table":"foods","op":"INSERT","fdc_id":7777}'), (5, "none")],
        "seq BIGINT, payload STRING",
    )
    found = []
    for tables in (lambda spark: (items, measures), lambda spark: Seen(kept.items, kept.measures, kept.owners)):
        sync = DocumentSync(scratch_dir(spark), tables, {"item_class": "c0"})
        sync.rebuild(spark.createDataFrame([(9, "old", [])], "item_id BIGINT, name STRING, nutrients ARRAY<STRUCT<type STRING, amount DOUBLE>>"))
        sync.handle(batch, 0)
        found.append(rows(sync.current(spark)))
    assert found[0] == found[1] and {r[0] for r in found[0]} == {3, 6}
    ids = spark.createDataFrame([(3,), (6,), (7777,)], "item_id BIGINT")
    assert opened and set(opened) <= set(map(str, kept.items.touched(ids)))


def test_replaced_measures_are_found_without_moving_the_others(spark, items, measures, monkeypatch):
    kept = store.create_store(items, measures, scratch_dir(spark), 8)
    seen, write = [], store.KeyedTable._write

    def watched(table, new, buckets):
        with store._rewriting(spark):
            seen.append((table.name, plan(new)))
        write(table, new, buckets)

    monkeypatch.setattr(store.KeyedTable, "_write", watched)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept.delete_measures(measures.where("row_id % 7 = 0").select("row_id"))
        kept.upsert_measures(measures.where("row_id % 7 = 1").selectExpr("row_id", "item_id + 1 AS item_id", "measure_id", "amount", "0 AS seq"), "seq")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = [above for name, explained in seen if name == kept.measures.name for above in above_scans(explained, name)]
    assert len(moved) == 2 and not any("Exchange" in line for above in moved for line in above)
    want = measures.where("row_id IS NOT NULL AND item_id IS NOT NULL AND row_id % 7 <> 0").selectExpr(
        "row_id", "CASE WHEN row_id % 7 = 1 THEN item_id + 1 ELSE item_id END AS item_id", "measure_id", "amount"
    )
    assert rows(kept.measures.rows()) == rows(want)
