"""Mutations, constraints, documents and the spread join."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfmark.operators import constraints, documents, mutations, skew

ITEM = "item_id BIGINT, item_class STRING, description STRING"
MEASURE = "row_id BIGINT, item_id BIGINT, measure_id INT, amount DOUBLE"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(1, "c", "one"), (2, "c", "two"), (3, "d", "three")], ITEM).cache()


def test_upsert_takes_the_last_or_fails(spark, base):
    changes = spark.createDataFrame([(2, "c", "old", 1), (2, None, "new", 2), (4, "c", "four", 3)], ITEM + ", seq BIGINT")
    assert rows(mutations.upsert(base, changes, "item_id", "seq")) == [
        (1, "c", "one"), (2, None, "new"), (3, "d", "three"), (4, "c", "four")]
    assert mutations.upsert_counts(base, changes, "item_id").first().asDict() == {"sent": 3, "inserted": 1, "updated": 1}
    with pytest.raises(PySparkException, match="more than one row for key 2"):
        mutations.upsert(base, changes, "item_id", "seq", on_duplicate="error").collect()
    single = changes.where("seq > 1")
    assert rows(mutations.upsert(base, single, "item_id", "seq", on_duplicate="error"))[1] == (2, None, "new")
    none = changes.where("false")
    assert rows(mutations.upsert(base, none, "item_id", "seq")) == rows(base)
    assert mutations.upsert_counts(base, none, "item_id").first().asDict() == {"sent": 0, "inserted": 0, "updated": 0}


def test_insert_only(spark, base):
    new = spark.createDataFrame([(3, "x", "x", 1), (5, "c", "first", 2), (5, "c", "second", 3)], ITEM + ", seq BIGINT")
    status = mutations.insert_status(base, new, "item_id", "seq").select("seq", "status")
    assert rows(status) == [(1, "conflict"), (2, "inserted"), (3, "conflict")]
    assert rows(mutations.insert_only(base, new, "item_id", "seq"))[-1] == (5, "c", "first")


def test_partial_update(spark, base):
    changes = spark.createDataFrame(
        [(1, None, "a", 1), (1, "z", None, 2), (2, None, None, 3), (9, "z", "z", 4)], ITEM + ", seq BIGINT")
    assert rows(mutations.partial_update(base, changes, "item_id", "seq")) == [
        (1, "z", "a"), (2, "c", "two"), (3, "d", "three")]
    status = mutations.update_status(base, changes, "item_id", "seq").select("seq", "status")
    assert rows(status) == [(1, "updated"), (2, "updated"), (3, "no_change"), (4, "not_found")]


def test_deletes(spark, base):
    measures = spark.createDataFrame([(10, 1, 1, 1.0), (11, 1, 2, 2.0), (12, 2, 1, 3.0)], MEASURE)
    keys = spark.createDataFrame([(1,), (7,)], "item_id BIGINT")
    items, left = mutations.delete_items(base, measures, keys)
    assert [r.item_id for r in items.orderBy("item_id").collect()] == [2, 3]
    assert [r.row_id for r in left.collect()] == [12]
    assert rows(mutations.delete_status(base, keys, "item_id")) == [(1, True), (7, False)]
    asked = spark.createDataFrame([(12,), (99,)], "row_id BIGINT")
    left, deleted = mutations.delete_measures(measures, asked)
    assert rows(deleted) == [(12, 2)] and left.count() == 2
    gone = base.where("item_id = 2").join(left, "item_id", "left")
    assert gone.count() == 1  # the owner stays without measures


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_assigned_ids_follow_the_order(spark, n):
    rng = random.Random(n)
    seqs = [i * i for i in range(n)]
    rng.shuffle(seqs)
    base = spark.createDataFrame([(41,), (7,)], "row_id BIGINT")
    batch = spark.createDataFrame([(s, f"p{s}") for s in seqs], "seq BIGINT, p STRING")
    got = [(r.row_id, r.seq) for r in mutations.assign_ids(base, batch, "row_id", "seq").collect()]
    assert sorted(got) == [(42 + i, s) for i, s in enumerate(sorted(seqs))]
    empty = mutations.assign_ids(base.where("false"), batch, "row_id", "seq")
    assert sorted(r.row_id for r in empty.collect()) == list(range(1, n + 1))


def test_dates_in_mutations(spark):
    raw = spark.createDataFrame([(1, "2024-01-05"), (2, "soon"), (3, None)], "item_id BIGINT, published STRING")
    typed = mutations.typed_item_changes(raw).orderBy("item_id").collect()
    assert [(str(r.published), r.reject_reason) for r in typed] == [
        ("2024-01-05", None), ("None", "bad_published"), ("None", None)]


def test_constraints(spark, base):
    child = spark.createDataFrame([(1, 1, 1, 1.0), (1, 9, 1, None), (2, 9, 2, 1.0), (3, None, 2, 1.0)], MEASURE)
    assert rows(constraints.duplicate_keys(child, ["row_id"])) == [(1, 2)]
    assert dict(rows(constraints.null_counts(child, ["row_id", "item_id", "amount"]))) == {"row_id": 0, "item_id": 1, "amount": 1}
    assert rows(constraints.orphan_keys(child, "item_id", base, "item_id")) == [(9, 2)]
    assert rows(constraints.restricted_deletes(base, "item_id", child, "item_id")) == [(1, 1)]


def amounts(spark, entries):
    data = [(i, 1, m, a) for i, (m, a) in enumerate(entries)]
    return spark.createDataFrame(data, "row_id BIGINT, item_id BIGINT, measure_id INT, amount STRING")


@pytest.mark.parametrize("entries, mapping, want", [
    ([(1085, "4.5"), (1008, "61"), (2039, "7"), (1003, "3.25")], None, {"calories": 61, "protein": 3.25, "carbs": 7, "fat": 4.5}),
    ([(2039, "88.1")], None, {"carbs": 88.1}),
    ([], None, {}),
    ([(1085, "0.0"), (1085, "-2")], None, {"fat": -2}),
    ([(17, "6"), (1003, "5")], {17: "protein"}, {"protein": 6}),
    ([(555, "12"), (None, "3")], None, {}),
    ([(1008, "12 g"), (1003, None), (2039, "{1}"), (1085, " ")], None, {}),
    ([(1003, "2")], {1003: "vitamins"}, {}),
    ([(1003, "2")], {}, {}),
    ([(1003, "2")], {"1003": "protein"}, {}),
    ([(1003, "2"), (1003, "3"), (1003, "1")], None, {"protein": 1}),
])
def test_mapping_cases(spark, entries, mapping, want):
    table = amounts(spark, entries)
    options = {} if mapping is None else {"mapping": mapping}
    mapped = documents.map_measures(table, **options)
    assert {r.type: r.amount for r in mapped.collect()} == want
    arrays = documents.measure_arrays(table, **options).collect()
    assert {m.type: m.amount for r in arrays for m in r.nutrients} == want


def test_wide_and_long_gathering_agree(spark):
    rng = random.Random(3)
    names = [f"m{i}" for i in range(20)]
    mapping = dict(enumerate(names))
    table = spark.createDataFrame(
        [(i, rng.randint(1, 6), rng.randint(0, 21), rng.choice([None, 1.0, 2.0, float(i)])) for i in range(400)], MEASURE)
    small = {i: n for i, n in mapping.items() if i < 10}

    def gathered(df):
        return {r.item_id: [tuple(m) for m in r.nutrients] for r in df.collect() if r.nutrients}

    wide = gathered(documents.measure_arrays(table, small, names=names))
    long = gathered(documents.measure_arrays(table, mapping, names=names))
    assert wide == {k: v for k, v in ((k, [m for m in v if m[0] in small.values()]) for k, v in long.items()) if v}


def test_documents(spark):
    items = spark.createDataFrame([(1, "foundation_food", " Food A "), (2, "foundation_food", None), (3, "survey_food", "C")], ITEM)
    measures = spark.createDataFrame([(1, 1, 1008, 100.0), (2, 1, 77, 1.0), (3, 3, 1008, 1.0)], MEASURE)
    docs = {r.item_id: r for r in documents.build_documents(items, measures).collect()}
    assert set(docs) == {1, 2}
    assert docs[1].name == "Food A" and [tuple(m) for m in docs[1].nutrients] == [("calories", 100.0)]
    assert docs[2].name == "" and docs[2].nutrients == []
    changed = documents.build_documents(items.where("item_id = 2"), measures).withColumn("seq", F.lit(1))
    with_null = changed.unionByName(changed.withColumn("item_id", F.lit(None).cast("bigint")))
    assert documents.upsert_documents(documents.build_documents(items, measures), with_null, "seq").count() == 2


def test_result_shape(spark):
    schema = "query_id BIGINT, rank INT, name STRING, nutrients ARRAY<STRUCT<type STRING, amount DOUBLE>>"
    hits = spark.createDataFrame([
        (1, 1, "A", [("calories", 1.0), (None, 1.0), ("fat", None), ("other", 1.0), ("fat", 2.0)]),
        (1, 2, None, None),
        (1, 3, "C", []),
    ], schema)
    shaped = documents.shape_hits(hits).orderBy("rank").collect()
    assert [(r.name, [tuple(m) for m in r.nutrients]) for r in shaped] == [
        ("A", [("calories", 1.0), ("fat", 2.0)]), ("", []), ("C", [])]
    requests = spark.createDataFrame([(1,), (2,)], "query_id BIGINT")
    bodies = {r.query_id: json.loads(r.response) for r in documents.responses(documents.shape_hits(hits), requests).collect()}
    assert bodies[2] == {"foods": []}
    assert bodies[1]["foods"][0] == {"name": "A", "nutrients": [{"type": "calories", "amount": 1.0}, {"type": "fat", "amount": 2.0}]}
    assert [f["name"] for f in bodies[1]["foods"]] == ["A", "", "C"]


def test_spread_join_equals_broadcast(spark):
    rng = random.Random(1)
    data = [(rng.choice([1] * 500 + [None] * 300 + list(range(2, 60))), i % 7) for i in range(4000)]
    facts = spark.createDataFrame(data, "k BIGINT, v INT").repartition(3)
    keys = spark.createDataFrame([(k,) for k in [1, 1, 5, 9, 33, None, 1000]], "k BIGINT")
    small = skew.with_membership(facts, keys, "k", "known")
    large = skew.with_membership(facts, keys, "k", "known", limit=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    heavy = {r.k: r._parts for r in skew.heavy_keys(facts, "k").collect()}
    assert 1 in heavy and heavy[1] >= 2 and len(heavy) <= skew.HEAVY_SHARE


def test_spread_join_splits_the_heavy_key(spark):
    facts = spark.range(0, 20000, 1, 4).select((F.col("id") % 3 > 0).cast("bigint").alias("k"), F.col("id").alias("v"))
    keys = spark.createDataFrame([(1,)], "k BIGINT")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        joined = skew.with_membership(facts, keys, "k", "known", limit=0)
        sizes = [r.n for r in joined.where("k = 1").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 13333 and len(sizes) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
