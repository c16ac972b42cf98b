"""Change events in batch form and as a stream."""

import json
import random
import time

import pytest

from shelfmark.operators import changes, documents
from shelfmark.operators import index as indexes
from shelfmark.operators import mutations
from shelfmark.operators import search as text_search
from shelfmark.sources.feed import read_feed
from shelfmark.streaming import sync as stream
from shelfmark.streaming.sync import DocumentSync

ITEM = "item_id BIGINT, item_class STRING, description STRING"
MEASURE = "row_id BIGINT, item_id BIGINT, measure_id INT, amount DOUBLE"
CLASS = "foundation_food"


def parse(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "seq BIGINT, payload STRING")
    return changes.parse_events(df).orderBy("seq")


def text(**fields):
    return json.dumps(fields)


PAYLOADS = [
    (text(fdc_id=70155, op="UPDATE", table="food_nutrients"), ("food_nutrients", "UPDATE", 70155), "refresh"),
    (text(fdc_id="  88 ", op="DELETE", table="foods"), ("foods", "DELETE", 88), "delete"),
    (text(fdc_id=-4, op="\tDELETE", table="foods\n"), ("foods", "DELETE", -4), "delete"),
    (text(fdc_id=31.99, op="DELETE", table="foods"), ("foods", "DELETE", 31), "delete"),
    (text(fdc_id=0, op="INSERT", table="foods"), ("foods", "INSERT", 0), "refresh"),
    (text(fdc_id=9, op="Delete", table="foods"), ("foods", "Delete", 9), "refresh"),
    (text(fdc_id=10, op="DELETE", table="FOODS"), ("FOODS", "DELETE", 10), "refresh"),
    (text(fdc_id=11, op=" ", table="foods", more=[1, {"a": 2}]), ("foods", "", 11), "refresh"),
    (text(fdc_id=12, op=5, table="other"), ("other", "5", 12), "refresh"),
]
REFUSED = [
    (text(table="foods", op="UPDATE", fdc_id="12.7"), "bad_id"),
    (text(table="foods", op="UPDATE", fdc_id="1e3"), "bad_id"),
    (text(table="foods", op="UPDATE", fdc_id=False), "bad_id"),
    (text(table="foods", op="UPDATE", fdc_id=[3]), "bad_id"),
    (text(table="foods", op="UPDATE", fdc_id=""), "bad_id"),
    (text(table=0, op="UPDATE", fdc_id=3), "no_table"),
    (text(table=[], op="UPDATE", fdc_id=3), "no_table"),
    (text(op="UPDATE", fdc_id=3), "no_table"),
    (text(table="foods", op=False, fdc_id=3), "no_op"),
    (text(table="foods", op={}, fdc_id=3), "no_op"),
    (text(table="foods", op="UPDATE"), "no_id"),
    ("[3, 4]", "not_an_event"), ("17", "not_an_event"), ("<foods/>", "not_an_event"), ('{"table":"foods"', "not_an_event"), (None, "not_an_event"),
]


def test_parse_and_route(spark):
    parsed = parse(spark, [p for p, _, _ in PAYLOADS] + [p for p, _ in REFUSED])
    good = parsed.where("reject_reason IS NULL").collect()
    assert [(r.table, r.op, r.item_id) for r in good] == [e for _, e, _ in PAYLOADS]
    assert [r.reject_reason for r in parsed.where("reject_reason IS NOT NULL").collect()] == [w for _, w in REFUSED]
    routed = changes.route_events(parsed).orderBy("seq").collect()
    assert [r.action for r in routed] == [a for _, _, a in PAYLOADS]


def test_last_action_wins(spark):
    routed = spark.createDataFrame([(1, 5, "delete"), (2, 5, "refresh"), (3, 6, "refresh"), (4, 6, "delete")],
                                   "seq BIGINT, item_id BIGINT, action STRING")
    assert {r.item_id: r.action for r in changes.last_actions(routed).collect()} == {5: "refresh", 6: "delete"}


def test_item_events(spark):
    old = spark.createDataFrame([(1, CLASS, "a"), (2, "x", "b"), (3, CLASS, "c"), (4, "x", "d"), (5, CLASS, "e"), (6, None, "f")], ITEM)
    new = spark.createDataFrame([(1, CLASS, "a"), (2, CLASS, "b"), (3, "x", "c"), (4, "x", "D"), (7, CLASS, "g"), (8, "x", "h"), (6, None, "F")], ITEM)
    got = {(r.op, r.item_id) for r in changes.item_events(old, new).collect()}
    assert got == {("UPDATE", 2), ("UPDATE", 3), ("DELETE", 5), ("INSERT", 7)}
    payload = changes.with_payload(changes.item_events(old, new).where("item_id = 7")).first().payload
    assert json.loads(payload) == {"table": "foods", "op": "INSERT", "fdc_id": 7}


def test_measure_events(spark):
    old = spark.createDataFrame([(1, 10, 1, 1.0), (2, 10, 1, 1.0), (3, 11, 1, 1.0)], MEASURE)
    new = spark.createDataFrame([(1, 12, 1, 1.0), (2, 10, 1, 2.0), (4, 13, 1, 1.0)], MEASURE)
    both = {(r.op, r.item_id) for r in changes.measure_events(old, new).collect()}
    assert both == {("UPDATE", 12), ("UPDATE", 10), ("DELETE", 11), ("INSERT", 13)}
    moved = changes.measure_events(old.where("row_id = 1"), new.where("row_id = 1"), notify_both_owners=False)
    assert [r.item_id for r in moved.collect()] == [12]


def test_cascade_fires_for_measures_too(spark):
    items = spark.createDataFrame([(1, CLASS, "a"), (2, CLASS, "b")], ITEM)
    measures = spark.createDataFrame([(1, 1, 1008, 1.0), (2, 1, 1003, 1.0), (3, 2, 1008, 1.0)], MEASURE)
    left = mutations.delete_items(items, measures, items.where("item_id = 1"))
    events = changes.table_events(items, left[0], measures, left[1]).collect()
    assert sorted((r.table, r.op, r.item_id) for r in events) == [
        ("food_nutrients", "DELETE", 1), ("food_nutrients", "DELETE", 1), ("foods", "DELETE", 1)]


def test_failures(spark):
    failed = spark.createDataFrame([(1, 0), (2, 2), (3, 3)], "seq BIGINT, attempt INT")
    got = {r.seq: (r.attempt, r.outcome) for r in changes.split_failures(failed).collect()}
    assert got == {1: (1, "retry"), 2: (3, "retry"), 3: (4, "dead")}


class Shop:
    """Tables that change between readings."""

    def __init__(self, spark):
        self.spark = spark
        self.items = {1: (CLASS, "Fish, haddock, raw"), 2: (CLASS, "Milk"), 3: ("survey_food", "Other")}
        self.measures = {100: (1, 1008, 70.0), 101: (2, 1008, 50.0)}
        self.fail = False

    def tables(self, spark):
        if self.fail:
            raise RuntimeError("tables not reachable")
        items = spark.createDataFrame([(k, *v) for k, v in self.items.items()], ITEM)
        measures = spark.createDataFrame([(k, *v) for k, v in self.measures.items()], MEASURE)
        return items, measures

    def documents(self):
        return documents.build_documents(*self.tables(self.spark))


def contents(df):
    return {r.item_id: (r.name, [tuple(m) for m in r.nutrients]) for r in df.collect()}


def event(seq, op, item, table="foods"):
    return {"seq": seq, "payload": json.dumps({"table": table, "op": op, "fdc_id": item})}


@pytest.fixture()
def shop(spark):
    return Shop(spark)


@pytest.fixture()
def sync(spark, shop, tmp_path):
    s = DocumentSync(str(tmp_path / "docs"), shop.tables, retry_interval=0.0)
    s.rebuild(shop.documents())
    return s


def send(tmp_path, name, events):
    feed = tmp_path / "feed"
    feed.mkdir(exist_ok=True)
    (feed / f".{name}.tmp").write_text("\n".join(json.dumps(e) for e in events) + "\n")
    (feed / f".{name}.tmp").rename(feed / f"{name}.json")
    return str(feed)


def follow(spark, sync, tmp_path, max_files=None):
    query = sync.start(read_feed(spark, str(tmp_path / "feed"), max_files=max_files), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_follows_the_tables(spark, shop, sync, tmp_path):
    before = contents(sync.current(spark))
    assert set(before) == {1, 2}

    del shop.items[1]
    send(tmp_path, "a", [event(1, "DELETE", 1), event(2, "DELETE", 99), {"seq": 3, "payload": "not json"}])
    follow(spark, sync, tmp_path)
    assert set(contents(sync.current(spark))) == {2}
    assert [r.reject_reason for r in sync.rejects(spark).collect()] == ["not_an_event"]

    shop.items[1] = (CLASS, "Fish, haddock, raw")
    shop.items[2] = ("survey_food", "Milk")
    shop.items[4] = (CLASS, "  chicken balooza ")
    shop.measures[102] = (4, 2039, 20.0)
    send(tmp_path, "b", [event(4, "INSERT", 1), event(5, "UPDATE", 2), event(6, "INSERT", 4), event(7, "INSERT", 4, "food_nutrients")])
    follow(spark, sync, tmp_path)
    assert contents(sync.current(spark)) == {
        1: ("Fish, haddock, raw", [("calories", 70.0)]), 4: ("chicken balooza", [("carbs", 20.0)])}

    del shop.measures[102]
    shop.measures[100] = (1, 1008, 70.5)
    send(tmp_path, "c", [event(8, "DELETE", 4, "food_nutrients"), event(9, "UPDATE", 1, "food_nutrients")])
    follow(spark, sync, tmp_path)
    assert contents(sync.current(spark)) == {1: ("Fish, haddock, raw", [("calories", 70.5)]), 4: ("chicken balooza", [])}

    sync.compact(spark, str(tmp_path / "compacted"))
    assert contents(spark.read.parquet(str(tmp_path / "compacted"))) == contents(sync.current(spark))


def test_running_a_batch_again_changes_nothing(spark, shop, sync):
    shop.items[2] = (CLASS, "Milk, whole")
    events = spark.createDataFrame([(1, event(1, "UPDATE", 2)["payload"])], "seq BIGINT, payload STRING")
    sync.handle(events, 0)
    once = contents(sync.current(spark))
    sync.handle(events, 0)
    assert contents(sync.current(spark)) == once and once[2][0] == "Milk, whole"


def test_failed_batches_are_tried_again_then_set_aside(spark, shop, sync):
    shop.items[2] = (CLASS, "Milk, whole")
    events = spark.createDataFrame([(1, event(1, "UPDATE", 2)["payload"])], "seq BIGINT, payload STRING")
    shop.fail = True
    sync.handle(events, 0)
    assert contents(sync.current(spark))[2][0] == "Milk"
    shop.fail = False
    sync.retry_pending(spark, 1)
    assert contents(sync.current(spark))[2][0] == "Milk, whole"
    assert sync.dead_letters(spark).count() == 0

    shop.fail = True
    sync.handle(events, 2)
    for batch in (3, 4, 5):
        sync.retry_pending(spark, batch)
    dead = sync.dead_letters(spark).collect()
    assert [(r.seq, r.attempt) for r in dead] == [(1, 4)] and "not reachable" in dead[0].error
    sync.retry_pending(spark, 6)
    assert sync.dead_letters(spark).count() == 1


def test_an_old_delete_does_not_remove_a_new_item(spark, shop, sync):
    shop.fail = True
    sync.handle(spark.createDataFrame([(1, event(1, "DELETE", 1)["payload"])], "seq BIGINT, payload STRING"), 0)
    shop.fail = False
    sync.retry_pending(spark, 1)
    assert 1 in contents(sync.current(spark))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_batch_result(spark, shop, sync, tmp_path, seed):
    rng = random.Random(seed)
    shop.items.update({i: (CLASS, f"n{i}") for i in range(4, 12) if rng.random() < 0.6})
    events = []
    for seq in range(30):
        item = rng.randint(1, 12)
        # A delete is only sent for an item that is gone.
        op = "DELETE" if item not in shop.items and rng.random() < 0.7 else "UPDATE"
        events.append(event(seq, op, item))
    cuts = sorted(rng.sample(range(1, 30), 2))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 30])):
        send(tmp_path, f"part{i}", events[a:b])
    old = sync.current(spark)
    routed = changes.route_events(parse(spark, [e["payload"] for e in events]))
    want = contents(changes.apply_events(old, routed, *shop.tables(spark)))
    follow(spark, sync, tmp_path, max_files=1)
    assert contents(sync.current(spark)) == want


def test_padded_class_gives_an_event_as_it_gives_a_document(spark):
    old = spark.createDataFrame([(1, "x", "a")], ITEM)
    new = spark.createDataFrame([(1, f" {CLASS}\t", "a")], ITEM)
    none = spark.createDataFrame([], MEASURE)
    assert documents.build_documents(new, none).count() == 1
    assert [r.op for r in changes.item_events(old, new).collect()] == ["UPDATE"]
    assert changes.item_events(old, new, trim_class=False).count() == 0


def both(spark):
    rows = [(i, event(i, "UPDATE", i)["payload"]) for i in (1, 2)]
    return spark.createDataFrame(rows, "seq BIGINT, payload STRING")


def test_one_bad_item_does_not_take_the_batch_with_it(spark, shop, sync, monkeypatch):
    build = stream.document_changes

    def poisoned(actions, items, measures, **options):
        if not actions.where("item_id = 2").isEmpty():
            raise RuntimeError("item 2 cannot be built")
        return build(actions, items, measures, **options)

    monkeypatch.setattr(stream, "document_changes", poisoned)
    shop.items.update({1: (CLASS, "one"), 2: (CLASS, "two")})
    sync.handle(both(spark), 0)
    for batch in (1, 2, 3, 4):
        sync.retry_pending(spark, batch)
    assert {k: v[0] for k, v in contents(sync.current(spark)).items()} == {1: "one", 2: "Milk"}
    assert [(r.seq, r.attempt) for r in sync.dead_letters(spark).collect()] == [(2, 4)]


def test_retries_wait_until_they_are_due(spark, shop, sync):
    now = [100.0]
    sync.clock, sync.retry_interval = lambda: now[0], 30.0
    shop.items[1] = (CLASS, "one")
    shop.fail = True
    sync.handle(both(spark), 0)
    shop.fail = False
    sync.retry_pending(spark, 1)
    assert contents(sync.current(spark))[1][0] != "one"
    now[0] = 130.0
    sync.retry_pending(spark, 2)
    assert contents(sync.current(spark))[1][0] == "one"


def test_retries_come_due_while_the_feed_is_quiet(spark, shop, sync, tmp_path):
    shop.items[1] = (CLASS, "one")
    shop.fail = True
    feed = send(tmp_path, "a", [event(1, "UPDATE", 1)])
    query = sync.start(read_feed(spark, feed), str(tmp_path / "quiet"), interval="1 second")
    try:
        for _ in range(60):
            if query.lastProgress and query.lastProgress["batchId"] >= 0:
                break
            time.sleep(1)
        shop.fail = False
        for _ in range(60):
            if contents(sync.current(spark))[1][0] == "one":
                break
            time.sleep(1)
    finally:
        query.stop()
    assert contents(sync.current(spark))[1][0] == "one"


def test_search_sees_changes(spark, shop, sync, tmp_path):
    first = sync.current(spark).withColumnRenamed("item_id", "doc_id")
    base = indexes.scratch_index(first, "doc_id", "name")

    def top(query):
        docs = sync.current(spark).withColumnRenamed("item_id", "doc_id")
        index = sync.index(spark, base)
        found = text_search.search(spark.createDataFrame([(1, query, 5)], "query_id BIGINT, query STRING, size INT"), index, docs)
        return [r.doc_id for r in found.orderBy("rank").collect()]

    assert top("Fish, haddock, raw") == [1]
    shop.items[2] = (CLASS, "chicken balooza")
    del shop.items[1]
    send(tmp_path, "a", [event(1, "DELETE", 1), event(2, "UPDATE", 2)])
    follow(spark, sync, tmp_path)
    assert top("Fish, haddock, raw") == [] and top("chicken balooza") == [2]
    docs = sync.current(spark).withColumnRenamed("item_id", "doc_id")
    whole = indexes.scratch_index(docs, "doc_id", "name")
    followed = sync.index(spark, base)
    assert sorted(map(tuple, followed.terms.collect())) == sorted(map(tuple, whole.terms.collect()))
    assert followed.totals.first() == whole.totals.first()


def test_the_text_of_an_event_is_read_once(spark):
    feed = spark.createDataFrame([(1, "{}")], "seq BIGINT, payload STRING")
    explained = changes.parse_events(feed)._jdf.queryExecution().optimizedPlan().toString()
    assert explained.count("parseJson(payload") == 1
