"""Reports seen while loading, keyed event state, Bloom-filtered key joins, refused measure updates, scan limits."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import bloom, changes, ingest, mutations, quality, skew
from shelfmark.plans import bindings as b
from shelfmark.plans import observed
from shelfmark.session import scratch_dir
from shelfmark.streaming.keyed import EventState, event_states, keyed_state, read_all


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- observed -------------------------------------------------------------------------


def raw_tables(spark, sf):
    return b.raw_items(spark, sf), b.raw_measures(spark, sf), b.raw_reference(spark, sf)


@pytest.mark.parametrize("empty", ["none", "items", "measures"])
def test_reports_seen_while_loading_are_those_of_the_operators(spark, sf, empty):
    items, measures, reference = raw_tables(spark, sf)
    if empty == "items":
        items = items.where("false")
    if empty == "measures":
        measures = measures.where("false")
    loaded = observed.load_observed(items, measures, reference, scratch_dir(spark), b.CLASS, b.MAPPING, ["name"])
    judged = ingest.judge_items(items, b.CLASS)
    judged_measures = ingest.judge_measures(measures, judged.where("reject_reason IS NULL"), b.MAPPING)
    assert rows(loaded.counters) == rows(ingest.load_counters(judged, judged_measures))
    assert rows(loaded.funnel) == rows(ingest.load_funnel(judged_measures))
    checks = quality.item_checks(items, b.CLASS).unionByName(quality.measure_checks(measures, b.MAPPING)).unionByName(quality.reference_checks(reference, ["name"]))
    assert rows(loaded.checks) == rows(checks)
    ids = judged.where("reject_reason IS NULL").select("item_id").distinct()
    assert rows(loaded.items.select("item_id")) == rows(ids)
    kept = judged_measures.where("reject_reason IS NULL").select("row_id").distinct()
    assert rows(loaded.measures.select("row_id")) == rows(kept)


def test_each_raw_file_is_scanned_once(spark, tmp_path, monkeypatch):
    (tmp_path / "items.csv").write_text("fdc_id,data_type,description,publication_date\n1,foundation_food,A,2024-01-01\n1,foundation_food,B,2024-01-01\n")
    (tmp_path / "measures.csv").write_text("id,fdc_id,nutrient_id,amount\n1,1,1008,5\n1,1,1008,6\n2,9,1008,1\n3,1,1008,x\n")
    (tmp_path / "reference.csv").write_text("id,name,unit_name\n1008,Energy,KCAL\n")
    from shelfmark.sources.files import read_items, read_measures, read_reference

    plans = []
    monkeypatch.setattr(observed, "written", lambda df, path, write=observed.written: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, path))[1])
    tables = [read(spark, str(tmp_path / f"{name}.csv"), ordered=True).rows for name, read in (("items", read_items), ("measures", read_measures), ("reference", read_reference))]
    loaded = observed.load_observed(*tables, str(tmp_path / "out"))
    assert sum(p.count("FileScan csv") for p in plans) == 3
    for plan in plans:  # what is observed stands above every exchange
        assert "Exchange" not in plan.split("CollectMetrics")[0]
    assert rows(loaded.items.select("item_id", "description")) == [(1, "B")]
    assert rows(loaded.measures) == [(1, 1, 1008, 6.0)]
    assert rows(loaded.counters) == [("items", 2, 0, 1), ("measures", 2, 2, 1)]


# --- keyed state ----------------------------------------------------------------------


def stream(spark, folder, target, processor):
    feed = spark.readStream.schema("seq BIGINT, item_id BIGINT, action STRING, attempt INT").option("maxFilesPerTrigger", 1).json(folder)
    with keyed_state(spark):
        found = event_states(feed, processor)
        writer = found.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/checkpoint")
        read_all(writer.outputMode("append").trigger(availableNow=True).start())
    return spark.read.schema(found.schema).parquet(f"{target}/out")


@pytest.mark.parametrize("files", [1, 3])
def test_keyed_outcomes_for_any_split_and_after_a_restart(spark, tmp_path, files):
    rng = random.Random(files)
    events = [(i, rng.randint(1, 8), rng.choice(["refresh", "delete"]), rng.randint(0, 4)) for i in range(60)]
    routed = spark.createDataFrame(events, "seq BIGINT, item_id BIGINT, action STRING, attempt INT")
    failed = spark.createDataFrame([(3, "down"), (6, "down")], "item_id BIGINT, error STRING")
    want = rows(changes.settle_events(routed, failed).select("seq", "item_id", "attempt", "outcome"))
    folder, late = tmp_path / "in", tmp_path / "late"
    for part in range(files):
        routed.where(f"seq % {files} = {part}").coalesce(1).write.mode("append").json(str(folder if part < 2 else late))
    processor = EventState(lambda item_id, action: "down" if item_id % 3 == 0 else None, interval=0.0)
    found = stream(spark, str(folder), str(tmp_path), processor)
    if files > 2:  # the query stopped, then came back with more files and its checkpoint
        for file in late.glob("part-*.json"):
            shutil.copy(file, folder)
        found = stream(spark, str(folder), str(tmp_path), processor)
    first = found.where("NOT retried")
    assert rows(first.select("seq", "item_id", "attempt", "outcome")) == want
    # With no wait, events of failing items have come due by timers and were tried again, the attempts one higher each time.
    tries = found.where("outcome <> 'done'").groupBy("seq").agg(F.sort_array(F.collect_list("attempt")).alias("a"), F.min("attempt").alias("lo")).collect()
    assert all(r.a == list(range(r.lo, r.lo + len(r.a))) and r.a[-1] <= max(4, r.lo) for r in tries)
    if files > 2:
        assert found.where("retried").count() > 0
    last = {r.item_id: (r.s, r.a) for r in found.groupBy("item_id").agg(F.max("last_seq").alias("s"), F.max_by("last_action", "last_seq").alias("a")).collect()}
    assert last == {i: max((s, a) for s, k, a, _ in events if k == i) for i in {e[1] for e in events}}


# --- Bloom filter ---------------------------------------------------------------------


def test_filter_keeps_all_keys_and_few_others(spark):
    keys = spark.range(0, 40_000, 2).withColumnRenamed("id", "k")
    found = bloom.key_filter(keys, "k", 20_000)
    facts = spark.range(60_000).withColumnRenamed("id", "k")
    passed = found.passing(facts, "k")
    assert passed.where("k < 40000 AND k % 2 = 0").count() == 20_000
    assert passed.count() < 20_000 + 40_000 * 0.01
    assert passed.count() + found.failing(facts, "k").count() == 60_000
    assert bloom.key_filter(keys, "k", 1 << 40) is None


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_key_joins_with_and_without_a_filter(spark, limit):
    facts = spark.createDataFrame([(i % 50 if i % 7 else None, i) for i in range(500)] + [(3, i) for i in range(300)], "k BIGINT, v INT")
    keys = spark.createDataFrame([(i,) for i in range(0, 50, 3)] + [(None,), (3,)], "k BIGINT")
    want = [r for r in rows(facts) if r[0] is not None and r[0] % 3 == 0]
    assert rows(skew.keep_known(facts, keys, "k", limit)) == want
    assert rows(skew.drop_known(facts, keys, "k", limit)) == sorted(set(rows(facts)) - set(want), key=repr)


def test_rows_that_do_not_match_are_not_shuffled(spark):
    """Of 20,000 rows and 500 keys beyond the limit, the salted exchange gets the rows that match and the filter's error."""
    facts = spark.range(20_000).withColumnRenamed("id", "k")
    keys = spark.range(0, 10_000, 20).withColumnRenamed("id", "k")
    maybe, _, found = skew._filtered(facts, keys, "k", 100)
    assert found is not None and 500 <= maybe.count() <= 600
    plan = skew.keep_known(facts, keys, "k", 100)._jdf.queryExecution().executedPlan().toString()
    assert "_hit" in plan or "getbit" in plan.lower() or "bit_get" in plan.lower()


# --- refused updates, scan limits -----------------------------------------------------


def test_measure_updates_are_refused_by_foreign_keys(spark):
    base = spark.createDataFrame([(1, 10, 1008, 1.0), (2, 11, 1003, 2.0)], "row_id BIGINT, item_id BIGINT, measure_id INT, amount DOUBLE")
    items = spark.createDataFrame([(10,), (11,)], "item_id BIGINT")
    reference = spark.createDataFrame([(1003,), (1008,)], "measure_id INT")
    batch = spark.createDataFrame(
        [(1, 99, None, 5.0, 1), (1, None, 7, 6.0, 2), (1, 11, None, None, 3), (2, None, None, None, 4), (2, None, 1008, 9.0, 5), (5, 10, None, 1.0, 6), (None, 10, None, 1.0, 7)],
        "row_id BIGINT, item_id BIGINT, measure_id INT, amount DOUBLE, seq INT",
    )
    status = {r.seq: r.status for r in mutations.measure_update_status(base, batch, items, reference).collect()}
    assert status == {1: "unknown_item", 2: "unknown_measure", 3: "updated", 4: "no_change", 5: "updated", 6: "not_found", 7: "not_found"}
    assert rows(mutations.update_measures(base, batch, items, reference)) == [(1, 11, 1008, 1.0), (2, 11, 1008, 9.0)]


def test_scan_limits(spark):
    raw = spark.range(1_000).selectExpr("CAST(id AS STRING) AS item_id", "'foundation_food' AS item_class", "'d' AS description")
    seen = lambda **k: quality.item_checks(quality.scanned(raw, **k)).where("check = 'class_rows'").first().n
    assert seen() == seen(max_rows=0) == 1_000
    assert seen(max_rows=500) == 499 and seen(max_rows=5_000) == 1_000 and seen(max_rows=1) == 0
    part = seen(fraction=0.3)
    assert 200 < part < 400 and part == seen(fraction=0.3)
