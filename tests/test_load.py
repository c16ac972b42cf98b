"""Raw files: reading, loading, counters, funnel, quality, rebuild."""

import csv
import datetime
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import ingest, quality
from shelfmark.operators.documents import build_documents
from shelfmark.plans import catalogue
from shelfmark.sources.files import READ_ORDER, read_items, read_measures, read_raw, read_reference

FOOD = '''"fdc_id","data_type","description","publication_date","extra"
"1","foundation_food","Milk, ""whole"", raw","2024-01-05","z"
" 2 "," foundation_food ","  Fish
haddock  ","2024-1-5"

"x","foundation_food","Bad id","2024-01-05"
"7.0","foundation_food","Bad id","2024-01-05"
"3","survey_food","Other class","2024-01-05"
"1","foundation_food","Milk again","2024-02-30"
"4","foundation_food","   ","bad"
"5","foundation_food","",""
"6"
'''
MEASURES = '''amount,nutrient_id,fdc_id,id
10.5,1008,1,100
,1008,1,101
abc,1003,1,102
1e3,1003,2,103
1.5d,1003,2,104
0,2039,2,105
5,1085,99,106
5,1085,x,107
5,1085,1,y
5,9999,1,108
nan,1085,4,109
7,1008,1,100
8,1008,5,110
'''
NUTRIENT = '''"id","name","unit_name","rank"
"1008","Energy","KCAL","1"
"1003"," Protein ","","2"
"1085","  ","G","3"
"1","Other","G","4"
"1","Other","G","4"
"","None","G","5"
'''


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "food.csv").write_text(FOOD, encoding="utf-8")
    (tmp_path / "food_nutrient.csv").write_text(MEASURES, encoding="utf-8")
    (tmp_path / "nutrient.csv").write_text(NUTRIENT, encoding="utf-8")
    return str(tmp_path)


def test_reader_by_header_name(spark, folder):
    items = read_items(spark, f"{folder}/food.csv", multi_line=True, ordered=True)
    rows = items.rows.orderBy(READ_ORDER).collect()
    assert items.found and items.missing_columns == ()
    assert rows[0].description == 'Milk, "whole", raw'
    assert rows[1].description == "  Fish\nhaddock  " and rows[1].published == "2024-1-5"
    assert (rows[-1].item_id, rows[-1].item_class) == ("6", None)
    assert len(rows) == 9
    measures = read_measures(spark, f"{folder}/food_nutrient.csv").rows
    assert measures.columns == ["row_id", "item_id", "measure_id", "amount"]
    assert measures.first().asDict() == {"row_id": "100", "item_id": "1", "measure_id": "1008", "amount": "10.5"}


@pytest.mark.parametrize("alphabet", ['ab,"\n ', 'ab, '])
def test_records_with_and_without_line_breaks(spark, tmp_path, alphabet):
    rng = random.Random(8)
    rows = [(str(i), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) + "z") for i in range(300)]
    for name, part in (("a.csv", rows[:200]), ("b.csv", rows[200:])):
        with open(tmp_path / name, "w", newline="") as f:
            out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n")
            out.writerows([("id", "name"), *part])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        table = read_raw(spark, str(tmp_path), {"id": "id", "name": "name"}, multi_line=True, ordered=True)
        tasks = table.rows.rdd.getNumPartitions()
        got = table.rows.orderBy(READ_ORDER).select("id", "name").collect()
        plan = table.rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r) for r in got] == rows
    assert "Exchange" not in plan
    # Files whose lines are all whole records are read in splits, the others as a whole.
    assert tasks == 2 if "\n" in alphabet else tasks > 10


def test_missing_file_and_columns(spark, tmp_path):
    gone = read_items(spark, str(tmp_path / "none.csv"))
    assert not gone.found and gone.rows.count() == 0
    (tmp_path / "r.csv").write_text("id,other\n1,a\n")
    table = read_reference(spark, str(tmp_path / "r.csv"))
    assert table.missing_columns == ("name", "unit_name")
    assert table.rows.first().asDict() == {"measure_id": "1", "name": None, "unit_name": None}
    checks = {r.check: r.n for r in quality.reference_checks(table.rows, table.missing_columns).collect()}
    assert checks["missing_columns"] == 1
    empty = table.rows.where("false")
    assert quality.reference_checks(empty, table.missing_columns).first().n == 0


def test_other_header_in_a_folder_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,a\n")
    (tmp_path / "b.csv").write_text("name,id\nb,2\n")
    table = read_raw(spark, str(tmp_path), {"id": "id", "name": "name"})
    with pytest.raises(Exception, match="(?i)header"):
        table.rows.collect()


def test_load(spark, folder):
    raw = catalogue.read_catalogue(spark, folder)
    items = ingest.load_items(raw.items.rows)
    got = [tuple(r) for r in items.orderBy("item_id", "description").collect()]
    day = datetime.date(2024, 1, 5)
    assert got == [
        (1, "foundation_food", "Milk again", None),
        (1, "foundation_food", 'Milk, "whole", raw', day),
        (2, "foundation_food", "Fish\nhaddock", None),
        (4, "foundation_food", "", None),
        (5, "foundation_food", "", None),
    ]
    reference = ingest.load_reference(raw.reference.rows).orderBy("measure_id").collect()
    assert [tuple(r) for r in reference] == [(1003, "Protein", None), (1008, "Energy", "KCAL"), (1085, None, "G")]
    measures = ingest.load_measures(raw.measures.rows, items)
    assert sorted(r.row_id for r in measures.collect()) == [100, 100, 103, 105, 109, 110]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_counters_and_funnel_on_both_join_paths(spark, folder, limit):
    raw = catalogue.read_catalogue(spark, folder)
    judged_items = ingest.judge_items(raw.items.rows)
    judged = ingest.judge_measures(raw.measures.rows, judged_items.where("reject_reason IS NULL"), broadcast_limit=limit)
    counters = {r.source: r.asDict() for r in ingest.load_counters(judged_items, judged).collect()}
    assert counters["items"] == {"source": "items", "inserted": 5, "skipped": 4, "distinct_ids": 4}
    assert counters["measures"] == {"source": "measures", "inserted": 6, "skipped": 6, "distinct_ids": 5}
    assert ingest.load_funnel(judged).first().asDict() == {
        "total_rows": 13, "listed_measure": 12, "valid_amount": 9, "known_item": 6,
        "duplicate_row_ids": 1, "to_insert": 5, "skipped": 7,
    }


def test_without_items_measures_are_not_read(spark, folder):
    raw = catalogue.read_catalogue(spark, folder)
    judged_items = ingest.judge_items(raw.items.rows, "no_such_class")
    judged = ingest.judge_measures(raw.measures.rows, judged_items.where("reject_reason IS NULL"))
    counters = {r.source: (r.inserted, r.skipped) for r in ingest.load_counters(judged_items, judged).collect()}
    assert counters == {"items": (0, 9), "measures": (0, 0)}


def test_quality_report(spark, folder):
    checks = catalogue.quality_checks(spark, folder)
    counts = {(r.source, r.check): r.n for r in checks.collect()}
    assert counts == {
        ("food", "class_rows"): 7, ("food", "duplicate_ids"): 1, ("food", "bad_ids"): 2,
        ("food", "empty_descriptions"): 2, ("food", "padded_descriptions"): 1,
        ("food_nutrient", "empty_amounts"): 1, ("food_nutrient", "bad_amounts"): 2,
        ("food_nutrient", "duplicate_ids"): 1, ("food_nutrient", "bad_item_ids"): 1, ("food_nutrient", "bad_measure_ids"): 0,
        ("nutrient", "missing_columns"): 0, ("nutrient", "duplicate_ids"): 1, ("nutrient", "bad_ids"): 1,
    }
    text = catalogue.quality_report(checks).splitlines()
    assert text[2] == "Nutrient IDs checked (from config): [1003, 1008, 1085, 2039]"
    assert text[4] == "Has issues: True"
    assert text[6] == "Summary: Cleaning checks found issues: food=4, food_nutrient=4, nutrient=2."
    assert text[9] == "  - Foundation_food rows in scan (data_type=foundation_food): 7 found"
    assert text[-1] == "  - Empty or non-integer id: 1 found"
    assert "  - Missing required columns (id, name, unit_name): none" in text


def test_saved_report(spark, folder, tmp_path):
    checks = catalogue.quality_checks(spark, folder)
    text = catalogue.write_quality_report(checks, str(tmp_path / "report"))
    saved = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert saved == text


def test_unreadable_source_is_a_line_of_the_report(spark, folder, tmp_path):
    (tmp_path / "food.csv").unlink()
    (tmp_path / "food.csv").mkdir()
    (tmp_path / "food.csv" / "a.csv").write_text("fdc_id,data_type\n1,x\n")
    (tmp_path / "food.csv" / "b.csv").write_text("data_type,fdc_id\nx,1\n")
    checks = catalogue.quality_checks(spark, folder)
    lines = [r.line for r in quality.report_lines(checks).where("source = 'food'").collect()]
    assert len(lines) == 1 and lines[0].startswith("Error reading food CSV: ")
    assert checks.where("source = 'nutrient'").count() == 3


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_last_row_read_wins_on_both_join_paths(spark, tmp_path, limit, monkeypatch):
    folder = tmp_path / "measures"
    folder.mkdir()
    want = {}
    for f in range(3):
        rows = [(i % 50, 1, 1008, f * 10_000 + i) for i in range(2_000)]
        (folder / f"part{f}.csv").write_text("id,fdc_id,nutrient_id,amount\n" + "".join("%d,%d,%d,%d\n" % r for r in rows))
        want.update({r[0]: float(r[3]) for r in rows})
    items = spark.createDataFrame([(1,)], "item_id BIGINT")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if limit == 0 else threshold)
    try:
        raw = read_measures(spark, str(folder), ordered=True).rows.repartition(7) if limit == 0 else read_measures(spark, str(folder), ordered=True).rows
        kept = catalogue._one_per_key(ingest.load_measures(raw, items, broadcast_limit=limit), "row_id")
        assert {r.row_id: r.amount for r in kept.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_quality_of_a_clean_folder(spark, tmp_path):
    (tmp_path / "food.csv").write_text("fdc_id,data_type,description,publication_date\n1,foundation_food,A,2024-01-01\n")
    (tmp_path / "food_nutrient.csv").write_text("id,fdc_id,nutrient_id,amount\n1,1,1008,5\n")
    checks = catalogue.quality_checks(spark, str(tmp_path))
    assert quality.summary_text(checks).first().summary.endswith("food=0, food_nutrient=0, nutrient=1.")
    lines = [r.line for r in quality.report_lines(checks).where("source = 'nutrient'").collect()]
    assert lines == [f"File not found: {tmp_path}/nutrient.csv"]
    (tmp_path / "nutrient.csv").write_text("id,name,unit_name\n1008,Energy,KCAL\n")
    summary = quality.summary_text(catalogue.quality_checks(spark, str(tmp_path))).first()
    assert not summary.has_issues and summary.summary.startswith("Cleaning checks completed. No issues found;")


def test_no_row_of_the_class_is_an_issue(spark, folder):
    raw = catalogue.read_catalogue(spark, folder)
    first = quality.item_checks(raw.items.rows, "no_such_class").first()
    assert (first.check, first.n, first.is_issue) == ("class_rows", 0, True)


def test_whole_catalogue_and_reset(spark, folder, tmp_path):
    target = str(tmp_path / "target")
    loaded = catalogue.load_catalogue(spark, folder, target)
    docs = {r.item_id: (r.name, [(m.type, m.amount) for m in r.nutrients]) for r in loaded.documents.collect()}
    assert docs[1] == ("Milk again", [("calories", 7.0)])
    assert docs[2] == ("Fish\nhaddock", [("protein", 1000.0), ("carbs", 0.0)])
    assert docs[5] == ("", [("calories", 8.0)])
    requests = spark.createDataFrame([(1, "milk", None), (2, "hadock", None)], "query_id BIGINT, query STRING, size INT")
    hits = loaded.search(requests).orderBy("query_id").collect()
    assert [(h.query_id, h.rank, h.doc_id) for h in hits] == [(1, 1, 1), (2, 1, 2)]
    # Loading a changed folder into the same target replaces everything.
    with open(f"{folder}/food.csv", "w") as f:
        f.write("fdc_id,data_type,description,publication_date\n9,foundation_food,New,2024-01-01\n")
    again = catalogue.load_catalogue(spark, folder, target)
    assert [r.item_id for r in again.documents.collect()] == [9]


def test_class_is_trimmed_by_default(spark):
    items = spark.createDataFrame([(1, " foundation_food ", "A"), (None, "foundation_food", "B"), (3, "x", "C")],
                                  "item_id BIGINT, item_class STRING, description STRING")
    none = spark.createDataFrame([], "row_id BIGINT, item_id BIGINT, measure_id INT, amount DOUBLE")
    assert [r.item_id for r in build_documents(items, none).collect()] == [1]
    assert build_documents(items, none, trim_class=False).count() == 0


def test_shipped_reference_shape(spark, tmp_path):
    path = tmp_path / "nutrient.csv"
    rows = ['"id","name","unit_name","nutrient_nbr","rank"'] + [f'"{i}","n{i}","G","{i}","1"' for i in (1008, 1003, 2039, 1085, 2047)]
    path.write_text("\n".join(rows) + "\n")
    loaded = ingest.load_reference(read_reference(spark, str(path)).rows)
    assert loaded.agg(F.count("*")).first()[0] == 4
