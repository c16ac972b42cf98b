"""Requests, clauses, ranking, and the index on disk."""

import math

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import index as indexes
from shelfmark.operators import requests as req
from shelfmark.operators import search as text_search

NAMES = {
    1: "Fish, haddock, raw",
    2: "Fish, cod, raw",
    3: "Milk, whole",
    4: "Milk 2%",
    5: "Haddock soup",
    6: "Chicken breast, raw",
    7: "Breast of chicken",
    8: "chicken balooza",
    9: "",
    10: "raw raw raw fish",
    11: "Milk, whole",
}
REQUEST = "query_id BIGINT, query STRING, size INT"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(NAMES.items()), "doc_id BIGINT, name STRING").cache()


@pytest.fixture(scope="module")
def index(docs):
    return indexes.scratch_index(docs, "doc_id", "name")


def run(spark, index, docs, query, size=None, **options):
    requests = spark.createDataFrame([(1, query, size)], REQUEST)
    found = text_search.search(requests, index, docs, **options).orderBy("rank").collect()
    assert [r.rank for r in found] == list(range(1, len(found) + 1))
    return [r.doc_id for r in found]


def test_validation(spark):
    requests = spark.createDataFrame(
        [(1, None, 5), (2, "", 0), (3, "  ", 5), (4, "a", 0), (5, "a", 101), (6, " a ", None), (7, "a", 100)], REQUEST)
    refused = {r.query_id: (r.code, r.message) for r in req.refused_requests(requests).collect()}
    assert {k: v[0] for k, v in refused.items()} == {
        1: "QUERY_REQUIRED", 2: "QUERY_REQUIRED", 3: "QUERY_REQUIRED", 4: "INVALID_SIZE", 5: "INVALID_SIZE"}
    assert refused[4][1] == "size must be between 1 and 100"
    assert {r.query_id: (r.query, r.size) for r in req.valid_requests(requests).collect()} == {6: ("a", 20), 7: ("a", 100)}


def test_statistics(index):
    stats = {r.term: (r.df, r.cf) for r in indexes.term_statistics(index).collect()}
    assert stats["raw"] == (4, 6) and stats["milk"] == (3, 3) and stats["2"] == (1, 1)
    totals = index.totals.first()
    assert totals.n_docs == 10 and math.isclose(totals.avg_len, 26 / 10)


def test_phrase_first_then_typo(spark, index, docs):
    assert run(spark, index, docs, "haddock raw")[0] == 1
    assert run(spark, index, docs, "chicken breast")[:2] == [6, 7]
    assert run(spark, index, docs, "hadock") == [5, 1]
    assert run(spark, index, docs, "ahddock") == [5, 1]
    assert run(spark, index, docs, "chicken bal")[0] == 8
    assert set(run(spark, index, docs, "mikl")) == {3, 4, 11}


def test_equal_scores_by_name_then_id(spark, index, docs):
    assert run(spark, index, docs, "whole") == [3, 11]
    assert run(spark, index, docs, "whole", size=1) == [3]


def test_nothing_left_finds_nothing(spark, index, docs):
    assert run(spark, index, docs, "++;;***") == []
    assert run(spark, index, docs, "zzzzzz") == []


def test_match_strategy_takes_text_as_given(spark, index, docs):
    assert set(run(spark, index, docs, "fish+chicken", strategy="match")) == {1, 2, 6, 7, 8, 10}
    with pytest.raises(ValueError):
        run(spark, index, docs, "a", strategy="other")


def test_scores_by_hand(spark, index, docs):
    requests = spark.createDataFrame([(1, "soup", None)], REQUEST)
    score = text_search.search(requests, index, docs).first().score
    idf = math.log(1 + (10 - 1 + 0.5) / 1.5)
    part = 2.2 * 1 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2.6))
    # One word is phrase, prefix and match at once.
    assert math.isclose(score, round((3 + 2 + 1) * idf * part, 6))


def test_phrase_counts_every_occurrence(spark, index):
    words = req.query_tokens(spark.createDataFrame([(1, "raw raw"), (2, "fish cod raw"), (3, "cod fish")], "query_id BIGINT, text STRING"))
    found = text_search.phrase_matches(text_search.phrase_slots(words, index), index)
    assert {(r.query_id, r.doc_id, r.freq) for r in found.collect()} == {(1, 10, 2), (2, 2, 1)}


def test_prefix_limit_is_in_term_order(spark):
    docs = spark.createDataFrame([(i, f"ab{i:03d}") for i in range(80)], "doc_id BIGINT, name STRING")
    terms = indexes.build_index(docs, "doc_id", "name").terms
    prefixes = spark.createDataFrame([("ab",), ("ab07",), ("zz",)], "prefix STRING")
    found = text_search.prefix_terms(prefixes, terms, 50)
    got = sorted(r.term for r in found.where("prefix = 'ab'").collect())
    assert got == [f"ab{i:03d}" for i in range(50)]
    assert found.where("prefix = 'ab07'").count() == 10
    assert text_search.prefix_terms(prefixes, terms, None).where("prefix = 'ab'").count() == 80


def test_sizes_up_to_a_hundred(spark):
    docs = spark.createDataFrame([(i, "same name") for i in range(150)], "doc_id BIGINT, name STRING")
    index = indexes.scratch_index(docs, "doc_id", "name")
    assert run(spark, index, docs, "same", size=100) == list(range(100))
    assert run(spark, index, docs, "name") == list(range(20))


def test_saved_index_reads_only_its_terms(spark, docs, tmp_path, capsys):
    saved = indexes.save_index(docs, "doc_id", "name", str(tmp_path / "index"))
    loaded = indexes.load_index(spark, str(tmp_path / "index"))
    assert [i.postings.agg(F.sum("tf")).first()[0] for i in (loaded, saved)] == [26, 26]
    assert run(spark, loaded, docs, "haddock raw")[0] == 1
    term = spark.createDataFrame([("cod",)], "term STRING")
    text_search._postings_of(loaded, term).explain()
    assert "dynamicpruning" in capsys.readouterr().out
    # A plan over the documents gives the same matches as tables on disk.
    plain = indexes.build_index(docs, "doc_id", "name")
    assert run(spark, plain, docs, "haddock raw") == run(spark, loaded, docs, "haddock raw")


def test_many_requests_at_once_equal_one_by_one(spark, index, docs):
    queries = ["fish", "milk whole", "raw fish", "chiken", "b"]
    requests = spark.createDataFrame([(i, q, 3) for i, q in enumerate(queries)], REQUEST)
    together = text_search.search(requests, index, docs).orderBy("query_id", "rank")
    got = {i: [] for i in range(len(queries))}
    for r in together.collect():
        got[r.query_id].append(r.doc_id)
    assert got == {i: run(spark, index, docs, q, 3) for i, q in enumerate(queries)}
    assert together.agg(F.max("rank")).first()[0] == 3


def test_frequent_terms_do_not_multiply_requests_by_documents(spark):
    """Every document holds the stop word; only those that can be ranked are scored."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("the the "), F.when(F.col("id") % 100 == 0, F.concat(F.lit("rare"), (F.col("id") % 500).cast("string"))).otherwise("other"), F.lit(" x"),
    ).alias("name"))
    index = indexes.scratch_index(docs, "doc_id", "name")
    requests = spark.createDataFrame([(i, f"the rare{i * 100}", 3) for i in range(5)], REQUEST)
    words = req.query_tokens(requests.select("query_id", F.col("query").alias("text")))
    weights = text_search.match_weights(words, index)
    none = spark.createDataFrame([], "query_id BIGINT, doc_id BIGINT, score DOUBLE")
    best = text_search.best_scores(weights, none, requests.select("query_id", "size"), index)
    whole = text_search.match_scores(weights, index).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    assert whole.count() == 5 * 3000 and best.count() <= 5 * 60
    ranked = [sorted((r.query_id, r.rank, r.doc_id, r.score) for r in text_search.rank_hits(s, requests, docs).collect()) for s in (best, whole)]
    assert ranked[0] == ranked[1] and len(ranked[0]) == 15


def test_an_absent_document_takes_no_place(spark, docs, index):
    left = docs.where("doc_id <> 3")
    requests = spark.createDataFrame([(1, "milk whole", 1)], REQUEST)
    assert [r.doc_id for r in text_search.search(requests, index, left, stale=True).collect()] == [11]


def test_a_size_out_of_range_is_refused(spark, docs, index):
    scores = spark.createDataFrame([(1, 3, 1.0)], "query_id BIGINT, doc_id BIGINT, score DOUBLE")
    requests = spark.createDataFrame([(1, 101)], "query_id BIGINT, size INT")
    with pytest.raises(Exception, match="out of range"):
        text_search.rank_hits(scores, requests, docs).collect()


@pytest.mark.parametrize("share", [1, 2, 1000])
def test_scores_by_parts_of_the_documents_are_those_of_all_rows(spark, index, docs, monkeypatch, share):
    """Whichever terms count as frequent, with other clauses, ties on the last place and a list that is not filled."""
    monkeypatch.setattr(text_search, "FREQUENT_SHARE", share)
    requests = spark.createDataFrame([(1, "milk whole", 1), (2, "raw fish raw", 2), (3, "soup", 9)], REQUEST)
    words = req.query_tokens(requests.select("query_id", F.col("query").alias("text")))
    weights = text_search.match_weights(words, index)
    # A word and the terms near it are kept once, however many requests ask for it.
    assert weights.near.columns == ["qterm", "term", "df", "weight"]
    others = spark.createDataFrame([(3, 7, 0.5), (1, 4, 50.0)], "query_id BIGINT, doc_id BIGINT, score DOUBLE")
    best = text_search.best_scores(weights, others, requests.select("query_id", "size"), index)
    whole = text_search.match_scores(weights, index).unionByName(others)
    ranked = [sorted((r.query_id, r.rank, r.doc_id, r.score) for r in text_search.rank_hits(s, requests, docs).collect()) for s in (best, whole)]
    assert ranked[0] == ranked[1] and {r[0] for r in ranked[0]} == {1, 2, 3}
    assert {r.doc_id for r in best.where("query_id = 1").collect()} == {4}


def test_parts_of_the_documents_follow_the_pairs_and_places(spark, index, docs, monkeypatch):
    """What one task adds up is bounded, so more rows give more parts, with the same results."""
    requests = spark.createDataFrame([(1, "whole milk", 2), (2, "milk", 3), (3, "raw fish", 2)], REQUEST)
    run_all = lambda: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in text_search.search(requests, index, docs).collect())
    plain = run_all()
    for name in ("PART_PAIRS", "PART_PLACES"):
        monkeypatch.setattr(text_search, name, 1)
    asked, original = [], text_search._parts
    monkeypatch.setattr(text_search, "_parts", lambda s, rows, each: asked.append((rows, original(s, rows, each))) or asked[-1][1])
    assert run_all() == plain and plain
    assert len(asked) >= 3 and all(parts == max(4, rows) for rows, parts in asked) and max(parts for _, parts in asked) > 4
    monkeypatch.setattr(text_search, "BROADCAST_KEYS", 0)
    assert run_all() == plain
